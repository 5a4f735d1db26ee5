"""The engine's own queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions import text as T
from .operators import aggregates as A
from .operators import clusters as C
from .operators import events as E
from .operators import joins as J
from .operators import robust as B
from .operators import sets as Z
from .operators import stats as M
from .operators import vectors as V
from .operators import windows as W
from .plans import formula as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table loader under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(S.col(x), digits) + F.lit(0.0)


def r_fast(x: str, digits: int) -> Column:
    """``r`` of a double that is not negative, by the arithmetic of the SQL's round (ties up) and without a decimal number for each row."""
    t = F.col(x) * F.lit(10.0**digits)
    return (F.rint(t) + F.when(t - F.rint(t) == 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def rounded(data: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """All double columns rounded."""
    return data.select(*[r(c, more.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in data.dtypes])


def seconds(c: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp without a zone."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


SECONDS = "(epoch_us(ts) / 1e6)"


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def month() -> Column:
    return F.year("l_shipdate") * 12 + F.month("l_shipdate")


# --- the flagship: series, percent change, slopes, second-level t ---


@query("""
WITH series AS (SELECT l_suppkey, l_returnflag, year(l_shipdate)*12+month(l_shipdate) AS m, sum(l_extendedprice*(1-l_discount)) AS v FROM lineitem GROUP BY 1,2,3),
psc AS (SELECT *, 100*v/avg(v) OVER (PARTITION BY l_suppkey, l_returnflag) AS p FROM series),
b AS (SELECT l_suppkey, l_returnflag, regr_slope(p, m) AS beta FROM psc GROUP BY 1,2)
SELECT l_suppkey, coalesce(round(sqrt(count(beta))*avg(beta)/nullif(stddev_samp(beta),0),6),0)+0.0 AS t, count(beta) AS n FROM b GROUP BY 1
""")
def second_level_t(t):
    series = t("lineitem").groupBy("l_suppkey", "l_returnflag", month().alias("m")).agg(F.sum(net()).alias("v"))
    psc = W.percent_change(series, ["l_suppkey", "l_returnflag"], "v")
    beta = psc.groupBy("l_suppkey", "l_returnflag").agg(F.regr_slope("psc", "m").alias("beta"))
    return rounded(M.one_sample_t(beta, ["l_suppkey"], "beta"))


# --- aggregates ---


@query("""
WITH s AS (SELECT l_linenumber AS k, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem)
SELECT CAST(i.i AS INTEGER) AS key, round(coalesce(sum(s.v),0),4)+0.0 AS total FROM range(1, 10) i(i) LEFT JOIN s ON s.k = i.i GROUP BY 1
""")
def conditional_sum(t):
    v = F.when(F.col("l_partkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return rounded(A.conditional_sum(t("lineitem"), 9, "l_linenumber", v), 4)


@query("SELECT CAST(floor((least(l_quantity, 40) - 5) / 2.5) + 1 AS INTEGER) AS bin1, count(*) AS n FROM lineitem WHERE l_quantity >= 5 GROUP BY 1")
def histogram_clamped(t):
    return A.histogram(t("lineitem"), [("l_quantity", 5, 40, 2.5)])


@query("""SELECT CAST(floor((least(l_quantity, 50) - 0) / 10) + 1 AS INTEGER) AS bin1, CAST(floor((least(l_extendedprice, 50000) - 0) / 10000) + 1 AS INTEGER) AS bin2,
round(sum(l_tax), 4)+0.0 AS n FROM lineitem WHERE l_quantity >= 0 AND l_extendedprice >= 0 GROUP BY 1, 2""")
def histogram_2d_weighted(t):
    return rounded(A.histogram(t("lineitem"), [("l_quantity", 0, 50, 10), ("l_extendedprice", 0, 50000, 10000)], "l_tax"), 4)


@query("""SELECT CAST(floor(1 + 10.0/45*(l_quantity-5)) AS INTEGER) AS bin1, CAST(floor(1 + 4.0/8*(l_linenumber*1.0-0)) AS INTEGER) AS bin2, count(*) AS n
FROM lineitem WHERE l_quantity BETWEEN 5 AND 50 AND l_linenumber BETWEEN 0 AND 8 GROUP BY 1, 2""")
def histogram_nd(t):
    return A.histogram_nd(t("lineitem"), [("l_quantity", 5, 50, 4.5), ("l_linenumber", 0, 8, 1.75)])


@query("""
WITH x AS (SELECT c_mktsegment AS g, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT g, round(avg(v),4)+0.0 AS mean, round(stddev_samp(v),4)+0.0 AS sd, round(var_samp(v)/1e6,6)+0.0 AS variance, round(count(v)/sum(1/v),4)+0.0 AS harmonic,
round(sqrt(avg(v*v)),4)+0.0 AS rms, count(v) AS n FROM x GROUP BY g
""")
def good_moments(t):
    v = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    d = t("customer").select(F.col("c_mktsegment").alias("g"), v.alias("v"))
    return d.groupBy("g").agg(r(A.good_mean("v"), 4).alias("mean"), r(A.good_sd("v"), 4).alias("sd"), r(A.safe_variance("v") / 1e6).alias("variance"), r(A.harmonic_mean("v"), 4).alias("harmonic"), r(A.root_mean_square("v"), 4).alias("rms"), F.count(S.good("v")).alias("n"))


@query("""
WITH m AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS mu, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT g, n, avg((l_extendedprice-mu)^2) AS m2, avg((l_extendedprice-mu)^3) AS m3, avg((l_extendedprice-mu)^4) AS m4 FROM lineitem JOIN m ON g = l_returnflag GROUP BY 1, 2)
SELECT g AS l_returnflag, round(m3/m2^1.5,6)+0.0 AS skew, round(m4/m2^2,6)+0.0 AS kurtosis, round(m3/m2^1.5*sqrt((n-1)/n)*n/(n-2),6)+0.0 AS skew_corrected,
round(((n+1)*(m4/m2^2)-3*(n-1))*(n-1)/((n-2)*(n-3))+3,6)+0.0 AS kurtosis_corrected FROM p
""")
def shape_moments(t):
    return rounded(A.shape(t("lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("""
SELECT event_type, round(min(value),6)+0.0 AS min, round(max(value),6)+0.0 AS max, round(avg(value),6)+0.0 AS mean,
(SELECT min(event_id) FROM events f WHERE f.event_type = e.event_type AND f.value = min(e.value)) AS min_pos,
(SELECT min(event_id) FROM events f WHERE f.event_type = e.event_type AND f.value = max(e.value)) AS max_pos, round(var_samp(value),6)+0.0 AS variance FROM events e GROUP BY event_type
""")
def min_max_mean(t):
    return rounded(A.min_max_mean(t("events"), ["event_type"], "value", "event_id"))


@query("SELECT o_orderpriority, CAST(sum(g*(g-1)//2) AS BIGINT) AS ties FROM (SELECT o_orderpriority, o_custkey, count(*) AS g FROM orders GROUP BY 1, 2) GROUP BY 1")
def tied_pairs(t):
    return A.ties(t("orders"), ["o_orderpriority"], "o_custkey")


@query("""
WITH e AS (SELECT event_type AS g, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1),
b AS (SELECT g, n, least(20-1, floor((value-lo)/(hi-lo)*20)) AS b, count(*) AS c FROM events JOIN e ON g = event_type GROUP BY 1, 2, 3)
SELECT g AS event_type, round(sum((c*1.0/n)*log2(c*1.0/n)),6)+0.0 AS entropy FROM b GROUP BY g
""")
def spatial_entropy(t):
    return rounded(A.spatial_entropy(t("events"), ["event_type"], "value", 20))


@query("""
SELECT o_orderkey, round((sum(o_totalprice) OVER w - o_totalprice)/(count(*) OVER w - 1), 3)+0.0 AS loo_mean FROM orders WINDOW w AS (PARTITION BY o_orderpriority)
""")
def leave_one_out_mean(t):
    d = A.leave_one_out(t("orders"), ["o_orderpriority"], "o_totalprice")
    return d.select("o_orderkey", r("loo_mean", 3).alias("loo_mean"))


@query("""
WITH s AS (SELECT l_returnflag AS g, l_quantity AS s, 1 + l_tax AS w FROM lineitem),
m AS (SELECT g, count(*) AS n, sum(w) AS w, sum(w*w) AS w2, sum(w*s)/sum(w) AS mu FROM s GROUP BY g)
SELECT m.g AS l_returnflag, m.n AS n, round(mu,6)+0.0 AS mean, round((sum(s.w*(s.s-mu)^2))/(m.w-m.w2/m.w),6)+0.0 AS variance,
round(sqrt(m.n/((m.n-1)*m.w*m.w)*sum((s.w*(s.s-mu))^2)),8)+0.0 AS se, round(m.w*m.w/m.w2-1,4)+0.0 AS df
FROM s JOIN m ON s.g = m.g GROUP BY m.g, m.n, mu, m.w, m.w2
""")
def weighted_tally(t):
    parts = A.tally(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", 1 + F.col("l_tax"))
    d = A.tally_statistics(A.merge_tallies(parts, ["l_returnflag"]))
    return d.select("l_returnflag", "n", r("mean").alias("mean"), r("variance").alias("variance"), r("se", 8).alias("se"), r("df", 4).alias("df"))


@query("""
WITH s AS (SELECT sum(l_quantity*l_quantity) qq, sum(l_tax*l_tax) tt, sum(l_discount*l_discount) dd, sum(l_quantity*l_tax) qt, sum(l_quantity*l_discount) qd, sum(l_tax*l_discount) td FROM lineitem)
SELECT a, b, round(c,6)+0.0 AS cosine FROM (SELECT unnest([{'a':'l_quantity','b':'l_quantity','c':1.0},{'a':'l_quantity','b':'l_tax','c':qt/sqrt(qq*tt)},{'a':'l_quantity','b':'l_discount','c':qd/sqrt(qq*dd)},
{'a':'l_tax','b':'l_tax','c':1.0},{'a':'l_tax','b':'l_discount','c':td/sqrt(tt*dd)},{'a':'l_discount','b':'l_discount','c':1.0}], recursive := true) FROM s)
""")
def orthogonality(t):
    return rounded(A.orthogonality(t("lineitem"), ["l_quantity", "l_tax", "l_discount"]))


@query("""
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS x FROM lineitem)
SELECT unnest(['l_quantity', 'l_extendedprice']) AS predictor, round(1/(1-x*x), 5)+0.0 AS vif FROM c
""")
def variance_inflation(t):
    return rounded(A.variance_inflation(t("lineitem"), ["l_quantity", "l_extendedprice"]), 5)


@query("""
WITH e AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), h AS (SELECT least(255, floor((l_extendedprice-lo)/(hi-lo)*256)) AS b, any_value(lo) lo, any_value(hi) hi, count(*) n, avg(l_extendedprice) m, var_pop(l_extendedprice)*count(*) v FROM lineitem, e GROUP BY 1),
c AS (SELECT x.b, x.lo, x.hi, y.b <= x.b AS up, sum(y.n) n, sum(y.n*y.m)/sum(y.n) mu FROM h x, h y GROUP BY 1,2,3,4), k AS (SELECT c.b, c.lo, c.hi, sum(v + n2*(m-mu)^2) AS cost FROM c JOIN (SELECT b AS b2, n AS n2, m, v FROM h) ON (b2 <= c.b) = c.up GROUP BY 1,2,3)
SELECT round(arg_min(lo+(b+1)*(hi-lo)/256, cost), 4)+0.0 AS threshold FROM k
""")
def otsu_threshold(t):
    return rounded(A.otsu_threshold(t("lineitem"), "l_extendedprice"), 4)


@query()
def robust_mean(t):
    return B.robust_mean(t("lineitem"), ["l_suppkey"], "l_extendedprice")


@query("SELECT p_brand, min(p_size) AS min_p_size, max(p_size) AS max_p_size, min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice FROM part GROUP BY 1")
def bounding_box(t):
    return A.bounding_box(t("part"), ["p_brand"], ["p_size", "p_retailprice"])


@query("""
WITH u AS (SELECT l_suppkey AS k, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag='A' GROUP BY 1 UNION ALL SELECT l_suppkey, avg(l_quantity) FROM lineitem WHERE l_returnflag='N' GROUP BY 1 UNION ALL SELECT l_suppkey, avg(l_quantity) FROM lineitem WHERE l_returnflag='R' GROUP BY 1)
SELECT k AS l_suppkey, round(avg(v),6)+0.0 AS mean, round(stddev_samp(v),6)+0.0 AS sd, count(v) AS n FROM u GROUP BY 1
""")
def average_maps(t):
    maps = [t("lineitem").where(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.avg("l_quantity").alias("v")) for f in "ANR"]
    return rounded(A.average_objects(maps, ["l_suppkey"], "v"))


# --- windows ---


@query("SELECT event_id, round((value-avg(value) OVER w)/stddev_samp(value) OVER w, 6)+0.0 AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def z_transform(t):
    return W.z_transform(t("events"), ["user_id"], "value").select("event_id", r("z").alias("z"))


@query("SELECT event_id, round(coalesce(100*value/nullif(avg(value) FILTER (event_type='click') OVER w,0),0), 5)+0.0 AS psc FROM events WINDOW w AS (PARTITION BY user_id)")
def percent_signal_change(t):
    return W.percent_change(t("events"), ["user_id"], "value", F.col("event_type") == "click").select("event_id", r("psc", 5).alias("psc"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def rank_transform(t):
    return W.rank_transform(t("lineitem"), ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", F.col("rank").cast("double").alias("rank"))


@query("SELECT c_custkey, round(0 + (c_acctbal-min(c_acctbal) OVER w)*255/(max(c_acctbal) OVER w-min(c_acctbal) OVER w), 5)+0.0 AS scaled FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def linear_scale(t):
    return W.linear_scale(t("customer"), ["c_mktsegment"], "c_acctbal", 255.0).select("c_custkey", r("scaled", 5).alias("scaled"))


@query("""
SELECT event_id, round(0.5*value + 0.3*coalesce(lag(value,1) OVER w,0) + 0.2*coalesce(lag(value,2) OVER w,0), 6)+0.0 AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def moving_sum(t):
    return W.moving_sum(t("events"), ["user_id"], "event_id", "value", [0.5, 0.3, 0.2]).select("event_id", r("moving").alias("moving"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6)+0.0 AS moving_avg FROM events")
def moving_average(t):
    return W.moving_average(t("events"), ["user_id"], "event_id", "value", 2, 2).select("event_id", r("moving_avg").alias("moving_avg"))


@query("""
SELECT user_id, round(corr(a,b),6)+0.0 AS r, count(*) AS n FROM (SELECT user_id, value AS a, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1
""")
def autocorrelation(t):
    return rounded(W.lagged_correlation(t("events"), ["user_id"], ["ts", "event_id"], "value"))


@query("SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice),3)+0.0 AS cov, round(corr(l_quantity, l_extendedprice),6)+0.0 AS r, count(*) AS n FROM lineitem GROUP BY 1")
def covariance(t):
    return rounded(W.covariance(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 6, cov=3)


def _winsorize_sql(passes: int, sd: float) -> str:
    """The passes written out: g1, g2 ... hold a group's mean and deviation after each."""
    sql = "WITH g1 AS (SELECT event_type k, count(value) n, avg(value) m, stddev_samp(value) s, count(value) >= 4 AS o, -1 AS last FROM events GROUP BY 1)"
    for i in range(1, passes):
        far = f"n >= 4 AND abs(value-m) > {sd}*s"
        sql += f""", p{i} AS (SELECT k, n, m, s, o, last, count(*) FILTER ({far}) AS c, avg(CASE WHEN {far} THEN m ELSE value END) AS m2, stddev_samp(CASE WHEN {far} THEN m ELSE value END) AS s2
FROM events JOIN g{i} ON event_type = k GROUP BY 1,2,3,4,5,6), g{i + 1} AS (SELECT k, n, CASE WHEN o AND c <> last THEN m2 ELSE m END AS m, CASE WHEN o AND c <> last THEN s2*sqrt(CASE WHEN c > 0 THEN (n-1)/greatest(n-c-1, 1) ELSE 1 END) ELSE s END AS s, o AND c <> last AS o, c AS last FROM p{i})"""
    return f"{sql} SELECT event_id, value, round(CASE WHEN n >= 4 AND abs(value-m) > {sd}*s THEN m ELSE value END, 6)+0.0 AS winsorized FROM events JOIN g{passes} ON event_type = k"


@query(_winsorize_sql(3, 1.5))
def winsorize(t):
    d = W.winsorize(t("events"), ["event_type"], "value", 1.5)
    return d.select("event_id", "value", r("winsorized").alias("winsorized"))


@query("""
SELECT l_suppkey, CAST(m AS INTEGER) AS m, round(v-regr_slope(v,m) OVER w*(m-avg(m) OVER w), 2)+0.0 AS detrended FROM (SELECT l_suppkey, year(l_shipdate)*12+month(l_shipdate) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1,2) WINDOW w AS (PARTITION BY l_suppkey)
""")
def detrend(t):
    d = t("lineitem").groupBy("l_suppkey", month().alias("m")).agg(F.sum("l_quantity").alias("v"))
    return W.detrend(d, ["l_suppkey"], "m", "v").select("l_suppkey", "m", r("detrended", 2).alias("detrended"))


@query("""
WITH p AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role AS after FROM conversations), n AS (SELECT before, after, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY 1,2)
SELECT before, after, n, round(n*1.0/sum(n) OVER (PARTITION BY before), 6)+0.0 AS p FROM n
""")
def state_transitions(t):
    return rounded(W.transitions(t("conversations"), ["conv_id"], ["turn"], "role"))


def _grid(t) -> DataFrame:
    return t("lineitem").groupBy((F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_suppkey") % 32).cast("int").alias("y")).agg(F.avg("l_quantity").alias("v"))


GRID = "g AS (SELECT CAST(l_partkey%32 AS INTEGER) AS x, CAST(l_suppkey%32 AS INTEGER) AS y, avg(l_quantity) AS v FROM lineitem GROUP BY 1,2)"


@query(f"""
WITH {GRID}
SELECT g.x, g.y, round(sqrt(coalesce((a.v-b.v)/2,0)^2 + coalesce((c.v-d.v)/2,0)^2), 5)+0.0 AS gradient FROM g LEFT JOIN g a ON a.x=g.x+1 AND a.y=g.y LEFT JOIN g b ON b.x=g.x-1 AND b.y=g.y
LEFT JOIN g c ON c.x=g.x AND c.y=g.y+1 LEFT JOIN g d ON d.x=g.x AND d.y=g.y-1
""")
def gradient_magnitude(t):
    return W.gradient_magnitude(_grid(t), ["x", "y"], "v").select("x", "y", r("gradient", 5).alias("gradient"))


@query("""
WITH b AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS block FROM events)
SELECT user_id, event_id, round(list_sum(block),5)+0.0 AS total FROM b WHERE len(block)=5
""")
def sliding_blocks(t):
    d = W.sliding_blocks(t("events"), ["user_id"], "event_id", "value", 5)
    return d.select("user_id", "event_id", r(F.aggregate("block", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""
WITH d AS (SELECT n_chars AS s, quality AS l FROM labels JOIN documents USING (doc_id)),
w AS (SELECT sum((SELECT count(*) FROM d q WHERE q.l=0 AND q.s<p.s) + 0.5*(SELECT count(*) FROM d q WHERE q.l=0 AND q.s=p.s)) AS w FROM d p WHERE p.l=1)
SELECT round(w/((SELECT count(*) FROM d WHERE l=1)*(SELECT count(*) FROM d WHERE l=0)),6)+0.0 AS auc, (SELECT count(*) FROM d WHERE l=1) AS n_pos, (SELECT count(*) FROM d WHERE l=0) AS n_neg FROM w
""")
def roc_area(t):
    d = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(W.auc(d.withColumn("g", F.lit(1)), ["g"], "n_chars", "quality").drop("g"))


@query("""
WITH d AS (SELECT o_custkey, o_orderkey AS i, o_totalprice AS x, o_orderdate AS y FROM orders),
p AS (SELECT a.o_custkey, sign(a.x-b.x)*sign(epoch_us(a.y)-epoch_us(b.y)) AS s FROM d a JOIN d b ON a.o_custkey=b.o_custkey AND a.i<b.i)
SELECT o_custkey, round(coalesce(sum(s)/nullif(count(*) FILTER (s<>0),0),0),6)+0.0 AS tau FROM p GROUP BY 1
""")
def kendall_tau(t):
    d = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    return rounded(W.kendall_tau(d, ["o_custkey"], "o_orderkey", "o_totalprice", "day").where("n > 1").select("o_custkey", "tau"))


@query("SELECT l_orderkey, min(l_linenumber) FILTER (l_discount<>0) AS first, max(l_linenumber) FILTER (l_discount<>0) AS last FROM lineitem GROUP BY 1")
def first_nonzero(t):
    return W.first_nonzero(t("lineitem"), ["l_orderkey"], "l_linenumber", "l_discount")


@query("SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS max_pos, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS min_pos FROM orders GROUP BY 1")
def extreme_positions(t):
    return W.extreme_positions(t("orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


def draw_sql(table: str, seed: int) -> str:
    """CTEs after which ``d`` is the table with the number h that ``scalars.drawn`` gives for event_id."""
    return f"""WITH a AS (SELECT *, (event_id % 2147483647 * 31 + {seed * 104729}) % 2147483647 AS x1 FROM {table}), a1 AS (SELECT *, (x1*x1+12345) % 2147483647 AS x2 FROM a),
a2 AS (SELECT *, (x2*x2+67891) % 2147483647 AS x3 FROM a1), d AS (SELECT *, (x3*x3+24680) % 2147483647 AS h FROM a2)"""


@query(draw_sql("events", 5) + " SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) AS INTEGER) AS place FROM d")
def shuffled_sequence(t):
    return W.shuffled(t("events"), ["user_id"], "event_id", 5).select("user_id", "event_id", "place")


# --- scalars ---


@query("""
SELECT p_partkey, round(CASE WHEN x >= 1100 THEN x ELSE 0 END, 4)+0.0 AS masked, round(greatest(least(x, 1500), 1000), 4)+0.0 AS clamped, x BETWEEN 1200 AND 1300 AS inside,
round(CASE WHEN abs(d)>=0.2 THEN least(1,(abs(d)-0.2)/0.6)*sign(d) ELSE 0 END, 6)+0.0 AS thresholded FROM (SELECT p_partkey, p_retailprice AS x, sin(p_partkey) AS d FROM part)
""")
def limits_and_thresholds(t):
    x, d = F.col("p_retailprice"), F.sin(F.col("p_partkey"))
    return t("part").select("p_partkey", r(S.mask_values(x, 1100.0, 1), 4).alias("masked"), r(S.clamp(x, 1000.0, 1500.0), 4).alias("clamped"), S.in_range(x, 1200, 1300).alias("inside"), r(S.threshold_map(d, 0.2, 0.8)).alias("thresholded"))


@query("""
WITH c AS (SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(a*sqrt((n-2)/(1-a*a)),5)+0.0 AS t, round(0.5*ln((1+b)/(1-b))*sqrt(n-3),6)+0.0 AS fisher, round(tanh(0.5*ln((1+b)/(1-b))),6)+0.0 AS back,
round((0.5*ln((1+a)/(1-a))-0.5*ln((1+b)/(1-b)))/sqrt(1/(n-3)+1/(n-3)),5)+0.0 AS z,
round(CASE WHEN sign(a)=sign(b) THEN sign(a)*least(abs(a),abs(b)) ELSE 0 END,6)+0.0 AS both, round((a*sqrt((n-2)/(1-a*a)))/sqrt((a*sqrt((n-2)/(1-a*a)))^2+n-2),6)+0.0 AS r FROM c
""")
def correlation_scalars(t):
    c = t("lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_extendedprice").alias("a"), F.corr("l_quantity", "l_tax").alias("b"), F.count("*").alias("n"))
    c = c.withColumn("t", S.correlation_t("a", "n"))
    return c.select("l_suppkey", r("t", 5).alias("t"), r(S.fisher_z("b", "n")).alias("fisher"), r(S.fisher_r(S.fisher_z("b"))).alias("back"), r(S.independent_correlations_z("a", "n", "b", "n"), 5).alias("z"), r(S.conjunction("a", "b")).alias("both"), r(S.t_correlation("t", "n")).alias("r"))


@query("""
SELECT s_suppkey, round(sqrt(x*x+y*y+z*z),6)+0.0 AS radius, round(atan2(y,x),6)+0.0 AS azimuth, round(atan2(z,sqrt(x*x+y*y)),6)+0.0 AS elevation,
round(CASE WHEN z<0 THEN 0.9688*y+0.042*z ELSE 0.9688*y+0.046*z END,6)+0.0 AS tal_y, round(CASE WHEN z<0 THEN -0.0485*y+0.839*z ELSE -0.0485*y+0.9189*z END,6)+0.0 AS tal_z
FROM (SELECT s_suppkey, 70*sin(s_suppkey) AS x, 100*cos(s_suppkey) AS y, 60*sin(2*s_suppkey) AS z FROM supplier)
""")
def coordinate_frames(t):
    k = F.col("s_suppkey")
    d = t("supplier").select("s_suppkey", (70 * F.sin(k)).alias("x"), (100 * F.cos(k)).alias("y"), (60 * F.sin(2 * k)).alias("z"))
    s, tal = S.spherical("x", "y", "z"), S.mni_to_talairach("x", "y", "z")
    return d.select("s_suppkey", r(s["r"]).alias("radius"), r(s["azimuth"]).alias("azimuth"), r(s["elevation"]).alias("elevation"), r(tal[1]).alias("tal_y"), r(tal[2]).alias("tal_z"))


@query("SELECT p_partkey, CAST(1 + (p_partkey%10) + (p_size%7)*10 AS BIGINT) AS idx, CAST((p_partkey%10)+1 AS BIGINT) AS s1, CAST((p_size%7)+1 AS BIGINT) AS s2 FROM part")
def linear_indices(t):
    d = t("part").select("p_partkey", S.linear_index([F.col("p_partkey") % 10 + 1, F.col("p_size") % 7 + 1], [10, 7]).alias("idx"))
    s1, s2 = S.subscripts("idx", [10, 7])
    return d.select("p_partkey", F.col("idx").cast("long").alias("idx"), s1.cast("long").alias("s1"), s2.cast("long").alias("s2"))


# --- expressions ---


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax)/2 * sqrt(abs(l_discount)) + greatest(l_quantity, l_tax, l_discount), 6)+0.0 AS value FROM lineitem")
def map_formula(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("m1"), F.col("l_tax").alias("m2"), F.col("l_discount").alias("m3"))
    return P.compute(d, "(#1 + #2) ./ 2 .* sqrt(abs($3)) + greatest(#1:3)").select("l_orderkey", "l_linenumber", r("value").alias("value"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size >= 10 AND p_size < 30 AND regexp_matches(lower(p_type), '^.*a.*$')) OR lower(p_brand) = lower('BRAND#12')")
def point_predicate(t):
    return P.select_points(t("part"), "($p_size >= 10 & $p_size < 30 & $p_type == '*A*') | $p_brand == 'BRAND#12'").select("p_partkey", "p_brand", "p_size")


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal),4)+0.0 AS m FROM customer WHERE c_acctbal > 0 AND c_name LIKE 'C%' GROUP BY c_mktsegment")
def struct_select(t):
    return rounded(P.select(t("customer"), "SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m WHERE c_acctbal > 0 AND c_name LIKE 'C%'", ["c_mktsegment"]), 4)


# --- joins ---


@query(f"""
WITH e AS (SELECT {SECONDS} AS onset, event_type, user_id FROM events), s AS (SELECT {SECONDS} AS t, value, user_id FROM events)
SELECT event_type AS condition, CAST(floor((t-onset)/3600) AS INTEGER) AS bin, count(*) AS n, round(avg(value),6)+0.0 AS mean FROM s JOIN e ON s.user_id=e.user_id AND t >= onset-43200 AND t < onset+43200 GROUP BY 1,2
""")
def event_window_counts(t):
    s = t("events").select(seconds().alias("t"), "value", "user_id")
    e = t("events").select(seconds().alias("onset"), F.col("event_type").alias("condition"), "user_id")
    return rounded(E.event_counts(s, e, ["user_id"], "condition", "t", "value", "onset", 43200.0, 43200.0, 3600.0))


@query(f"""
WITH e AS (SELECT {SECONDS} AS onset, event_type, user_id, event_id FROM events), s AS (SELECT {SECONDS} AS t, value, user_id FROM events),
j AS (SELECT event_id, event_type, CAST(floor((t-onset)/21600) AS INTEGER) AS bin, value, avg(value) FILTER (t-onset >= -43200 AND t-onset < 0) OVER (PARTITION BY event_id) AS b FROM s JOIN e ON s.user_id=e.user_id AND t >= onset-43200 AND t < onset+43200),
trial AS (SELECT event_id, event_type, bin, avg(value-b) AS v FROM j WHERE b IS NOT NULL GROUP BY 1,2,3)
SELECT event_type AS condition, bin, round(avg(v),6)+0.0 AS mean, round(stddev_samp(v),6)+0.0 AS sd, count(*) AS n, round(stddev_samp(v)/sqrt(count(*)),6)+0.0 AS se FROM trial GROUP BY 1,2
""")
def event_locked_average(t):
    s = t("events").select(seconds().alias("t"), "value", "user_id")
    e = t("events").select("event_id", seconds().alias("onset"), F.col("event_type").alias("condition"), "user_id")
    return rounded(E.event_average(s, e, ["user_id"], "condition", "t", "value", "onset", 43200.0, 43200.0, 21600.0, (-43200.0, 0.0)))


@query("""
SELECT a.s_suppkey, b.s_suppkey AS other_s_suppkey, round(sqrt((a.x-b.x)^2+(a.y-b.y)^2),5)+0.0 AS distance FROM (SELECT s_suppkey, s_acctbal/100 AS x, s_suppkey%17 AS y FROM supplier) a, (SELECT s_suppkey, s_acctbal/100 AS x, s_suppkey%17 AS y FROM supplier) b
WHERE (a.x-b.x)^2+(a.y-b.y)^2 <= 25
""")
def radius_join(t):
    d = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 17).alias("y"))
    return J.radius_join(d, d, ["x", "y"], 5.0).select("s_suppkey", "other_s_suppkey", r("distance", 5).alias("distance"))


@query("""
WITH p AS (SELECT c_custkey, c_acctbal/100 AS x, c_custkey%17 AS y FROM customer), q AS (SELECT s_suppkey, s_acctbal/100 AS x, s_suppkey%17 AS y FROM supplier),
d AS (SELECT c_custkey, s_suppkey, sqrt((p.x-q.x)^2+(p.y-q.y)^2) AS d FROM p, q WHERE (p.x-q.x)^2+(p.y-q.y)^2 <= 400)
SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d),5)+0.0 AS distance FROM d GROUP BY 1
""")
def nearest_point(t):
    p = t("customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 17).alias("y"))
    q = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 17).alias("y"))
    return rounded(J.nearest(p, "c_custkey", q, "s_suppkey", ["x", "y"], 20.0), 5)


@query("""
SELECT l.event_id, r.value AS last_value FROM events l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type='purchase' GROUP BY 1,2) r ON l.user_id=r.user_id AND l.ts>=r.ts
""")
def as_of_join(t):
    right = t("events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return J.as_of(t("events"), right, ["user_id"], "ts", ["last_value"], 86_400.0).select("event_id", "last_value")


@query("""
SELECT n.n_nationkey, coalesce(max(r.r_regionkey+1), 0) AS match FROM nation n LEFT JOIN (SELECT r_regionkey, upper(r_name) AS k FROM region UNION ALL SELECT 5+n_nationkey, n_name FROM nation WHERE n_nationkey%3=0) r ON lower(r.k)=lower(n.n_name) GROUP BY 1
""")
def list_match(t):
    other = t("region").select(F.upper("r_name").alias("n_name"), (F.col("r_regionkey") + 1).alias("pos")).union(t("nation").where("n_nationkey % 3 = 0").select("n_name", F.col("n_nationkey") + 6))
    return J.last_match(t("nation"), other, "n_name", "pos").select("n_nationkey", F.col("match"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type,'(?i)steel') THEN 3 WHEN regexp_matches(p_type,'(?i)^s') THEN 2 WHEN regexp_matches(p_type,'(?i)brass|tin') THEN 1 ELSE 0 END AS match FROM part")
def pattern_match(t):
    return J.pattern_match(t("part"), ["brass|tin", "^s", "steel"], "p_type").select("p_partkey", "match")


@query("SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<b.n_nationkey")
def key_pairs(t):
    return J.pairs_within(t("nation"), ["n_regionkey"], "n_nationkey")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus='F'), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus='O')
SELECT a.o_custkey, CAST(a.pos AS INTEGER) AS pos, a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM a JOIN b USING (o_custkey, pos)
""")
def positional_join(t):
    a = t("orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("first_key"))
    b = t("orders").where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("second_key"))
    return J.by_position(a, b, ["first_key"], ["second_key"], ["o_custkey"]).select("o_custkey", "pos", "first_key", "second_key")


@query("SELECT o_orderkey, n_name, r_name, c_custkey IS NOT NULL AND n_nationkey IS NOT NULL AND r_regionkey IS NOT NULL AS complete FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey<20) ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey")
def lookup_codes(t):
    d = J.lookup_all(t("orders"), [(t("customer"), "c_custkey", "o_custkey"), (t("nation").where("n_nationkey < 20"), "n_nationkey", "c_nationkey"), (t("region"), "r_regionkey", "n_regionkey")])
    return d.select("o_orderkey", "n_name", "r_name", "complete")


@query("""
SELECT coalesce(a.p_partkey,b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM part WHERE p_partkey%5<>0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey%7=0 THEN p_size+1 ELSE p_size END AS p_size FROM part WHERE p_partkey%3<>0) b ON a.p_partkey=b.p_partkey
WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size<>b.p_size
""")
def table_differences(t):
    a = t("part").where("p_partkey % 5 <> 0")
    b = t("part").where("p_partkey % 3 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return J.differences(a, b, ["p_partkey"], ["p_size"])


# --- sets ---


@query("""
WITH u AS (SELECT n_name AS v, 0 AS s, n_nationkey AS p FROM nation WHERE n_nationkey%2=0 UNION ALL SELECT n_name, 1, 100-n_nationkey FROM nation WHERE n_nationkey<15)
SELECT v AS n_name, arg_min(s, (s,p)) AS source, CAST(arg_min(p, (s,p)) AS BIGINT) AS place FROM u GROUP BY 1
""")
def ordered_union(t):
    a = t("nation").where("n_nationkey % 2 = 0").select("n_name", F.col("n_nationkey").alias("pos"))
    b = t("nation").where("n_nationkey < 15").select("n_name", (100 - F.col("n_nationkey")).alias("pos"))
    return Z.ordered_union(a, b, "n_name", "pos")


@query("SELECT n_nationkey AS key, n_name AS name, NULL AS balance FROM nation UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def append_rows(t):
    a = t("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return Z.append_rows(a, t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))


def _regions(t) -> DataFrame:
    return t("lineitem").select("l_returnflag", (F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 50).alias("y")).distinct()


REGIONS = "m AS (SELECT DISTINCT l_returnflag, l_partkey%200 AS x, l_suppkey%50 AS y FROM lineitem)"


@query(f"WITH {REGIONS} SELECT x, y FROM m WHERE l_returnflag='A' INTERSECT SELECT x, y FROM m WHERE l_returnflag='R'")
def region_intersect(t):
    return Z.intersect_regions(_regions(t), "l_returnflag", ["x", "y"], ["A", "R"])


@query(f"WITH {REGIONS} SELECT x, y FROM m WHERE l_returnflag='A' UNION SELECT x, y FROM m WHERE l_returnflag='R'")
def region_union(t):
    return Z.unite_regions(_regions(t), "l_returnflag", ["x", "y"], ["A", "R"])


@query(f"WITH {REGIONS} SELECT x, y FROM m WHERE l_returnflag='N' EXCEPT SELECT x, y FROM m WHERE l_returnflag IN ('A','R')")
def region_difference(t):
    return Z.subtract_regions(_regions(t), "l_returnflag", ["x", "y"], "N", ["A", "R"])


@query(f"WITH {REGIONS} SELECT x, y, count(*) AS n_regions FROM m GROUP BY 1,2 HAVING count(*) >= 2")
def region_overlap(t):
    return Z.overlap_regions(_regions(t), "l_returnflag", ["x", "y"], ["A", "N", "R"], 0.5)


@query(f"WITH {REGIONS} SELECT x, y FROM m WHERE l_returnflag='A' AND x BETWEEN 20 AND 120 AND y BETWEEN 5 AND 40 AND (x-70)^2+(y-20)^2 <= 900")
def region_restrict(t):
    d = _regions(t).where("l_returnflag = 'A'").select("x", "y")
    return Z.restrict_sphere(Z.restrict_box(d, ["x", "y"], [20, 5], [120, 40]), ["x", "y"], [70, 20], 30)


@query(f"""
WITH {GRID}, m AS (SELECT DISTINCT l_returnflag, CAST(l_partkey%32 AS INTEGER) AS x, CAST(l_suppkey%32 AS INTEGER) AS y FROM lineitem WHERE l_quantity > 45)
SELECT l_returnflag, round(avg(v),5)+0.0 AS mean, round(max(v),5)+0.0 AS peak, arg_min(x,(-v,x,y)) AS peak_x, arg_min(y,(-v,x,y)) AS peak_y, count(*) AS n FROM m JOIN g USING (x,y) GROUP BY 1
""")
def region_summary(t):
    m = t("lineitem").where("l_quantity > 45").select("l_returnflag", (F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_suppkey") % 32).cast("int").alias("y"))
    return rounded(Z.region_summary(m, "l_returnflag", ["x", "y"], _grid(t), "v"), 5)


# --- events ---


@query(f"""
WITH i AS (SELECT user_id, {SECONDS} AS s, {SECONDS}+3600*(1+event_id%12) AS e FROM events),
f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600 THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY s,e)=1 THEN 1 ELSE 0 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM f)
SELECT user_id, round(min(s),3)+0.0 AS s, round(max(e),3)+0.0 AS e, count(*) AS n FROM g GROUP BY user_id, g
""")
def merged_intervals(t):
    d = t("events").select("user_id", seconds().alias("s"), (seconds() + 3600 * (1 + F.col("event_id") % 12)).alias("e"))
    return rounded(E.merge_intervals(d, ["user_id"], "s", "e", 600.0), 3)


@query("SELECT CASE WHEN event_type IN ('click','view') THEN 'browse' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1")
def collapsed_conditions(t):
    return E.collapse_conditions(t("events"), "event_type", {"click": "browse", "view": "browse"}).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""
SELECT user_id, count(*) AS n, round(avg(d),3)+0.0 AS mean_interval, round(min(d),3)+0.0 AS least_interval FROM (SELECT user_id, {SECONDS}-lag({SECONDS}) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) WHERE d IS NOT NULL GROUP BY 1
""")
def event_intervals(t):
    return rounded(E.inter_event_intervals(t("events").select("user_id", seconds().alias("t")), ["user_id"], "t"), 3)


@query(f"""
WITH e AS (SELECT user_id, event_type, {SECONDS} AS a, {SECONDS}+1800+event_id%5*3600 AS b FROM events), x AS (SELECT *, unnest(range(CAST(floor(a/3600) AS BIGINT), CAST(floor((b-1e-9)/3600) AS BIGINT)+1)) AS t FROM e)
SELECT user_id, event_type, t, round(least(sum((least(b,(t+1)*3600)-greatest(a,t*3600))/3600),1),5)+0.0 AS value FROM x GROUP BY 1,2,3
""")
def box_design(t):
    d = t("events").select("user_id", "event_type", seconds().alias("a"), (seconds() + 1800 + F.col("event_id") % 5 * 3600).alias("b"))
    return rounded(E.box_design(d, ["user_id"], "event_type", "a", "b", 3600.0), 5)


@query("""
WITH s AS (SELECT l_suppkey, year(l_shipdate)*12+month(l_shipdate) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1,2), k AS (SELECT * FROM (VALUES (0,0.5),(1,0.3),(2,0.2)) k(d,w))
SELECT l_suppkey, CAST(m+d AS INTEGER) AS m, round(sum(v*w),4)+0.0 AS v FROM s, k GROUP BY 1,2
""")
def convolution(t):
    s = t("lineitem").groupBy("l_suppkey", month().alias("m")).agg(F.sum("l_quantity").alias("v"))
    return rounded(E.convolve(s, ["l_suppkey"], "m", "v", [0.5, 0.3, 0.2]), 4)


@query(f"""
WITH d AS (SELECT user_id, {SECONDS} AS t FROM events), f AS (SELECT *, CASE WHEN t-lag(t) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, round(min(t),3)+0.0 AS first, round(max(t),3)+0.0 AS last, count(*) AS n FROM g GROUP BY 1,2
""")
def event_sessions(t):
    return rounded(E.sessions(t("events").select("user_id", seconds().alias("t")), ["user_id"], "t", 21600.0), 3)


# --- statistics ---


@query("SELECT user_id, coalesce(round(sqrt(count(value))*avg(value)/nullif(stddev_samp(value),0),5),0)+0.0 AS t, count(value) AS n FROM events GROUP BY 1")
def one_sample_t(t):
    return rounded(M.one_sample_t(t("events"), ["user_id"], "value"), 5)


@query("""
WITH s AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag='A') m1, avg(l_quantity) FILTER (l_returnflag<>'A') m2, stddev_samp(l_quantity) FILTER (l_returnflag='A') s1, stddev_samp(l_quantity) FILTER (l_returnflag<>'A') s2, count(*) FILTER (l_returnflag='A') n1, count(*) FILTER (l_returnflag<>'A') n2 FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((m1-m2)/sqrt(s1*s1/n1+s2*s2/n2),5)+0.0 AS t, round((s1*s1/n1+s2*s2/n2)^2/((s1*s1/n1)^2/(n1-1)+(s2*s2/n2)^2/(n2-1)),4)+0.0 AS df, n1, n2 FROM s
""")
def two_sample_t(t):
    d = M.two_sample_t(t("lineitem"), ["l_suppkey"], "l_quantity", F.col("l_returnflag") == "A")
    return d.select("l_suppkey", r("t", 5).alias("t"), r("df", 4).alias("df"), "n1", "n2")


@query("SELECT event_type, round(sum(value/10-1)/sqrt(count(*)),5)+0.0 AS plain, round(sum((1+user_id%3)*(value/10-1))/sqrt(sum((1+user_id%3)*(1+user_id%3))),5)+0.0 AS weighted FROM events GROUP BY 1")
def stouffer_z(t):
    d = t("events").select("event_type", (F.col("value") / 10 - 1).alias("z"), (1 + F.col("user_id") % 3).alias("w"))
    return rounded(d.groupBy("event_type").agg(M.stouffer("z").alias("plain"), M.stouffer("z", "w").alias("weighted")), 5)


@query("""
WITH s AS (SELECT l_suppkey, regr_slope(l_extendedprice,l_quantity) b, regr_intercept(l_extendedprice,l_quantity) a, regr_sxx(l_extendedprice,l_quantity) sxx, regr_syy(l_extendedprice,l_quantity) syy, regr_sxy(l_extendedprice,l_quantity) sxy, count(*) n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(b,3)+0.0 AS slope, round(a,2)+0.0 AS intercept, round(sqrt((syy-sxy*sxy/sxx)/(n-2)),2)+0.0 AS se, round(b*sqrt(sxx)/sqrt((syy-sxy*sxy/sxx)/(n-2)),4)+0.0 AS t, n FROM s
""")
def simple_regression(t):
    return rounded(M.simple_regression(t("lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity"), 2, slope=3, t=4)


@query("""
WITH s AS (SELECT l_suppkey AS k, count(*) n, covar_samp(l_extendedprice,l_quantity) yq, covar_samp(l_extendedprice,l_tax) yt, var_samp(l_quantity) qq, var_samp(l_tax) tt, covar_samp(l_quantity,l_tax) qt, avg(l_extendedprice) my, avg(l_quantity) mq, avg(l_tax) mt, var_samp(l_extendedprice) yy FROM lineitem GROUP BY 1),
b AS (SELECT *, (yq*tt-yt*qt)/(qq*tt-qt*qt) AS bq, (yt*qq-yq*qt)/(qq*tt-qt*qt) AS bt FROM s), e AS (SELECT *, my-bq*mq-bt*mt AS b0, sqrt((n-1)*(yy-bq*yq-bt*yt)/(n-3)) AS se FROM b)
SELECT k AS l_suppkey, round(bq,2)+0.0 AS b_quantity, round(bt,1)+0.0 AS b_tax, round(b0,1)+0.0 AS b_0, round(se,2)+0.0 AS se, n, round(bq/(se*sqrt(tt/((n-1)*(qq*tt-qt*qt)))),3)+0.0 AS t FROM e
""")
def two_predictor_model(t):
    s = M.normal_equations(t("lineitem"), ["l_suppkey"], "l_extendedprice", ["l_quantity", "l_tax"])
    d = M.solve(s, ["l_suppkey"], ["l_quantity", "l_tax"], [1, 0, 0])
    return d.select("l_suppkey", r(F.get("betas", 0), 2).alias("b_quantity"), r(F.get("betas", 1), 1).alias("b_tax"), r(F.get("betas", 2), 1).alias("b_0"), r("se", 2).alias("se"), "n", r("t", 3).alias("t"))


@query("""
WITH x AS (SELECT l_suppkey AS k, l_extendedprice AS y, l_quantity AS x, 1+l_tax AS w FROM lineitem), s AS (SELECT k, sum(w) sw, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my FROM x GROUP BY 1)
SELECT x.k AS l_suppkey, round(sum(w*(x-mx)*(y-my))/sum(w*(x-mx)^2),2)+0.0 AS slope FROM x JOIN s ON x.k=s.k GROUP BY 1
""")
def weighted_regression(t):
    d = t("lineitem").withColumn("w", 1 + F.col("l_tax"))
    s = M.normal_equations(d, ["l_suppkey", "l_returnflag"], "l_extendedprice", ["l_quantity"], "w").drop("l_returnflag")
    out = M.solve(M.merge_equations(s, ["l_suppkey"]), ["l_suppkey"], ["l_quantity"])
    return out.select("l_suppkey", r(F.get("betas", 0), 2).alias("slope"))


@query("""
WITH s AS (SELECT l_suppkey AS k, count(*) n, covar_samp(l_extendedprice,l_quantity) yq, covar_samp(l_extendedprice,l_tax) yt, var_samp(l_quantity) qq, var_samp(l_tax) tt, covar_samp(l_quantity,l_tax) qt, var_samp(l_extendedprice) yy FROM lineitem GROUP BY 1),
e AS (SELECT *, yy-((yq*tt-yt*qt)*yq+(yt*qq-yq*qt)*yt)/(qq*tt-qt*qt) AS rf, yy-yq*yq/qq AS rr FROM s)
SELECT k AS l_suppkey, round((rr-rf)/(rf/(n-3)),4)+0.0 AS f, CAST(1 AS DOUBLE) AS df1, CAST(n-3 AS DOUBLE) AS df2 FROM e
""")
def nested_model_f(t):
    d, by = t("lineitem"), ["l_suppkey"]
    full = M.solve(M.normal_equations(d, by, "l_extendedprice", ["l_quantity", "l_tax"]), by, ["l_quantity", "l_tax"])
    small = M.solve(M.normal_equations(d, by, "l_extendedprice", ["l_quantity"]), by, ["l_quantity"])
    return rounded(M.model_comparison(full, small, by), 4)


@query("""
WITH c AS (SELECT l_suppkey, corr(l_extendedprice,l_quantity) xy, corr(l_extendedprice,l_tax) xz, corr(l_quantity,l_tax) yz, count(*) n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((xy-xz*yz)/sqrt((1-xz*xz)*(1-yz*yz)),6)+0.0 AS r, n FROM c
""")
def partial_correlation(t):
    return rounded(M.partial_correlation(t("lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", "l_tax"))


@query("""
WITH c AS (SELECT l_suppkey, corr(l_extendedprice,l_quantity) a, corr(l_extendedprice,l_tax) b, corr(l_quantity,l_tax) c, count(*) n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((a-b)*sqrt((n-1)*(1+c)/(2*(n-1)*1.0/(n-3)*(1-a*a-b*b-c*c+2*a*b*c)+((a+b)/2)^2*(1-c)^3)),4)+0.0 AS t, n-3 AS df FROM c
""")
def dependent_correlation_t(t):
    return rounded(M.dependent_correlation_t(t("lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", "l_tax"), 4)


@query("""
WITH b AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS b, count(*) AS w FROM lineitem WHERE NOT (l_suppkey%10=3 AND l_returnflag='A') GROUP BY 1,2)
SELECT l_suppkey, round(sum(w*b)/sum(w),6)+0.0 AS beta FROM b GROUP BY 1
""")
def combined_runs(t):
    b = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("b"), F.count("*").alias("w"))
    b = b.withColumn("b", F.when((F.col("l_suppkey") % 10 == 3) & (F.col("l_returnflag") == "A"), F.lit(float("nan"))).otherwise(F.col("b")))
    return rounded(M.combine_runs(b, ["l_suppkey"], "b", "w"))


@query("""
WITH b AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_suppkey%10=3 AND l_returnflag='A' THEN 0 ELSE avg(l_quantity) END AS b FROM lineitem GROUP BY 1,2), w AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 1 ELSE -2 END AS w FROM b)
SELECT l_suppkey, round(coalesce(sum(w*b) FILTER (w>0)/nullif(abs(sum(w) FILTER (w>0 AND b<>0)),0),0)+coalesce(sum(w*b) FILTER (w<0)/nullif(abs(sum(w) FILTER (w<0 AND b<>0)),0),0),6)+0.0 AS contrast FROM w GROUP BY 1
""")
def safe_contrast(t):
    b = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("b"))
    b = b.withColumn("b", F.when((F.col("l_suppkey") % 10 == 3) & (F.col("l_returnflag") == "A"), F.lit(None)).otherwise(F.col("b")))
    b = b.withColumn("w", F.when(F.col("l_returnflag") == "R", -2.0).otherwise(1.0))
    return rounded(M.safe_contrast(b, ["l_suppkey"], "w", "b"))


P_SQL = "t AS (SELECT event_type AS g, ((event_id*7919)%10007 + 0.5)/10007*((event_id*31)%97+1)/97 AS p FROM events)"


def _tests(t) -> DataFrame:
    i = F.col("event_id")
    return t("events").select(F.col("event_type").alias("g"), (((i * 7919) % 10007 + 0.5) / 10007 * ((i * 31) % 97 + 1) / 97).alias("p"))


@query(f"""
WITH {P_SQL}, r AS (SELECT g, p, rank() OVER (PARTITION BY g ORDER BY p) + count(*) OVER (PARTITION BY g, p) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM t)
SELECT g, CAST(level AS DOUBLE) AS level, round(coalesce(max(p) FILTER (p <= level*i/m), min(p)/2.001),8)+0.0 AS threshold FROM r, (VALUES (0.05),(0.2)) q(level) GROUP BY 1,2
""")
def fdr_last_crossing(t):
    return rounded(M.fdr_thresholds(_tests(t), ["g"], "p", [0.05, 0.2], 2), 8)


@query(f"""
WITH {P_SQL}, r AS (SELECT g, p, rank() OVER (PARTITION BY g ORDER BY p) + count(*) OVER (PARTITION BY g, p) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM t), l AS (SELECT *, p <= level*i/m/(ln(m)+0.5772) AS ok FROM r, (VALUES (0.2),(0.9)) q(level)),
b AS (SELECT g, level, min(p) FILTER (NOT ok) AS bad FROM l GROUP BY 1,2)
SELECT l.g, CAST(l.level AS DOUBLE) AS level, round(coalesce(max(p) FILTER (ok AND (bad IS NULL OR p < bad)), min(p)/2.001),8)+0.0 AS threshold FROM l JOIN b ON l.g=b.g AND l.level=b.level GROUP BY 1,2
""")
def fdr_first_crossing(t):
    return rounded(M.fdr_thresholds(_tests(t), ["g"], "p", [0.2, 0.9], 1), 8)


@query("""
WITH s AS (SELECT source, count(*) n, count(*) FILTER (quality=toxic) same, count(*) FILTER (quality=1) a1, count(*) FILTER (toxic=1) b1 FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1), c AS (SELECT *, (a1*b1+(n-a1)*(n-b1))*1.0/(n*n) AS e FROM s)
SELECT source, round((same*1.0/n-e)/nullif(1-e,0),6)+0.0 AS kappa, n FROM c
""")
def cohens_kappa(t):
    d = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return rounded(M.cohens_kappa(d, ["source"], "quality", "toxic"))


@query("""
WITH v AS (SELECT l_orderkey AS u, l_returnflag AS v FROM lineitem), c AS (SELECT u, v, count(*) c FROM v GROUP BY 1,2), m AS (SELECT u, sum(c) m, sum(c*(c-1)) same FROM c GROUP BY 1 HAVING sum(c)>1),
a AS (SELECT sum(same*1.0/(m-1)) o, sum(m) n FROM m), k AS (SELECT sum(k*(k-1)) e FROM (SELECT v, sum(c) k FROM c WHERE u IN (SELECT u FROM m) GROUP BY 1))
SELECT round(1-(n-o)*(n-1)/(n*(n-1.0)-e),6)+0.0 AS alpha, CAST(n AS BIGINT) AS n_values FROM a, k
""")
def krippendorff_alpha(t):
    return rounded(M.krippendorff_alpha(t("lineitem").withColumn("g", F.lit(0)), ["g"], "l_orderkey", "l_returnflag").drop("g"))


@query("""
WITH d AS (SELECT l_suppkey AS t, l_returnflag AS f, avg(l_extendedprice)/1000 AS x FROM lineitem GROUP BY 1,2), g AS (SELECT count(DISTINCT t) n, count(DISTINCT f) k, sum(x) s, sum(x*x) ss FROM d),
r AS (SELECT sum(s*s)/3.0 st FROM (SELECT t, sum(x) s FROM d GROUP BY 1)), c AS (SELECT sum(s*s/c) sr FROM (SELECT f, sum(x) s, count(*) c FROM d GROUP BY 1)),
z AS (SELECT n, k, (st-s*s/(n*k))/(n-1) bms, (ss-st)/(n*(k-1)) wms, (sr-s*s/(n*k))/(k-1) jms, (ss-st-(sr-s*s/(n*k)))/((n-1)*(k-1)) ems FROM g, r, c)
SELECT round((bms-wms)/(bms+(k-1)*wms),5)+0.0 AS icc1, round((bms-ems)/(bms+(k-1)*ems+k*(jms-ems)/n),5)+0.0 AS icc2, round((bms-ems)/(bms+(k-1)*ems),5)+0.0 AS icc3, n AS n_targets FROM z
""")
def intraclass_correlation(t):
    d = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg((F.avg("l_extendedprice") / 1000).alias("x"))
    return rounded(M.intraclass_correlation(d, "l_suppkey", "l_returnflag", "x"), 5)


@query("""
WITH g AS (SELECT c_mktsegment k, c_nationkey f, count(*) c, sum(c_acctbal) s, sum(c_acctbal*c_acctbal) ss FROM customer GROUP BY 1,2), t AS (SELECT k, count(*) l, sum(c) n, sum(s) s, sum(ss) ss, sum(s*s/c) b FROM g GROUP BY 1)
SELECT k AS c_mktsegment, round((b-s*s/n)/(l-1)/((ss-b)/(n-l)),5)+0.0 AS f, l-1 AS df1, CAST(n-l AS BIGINT) AS df2 FROM t
""")
def one_way_anova(t):
    return rounded(M.one_way_anova(t("customer"), ["c_mktsegment"], "c_nationkey", "c_acctbal"), 5)


@query("""
WITH m AS (SELECT avg(c_acctbal) mx, avg(c_nationkey) my, var_samp(c_acctbal) vx, var_samp(c_nationkey) vy, covar_samp(c_acctbal,c_nationkey) c FROM customer)
SELECT c_custkey, round((vy*(c_acctbal-mx)^2-2*c*(c_acctbal-mx)*(c_nationkey-my)+vx*(c_nationkey-my)^2)/(vx*vy-c*c),5)+0.0 AS d2 FROM customer, m
""")
def mahalanobis(t):
    return rounded(M.mahalanobis(t("customer"), "c_custkey", "c_acctbal", "c_nationkey"), 5)


@query("""
WITH s AS (SELECT l_returnflag, avg(l_quantity) cx, avg(l_linenumber) cy, var_samp(l_quantity) vx, var_samp(l_linenumber) vy, covar_samp(l_quantity,l_linenumber) c FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(cx,5)+0.0 AS cx, round(cy,5)+0.0 AS cy, round(sqrt((vx+vy)/2+sqrt(((vx-vy)/2)^2+c*c)),5)+0.0 AS major, round(sqrt((vx+vy)/2-sqrt(((vx-vy)/2)^2+c*c)),5)+0.0 AS minor, round(0.5*atan2(2*c,vx-vy),5)+0.0 AS angle FROM s
""")
def covariance_ellipse(t):
    return rounded(M.covariance_ellipse(t("lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber"), 5)


def _drawn_sql(samples: int, first: int) -> str:
    """A CTE ``d`` of event_type, b, value and the number u that ``stats.draws`` gives for every event and sample."""
    x = "(((event_id % 2147483647) * (event_id % 2147483647) + event_id // 2147483647 % 2147483647 * 7907 + 12345) % 2147483647 * 31 + b * 7919 + 104729) % 2147483647"
    return f"""WITH a AS (SELECT event_type, value, b, {x} AS x FROM events, range({first}, {samples + 1}) r(b)), a1 AS (SELECT *, (x*x+12345) % 2147483647 AS y FROM a),
a2 AS (SELECT *, (y*y+67891) % 2147483647 AS z FROM a1), d AS (SELECT event_type, b, value, ((z*z+24680) % 2147483647) / 2147483647.0::DOUBLE AS u FROM a2)"""


@query(f"""
{_drawn_sql(200, 1)}, m AS (SELECT event_type, b, sum(w*value)/sum(w) AS m FROM (SELECT *, CASE {" ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(map(float, M._POISSON)))} ELSE 7 END AS w FROM d) GROUP BY 1,2)
SELECT event_type, round(quantile_cont(m, 0.025), 6)+0.0 AS low, round(quantile_cont(m, 0.975), 6)+0.0 AS high, round(stddev_samp(m), 6)+0.0 AS se FROM m GROUP BY 1
""")
def bootstrap_interval(t):
    return rounded(M.bootstrap_mean(t("events"), ["event_type"], "event_id", "value"))


@query(f"""
{_drawn_sql(200, 0)}, m AS (SELECT event_type, b, sum((value-50)*(CASE WHEN b > 0 AND u < 0.5 THEN -1 ELSE 1 END)) AS m FROM d GROUP BY 1,2)
SELECT event_type, round(count(*) FILTER (abs(m) >= o*(1-1e-12))/count(*), 6)+0.0 AS p FROM m JOIN (SELECT event_type AS e, abs(m) AS o FROM m WHERE b = 0) ON event_type = e GROUP BY 1
""")
def sign_permutation(t):
    d = t("events").withColumn("v", F.col("value") - 50)
    return rounded(M.sign_permutation(d, ["event_type"], "event_id", "v", 200))


@query()
def robust_regression(t):
    return B.robust_regression(t("lineitem"), ["l_suppkey"], "l_extendedprice", ["l_quantity"])


@query(f"""
WITH e AS (SELECT user_id, ts, event_id, {SECONDS}/86400-19700 AS x, value AS y FROM events), f AS (SELECT user_id AS u, regr_slope(y,x) b, regr_intercept(y,x) a FROM e GROUP BY 1), z AS (SELECT e.*, y-a-b*x AS q FROM e JOIN f ON u=user_id),
l AS (SELECT *, lag(q) OVER w q1, lag(x) OVER w x1, lag(y) OVER w y1 FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id AS u, round(20*coalesce(corr(q,q1),0))/20 AS rho FROM l GROUP BY 1)
SELECT user_id, rho, round(regr_slope(y-rho*y1, x-rho*x1),4)+0.0 AS slope, count(*) AS n FROM l JOIN r ON u=user_id WHERE x1 IS NOT NULL GROUP BY 1,2
""")
def whitened_regression(t):
    d = t("events").withColumn("x", seconds() / 86400 - 19700)
    return rounded(M.whitened_regression(d, ["user_id"], ["ts", "event_id"], "value", "x"), 4)


@query("SELECT n_nationkey, round(CASE WHEN sign(a)=sign(b) AND greatest(abs(a),abs(b))>0 THEN sign(a)*least(greatest(abs(a),abs(b)),1) ELSE 1 END,6)+0.0 AS p FROM (SELECT n_nationkey, sin(n_nationkey) AS a, cos(n_nationkey)/2 AS b FROM nation)")
def conjunction_p(t):
    return t("nation").select("n_nationkey", r(S.conjunction_p(F.sin("n_nationkey"), F.cos("n_nationkey") / 2)).alias("p"))


@query("""
WITH m AS (SELECT c_mktsegment g, avg(c_acctbal) mu, stddev_samp(c_acctbal) sd, count(*) n FROM customer GROUP BY 1)
SELECT c_custkey, round((c_acctbal-mu)/(sd*sqrt((n+1)*1.0/n)),6)+0.0 AS t FROM customer JOIN m ON g=c_mktsegment
""")
def single_case_t(t):
    m = t("customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mu"), F.stddev_samp("c_acctbal").alias("sd"), F.count("*").alias("n"))
    return t("customer").join(m, "c_mktsegment").select("c_custkey", r(S.crawford_t("c_acctbal", "mu", "sd", "n")).alias("t"))


# --- grids ---


@query(f"""
WITH RECURSIVE {GRID}, c AS (SELECT x, y, v, x*32+y AS id FROM g WHERE v >= 26.0), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.x-b.x)+abs(a.y-b.y)=1),
reach AS (SELECT id AS root, id AS node FROM c UNION SELECT root, e.b FROM reach JOIN e ON e.a=node), lab AS (SELECT node AS id, min(root) AS cluster FROM reach GROUP BY 1)
SELECT count(*) AS size, round(max(v),5)+0.0 AS peak, arg_min(x,(-v,x,y)) AS peak_x, arg_min(y,(-v,x,y)) AS peak_y, round(avg(v),5)+0.0 AS mean, round(sum(x*v)/sum(v),5)+0.0 AS cog_x, round(sum(y*v)/sum(v),5)+0.0 AS cog_y FROM c JOIN lab USING (id) GROUP BY cluster HAVING count(*)>=2
""")
def cluster_table(t):
    return rounded(C.cluster_table(_grid(t), ["x", "y"], "v", 26.0, 2), 5)


@query(f"""
WITH {GRID} SELECT a.x, a.y, round(a.v,5)+0.0 AS v FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE greatest(abs(a.x-b.x),abs(a.y-b.y))=1 AND b.v>=a.v)
""")
def local_maxima(t):
    return rounded(C.local_maxima(_grid(t), ["x", "y"], "v", 2), 5)


@query(f"WITH {GRID}, c AS (SELECT x, y FROM g WHERE v>=27) SELECT DISTINCT x+dx AS x, y+dy AS y FROM c, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy)")
def dilate(t):
    return C.dilate(_grid(t).where("v >= 27"), ["x", "y"])


@query(f"WITH {GRID}, c AS (SELECT x, y FROM g WHERE v>=24) SELECT a.x, a.y FROM c a JOIN c b ON abs(a.x-b.x)+abs(a.y-b.y)=1 GROUP BY 1,2 HAVING count(*)=4")
def erode(t):
    return C.erode(_grid(t).where("v >= 24"), ["x", "y"])


@query(f"""
WITH {GRID}, k AS (SELECT * FROM (VALUES (-1,0.25),(0,0.5),(1,0.25)) k(d,w)), a AS (SELECT x+d AS x, y, sum(v*w)/sum(w) AS v FROM g, k GROUP BY 1,2), a2 AS (SELECT a.* FROM a JOIN g USING (x,y)),
b AS (SELECT x, y+d AS y, sum(v*w)/sum(w) AS v FROM a2, k GROUP BY 1,2) SELECT b.x, b.y, round(b.v,6)+0.0 AS v FROM b JOIN g USING (x,y)
""")
def smooth_map(t):
    return rounded(C.smooth(_grid(t), ["x", "y"], "v", [0.25, 0.5, 0.25]))


@query(f"""
WITH {GRID}, p AS (SELECT s_suppkey, 0.37*(s_suppkey%80) AS px, 0.53*(s_suppkey%50) AS py FROM supplier)
SELECT s_suppkey, round(sum((CASE WHEN x=floor(px) THEN 1-(px-floor(px)) ELSE px-floor(px) END)*(CASE WHEN y=floor(py) THEN 1-(py-floor(py)) ELSE py-floor(py) END)*v),6)+0.0 AS v FROM p JOIN g ON x BETWEEN floor(px) AND floor(px)+1 AND y BETWEEN floor(py) AND floor(py)+1 GROUP BY 1
""")
def interpolate_map(t):
    k = F.col("s_suppkey")
    return rounded(C.trilinear(_grid(t), ["x", "y"], "v", t("supplier").select("s_suppkey", (0.37 * (k % 80)).alias("x"), (0.53 * (k % 50)).alias("y")), "s_suppkey"))


# --- vectors ---


@query("SELECT q.vec_id AS query, e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]),5)+0.0 AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id%20=0) q")
def query_distances(t):
    e = t("embeddings")
    return V.distances_to(e, "vec_id", "embedding", e.where("vec_id % 20 = 0")).select("query", "vec_id", r_fast("distance", 5).alias("distance"))


@query("""
WITH p AS (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY 1,2)
SELECT x.label AS a, y.label AS b, round(1-corr(x.m,y.m),6)+0.0 AS dissimilarity FROM p x JOIN p y ON x.i=y.i AND x.label<y.label GROUP BY 1,2
""")
def class_dissimilarity(t):
    return rounded(V.class_dissimilarity(t("embeddings"), "label", "embedding"))


@query("""
WITH p AS (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY 1,2), m AS (SELECT label, list(m ORDER BY i) AS mean FROM p GROUP BY 1)
SELECT vec_id, arg_min(m.label, (list_distance(embedding::DOUBLE[], mean), m.label)) AS predicted FROM embeddings, m GROUP BY 1
""")
def nearest_class_mean(t):
    e = t("embeddings")
    return V.nearest_mean(e, "vec_id", "embedding", V.class_means(e, "label", "embedding"), "label")


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i FROM embeddings), s AS (SELECT label, i, avg(v) m, var_samp(v)+1e-9 s2, count(*) n FROM e WHERE vec_id%5<>0 GROUP BY 1,2),
l AS (SELECT vec_id, e.label, s.label AS k, sum(-0.5*ln(s2)-(v-m)*(v-m)/(2*s2))+ln(max(n)) AS ll FROM e JOIN s ON e.i=s.i WHERE vec_id%5=0 GROUP BY 1,2,3) SELECT vec_id, label, arg_max(k, (ll, k)) AS predicted FROM l GROUP BY 1,2
""")
def naive_bayes(t):
    return V.naive_bayes(t("embeddings"), "vec_id", "label", "embedding", F.col("vec_id") % 5 == 0)


@query()
def k_means(t):
    return V.k_means(t("embeddings"), "vec_id", "embedding", 8, 5)


# --- text ---


@query("""
SELECT p_partkey, len(string_split_regex(p_type, '[ ,]+')) AS n_parts, array_to_string(string_split_regex(p_type, '[ ,]+'), '|') || '|' AS glued, replace(replace(p_name, 'a', 'A'), 'e', 'E') AS replaced,
lpad(CAST(p_size AS VARCHAR), 5, '0') AS zeroed, CASE WHEN regexp_matches(regexp_replace(p_brand,'[^A-Za-z0-9_]','_','g'),'^[A-Za-z]') THEN regexp_replace(p_brand,'[^A-Za-z0-9_]','_','g') ELSE 'V_'||regexp_replace(p_brand,'[^A-Za-z0-9_]','_','g') END AS label,
CASE WHEN p_size=1 THEN '' ELSE 's' END AS plural FROM part
""")
def string_functions(t):
    parts = T.split("p_type", " ,", True)
    return t("part").select("p_partkey", F.size(parts).cast("long").alias("n_parts"), T.glue(parts, "|", True).alias("glued"), T.replace_all("p_name", [("a", "A"), ("e", "E")]).alias("replaced"), T.zero_filled("p_size", 5).alias("zeroed"), T.label("p_brand").alias("label"), T.plural("p_size").alias("plural"))


@query("SELECT doc_id, coalesce(string_split(text, chr(10))[2], '') AS second_line, array_to_string(list_transform(string_split_regex(trim(source, ' '), ' +'), lambda x: upper(x[1:1]) || x[2:]), '') AS camel FROM documents")
def text_lines(t):
    return t("documents").select("doc_id", T.line("text", 2).alias("second_line"), T.camel_case("source").alias("camel"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'tion')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '(?i)license|token')")
def text_search(t):
    return t("documents").where(F.col("text").rlike("(?i)license|token")).select("doc_id", F.regexp_count("text", F.lit("tion")).cast("long").alias("n"))


# --- grouping sets, sketches and reports ---


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity),2)+0.0 AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def factor_cube(t):
    return rounded(t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), 2)


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal,0.05),4)+0.0 AS low, round(quantile_cont(c_acctbal,0.5),4)+0.0 AS mid, round(quantile_cont(c_acctbal,0.95),4)+0.0 AS high FROM customer GROUP BY 1")
def percentiles(t):
    return rounded(t("customer").groupBy("c_mktsegment").agg(*[F.percentile("c_acctbal", F.lit(q)).alias(n) for q, n in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))]), 4)


@query("""
WITH d AS (SELECT o_orderpriority, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_orderpriority, o_orderkey, CAST(rn AS INTEGER) AS place FROM d WHERE rn<=5
""")
def top_trials(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("place", F.row_number().over(w)).where("place <= 5").select("o_orderpriority", "o_orderkey", "place")


# --- distributions and filters: numpy kernels, tested against known values ---


@query()
def map_p_values(t):
    from .functions import dist as D

    d = t("lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_extendedprice").alias("v"), F.count("*").alias("n"))
    d = d.withColumn("t", S.correlation_t("v", "n"))
    return d.select("l_suppkey", D.map_p("v", F.lit(2.0), F.col("n") - 2.0, F.lit(0.0)).alias("p_r"), D.t_two_tailed("t", F.col("n") - 2.0).alias("p_t"), D.normal_cdf("t").alias("cdf"))


_MONTHS = "s AS (SELECT l_suppkey AS k, year(l_shipdate)*12+month(l_shipdate) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1,2), o AS (SELECT k, m, v, row_number() OVER (PARTITION BY k ORDER BY m)-1 AS t, count(*) OVER (PARTITION BY k) AS n FROM s)"


@query(f"""
WITH {_MONTHS}, b AS (SELECT k, j, n, 2.0/n*sum(v*cos(pi()*(2*t+1)*j/(2*n))) AS b FROM o, range(1, 100) r(j) WHERE j <= floor(2*n/24.0) GROUP BY 1,2,3)
SELECT o.k AS l_suppkey, m, round(any_value(v)-sum(b*cos(pi()*(2*t+1)*j/(2*o.n))),6)+0.0 AS v FROM o JOIN b ON o.k=b.k GROUP BY 1,2
""")
def drift_filter(t):
    from .operators import filters as X

    s = t("lineitem").groupBy("l_suppkey", month().alias("m")).agg(F.sum("l_quantity").alias("v"))
    d = X.remove_drifts(X.as_series(s, ["l_suppkey"], "m", "v"), "cosine", 24)
    return rounded(d.select("l_suppkey", F.explode(F.arrays_zip("ts", "values")).alias("s")).select("l_suppkey", F.col("s.ts").alias("m"), F.col("s.values").alias("v")))


@query(f"""
WITH {_MONTHS}, p AS (SELECT k, i, t-i AS j, v-avg(v) OVER (PARTITION BY k, i) AS q FROM o, range(0, 2000, 16) r(i) WHERE t >= i AND t < i+32 AND i+32 <= n), w AS (SELECT j, 0.5-0.5*cos(2*pi()*j/32) AS w FROM range(0, 32) r(j)),
f AS (SELECT k, i, f, sum(q*w*cos(2*pi()*f*p.j/32)) AS re, sum(q*w*sin(2*pi()*f*p.j/32)) AS im FROM p JOIN w ON p.j=w.j, range(0, 17) r(f) GROUP BY 1,2,3)
SELECT k AS l_suppkey, CAST(f AS INTEGER) AS bin, round(avg(re*re+im*im)/(SELECT sum(w*w) FROM w),4)+0.0 AS power FROM f GROUP BY 1,2
""")
def power_spectrum(t):
    from .operators import filters as X

    s = t("lineitem").groupBy("l_suppkey", month().alias("m")).agg(F.sum("l_quantity").alias("v"))
    return rounded(X.power_spectrum(X.as_series(s, ["l_suppkey"], "m", "v"), ["l_suppkey"], 32), 4)


# --- streams: the same rows as a batch ---


def stream_query(sql: str | None = None):
    """Registers a function of the event stream."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .streaming import tallies

            return f(tallies, tallies.event_stream(spark, f"{sf_dir}/events.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@stream_query("""
WITH s AS (SELECT event_type AS g, value AS s, 1.0+user_id%3 AS w FROM events), m AS (SELECT g, count(*) n, sum(w) w, sum(w*w) w2, sum(w*s)/sum(w) mu FROM s GROUP BY 1)
SELECT m.g AS event_type, m.n, round(mu,6)+0.0 AS mean, round(sum(s.w*(s.s-mu)^2)/(m.w-m.w2/m.w),5)+0.0 AS variance FROM s JOIN m ON s.g=m.g GROUP BY m.g, m.n, mu, m.w, m.w2
""")
def stream_tally(x, events):
    d = x.running_tally(events.withColumn("w", 1.0 + F.col("user_id") % 3), ["event_type"], "value", "w")
    return x.collected(d, "complete", "tally").select("event_type", "n", r("mean").alias("mean"), r("variance", 5).alias("variance"))


@stream_query("SELECT CAST(epoch(time_bucket(INTERVAL 1 day, ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(avg(value),6)+0.0 AS mean FROM events GROUP BY 1,2")
def stream_tumbling(x, events):
    d = x.collected(x.tumbling(events, ["event_type"], "1 day", "2 days"), "complete", "tumbling")
    return d.select(F.unix_timestamp("start").alias("day"), "event_type", "n", r("mean").alias("mean"))


@stream_query("SELECT CAST(epoch(time_bucket(INTERVAL 6 hour, ts)) - k*21600 AS BIGINT) AS start, event_type, count(*) AS n, round(max(value),6)+0.0 AS max FROM events, range(0,4) r(k) GROUP BY 1,2")
def stream_sliding(x, events):
    d = x.collected(x.sliding(events, ["event_type"], "1 day", "6 hours", "2 days"), "complete", "sliding")
    return d.select(F.unix_timestamp("start").alias("start"), "event_type", "n", r("max").alias("max"))


@stream_query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 hour THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM f)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, g
""")
def stream_sessions(x, events):
    d = x.collected(x.session_windows(events, ["user_id"], "6 hours", "2 days"), "complete", "sessions")
    return d.select("user_id", F.unix_micros("start").alias("start"), "n")


@stream_query("SELECT DISTINCT event_id FROM events")
def stream_distinct(x, events):
    return x.collected(x.distinct_events(events.union(events), "event_id", "60 days").select("event_id"), "append", "distinct")


@stream_query("""
SELECT before, after, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) WHERE before IS NOT NULL GROUP BY 1,2
""")
def stream_transitions(x, events):
    return x.collected(x.transitions(events), "append", "transitions").groupBy("before", "after").agg(F.count("*").alias("n"))


@stream_query("SELECT o.user_id, o.event_id AS onset_id, count(*) AS n, round(sum(s.value),6)+0.0 AS total FROM events o JOIN events s ON s.user_id=o.user_id AND s.ts >= o.ts - INTERVAL 2 hour AND s.ts <= o.ts + INTERVAL 6 hour WHERE o.event_type='purchase' GROUP BY 1,2")
def stream_onset_windows(x, events):
    d = x.onset_windows(events.where("event_type = 'purchase'"), events, ["user_id"], "2 HOURS", "6 HOURS", "60 days")
    return x.collected(d, "append", "windows").groupBy("user_id", "onset_id").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@stream_query("""
WITH e AS (SELECT user_id, event_type AS before, lead(event_type) OVER w AS after, ts, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT before, CASE WHEN next - ts <= INTERVAL 12 hour THEN after END AS after, count(*) AS n FROM e WHERE next IS NOT NULL GROUP BY 1,2
""")
def stream_visits(x, events):
    d = x.collected(x.expiring_transitions(events, 12 * 3600, "60 days"), "append", "visits")
    return d.groupBy("before", "after").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_methods, queries_models, queries_studies  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_methods, queries_models, queries_studies  # noqa: F401

    return dict(ORACLE)
