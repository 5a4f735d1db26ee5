"""Queries of the methods of protocols, designs, fitted models, masks, maps, regions and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import designs as D
from .operators import maps as G
from .queries import GRID, SECONDS, _grid, month, query, r, rounded, seconds

#: A protocol: every user is a run, every event lasts its value.
PROTOCOL = f"p AS (SELECT event_id, user_id, event_type AS c, {SECONDS} AS onset, {SECONDS} + value AS offset_ FROM events)"
#: A fitted model: suppliers are subjects, return flags predictors, line numbers voxels.
BETAS = "b AS (SELECT l_suppkey AS s, l_returnflag AS p, l_linenumber AS v, avg(l_extendedprice)/1000 AS beta FROM lineitem GROUP BY 1,2,3)"
#: Series by supplier and month.
SERIES = "s AS (SELECT l_suppkey AS k, year(l_shipdate)*12+month(l_shipdate) AS t, avg(l_quantity) AS x, avg(l_extendedprice)/1000 AS y FROM lineitem GROUP BY 1,2)"


def _protocol(t) -> DataFrame:
    return t("events").select("event_id", "user_id", F.col("event_type").alias("c"), seconds().alias("onset"), (seconds() + F.col("value")).alias("offset_"))


def _betas(t) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_linenumber").alias("v")).agg((S.steady_mean("l_extendedprice") / 1000).alias("beta"))


def _series(t) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_suppkey").alias("k"), month().alias("t")).agg(F.avg("l_quantity").alias("x"), (F.avg("l_extendedprice") / 1000).alias("y"))


def _members(t) -> DataFrame:
    """Three regions on the grid; they overlap."""
    g = _grid(t).select("x", "y")
    return g.withColumn("region", F.explode(F.array(*[F.when((F.col("x") + k * F.col("y")) % 7 == k, k) for k in (1, 2, 3)]))).where("region is not null")


MEMBERS = "m AS (SELECT x, y, k AS region FROM g, (VALUES (1),(2),(3)) w(k) WHERE (x+k*y)%7=k)"


# --- protocols ---


@query("SELECT event_type AS c, count(*) AS n_events FROM events GROUP BY 1")
def condition_names(t):
    return D.condition_names(_protocol(t), "c")


@query(f"WITH {PROTOCOL} SELECT c, count(*) AS n, round(sum(offset_-onset),4)+0.0 AS total FROM (SELECT c, onset, offset_ FROM p UNION ALL SELECT 'rest', onset-5, onset FROM p WHERE c='view') GROUP BY 1")
def added_condition(t):
    p = _protocol(t)
    more = p.where("c = 'view'").withColumn("offset_", F.col("onset")).withColumn("onset", F.col("onset") - 5)
    return rounded(D.add_condition(p, more, "c", "rest").groupBy("c").agg(F.count("*").alias("n"), F.sum(F.col("offset_") - F.col("onset")).alias("total")), 4)


@query("SELECT l_orderkey, l_linenumber, (l_linenumber-1)*2000.0 AS onset, (l_linenumber+1)*2000.0 AS offset_ FROM lineitem")
def volumes_to_milliseconds(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("onset"), (F.col("l_linenumber") + 1).alias("offset_"))
    return D.to_milliseconds(d, "onset", "offset_", 2000.0)


@query(f"WITH {PROTOCOL} SELECT event_id, round(CASE WHEN c='click' THEN onset+12.5 ELSE offset_ END,6) AS offset_ FROM p")
def set_durations(t):
    return D.set_duration(_protocol(t), "onset", "offset_", 12.5, F.col("c") == "click").select("event_id", F.round("offset_", 6).alias("offset_"))


@query("SELECT event_id, round(greatest(value-20,0),6)+0.0 AS onset, round(value+3+greatest(-20,-value),6)+0.0 AS offset_ FROM events")
def shifted_onsets(t):
    d = t("events").select("event_id", F.col("value").alias("onset"), (F.col("value") + 3).alias("offset_"))
    return rounded(D.shift_onsets(d, "onset", "offset_", -20.0))


@query(f"""
WITH {PROTOCOL}, g AS (SELECT *, onset - lag(offset_) OVER (PARTITION BY user_id ORDER BY onset, offset_) AS gap FROM p),
m AS (SELECT event_id, onset, coalesce(sum(least(gap, 3600) - gap) OVER (PARTITION BY user_id ORDER BY onset, offset_ ROWS UNBOUNDED PRECEDING), 0) AS moved FROM g) SELECT event_id, round(onset+moved, 2) AS onset FROM m
""")
def remodelled_gaps(t):
    d = D.remodel_gaps(_protocol(t), ["user_id"], "onset", "offset_", F.least("gap", F.lit(3600.0)))
    return d.select("event_id", F.round("onset", 2).alias("onset"))


@query("SELECT event_id, event_type || '_T' || lpad(CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS VARCHAR), 3, '0') AS c FROM events")
def single_trials(t):
    p = _protocol(t).withColumn("at", F.struct("onset", "event_id"))
    return D.single_trials(p, ["user_id"], "c", "at").select("event_id", "c")


@query("""
WITH a AS (SELECT *, (event_id % 2147483647 * 31 + 104729) % 2147483647 AS x FROM events), b AS (SELECT *, (x*x+12345) % 2147483647 AS y FROM a), c AS (SELECT *, (y*y+67891) % 2147483647 AS z FROM b), d AS (SELECT *, (z*z+24680) % 2147483647 AS h FROM c),
i AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), j AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) AS i FROM d)
SELECT event_id, j.event_type AS c FROM i JOIN j ON i.user_id = j.user_id AND i.i = j.i
""")
def shuffled_labels(t):
    return D.shuffle_labels(_protocol(t), ["user_id"], "c", "event_id").select("event_id", "c")


# --- designs and series ---


@query(f"""
WITH {SERIES}, d AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY t) AS t FROM s), n AS (SELECT k, max(t) AS n FROM d GROUP BY 1)
SELECT d.k, d.t, round(cos(pi()*1*(2*d.t-1)/(2*n)),8)+0.0 AS filter_1, round(cos(pi()*2*(2*d.t-1)/(2*n)),8)+0.0 AS filter_2 FROM d JOIN n ON d.k=n.k
""")
def design_filters(t):
    from pyspark.sql import Window

    d = _series(t).withColumn("t", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    return rounded(D.add_cosines(d, ["k"], "t", 2), 8).select("k", "t", "filter_1", "filter_2")


@query(f"WITH {SERIES} SELECT k, t, round(coalesce(x*(y-avg(y) OVER w)/nullif(stddev_samp(y) OVER w,0),0),6)+0.0 AS ppi FROM s WINDOW w AS (PARTITION BY k)")
def interaction_regressor(t):
    return rounded(D.add_interaction(_series(t), ["k"], "y", "x")).select("k", "t", "ppi")


@query(f"WITH {SERIES}, m AS (SELECT k, regr_slope(y,x) b, avg(x) m FROM s GROUP BY 1) SELECT s.k, t, round(y-coalesce(b,0)*(x-m),5)+0.0 AS cleaned FROM s JOIN m ON s.k=m.k")
def regressed_out(t):
    return rounded(D.regress_out(_series(t), ["k"], "y", "x"), 5).select("k", "t", "cleaned")


@query(f"WITH {SERIES}, g AS (SELECT t, avg(y) AS mean FROM s GROUP BY 1) SELECT t, round(mean,6)+0.0 AS mean, round(100*mean/(SELECT avg(mean) FROM g),6)+0.0 AS psc FROM g")
def global_course(t):
    return rounded(D.global_course(_series(t), [], "t", "y"))


@query(f"WITH {SERIES}, g AS (SELECT t, avg(y) AS r FROM s GROUP BY 1), c AS (SELECT k, corr(y, r) AS r, count(*) AS n FROM s JOIN g ON s.t=g.t GROUP BY 1) SELECT k, round(r,6)+0.0 AS r, round(r*sqrt(n-2)/sqrt(1-r*r),5)+0.0 AS t, n-2 AS df FROM c")
def course_correlations(t):
    s = _series(t)
    return rounded(D.course_correlation(s, ["k"], "t", "y", s.groupBy("t").agg(F.avg("y").alias("g")), "g"), 6, t=5)


@query(f"WITH {SERIES} SELECT k, round(corr(x, y),6)+0.0 AS r, count(*) AS n FROM s GROUP BY 1")
def series_cross_correlation(t):
    s = _series(t)
    return rounded(D.cross_correlation(s.select("k", "t", F.col("x").alias("v")), s.select("k", "t", F.col("y").alias("v")), ["k"], "t", "v"))


@query(f"WITH {SERIES}, a AS (SELECT k, t%12 AS bin, avg(y) AS y FROM s GROUP BY 1,2) SELECT k, round(max(y),6)+0.0 AS peak, arg_min(bin, (-y, bin)) AS time_to_peak FROM a WHERE bin BETWEEN 2 AND 9 GROUP BY 1")
def average_peaks(t):
    a = _series(t).groupBy("k", (F.col("t") % 12).alias("bin")).agg(F.avg("y").alias("y"))
    return rounded(D.average_peak(a, ["k"], "bin", "y", 2, 9))


@query("SELECT l_linenumber, round(avg(l_quantity),6)+0.0 AS mean, round(stddev_samp(l_quantity),6)+0.0 AS sd, count(*) AS n FROM lineitem GROUP BY 1")
def combined_conditions(t):
    a = t("lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"), F.count("*").alias("n"))
    return rounded(D.combine_conditions(a, ["l_linenumber"], "m", "s", "n"))


@query("""
WITH a AS (SELECT l_linenumber, l_suppkey, avg(l_quantity) FILTER (year(l_shipdate) < 1995) AS a, avg(l_quantity) FILTER (year(l_shipdate) >= 1995) AS b FROM lineitem GROUP BY 1,2)
SELECT l_linenumber, round(corr(a,b),6)+0.0 AS r, count(*) AS n FROM a WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1
""")
def retest_reliability(t):
    return rounded(D.retest_reliability(t("lineitem"), "l_suppkey", ["l_linenumber"], F.year("l_shipdate") < 1995, "l_quantity"))


# --- fitted models ---


@query(f"WITH {BETAS} SELECT s, v, round(sum(CASE p WHEN 'A' THEN 1 WHEN 'R' THEN -1 END*beta),6)+0.0 AS contrast FROM b WHERE p IN ('A','R') GROUP BY 1,2 HAVING count(*)=2")
def contrast_maps(t):
    return rounded(D.contrast_maps(_betas(t), ["s", "v"], "p", "beta", {"A": 1, "R": -1}))


@query(f"WITH {BETAS} SELECT s, p, v%2 AS region, round(avg(beta),6)+0.0 AS beta, count(*) AS n_voxels FROM b GROUP BY 1,2,3")
def region_betas(t):
    b = _betas(t)
    members = b.select("v").distinct().withColumn("region", F.col("v") % 2)
    return rounded(D.region_betas(b, members, ["v"], ["s", "p", "region"], "beta"))


@query(f"""
WITH {BETAS}, c AS (SELECT s, v, sum(CASE p WHEN 'A' THEN 1 ELSE -1 END*beta) AS x FROM b WHERE p IN ('A','R') GROUP BY 1,2 HAVING count(*)=2), k AS (SELECT v, corr(x, s_acctbal) AS r, count(*) AS n FROM c JOIN supplier ON s=s_suppkey GROUP BY 1)
SELECT v, round(r,6)+0.0 AS r, round(r*sqrt(n-2)/sqrt(1-r*r),5)+0.0 AS t, n-2 AS df FROM k
""")
def second_level_correlation(t):
    c = D.contrast_maps(_betas(t), ["s", "v"], "p", "beta", {"A": 1, "R": -1})
    return rounded(D.second_level_correlation(c, ["v"], "s", "contrast", t("supplier").withColumnRenamed("s_suppkey", "s"), "s_acctbal"), 6, t=5)


@query(f"""
WITH {BETAS}, c AS (SELECT s, v, sum(CASE p WHEN 'A' THEN 1 ELSE -1 END*beta) AS x FROM b WHERE p IN ('A','R') GROUP BY 1,2 HAVING count(*)=2),
o AS (SELECT v, rank() OVER (PARTITION BY v ORDER BY x) + (count(*) OVER (PARTITION BY v, x) - 1)/2.0 AS rx, rank() OVER (PARTITION BY v ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY v, s_acctbal) - 1)/2.0 AS ry FROM c JOIN supplier ON s=s_suppkey),
k AS (SELECT v, corr(rx, ry) AS r, count(*) AS n FROM o GROUP BY 1) SELECT v, round(r,6)+0.0 AS r, round(r*sqrt(n-2)/sqrt(1-r*r),5)+0.0 AS t, n-2 AS df FROM k
""")
def second_level_rank_correlation(t):
    c = D.contrast_maps(_betas(t), ["s", "v"], "p", "beta", {"A": 1, "R": -1})
    return rounded(D.second_level_correlation(c, ["v"], "s", "contrast", t("supplier").withColumnRenamed("s_suppkey", "s"), "s_acctbal", True), 6, t=5)


@query(f"WITH {BETAS} SELECT x.s, x.p AS a, y.p AS b, round(corr(x.beta,y.beta),6)+0.0 AS r, count(*) AS n FROM b x JOIN b y ON x.s=y.s AND x.v=y.v AND x.p<y.p GROUP BY 1,2,3")
def region_condition_correlations(t):
    return rounded(D.region_condition_correlations(_betas(t), "s", ["v"], "p", "beta"))


@query(f"WITH {BETAS}, f AS (SELECT * FROM b WHERE s%3<2), g AS (SELECT s, p, v, -beta AS beta FROM b WHERE s%3>0) SELECT s, p, v, round(beta,6)+0.0 AS beta FROM (SELECT * FROM f UNION ALL SELECT * FROM g WHERE s NOT IN (SELECT s FROM f))")
def joined_models(t):
    b = _betas(t)
    return rounded(D.join_models(b.where("s % 3 < 2"), b.where("s % 3 > 0").withColumn("beta", -F.col("beta")), "s"))


@query(f"WITH {BETAS}, f AS (SELECT * FROM b WHERE s%3<2), g AS (SELECT s, p, v, -beta AS beta FROM b WHERE s%3>0) SELECT s, p, v, round(beta,6)+0.0 AS beta FROM (SELECT * FROM f WHERE s NOT IN (SELECT s FROM g) UNION ALL SELECT * FROM g WHERE s IN (SELECT s FROM f))")
def replaced_subjects(t):
    b = _betas(t)
    return rounded(D.replace_subjects(b.where("s % 3 < 2"), b.where("s % 3 > 0").withColumn("beta", -F.col("beta")), "s"))


@query(f"WITH {BETAS} SELECT s, p, v, round(beta,6)+0.0 AS beta FROM b WHERE p NOT IN ('N') AND s NOT IN (3, 5)")
def removed_entries(t):
    return rounded(D.without_subjects(D.without_predictors(_betas(t), "p", ["N"]), "s", [3, 5]))


@query(f"WITH {BETAS} SELECT s, array_to_string(list_sort(list(DISTINCT p)), ',') AS predictors, CAST(count(DISTINCT p) AS INTEGER) AS n FROM b GROUP BY 1")
def subject_predictors(t):
    return D.subject_predictors(_betas(t), "s", "p").withColumn("predictors", F.array_join("predictors", ","))


@query(f"WITH {BETAS} SELECT s, p, v, CASE p WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM b")
def reordered_predictors(t):
    return D.reorder_predictors(_betas(t), "p", ["R", "A"]).select("s", "p", "v", "place")


_CASE = "k AS (SELECT l_returnflag AS g, avg(l_quantity) mx, avg(l_extendedprice/1000) my, stddev_samp(l_quantity) sx, stddev_samp(l_extendedprice/1000) sy, corr(l_quantity,l_extendedprice/1000) rr, count(*) n FROM lineitem GROUP BY 1)"


@query(f"""
WITH {_CASE}, c AS (SELECT *, (60-mx)/sx-(20-my)/sy AS d, (1+rr)*(1-rr*rr) AS a, (1-rr)*(4*(n-1)*(n-1)+4*(1+rr)*(n-1)+(1+rr)*(5+rr)) AS b, -2*((60-mx)/sx-(20-my)/sy)^2*(n*(n-1.0)*(n-1.0)/(n+1)) AS c FROM k)
SELECT g AS l_returnflag, round(d/sqrt((2-2*rr)*((n+1)*1.0/n)),6)+0.0 AS difference_t, round((CASE WHEN d<0 THEN -1 ELSE 1 END)*sqrt((sqrt(b*b-4*a*c)-b)/(2*a)),4)+0.0 AS dissociation_t FROM c
""")
def single_case_differences(t):
    x, y = "l_quantity", (F.col("l_extendedprice") / 1000)
    k = t("lineitem").withColumn("y", y).groupBy("l_returnflag").agg(F.avg(x).alias("mx"), F.avg("y").alias("my"), F.stddev_samp(x).alias("sx"), F.stddev_samp("y").alias("sy"), F.corr(x, "y").alias("rr"), F.count("*").cast("double").alias("n"))
    args = (F.lit(60.0), F.lit(20.0), *(F.col(c) for c in ("mx", "my", "sx", "sy", "rr", "n")))
    return k.select("l_returnflag", r(D.case_difference(*args)).alias("difference_t"), r(D.case_dissociation(*args), 4).alias("dissociation_t"))


@query("SELECT p_partkey, round(CASE WHEN p_size>0 THEN 2.0::DOUBLE*2.3548200450309493::DOUBLE*100/99*sqrt(-1/(4*ln(p_size/60.0::DOUBLE))) ELSE 0 END,8)+0.0 AS width, round(exp(-1/((p_size/10.0::DOUBLE/1.1774100225154747::DOUBLE)^2)),8)+0.0 AS lag1, round(exp(-1/((p_size/10.0::DOUBLE/2/1.1774100225154747::DOUBLE)^2)),8)+0.0 AS lag2 FROM part")
def smoothness_and_lags(t):
    lags = D.kernel_to_lags(F.col("p_size") / 10.0, 2)
    return t("part").select("p_partkey", r(D.lag_to_kernel(F.col("p_size") / 60.0, 2.0, 100), 8).alias("width"), r(F.get(lags, 0), 8).alias("lag1"), r(F.get(lags, 1), 8).alias("lag2"))


# --- masks, maps and volumes ---


@query("SELECT c_custkey, round(CASE WHEN c_acctbal>=500 THEN c_acctbal ELSE 0 END,6)+0.0 AS above, c_acctbal<=-100 AS low, round(CASE WHEN abs(c_acctbal)>=200 THEN least(1,(abs(c_acctbal)-200)/4800)*sign(c_acctbal) ELSE 0 END,8)+0.0 AS colour FROM customer")
def flexible_masks(t):
    x = "c_acctbal"
    return t("customer").select("c_custkey", r(G.flexible_mask(x, 500.0)).alias("above"), G.flexible_mask(x, -100.0, -1, True).alias("low"), r(G.threshold_colour(x, 200.0, 5000.0), 8).alias("colour"))


@query(f"WITH {SERIES}, m AS (SELECT k, avg(y) AS mean FROM s GROUP BY 1) SELECT k, round(mean,6)+0.0 AS mean FROM m WHERE mean >= 0.98*(SELECT avg(mean) FROM m)")
def intensity_mask(t):
    return rounded(G.intensity_mask(_series(t), ["k"], "y", 0.98))


@query(f"WITH {GRID} SELECT x, y, round(v,6)+0.0 AS v, CASE WHEN abs(v-25)>=2 THEN 1 ELSE 0 END AS mask FROM g")
def mask_of_map(t):
    d = G.mask_of_map(_grid(t).withColumn("away", F.col("v") - 25), "away", 2.0).drop("away")
    return rounded(d)


@query(f"WITH {GRID} SELECT x, y, round(v,6)+0.0 AS v FROM g WHERE (x+y)%3=0")
def masked_map(t):
    g = _grid(t)
    return rounded(G.apply_mask(g, g.select("x", "y", F.when((F.col("x") + F.col("y")) % 3 == 0, 1).otherwise(0).alias("m")), ["x", "y"], "m"))


@query(f"WITH {BETAS} SELECT s, v, round(avg(beta),6)+0.0 AS beta, count(*) AS n_maps FROM b GROUP BY 1,2")
def combined_maps(t):
    return rounded(G.combine_maps(_betas(t), ["s", "v"], "beta"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 5 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS place FROM lineitem WHERE l_linenumber IN (5,2,3)")
def subset_of_maps(t):
    return G.subset_of_maps(t("lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", [5, 2, 3])


@query(f"WITH {GRID} SELECT x-4 AS x, y-10 AS y, round(v,6)+0.0 AS v FROM g WHERE x BETWEEN 4 AND 20 AND y BETWEEN 10 AND 15")
def framed_map(t):
    return rounded(G.frame(_grid(t), {"x": (4, 20), "y": (10, 15)}))


@query(f"WITH {GRID} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM g WHERE v > 27")
def least_box(t):
    return G.least_box(_grid(t).withColumn("v", F.when(F.col("v") > 27, F.col("v")).otherwise(0.0)), ["x", "y"], "v")


@query("SELECT c_custkey, round(225*(least(greatest(c_acctbal,0),5000)-0)/5000)+0.0 AS c_acctbal FROM customer")
def limited_values(t):
    return rounded(G.limit_values(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.0, 5000.0))


@query(f"WITH {GRID} SELECT y, round(v,6)+0.0 AS v FROM g WHERE x = 7")
def map_slice(t):
    return rounded(G.slice_of(_grid(t), "x", 7.0))


@query(f"WITH {BETAS} SELECT s, p, round(beta,6)+0.0 AS beta FROM b WHERE v = 3")
def one_volume(t):
    return rounded(G.volume(_betas(t), "v", 3).drop("v"))


@query("""
WITH s AS (SELECT CAST(l_suppkey%6 AS INTEGER) AS x, l_linenumber AS y, year(l_shipdate)*12+month(l_shipdate) AS t, avg(l_quantity) AS q FROM lineitem GROUP BY 1,2,3),
c AS (SELECT a.x, a.y, b.x AS u, b.y AS w, corr(a.q,b.q) AS r FROM s a JOIN s b ON a.t=b.t AND abs(a.x-b.x)+abs(a.y-b.y)=1 GROUP BY 1,2,3,4)
SELECT x, y, round(avg(r),6)+0.0 AS coherence, count(*) AS n FROM c WHERE r IS NOT NULL GROUP BY 1,2
""")
def local_coherence(t):
    s = t("lineitem").groupBy((F.col("l_suppkey") % 6).cast("int").alias("x"), F.col("l_linenumber").alias("y"), month().alias("t")).agg(F.avg("l_quantity").alias("q"))
    return rounded(G.local_coherence(s, ["x", "y"], "t", "q"))


@query(f"WITH {BETAS}, m AS (SELECT s, avg(beta) AS m FROM b WHERE v <= 2 GROUP BY 1) SELECT v, p, round(corr(beta, m),6)+0.0 AS r, count(*) AS n FROM b JOIN m ON b.s=m.s GROUP BY 1,2")
def region_map_correlation(t):
    b = _betas(t)
    members = b.where("v <= 2").select("v", "p").distinct()
    return rounded(G.time_course_of_map(b, "s", members, ["v", "p"], "beta"))


# --- regions and meshes ---


@query(f"WITH {GRID}, {MEMBERS} SELECT DISTINCT region FROM m")
def region_names(t):
    return G.region_names(_members(t), "region")


@query(f"WITH {GRID}, {MEMBERS} SELECT x, y, count(DISTINCT region) AS n_regions FROM m WHERE region IN (1,3) GROUP BY 1,2")
def region_voxels(t):
    return G.region_voxels(_members(t), ["x", "y"], "region", [1, 3])


@query(f"WITH {GRID}, {MEMBERS} SELECT x, y, CASE WHEN (x,y) IN (SELECT (x,y) FROM m) THEN 1 ELSE 0 END AS mask FROM g")
def region_mask(t):
    return G.region_mask(_members(t), _grid(t), ["x", "y"])


@query("SELECT p_partkey, 128.0-p_size AS x, 128.0-CAST(p_partkey%40 AS DOUBLE) AS y, 128.0-CAST(p_partkey%17 AS DOUBLE) AS z FROM part")
def system_coordinates(t):
    d = t("part").select("p_partkey", (F.col("p_partkey") % 17).alias("x"), F.col("p_size").alias("y"), (F.col("p_partkey") % 40).alias("z"))
    return G.system_coordinates(d, ["x", "y", "z"])


@query(f"""
WITH {GRID}, {MEMBERS}, c AS (SELECT region, avg(x) cx, avg(y) cy FROM m GROUP BY 1), d AS (SELECT m.*, round(sqrt((x-cx)^2+(y-cy)^2),9) AS distance FROM m JOIN c ON m.region=c.region)
SELECT region, x, y, round(distance,6)+0.0 AS distance, CAST(row_number() OVER (PARTITION BY region ORDER BY distance, x, y) AS INTEGER) AS place FROM d
""")
def sorted_voxels(t):
    return rounded(G.sorted_voxels(_members(t), "region", ["x", "y"])).select("region", "x", "y", "distance", "place")


@query(f"WITH {GRID}, {MEMBERS} SELECT c_custkey FROM customer WHERE (CAST(floor((abs(c_acctbal)/300)/1.0+0.5) AS BIGINT), CAST(floor((c_custkey%32)/1.0+0.5) AS BIGINT)) IN (SELECT (CAST(x AS BIGINT), CAST(y AS BIGINT)) FROM m)")
def points_in_mask(t):
    d = t("customer").select("c_custkey", (F.abs("c_acctbal") / 300).alias("x"), (F.col("c_custkey") % 32).alias("y"))
    return G.points_in_mask(d, _members(t), ["x", "y"], 1.0).select("c_custkey")


_EDGES = "e AS (SELECT DISTINCT least(a,b) AS a, greatest(a,b) AS b FROM (SELECT p_partkey%200 AS a, (p_partkey*7+p_size)%200 AS b FROM part) WHERE a<>b)"


def _edges(t) -> DataFrame:
    a, b = F.col("p_partkey") % 200, (F.col("p_partkey") * 7 + F.col("p_size")) % 200
    return t("part").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


@query(f"WITH {_EDGES}, w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), two AS (SELECT DISTINCT x.a, y.b FROM w x JOIN w y ON x.b=y.a WHERE x.a<>y.b) SELECT a AS vertex, b AS neighbour, 1 AS degree FROM w UNION ALL SELECT a, b, 2 FROM (SELECT * FROM two EXCEPT SELECT * FROM w)")
def neighbours_to_degree(t):
    return G.neighbours_to_degree(_edges(t), 2)


@query(f"WITH {_EDGES}, w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT s_suppkey AS k, s_acctbal/100 AS x, s_nationkey AS y FROM supplier) SELECT a AS k, round(avg(sqrt((p.x-q.x)^2+(p.y-q.y)^2)),6)+0.0 AS distance, count(*) AS n FROM w JOIN c p ON p.k=a JOIN c q ON q.k=b GROUP BY 1")
def vertex_density(t):
    c = t("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").alias("y"))
    return rounded(G.vertex_density(_edges(t), c, "k", ["x", "y"]))


@query("SELECT n_nationkey AS v, n_name AS name FROM nation UNION ALL SELECT r_regionkey + (SELECT max(n_nationkey) FROM nation) + 1, r_name FROM region")
def combined_meshes(t):
    a, b = t("nation").select(F.col("n_nationkey").alias("v"), F.col("n_name").alias("name")), t("region").select(F.col("r_regionkey").alias("v"), F.col("r_name").alias("name"))
    return G.combine_meshes(a, b, "v")


# --- series kernels, matrices and dumps ---

#: Every user's events in order, as one series.
ORDERED = "o AS (SELECT user_id AS k, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _event_series(t) -> DataFrame:
    from .operators import filters as X

    return X.as_series(t("events").select(F.col("user_id").alias("k"), "event_id", "value"), ["k"], "event_id", "value")


def _exploded(d: DataFrame) -> DataFrame:
    return rounded(d.select("k", F.posexplode("values").alias("i", "v")).withColumn("i", F.col("i") + 1))


@query(f"WITH {ORDERED} SELECT k, CAST((i-1)//4+1 AS INTEGER) AS i, round(avg(v),6)+0.0 AS v FROM o WHERE i <= n//4*4 GROUP BY 1,2")
def resampled_series(t):
    from .operators import filters as X

    return _exploded(X.resample(_event_series(t), 4))


@query(f"WITH {ORDERED} SELECT a.k, CAST(a.i AS INTEGER) AS i, round(coalesce(0.7*a.v+0.3*b.v, a.v),6)+0.0 AS v FROM o a LEFT JOIN o b ON a.k=b.k AND b.i=a.i+1")
def shifted_series(t):
    from .operators import filters as X

    return _exploded(X.shift(_event_series(t), 0.3))


@query(f"""
WITH {ORDERED}, d AS (SELECT *, v-lag(v) OVER w AS d, lead(v) OVER w - v AS e, lag(v) OVER w AS b, lead(v) OVER w AS a FROM o WINDOW w AS (PARTITION BY k ORDER BY i)), c AS (SELECT k, median(d) AS c FROM d GROUP BY 1), s AS (SELECT d.k, median(abs(d-c))/0.6745 AS s FROM d JOIN c ON d.k=c.k GROUP BY 1)
SELECT d.k, CAST(i AS INTEGER) AS i, round(CASE WHEN abs(d) > 1.5*s AND abs(e) > 1.5*s AND d*e < 0 THEN (a+b)/2 ELSE v END,6)+0.0 AS v FROM d JOIN s ON d.k=s.k
""")
def despiked_series(t):
    from .operators import filters as X

    return _exploded(X.despike(_event_series(t), 1.5))


@query(f"""
WITH {ORDERED}, q AS (SELECT k, i, v AS x, v*((i*7)%5) AS y FROM o), c AS (SELECT a.k, l.lag, corr(a.x, b.y) AS r, count(*) AS n FROM q a JOIN q b ON a.k=b.k JOIN (SELECT unnest(range(-3,4)) AS lag) l ON a.i = b.i + l.lag GROUP BY 1,2)
SELECT k, CAST(arg_min(lag, (-round(r,10), abs(lag), lag)) AS INTEGER) AS lag, round(max(r),6)+0.0 AS r FROM c WHERE n > 2 GROUP BY 1
""")
def best_lags(t):
    from .operators import filters as X

    d = _event_series(t).withColumn("other", F.transform("values", lambda v, i: v * (((i + 1) * 7) % 5)))
    return rounded(X.best_lag(d, "k", "values", "other", 3))


@query("""
WITH m AS (SELECT p_partkey, p_size+0.5 AS a, (p_partkey%7)+0.0 AS b, (p_partkey%5)+0.0 AS c, p_retailprice/100 AS d FROM part)
SELECT p_partkey, round(a*d-b*c,6)+0.0 AS determinant, round(d/(a*d-b*c),8)+0.0 AS inverse_11, round(a*b+b*d,6)+0.0 AS square_12, round(a*b+c*d,6)+0.0 AS gram_12 FROM m
""")
def matrix_columns(t):
    from .functions import matrices as X

    m = F.array(F.col("p_size") + 0.5, (F.col("p_partkey") % 7).cast("double"), (F.col("p_partkey") % 5).cast("double"), F.col("p_retailprice") / 100)
    d = t("part").select("p_partkey", m.alias("m"))
    return d.select("p_partkey", r(X.determinant("m")).alias("determinant"), r(F.get(X.inverse("m"), 0), 8).alias("inverse_11"), r(F.get(X.product("m", "m"), 1)).alias("square_12"), r(F.get(X.gram("m", F.lit(2)), 1)).alias("gram_12"))


@query("SELECT c_custkey, trim(regexp_replace(lower(hex(encode(c_mktsegment))), '(..)', '\\1 ', 'g')) AS hex, lpad(bin(c_nationkey), 8, '0') AS bits FROM customer")
def byte_dumps(t):
    from .functions import text as X

    return t("customer").select("c_custkey", X.hex_dump(F.encode("c_mktsegment", "UTF-8")).alias("hex"), X.bit_dump("c_nationkey").alias("bits"))


@query("SELECT p_partkey, round(exp(3.5*ln(0.2::DOUBLE)+2.5*ln(p_size)-0.2*p_size-lgamma(3.5)),10)+0.0 AS density FROM part")
def gamma_density(t):
    from .functions import dist as X

    return t("part").select("p_partkey", r(X.gamma_pdf(F.col("p_size").cast("double"), F.lit(3.5), F.lit(0.2)), 10).alias("density"))
