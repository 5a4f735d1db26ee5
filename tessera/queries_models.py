"""Queries of models over runs, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import anova as A
from .operators import clusters as C
from .operators import glm as G
from .operators import robust as B
from .operators import spatial as X
from .operators import studies as U
from .operators import trees as T
from .queries import GRID, _grid, query, r
from .queries_studies import FACES, _mesh
from .sources import ranges as R
from .store import shared_dir

#: Years are runs, suppliers keys, weeks times: the quantity shipped, 0 in a week without.
WEEK = "least((dayofyear({0})-1)//7, 51)"
SERIES = f"""
z AS (SELECT year(l_shipdate) AS r, l_suppkey AS k, {WEEK.format("l_shipdate")} AS t, sum(l_quantity) AS y FROM lineitem GROUP BY 1,2,3),
s AS (SELECT r, k, t, coalesce(y,0) AS y FROM (SELECT DISTINCT year(l_shipdate) AS r FROM lineitem) CROSS JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem) CROSS JOIN range(52) w(t) LEFT JOIN z USING (r,k,t))"""
#: Orders of a week by priority: urgent ones are missing in 1997, high ones in even years; a quadratic trend from 1998 on.
DESIGN = f"""
o AS (SELECT year(o_orderdate) AS r, {WEEK.format("o_orderdate")} AS t, o_orderpriority AS p FROM orders),
n AS (SELECT r, w.t, count(*) FILTER (p='1-URGENT' AND r<>1997 AND o.t=w.t)+0.0 AS x1, count(*) FILTER (p='2-HIGH' AND r%2=1 AND o.t=w.t)+0.0 AS x2, count(*) FILTER (p='5-LOW' AND o.t=w.t)+0.0 AS x3, CASE WHEN r>=1998 THEN w.t*w.t ELSE 0 END+0.0 AS q FROM o, range(52) w(t) GROUP BY 1,2)"""


def cleared(table: str, columns: list[str], name: str) -> str:
    """Steps that clear columns of a constant, the trend t and (where there is one) q, run by run: t1, q2 and the columns with a 0 before them."""
    w = "OVER (PARTITION BY r)"
    return f"""
{name}1 AS (SELECT r, t, t-avg(t) {w} AS t1, q-avg(q) {w} AS q1, {", ".join(f"{c}-avg({c}) {w} AS {c}" for c in columns)} FROM {table}),
{name}2 AS (SELECT r, t, t1, q1-t1*sum(q1*t1) {w}/sum(t1*t1) {w} AS q2, {", ".join(f"{c}-t1*sum({c}*t1) {w}/sum(t1*t1) {w} AS {c}" for c in columns)} FROM {name}1),
{name} AS (SELECT r, t, t1, q2, {", ".join(f"{c}-coalesce(q2*sum({c}*q2) {w}/nullif(sum(q2*q2) {w},0),0) AS 0{c}" for c in columns)} FROM {name}2)""".replace(" AS 0", " AS c_")


def _week(c: str):
    return F.least(F.floor((F.dayofyear(c) - 1) / 7), F.lit(51)).cast("int")


def _series(t) -> DataFrame:
    z = t("lineitem").groupBy(F.year("l_shipdate").alias("r"), F.col("l_suppkey").alias("k"), _week("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("y"))
    runs = t("lineitem").select(F.year("l_shipdate").alias("r")).distinct().agg(F.collect_set("r").alias("rs"))
    keys = t("lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    full = keys.crossJoin(F.broadcast(runs)).select("k", F.explode("rs").alias("r")).select("k", "r", F.explode(F.sequence(F.lit(0), F.lit(51))).alias("t"))
    return full.join(z, ["r", "k", "t"], "left").select("r", "k", "t", F.coalesce("y", F.lit(0.0)).alias("y"))


def _design(t, predictors: dict, degree) -> DataFrame:
    """``predictors``: name -> (priority, the years that have it)."""
    o = t("orders").select(F.year("o_orderdate").alias("r"), _week("o_orderdate").alias("t"), F.col("o_orderpriority").alias("p"))
    parts = []
    for name, (priority, years) in predictors.items():
        n = o.where((F.col("p") == priority) & years).groupBy("r", "t").agg(F.count("*").cast("double").alias("value"))
        parts.append(n.select("r", "t", F.lit(name).alias("predictor"), "value", F.lit(False).alias("confound")))
    weeks = o.select("r").distinct().select("r", F.explode(F.sequence(F.lit(0), F.lit(51))).alias("t"))
    zero = weeks.select("r", "t", F.lit("none").alias("predictor"), F.lit(0.0).alias("value"), F.lit(True).alias("confound"))
    return G.with_trends(G.stacked([*parts, zero]), ["r"], "t", degree)


@query(f"""
WITH {SERIES}, {DESIGN}, {cleared("n", ["x1", "x2", "x3"], "c")},
m AS (SELECT sum(c_x1*c_x1) s11, sum(c_x1*c_x2) s12, sum(c_x1*c_x3) s13, sum(c_x2*c_x2) s22, sum(c_x2*c_x3) s23, sum(c_x3*c_x3) s33 FROM c),
i AS (SELECT *, s11*(s22*s33-s23*s23)-s12*(s12*s33-s23*s13)+s13*(s12*s23-s22*s13) AS det FROM m),
b AS (SELECT k, r, sum(c_x1*y) b1, sum(c_x2*y) b2, sum(c_x3*y) b3, var_pop(y)*52-sum(t1*y)^2/sum(t1*t1)-coalesce(sum(q2*y)^2/nullif(sum(q2*q2),0),0) AS v, 50-CASE WHEN r>=1998 THEN 1 ELSE 0 END AS d FROM s JOIN c USING (r,t) GROUP BY k, r),
g AS (SELECT k, sum(b1) b1, sum(b2) b2, sum(b3) b3, sum(v) v, sum(d)-3 AS d FROM b GROUP BY k),
f AS (SELECT k, v, d, b1, b2, b3, (s22*s33-s23*s23)/det i11, (s13*s23-s12*s33)/det i12, (s12*s23-s13*s22)/det i13, (s11*s33-s13*s13)/det i22, (s12*s13-s11*s23)/det i23, (s11*s22-s12*s12)/det i33 FROM g, i),
e AS (SELECT *, i11*b1+i12*b2+i13*b3 e1, i12*b1+i22*b2+i23*b3 e2, i13*b1+i23*b2+i33*b3 e3 FROM f),
w AS (SELECT *, sqrt((v-e1*b1-e2*b2-e3*b3)/d) AS se FROM e),
a AS (SELECT k, d, 'urgent' AS predictor, e1 AS beta, se*sqrt(i11) AS se FROM w UNION ALL SELECT k, d, 'high', e2, se*sqrt(i22) FROM w UNION ALL SELECT k, d, 'low', e3, se*sqrt(i33) FROM w UNION ALL SELECT k, d, 'urgent > low', e1-e3, se*sqrt(i11+i33-2*i13) FROM w)
SELECT k, predictor, round(beta,5)+0.0 AS beta, round(se,5)+0.0 AS se, round(beta/se,4)+0.0 AS t, d::DOUBLE AS df FROM a
""")
def glm_fixed_effects(t):
    """One model over seven runs with unequal predictors and confounds."""
    p = {"urgent": ("1-URGENT", F.col("r") != 1997), "high": ("2-HIGH", F.col("r") % 2 == 1), "low": ("5-LOW", F.lit(True))}
    names = G.Names(["r"], ["k"], "t", list(p))
    d = G.fixed_effects(_series(t), _design(t, p, F.when(F.col("r") >= 1998, 2).otherwise(1)), names, "y", {"urgent > low": [1, 0, -1]})
    return d.select("k", "predictor", r("beta", 5).alias("beta"), r("se", 5).alias("se"), r("t", 4).alias("t"), "df")


@query(f"""
WITH {SERIES}, {DESIGN}, {cleared("n", ["x1", "x2"], "c")},
m AS (SELECT r, sum(c_x1*c_x1) s11, sum(c_x1*c_x2) s12, sum(c_x2*c_x2) s22 FROM c GROUP BY r),
b AS (SELECT k, r, sum(c_x1*y) b1, sum(c_x2*y) b2 FROM s JOIN c USING (r,t) GROUP BY k, r),
e AS (SELECT k, r, s11-coalesce(s12*s12/nullif(s22,0),0) AS w1, b1-coalesce(b2*s12/nullif(s22,0),0) AS n1, s22-coalesce(s12*s12/nullif(s11,0),0) AS w2, b2-coalesce(b1*s12/nullif(s11,0),0) AS n2 FROM b JOIN m USING (r))
SELECT r%3 AS subject, k, 'urgent' AS predictor, round(sum(n1)/sum(w1),5)+0.0 AS beta, count(*) AS runs FROM e WHERE w1>0 GROUP BY 1,2
UNION ALL SELECT r%3, k, 'high', round(sum(n2)/sum(w2),5)+0.0, count(*) FROM e WHERE w2>0 GROUP BY 1,2
""")
def glm_random_effects(t):
    """A model for each run; a subject's estimates are weighted over the runs that have the predictor."""
    p = {"urgent": ("1-URGENT", F.col("r") != 1997), "high": ("2-HIGH", F.col("r") % 2 == 1)}
    names = G.Names(["r"], ["k"], "t", list(p))
    d = G.run_effects(_series(t), _design(t, p, F.when(F.col("r") >= 1998, 2).otherwise(1)), names, "y")
    d = G.random_effects(d.withColumn("subject", F.col("r") % 3), ["subject"], ["k"])
    return d.select("subject", "k", "predictor", r("beta", 5).alias("beta"), "runs")


@query(f"""
WITH {SERIES}, {DESIGN}, p AS (SELECT r, t, x3 AS x, 0.0 AS q FROM n), {cleared("p", ["x"], "c")},
f AS (SELECT s.*, y-avg(y) OVER v-t1*sum(t1*y) OVER v/sum(t1*t1) OVER v-c_x*sum(c_x*y) OVER v/sum(c_x*c_x) OVER v AS e FROM s JOIN c USING (r,t) WINDOW v AS (PARTITION BY r, k)),
l AS (SELECT *, lag(e) OVER u AS e1, lag(e,2) OVER u AS e2, lag(y) OVER u AS y1, lag(y,2) OVER u AS y2 FROM f WINDOW u AS (PARTITION BY r, k ORDER BY t)),
h AS (SELECT r, k, CASE WHEN var_pop(e)>0 THEN coalesce(corr(e,e1),0) ELSE 0 END AS r1, CASE WHEN var_pop(e)>0 THEN coalesce(corr(e,e2),0) ELSE 0 END AS r2 FROM l GROUP BY 1,2),
a AS (SELECT r, k, round(20*r1*(1-r2)/(1-r1*r1))/20 AS a1, round(20*(r2-r1*r1)/(1-r1*r1))/20 AS a2 FROM h),
dl AS (SELECT r, t, x, lag(x) OVER u AS x1, lag(x,2) OVER u AS x2 FROM p WINDOW u AS (PARTITION BY r ORDER BY t)),
w AS (SELECT l.r, l.k, l.t, a1, a2, y-a1*y1-a2*y2 AS y, x-a1*x1-a2*x2 AS x, l.t-a1*(l.t-1)-a2*(l.t-2) AS z FROM l JOIN a USING (r,k) JOIN dl ON l.r=dl.r AND l.t=dl.t WHERE l.t>=2),
w1 AS (SELECT r, k, a1, a2, y-avg(y) OVER v AS y, x-avg(x) OVER v AS x, z-avg(z) OVER v AS z FROM w WINDOW v AS (PARTITION BY r, k)),
w2 AS (SELECT r, k, a1, a2, y-z*sum(y*z) OVER v/sum(z*z) OVER v AS y, x-z*sum(x*z) OVER v/sum(z*z) OVER v AS x FROM w1 WINDOW v AS (PARTITION BY r, k)),
g AS (SELECT r, k, a1, a2, sum(x*y)/sum(x*x) AS beta, sqrt(greatest(sum(y*y)-sum(x*y)^2/sum(x*x),0)/47)/sqrt(sum(x*x)) AS se FROM w2 GROUP BY 1,2,3,4)
SELECT r, k, a1+0.0 AS a1, a2+0.0 AS a2, round(beta,4)+0.0 AS beta, round(se,4)+0.0 AS se, round(coalesce(beta/nullif(se,0),0),3)+0.0 AS t FROM g
""")
def glm_autoregressive(t):
    """A model for each run whose errors follow two lags."""
    p = {"low": ("5-LOW", F.lit(True))}
    names = G.Names(["r"], ["k"], "t", list(p))
    d = G.run_effects(_series(t), _design(t, p, F.lit(1)), names, "y", order=2)
    return d.select("r", "k", r("a1", 2).alias("a1"), r("a2", 2).alias("a2"), r("beta", 4).alias("beta"), r("se", 4).alias("se"), r("t", 3).alias("t"))


#: Keys of a volume file: its array is built in one task, and its extents are numbers of 16 bits.
SPAN = 4096


def _header(key: tuple, shape: tuple) -> dict:
    box = {"XStart": 0, "XEnd": shape[1], "YStart": 0, "YEnd": shape[2], "ZStart": 0, "ZEnd": shape[3]}
    return {"FileVersion": 3, "NameOfSourceFMR": "", "NrOfLinkedPRTs": 0, "NrOfCurrentPRT": 0, "DataType": 2, "NrOfVolumes": shape[0], "Resolution": 1, **box, "Convention": 1, "ReferenceSpace": 3, "TR": 2000.0}


@query("""
WITH k AS (SELECT unnest(range(max(l_suppkey)+1)) AS x FROM lineitem), y AS (SELECT DISTINCT year(l_shipdate) AS r FROM lineitem)
SELECT r, x::INT AS x, count(*) FILTER (l_suppkey IS NOT NULL) > 0 AS shipped, coalesce(sum(l_quantity),0)+0.0 AS quantity FROM y CROSS JOIN k LEFT JOIN lineitem ON year(l_shipdate)=r AND l_suppkey=x AND month(l_shipdate) BETWEEN 4 AND 9 AND l_linenumber<=4 GROUP BY 1,2
""")
def volume_ranges(t):
    """Volume files for each year, one for every SPAN keys, are written from the table; a box of months and lines is read back by ranges."""
    d = t("lineitem").withColumn("r", F.year("l_shipdate"))
    n = int(d.agg(F.max("l_suppkey")).first()[0]) + 1
    k = F.col("l_suppkey")
    cells = d.where(k.isNotNull()).select("r", F.floor(k / SPAN).alias("block"), (F.month("l_shipdate") - 1).alias("t"), (k % SPAN).alias("x"), (F.col("l_linenumber") - 1).alias("y"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("z"), F.col("l_quantity").alias("value"))
    zero = F.lit(0).cast("int")
    every = d.select("r").distinct().crossJoin(F.broadcast(d.sparkSession.range(-(-n // SPAN)).withColumnRenamed("id", "block")))  # blocks without a row in a year have a file, too
    cells = cells.unionByName(every.select("r", "block", zero.alias("t"), zero.cast("long").alias("x"), zero.alias("y"), zero.alias("z"), F.lit(0.0).alias("value")))
    folder = f"{shared_dir(d.sparkSession)}/tables/volumes-{uuid.uuid4().hex}"
    sums = cells.groupBy("r", "block", "t", "x", "y", "z").agg(F.sum("value").alias("value"))
    R.write_cells(sums, ["r", "block"], "vtc", _header, (12, min(n, SPAN), 7, 3), folder)
    box = R.read_cells(d.sparkSession, folder, "vtc", {"t": (3, 9), "y": (0, 4)})
    part = [F.regexp_extract("path", r"(\d+)-(\d+)\.vtc$", g).cast("int") for g in (1, 2)]
    box = box.select(part[0].alias("r"), (part[1] * SPAN + F.col("x")).alias("x"), "value").where(F.col("x") < n)
    return box.groupBy("r", "x").agg((F.max("value") > 0).alias("shipped"), F.sum("value").alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, round(median(l_extendedprice),6)+0.0 AS median, count(*) AS n FROM lineitem GROUP BY 1,2")
def exact_medians(t):
    """Groups of any size: their medians by narrowing histograms."""
    d = B.medians(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", gather=1_000)
    return d.select("l_returnflag", "l_linestatus", r("median").alias("median"), "n")


@query(f"""
WITH RECURSIVE {GRID}, u AS (SELECT a.x, a.y, a.v, arg_max((b.x, b.y), (b.v, -b.x, -b.y)) AS q FROM g a JOIN g b ON abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 GROUP BY 1,2,3),
n AS (SELECT x, y, q[1] AS px, q[2] AS py FROM u), w AS (SELECT x, y, px, py FROM n UNION SELECT w.x, w.y, n.px, n.py FROM w JOIN n ON n.x=w.px AND n.y=w.py)
SELECT w.x, w.y, w.px AS peak_x, w.py AS peak_y FROM w JOIN n ON n.x=w.px AND n.y=w.py AND n.px=n.x AND n.py=n.y GROUP BY ALL
""")
def ascent_basins(t):
    """Every cell of a map with the peak that its steepest ascent leads to."""
    return C.basins(_grid(t), ["x", "y"], "v", 2).select("x", "y", "peak_x", "peak_y")


#: Flips by whole months: the draw of a subject and a flip, squares modulo a prime.
FLIPS = """
f AS (SELECT k, b, CASE WHEN b>0 AND u3/2147483647.0<0.5 THEN -1 ELSE 1 END AS sign FROM (SELECT k, b, (u2*u2+24680)%2147483647 AS u3 FROM (SELECT k, b, (u1*u1+67891)%2147483647 AS u2 FROM (SELECT k, b, (u0*u0+12345)%2147483647 AS u1 FROM (
SELECT DISTINCT k, b, ((k*k+12345)%2147483647*31+b*7919+104729)%2147483647 AS u0 FROM d, range(41) w(b))))))"""


@query(f"""
WITH RECURSIVE d AS (SELECT (year(l_shipdate)*12+month(l_shipdate))::BIGINT AS k, CAST(l_partkey%32 AS INTEGER) AS x, CAST(l_suppkey%32 AS INTEGER) AS y, avg(l_quantity)-25.5 AS v FROM lineitem GROUP BY 1,2,3), {FLIPS},
e AS (SELECT x, y, count(*) AS n, sum(v*v) AS ss FROM d GROUP BY 1,2), s AS (SELECT b, x, y, sum(v*sign) AS s FROM d JOIN f USING (k) GROUP BY 1,2,3),
c AS (SELECT b, x, y, x*32+y AS id FROM s JOIN e USING (x,y) WHERE n > 1 AND (s/n)/sqrt(nullif((ss-n*(s/n)^2)/(n-1)/n,0)) >= 1.5),
j AS (SELECT p.b, p.id AS a, q.id AS z FROM c p JOIN c q ON p.b=q.b AND abs(p.x-q.x)+abs(p.y-q.y)=1), reach AS (SELECT b, id AS root, id AS node FROM c UNION SELECT reach.b, root, j.z FROM reach JOIN j ON j.b=reach.b AND j.a=node),
l AS (SELECT b, node, min(root) AS cl FROM reach GROUP BY 1,2), z AS (SELECT b, cl, count(*) AS c FROM l GROUP BY 1,2)
SELECT w.b::INT AS b, coalesce(sum(c),0)::BIGINT AS cells, coalesce(max(c),0) AS largest FROM range(41) w(b) LEFT JOIN z ON z.b=w.b GROUP BY 1
""")
def flipped_clusters(t):
    """The null of the largest cluster under sign flips of months, all maps labelled at once."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    d = t("lineitem").groupBy(month.alias("k"), (F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_suppkey") % 32).cast("int").alias("y")).agg((F.avg("l_quantity") - 25.5).alias("v"))
    return C.flipped_clusters(d, "k", ["x", "y"], "v", 1.5, 40)


@query("""
WITH d AS (SELECT l_suppkey AS s, l_suppkey%3 AS g, l_returnflag AS a, l_linestatus AS b, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), c AS (SELECT s, g, a, b, v-(SELECT avg(v) FROM d) AS v FROM d),
u AS (SELECT (SELECT sum(v)^2/count(*) FROM c) u0, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY g)) ug, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY a)) ua, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY b)) ub,
(SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY g,a)) uga, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY g,b)) ugb, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY a,b)) uab, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY g,a,b)) ugab,
(SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY s)) us, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY s,a)) usa, (SELECT sum(q) FROM (SELECT sum(v)^2/count(*) q FROM c GROUP BY s,b)) usb, (SELECT sum(v*v) FROM c) usab,
(SELECT count(DISTINCT s) FROM c) ns, (SELECT count(DISTINCT g) FROM c) ng, (SELECT count(DISTINCT a) FROM c) na, (SELECT count(DISTINCT b) FROM c) nb),
e AS (SELECT ug-u0 AS g, ua-u0 AS a, ub-u0 AS b, uga-ug-ua+u0 AS ga, ugb-ug-ub+u0 AS gb, uab-ua-ub+u0 AS ab, ugab-uga-ugb-uab+ug+ua+ub-u0 AS gab, us-ug AS es, usa-us-uga+ug AS ea, usb-us-ugb+ug AS eb, usab-usa-usb+us-ugab+uga+ugb-ug AS eab, ns-ng AS fs, ng-1 AS fg, na-1 AS fa, nb-1 AS fb FROM u),
r AS (SELECT unnest([{'effect':'g','ss':g,'df':fg,'es':es,'ed':fs},{'effect':'a','ss':a,'df':fa,'es':ea,'ed':fs*fa},{'effect':'b','ss':b,'df':fb,'es':eb,'ed':fs*fb},{'effect':'g:a','ss':ga,'df':fg*fa,'es':ea,'ed':fs*fa},{'effect':'g:b','ss':gb,'df':fg*fb,'es':eb,'ed':fs*fb},{'effect':'a:b','ss':ab,'df':fa*fb,'es':eab,'ed':fs*fa*fb},{'effect':'g:a:b','ss':gab,'df':fg*fa*fb,'es':eab,'ed':fs*fa*fb}], recursive := true) FROM e)
SELECT effect, round(ss,6)+0.0 AS ss, df, round(es,6)+0.0 AS error_ss, ed AS error_df, round((ss/df)/(es/ed),6)+0.0 AS f FROM r
""")
def factorial_anova(t):
    """Two within factors and one between: all effects from one pass over grouping sets."""
    d = t("lineitem").groupBy(F.col("l_suppkey").alias("s"), (F.col("l_suppkey") % 3).alias("g"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.avg("l_quantity").alias("v"))
    d = A.factorial(d, "s", ["g"], ["a", "b"], "v")
    return d.select("effect", r("ss").alias("ss"), "df", r("error_ss").alias("error_ss"), "error_df", r("f").alias("f"))


@query("""
WITH RECURSIVE m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1,2),
e AS (SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.v-b.v)^2)),6) AS w FROM m a JOIN m b ON a.i=b.i AND a.label<b.label GROUP BY 1,2), n AS (SELECT row_number() OVER (ORDER BY w, a, b) AS id, * FROM e),
r AS (SELECT id, a AS node FROM n UNION SELECT r.id, CASE WHEN x.a=node THEN x.b ELSE x.a END FROM r JOIN n x ON x.id<r.id AND (x.a=node OR x.b=node))
SELECT a, b, w+0.0 AS w FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id=n.id AND r.node=n.b)
""")
def class_tree(t):
    """The minimum spanning tree of the classes' mean vectors, from which single linkage is cut."""
    v = t("embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    a, b = v.select(F.col("label").alias("a"), "i", F.col("v").alias("_a")), v.select(F.col("label").alias("b"), "i", F.col("v").alias("_b"))
    e = a.join(b, "i").where("a < b").groupBy("a", "b").agg(r(F.sqrt(F.sum((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b"))))).alias("w"))
    return T.spanning_tree(e, "a", "b", "w").select("a", "b", "w")


#: One round of smoothing in SQL: an average over the neighbours beside the own value.
ROUND = "(SELECT p.m, p.k, (any_value(p.y)+1.5*coalesce(avg(q.y),any_value(p.y)))/2.5 AS y FROM {0} p LEFT JOIN e2 ON e2.a=p.k LEFT JOIN {0} q ON q.k=e2.b AND q.m=p.m GROUP BY p.m, p.k)"


@query(f"""
WITH {FACES}, e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT a, c FROM f)), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
s0 AS (SELECT month(l_shipdate) AS m, l_suppkey AS k, avg(l_quantity) AS y FROM lineitem GROUP BY 1,2), s1 AS {ROUND.format("s0")}, s2 AS {ROUND.format("s1")}, s3 AS {ROUND.format("s2")}
SELECT m::INT AS m, k, round(y,6)+0.0 AS y FROM s3
""")
def smoothed_mesh(t):
    """Three rounds of smoothing of monthly values over the edges of a mesh."""
    faces, _ = _mesh(t)
    v = t("lineitem").groupBy(F.month("l_shipdate").alias("m"), F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("y"))
    d = X.smooth_mesh(v, X.mesh_edges(faces), "k", ["y"], 1.5, 3, ["m"])
    return d.select("m", "k", r("y").alias("y"))


@query("""
WITH p AS (SELECT c_custkey AS k, c_nationkey AS study, 1.0+c_nationkey%3 AS w FROM customer), g AS (SELECT x.x, y.y, row_number() OVER (ORDER BY x.x, y.y)-1 AS i FROM range(0,32) x(x), range(0,32) y(y) WHERE (x.x-16)^2+(y.y-16)^2 < 200),
d0 AS (SELECT study, w, b, ((k*k+12345)%2147483647*31+b*7919+104729)%2147483647 AS u FROM p, range(1,31) r(b)), d1 AS (SELECT study, w, b, (u*u+12345)%2147483647 AS u FROM d0), d2 AS (SELECT study, w, b, (u*u+67891)%2147483647 AS u FROM d1), d3 AS (SELECT study, w, b, (u*u+24680)%2147483647 AS u FROM d2),
c AS (SELECT b, study, w, x, y FROM d3 JOIN g ON g.i=(u*(SELECT count(*) FROM g))//2147483647), o AS (SELECT b, study, g.x, g.y, max(w) AS w FROM c JOIN g ON (c.x-g.x)^2+(c.y-g.y)^2 <= 2.25 GROUP BY 1,2,3,4),
s AS (SELECT b, x, y, sum(w) AS s FROM o GROUP BY 1,2,3)
SELECT b::INT AS b, round(max(s)/(SELECT sum(w) FROM (SELECT study, max(w) w FROM p GROUP BY 1)),6)+0.0 AS highest FROM s GROUP BY 1
""")
def density_null(t):
    """The highest share of studies in a cell of a round mask when all points are dealt anew, draw by draw."""
    p = t("customer").select("c_custkey", F.col("c_nationkey").alias("study"), (1.0 + F.col("c_nationkey") % 3).alias("w"))
    cells = U.range_grid(p.sparkSession, [(0, 1, 31), (0, 1, 31)]).select(F.col("d1").cast("int").alias("x"), F.col("d2").cast("int").alias("y"))
    cells = cells.where("pow(x - 16, 2) + pow(y - 16, 2) < 200")
    d = U.density_null(p, "c_custkey", "study", "w", ["x", "y"], cells, 1.5, 30)
    return d.select("b", r("highest").alias("highest"))
