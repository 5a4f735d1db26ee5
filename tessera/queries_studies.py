"""Queries of study-level and spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import spatial as X
from .operators import studies as U
from .queries import GRID, SECONDS, _grid, month, query, r, rounded, seconds


@query("""
WITH s AS (SELECT l_returnflag AS g, var_samp(l_quantity) vx, var_samp(l_extendedprice/1000) vm, var_samp(l_tax*100) vy, covar_samp(l_quantity,l_extendedprice/1000) xm, covar_samp(l_quantity,l_tax*100) xy, covar_samp(l_extendedprice/1000,l_tax*100) my, count(*) n FROM lineitem GROUP BY 1),
p AS (SELECT *, xm/vx AS a, xy/vx AS c, (my*vx-xy*xm)/(vx*vm-xm*xm) AS b, (xy*vm-my*xm)/(vx*vm-xm*xm) AS d FROM s)
SELECT g AS l_returnflag, round(a,6)+0.0 AS a, round(b,6)+0.0 AS b, round(c,6)+0.0 AS c, round(d,6)+0.0 AS c_direct, round(a*b,6)+0.0 AS ab,
round(a*b/sqrt(b*b*((vm-a*xm)*(n-1)/(n-2)/((n-1)*vx))+a*a*((vy-d*xy-b*my)*(n-1)/(n-3)*vx/((n-1)*(vx*vm-xm*xm)))),5)+0.0 AS z, n FROM p
""")
def mediation(t):
    d = t("lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("m"), (F.col("l_tax") * 100).alias("y"))
    return rounded(U.mediation(d, ["l_returnflag"], "l_quantity", "m", "y"), 6, z=5)


@query("""
WITH c AS (SELECT o_custkey AS s, o_orderstatus AS l, avg(o_totalprice)/1e5 AS v FROM orders GROUP BY 1,2), k AS (SELECT count(DISTINCT l) k FROM c), f AS (SELECT s, sum(v) AS u FROM c, k GROUP BY s, k HAVING count(*)=k), d AS (SELECT c.* FROM c JOIN f USING (s)),
z AS (SELECT sum(v) s, sum(v*v) ss, count(DISTINCT s) n, max(k) k FROM d, k), e AS (SELECT sum(t*t) tt FROM (SELECT sum(v) t FROM d GROUP BY l)), g AS (SELECT sum(u*u) uu FROM f)
SELECT round(((tt/n-s*s/(n*k))/(k-1))/((ss-s*s/(n*k)-(tt/n-s*s/(n*k))-(uu/k-s*s/(n*k)))/((k-1)*(n-1))),5)+0.0 AS f, k-1 AS df1, (k-1)*(n-1) AS df2, n AS n_subjects FROM z, e, g
""")
def repeated_measures(t):
    d = t("orders").withColumn("v", F.col("o_totalprice") / 1e5)
    return rounded(U.repeated_measures(d, "o_custkey", "o_orderstatus", "v"), 5)


@query("SELECT l_returnflag, round(sqrt(count(*))*avg(l_tax-l_discount)/stddev_samp(l_tax-l_discount),4)+0.0 AS t, count(*)-1 AS df FROM lineitem GROUP BY 1")
def paired_t(t):
    return rounded(U.paired_t(t("lineitem"), ["l_returnflag"], "l_tax", "l_discount"), 4)


@query("""
WITH j AS (SELECT event_type, (sum(value) OVER w - value)/(count(*) OVER w - 1) AS m FROM events WINDOW w AS (PARTITION BY event_type)), k AS (SELECT event_type, avg(m) AS mm, count(*) n FROM j GROUP BY 1)
SELECT k.event_type, round(mm,6)+0.0 AS mean, round(sqrt((n-1)*1.0/n*sum((m-mm)^2)),6)+0.0 AS se, n FROM j JOIN k ON j.event_type=k.event_type GROUP BY k.event_type, mm, n
""")
def jackknife(t):
    return rounded(U.jackknife(t("events"), ["event_type"], "value"))


@query("SELECT user_id, round(avg(value),6)+0.0 AS mean, round(stddev_samp(value),6)+0.0 AS sd, round(avg(value)/stddev_samp(value),6)+0.0 AS snr FROM events GROUP BY 1")
def temporal_quality(t):
    return rounded(U.temporal_quality(t("events"), ["user_id"], "value"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_tax - sum(l_tax*l_discount) OVER w/sum(l_discount*l_discount) OVER w*l_discount, 6)+0.0 AS orthogonal FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)
""")
def orthogonalise(t):
    return U.orthogonalise(t("lineitem"), ["l_returnflag"], "l_discount", "l_tax").select("l_orderkey", "l_linenumber", r("orthogonal").alias("orthogonal"))


@query(f"""
WITH e AS (SELECT user_id, {SECONDS} AS a, {SECONDS}+3600*(1+event_id%12) AS b FROM events), g AS (SELECT user_id, max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, lead(a) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY a, b))
SELECT user_id, round(a,3)+0.0 AS a, round(b,3)+0.0 AS b FROM g WHERE b-a >= 1800
""")
def rest_intervals(t):
    d = t("events").select("user_id", seconds().alias("a"), (seconds() + 3600 * (1 + F.col("event_id") % 12)).alias("b"))
    return rounded(U.rest_intervals(d, ["user_id"], "a", "b", 1800.0), 3)


@query(f"SELECT event_id, CAST(floor(({SECONDS}-1704067200)/7200)+1 AS BIGINT) AS a, CAST(greatest(floor(({SECONDS}-1704067200)/7200)+1, ceil(({SECONDS}-1704067200+60*(event_id%300))/7200)) AS BIGINT) AS b FROM events")
def event_volumes(t):
    d = t("events").select("event_id", (seconds() - 1704067200).alias("a"), (seconds() - 1704067200 + 60 * (F.col("event_id") % 300)).alias("b"))
    return U.to_volumes(d, "a", "b", 7200.0).select("event_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("""
WITH n AS (SELECT l_linenumber AS run, max(l_partkey) AS n FROM lineitem GROUP BY 1), b AS (SELECT run, coalesce(sum(n) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM n)
SELECT l_orderkey, l_linenumber, CAST(l_partkey+before AS BIGINT) AS t_all FROM lineitem JOIN b ON run=l_linenumber
""")
def concatenated_runs(t):
    return U.concatenate_runs(t("lineitem"), "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "t_all")


@query("""
WITH m AS (SELECT DISTINCT n_regionkey AS region, s_suppkey FROM supplier JOIN nation ON s_nationkey=n_nationkey)
SELECT region, CAST(year(l_shipdate)*12+month(l_shipdate) AS INTEGER) AS m, round(avg(l_quantity),6)+0.0 AS l_quantity, count(*) AS n FROM lineitem JOIN m ON s_suppkey=l_suppkey GROUP BY 1,2
""")
def region_courses(t):
    members = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("s_suppkey").alias("l_suppkey"))
    return rounded(U.region_courses(t("lineitem").withColumn("m", month()), members, ["l_suppkey"], "region", "m", "l_quantity"))


@query("""
WITH p AS (SELECT c_nationkey AS study, 1.0+c_nationkey%3 AS w, 16+15*sin(c_custkey) AS x, 16+15*cos(2*c_custkey) AS y FROM customer), g AS (SELECT x.x, y.y FROM range(0,32) x(x), range(0,32) y(y)),
o AS (SELECT study, g.x, g.y, max(w) AS w FROM p, g WHERE (p.x-g.x)^2+(p.y-g.y)^2 <= 2.25 GROUP BY 1,2,3)
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(sum(w)/(SELECT sum(w) FROM (SELECT study, max(w) w FROM p GROUP BY 1)),6)+0.0 AS density, count(*) AS n_studies FROM o GROUP BY 1,2
""")
def point_density(t):
    k = F.col("c_custkey")
    p = t("customer").select(F.col("c_nationkey").alias("study"), (1.0 + F.col("c_nationkey") % 3).alias("w"), (16 + 15 * F.sin(k)).alias("x"), (16 + 15 * F.cos(2 * k)).alias("y"))
    cells = U.range_grid(p.sparkSession, [(0, 1, 31), (0, 1, 31)]).select(F.col("d1").alias("x"), F.col("d2").alias("y"))
    return rounded(U.point_density(p, "study", "w", ["x", "y"], cells, 1.5))


@query("""
WITH d AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, value FROM d WHERE value>=60 AND value>p AND value>=q
""")
def signal_peaks(t):
    return U.peaks(t("events"), ["user_id"], ["ts", "event_id"], "value", 60.0).select("user_id", "event_id", "value")


@query(f"""
WITH i AS (SELECT user_id, t, t-lag(t) OVER (PARTITION BY user_id ORDER BY t) AS i FROM (SELECT user_id, {SECONDS} AS t FROM events)), s AS (SELECT user_id, i, i-lag(i) OVER (PARTITION BY user_id ORDER BY t) AS s FROM i)
SELECT user_id, round(avg(i),3)+0.0 AS mean, round(stddev_samp(i),3)+0.0 AS sdnn, round(sqrt(avg(s*s)),3)+0.0 AS rmssd, round(count(*) FILTER (abs(s)>0.05)*1.0/count(s),6)+0.0 AS pnn50, count(i) AS n FROM s GROUP BY 1
""")
def interval_variability(t):
    return rounded(U.interval_variability(t("events").select("user_id", seconds().alias("t")), ["user_id"], "t"), 3, pnn50=6)


@query("SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size),6)+0.0 AS share FROM part")
def percentile_lookup(t):
    return U.share_below(t("part"), ["p_brand"], "p_size").select("p_partkey", r("share").alias("share"))


@query("SELECT CAST(a AS INTEGER) AS d1, CAST(b AS INTEGER) AS d2, CAST(c AS INTEGER) AS d3 FROM range(1,8,2) a(a), range(-2,3) b(b), range(0,10,5) c(c)")
def range_grid(t):
    return U.range_grid(t("region").sparkSession, [(1, 2, 7), (-2, 1, 2), (0, 5, 5)])


@query("SELECT l_suppkey, arg_min(l_returnflag, (-q, l_returnflag)) AS winner FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1,2) GROUP BY 1")
def winning_condition(t):
    return U.winner(t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q")), ["l_suppkey"], "l_returnflag", "q")


@query(f"WITH {GRID} SELECT a.x, a.y, round(avg(b.v),6)+0.0 AS mean, round(stddev_samp(b.v),6)+0.0 AS sd, count(*) AS n FROM g a JOIN g b ON (a.x-b.x)^2+(a.y-b.y)^2 <= 4 GROUP BY 1,2")
def searchlight_mean(t):
    return rounded(X.neighbourhood_statistics(_grid(t), ["x", "y"], "v", 2.0))


@query()
def searchlight_accuracy(t):
    s = t("lineitem").groupBy((F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_suppkey") % 32).cast("int").alias("y"), (F.col("l_orderkey") % 12).alias("trial"), "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return X.searchlight(s.withColumn("fold", F.col("trial") % 3), ["x", "y"], "trial", "l_returnflag", "fold", "v", 1.5)


FACES = "f AS (SELECT s_suppkey AS a, s_suppkey+1 AS b, s_suppkey+2 AS c FROM supplier WHERE s_suppkey+2 <= (SELECT max(s_suppkey) FROM supplier))"


def _mesh(t):
    v = t("supplier").select("s_suppkey", F.sin("s_suppkey").alias("x"), F.cos("s_suppkey").alias("y"), (F.col("s_suppkey") / 10).alias("z"))
    k = F.col("s_suppkey")
    top = t("supplier").agg(F.max("s_suppkey").alias("top"))
    f = t("supplier").crossJoin(F.broadcast(top)).where(k + 2 <= F.col("top")).select(k.alias("a"), (k + 1).alias("b"), (k + 2).alias("c"))
    return f, v


@query(f"""
WITH {FACES}, e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT a, c FROM f)), v AS (SELECT s_suppkey AS k, sin(s_suppkey) AS x, cos(s_suppkey) AS y, s_suppkey/10.0 AS z FROM supplier)
SELECT a, b, round(sqrt((p.x-q.x)^2+(p.y-q.y)^2+(p.z-q.z)^2),6)+0.0 AS length FROM e JOIN v p ON p.k=a JOIN v q ON q.k=b
""")
def mesh_edges(t):
    f, v = _mesh(t)
    return rounded(X.edge_lengths(X.mesh_edges(f), v, "s_suppkey", ["x", "y", "z"]))


@query(f"""
WITH {FACES}, v AS (SELECT s_suppkey AS k, sin(s_suppkey) AS x, cos(s_suppkey) AS y, s_suppkey/10.0 AS z FROM supplier), n AS (SELECT a, b, c, (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) AS x, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) AS y, (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) AS z FROM f JOIN v p ON p.k=a JOIN v q ON q.k=b JOIN v r ON r.k=c),
s AS (SELECT k, sum(x) x, sum(y) y, sum(z) z FROM (SELECT a AS k, x, y, z FROM n UNION ALL SELECT b, x, y, z FROM n UNION ALL SELECT c, x, y, z FROM n) GROUP BY 1)
SELECT k AS s_suppkey, round(x/sqrt(x*x+y*y+z*z),6)+0.0 AS x, round(y/sqrt(x*x+y*y+z*z),6)+0.0 AS y, round(z/sqrt(x*x+y*y+z*z),6)+0.0 AS z FROM s
""")
def vertex_normals(t):
    f, v = _mesh(t)
    return rounded(X.vertex_normals(f, v, "s_suppkey"))


@query(f"""
WITH RECURSIVE {GRID}, c AS (SELECT x, y FROM g WHERE v>=24.5), s AS (SELECT x, y FROM c WHERE (x,y)=(SELECT (min(x), min(y)) FROM c WHERE x=(SELECT min(x) FROM c)) UNION SELECT c.x, c.y FROM s JOIN c ON abs(s.x-c.x)+abs(s.y-c.y)=1) SELECT x, y FROM s
""")
def flood_fill(t):
    cells = _grid(t).where("v >= 24.5").select("x", "y")
    at = cells.agg(F.min(F.struct("x", "y")).alias("s")).first()[0]
    return X.flood(cells, ["x", "y"], {"x": at[0], "y": at[1]})


@query()
def cluster_size_simulation(t):
    return X.cluster_size_simulation(t("region").sparkSession, (16, 16, 16), 3.0, 0.01, 100)
