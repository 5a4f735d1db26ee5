"""Hand-checkable cases of single operators."""

import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.functions import dist as D
from tessera.functions import scalars as S
from tessera.functions import text as T
from tessera.operators import aggregates as A
from tessera.operators import clusters as C
from tessera.operators import events as E
from tessera.operators import filters as X
from tessera.operators import joins as J
from tessera.operators import robust as R
from tessera.operators import sets as Z
from tessera.operators import stats as M
from tessera.operators import vectors as V
from tessera.operators import windows as W
from tessera.plans import formula as P

NAN, INF = float("nan"), float("inf")


def column(spark, values, name="v"):
    return spark.createDataFrame([(i + 1, float(v) if v is not None else None) for i, v in enumerate(values)], f"i int, {name} double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_conditional_sum(spark):
    d = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (3.0, 5.0), (NAN, 9.0), (4.0, 7.0)], "k double, v double")
    assert [r.total for r in A.conditional_sum(d, 3, "k", "v").orderBy("key").collect()] == [3.0, 0.0, 5.0]


def test_histogram_clamps_above_and_drops_below(spark):
    d = column(spark, [-1, 0, 0.5, 2.9, 7])
    got = {r.bin1: r.n for r in A.histogram(d, [("v", 0, 3, 1)]).collect()}
    assert got == {1: 2, 3: 1, 4: 1}


def test_good_mean(spark):
    assert one(column(spark, [1, NAN, 3, INF]).agg(A.good_mean("v")))[0] == 2
    assert one(column(spark, [NAN, NAN]).agg(A.good_mean("v")))[0] == 0
    assert one(column(spark, []).agg(A.good_mean("v")))[0] == 0


def test_harmonic_mean(spark):
    assert one(column(spark, [1, 2, 4]).agg(A.harmonic_mean("v")))[0] == pytest.approx(12 / 7)


def test_rank_transform(spark):
    d = column(spark, [10, 20, 20, 5]).withColumn("g", F.lit(1))
    assert [r["rank"] for r in W.rank_transform(d, ["g"], "v").orderBy("i").collect()] == [2, 3.5, 3.5, 1]


def test_percent_change(spark):
    d = column(spark, [50, 100, 150]).withColumn("g", F.lit(1))
    assert [r.psc for r in W.percent_change(d, ["g"], "v").orderBy("i").collect()] == [50, 100, 150]
    d = column(spark, [-1, 1]).withColumn("g", F.lit(1))
    assert [r.psc for r in W.percent_change(d, ["g"], "v").orderBy("i").collect()] == [0, 0]


def test_kendall_tau(spark):
    d = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 2.0, 3.0), (1, 3, 3.0, 2.0)], "g int, i int, x double, y double")
    assert one(W.kendall_tau(d, ["g"], "i", "x", "y")).tau == pytest.approx(1 / 3)


def test_correlation_scalars(spark):
    d = spark.createDataFrame([(0.5, 27)], "r double, n int")
    r = one(d.select(S.correlation_t("r", "n").alias("t"), S.fisher_z("r").alias("z")))
    assert r.t == pytest.approx(2.8867513)
    assert r.z == pytest.approx(0.5493061, abs=1e-6)


def test_stouffer(spark):
    assert one(column(spark, [1, 2, NAN, 1]).agg(M.stouffer("v")))[0] == 2.0


def test_conjunction(spark):
    d = spark.createDataFrame([(2.0, 3.0), (-2.0, -1.0), (2.0, -1.0)], "a double, b double")
    assert [r[0] for r in d.select(S.conjunction("a", "b")).collect()] == [2, -1, 0]
    d = spark.createDataFrame([(0.2, 0.01), (0.2, -0.1)], "a double, b double")
    assert [r[0] for r in d.select(S.conjunction_p("a", "b")).collect()] == [0.2, 1]


def test_fdr(spark):
    d = column(spark, [0.001, 0.02, 0.03, 0.5], "p").withColumn("g", F.lit(1))
    assert one(M.fdr_thresholds(d, ["g"], "p", [0.05], 2)).threshold == 0.03
    d = column(spark, [0.9, 0.8], "p").withColumn("g", F.lit(1))
    assert one(M.fdr_thresholds(d, ["g"], "p", [0.05], 2)).threshold == pytest.approx(0.8 / 2.001)


def test_ordered_union(spark):
    a = spark.createDataFrame([(3, 1), (1, 2)], "v int, p int")
    b = spark.createDataFrame([(2, 1), (1, 2), (4, 3)], "v int, p int")
    assert [r.v for r in Z.ordered_union(a, b, "v", "p").orderBy("source", "place").collect()] == [3, 1, 2, 4]


def test_last_match(spark):
    a = spark.createDataFrame([(1, "a"), (2, "B"), (3, "z")], "i int, s string")
    b = spark.createDataFrame([(1, "A"), (2, "b"), (3, "a")], "p int, s string")
    assert [r.match for r in J.last_match(a, b, "s", "p").orderBy("i").collect()] == [3, 2, 0]


def test_transitions(spark):
    d = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 1)], "g int, t int, s int")
    assert {(r.before, r.after): r.p for r in W.transitions(d, ["g"], ["t"], "s").collect()} == {(1, 1): 0.5, (1, 2): 0.5, (2, 1): 1.0}


def test_auc(spark):
    d = spark.createDataFrame([(1, 3.0, 1), (1, 2.0, 0), (1, 1.0, 0)], "g int, s double, l int")
    assert one(W.auc(d, ["g"], "s", "l")).auc == 1.0


def test_winsorize_replaces_by_the_mean(spark):
    d = column(spark, [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 60]).withColumn("g", F.lit(1))
    got = [r.winsorized for r in W.winsorize(d, ["g"], "v", 3.0).orderBy("i").collect()]
    assert got[:11] == [1, 2] * 5 + [1] and got[11] < 10
    d = column(spark, [1, 2, 100]).withColumn("g", F.lit(1))
    assert [r.winsorized for r in W.winsorize(d, ["g"], "v", 0.1).orderBy("i").collect()] == [1, 2, 100]


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(scale=0.1, size=60)
    d = spark.createDataFrame([(i % 2, *map(float, x[i]), float(y[i])) for i in range(60)], "g int, a double, b double, y double")
    for r in M.solve(M.normal_equations(d, ["g"], "y", ["a", "b"]), ["g"], ["a", "b"]).collect():
        own = [i for i in range(60) if i % 2 == r.g]
        want = np.linalg.lstsq(np.column_stack([x[own], np.ones(30)]), y[own], rcond=None)[0]
        assert np.allclose(r.betas, want)


def test_robust_regression_resists_an_outlier(spark):
    rows = [(1, float(i), 2.0 * i + 1 + 0.01 * (i % 3)) for i in range(30)] + [(1, 30.0, 900.0)]
    r = one(R.robust_regression(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "y", ["x"]))
    assert r.betas[0] == pytest.approx(2, abs=0.01)


def test_krippendorff_perfect_agreement(spark):
    d = spark.createDataFrame([(1, u, r, u % 2) for u in range(6) for r in range(3)], "g int, u int, r int, v int")
    assert one(M.krippendorff_alpha(d, ["g"], "u", "v")).alpha == 1


def test_tail_areas():
    assert D.t_cdf_np(2.0, 10.0) == pytest.approx(0.963306, abs=1e-6)
    assert D.t_inv_np(0.975, 10.0) == pytest.approx(2.2281389, abs=1e-6)
    assert D.f_upper_np(3.0, 2.0, 10.0) == pytest.approx(0.0953674, abs=1e-6)
    assert D.gamma_inc(2.0, 3.0) == pytest.approx(1 - 4 * math.exp(-3), abs=1e-10)
    assert float(2 * D.t_upper_np(1.96, 1e7)) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-5)


def test_formula_and_predicate(spark):
    d = spark.createDataFrame([(1.0, 2.0, 4.0)], "m1 double, m2 double, m3 double")
    assert one(P.compute(d, "(#1 + $2) .* 2 + greatest(#1:3)")).value == 10
    with pytest.raises(ValueError):
        P.compute(d, "__import__('os')")
    with pytest.raises(ValueError):
        P.rewrite("java_method(#1)")
    p = spark.createDataFrame([(1, "Alpha"), (5, "beta"), (9, "alphabet")], "Value int, Name string")
    assert [r.Value for r in P.select_points(p, "$Value > 1 & $Name == 'alpha*'").collect()] == [9]
    assert [r.Value for r in P.select_points(p, "$Name == 'ALPHA' | ($Value >= 5 & $Name ~= 'beta')").orderBy("Value").collect()] == [1, 9]
    with pytest.raises(ValueError):
        P.predicate("$Value > 1; drop", ["Value"])
    assert one(P.select(p, "SELECT count(*) AS n, max(Value) AS m WHERE Name LIKE '%a%'")).asDict() == {"n": 3, "m": 9}


def test_interval_join_equals_brute_force(spark):
    t = [(1, float(i * 7 % 50)) for i in range(40)]
    e = [(1, float(i * 13 % 50)) for i in range(9)]
    got = J.interval_join(spark.createDataFrame(t, "g int, t double"), "t", spark.createDataFrame(e, "g int, o double"), "o", 3.0, 5.0, ["g"]).select("t", "o").collect()
    assert sorted(tuple(r) for r in got) == sorted((a, b) for _, a in t for _, b in e if b - 3 <= a < b + 5)


def test_components_and_clusters(spark):
    cells = [(0, 0), (0, 1), (1, 1), (5, 5), (5, 6), (9, 9)] + [(20, j) for j in range(30)]
    d = spark.createDataFrame([(x, y, float(x + y + 1)) for x, y in cells], "x int, y int, v double")
    lab = C.label_components(d, ["x", "y"]).collect()
    groups = {}
    for r in lab:
        groups.setdefault(tuple(r.cluster), set()).add((r.x, r.y))
    assert sorted(map(len, groups.values())) == [1, 2, 3, 30]
    top = C.cluster_table(d, ["x", "y"], "v", 0.0, 3).orderBy("size").collect()
    assert [r.size for r in top] == [3, 30] and (top[1].peak_x, top[1].peak_y) == (20, 29)


def test_morphology(spark):
    d = spark.createDataFrame([(x, y) for x in range(3) for y in range(3)], "x int, y int")
    assert [tuple(r) for r in C.erode(d, ["x", "y"]).collect()] == [(1, 1)]
    assert C.dilate(d, ["x", "y"]).count() == 21


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "g int, t int, k string")
    right = spark.createDataFrame([(1, 2, 10), (1, 5, 20), (2, 10, 30)], "g int, t int, v int")
    assert {r.k: r.v for r in J.as_of(left, right, ["g"], "t", ["v"]).collect()} == {"a": 20, "b": None, "c": None}


def test_filter_removes_a_drift(spark):
    rows = [(1, t, math.cos(math.pi * (2 * t + 1) / 128) * 10 + 5) for t in range(64)]
    s = X.remove_drifts(X.as_series(spark.createDataFrame(rows, "g int, t int, x double"), ["g"], "t", "x"), "cosine", 32)
    v = np.array(one(s)["values"])
    assert np.allclose(v, v.mean(), atol=1e-8)
    assert len(one(X.resample(s, 4))["values"]) == 16


def test_events(spark):
    d = spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 6.0), (1, 10.0, 12.0)], "g int, s double, e double")
    assert sorted((r.s, r.e, r.n) for r in E.merge_intervals(d, ["g"], "s", "e").collect()) == [(0, 6, 2), (10, 12, 1)]
    assert sum(E.gamma_response(0.5)) == pytest.approx(1)


def test_text_functions(spark):
    d = spark.createDataFrame([("red green  blue", 7, "AB12", "1, 2 x")], "s string, n int, c string, v string")
    r = one(d.select(T.camel_case("s").alias("camel"), T.zero_filled("n", 3).alias("z"), T.cell_reference("c")["column"].alias("col"), T.cell_reference("c")["row"].alias("row"), T.to_numbers("v").alias("v"), T.line("s", 2).alias("l")))
    assert (r.camel, r.z, r.col, r.row, r.v, r.l) == ("RedGreenBlue", "007", 28, 12, [1.0, 2.0, None], "")


def test_kmeans_and_bootstrap(spark):
    rows = [(i, [float(i % 2) * 10 + 0.01 * i, 0.0]) for i in range(40)]
    got = V.k_means(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 2, 20).collect()
    assert len({(r.k % 2, r.cluster) for r in got}) == 2
    d = spark.createDataFrame([(1, i, float(i % 37)) for i in range(3000)], "g int, k long, x double")
    found = [one(M.bootstrap_mean(d.repartition(p), ["g"], "k", "x", 400)) for p in (1, 2, 5)]
    assert all(np.allclose([r.low, r.high, r.se], [found[0].low, found[0].high, found[0].se]) for r in found)
    v = np.arange(3000) % 37
    assert abs(found[0].se / (v.std(ddof=1) / math.sqrt(3000)) - 1) < 0.1 and found[0].low < v.mean() < found[0].high
    assert M.bootstrap_mean(d, [], "k", "x", 50).count() == 1


def test_moments_survive_an_offset(spark):
    """A billion added to every value changes no spread, slope or F."""
    rng = np.random.default_rng(2)
    rows = [(i % 2, i % 5, float(rng.normal()), float(rng.normal()), float(1 + rng.random())) for i in range(400)]
    d = spark.createDataFrame([(g, f, x, 2 * x + y, w) for g, f, x, y, w in rows], "g int, f int, x double, y double, w double")
    far = d.withColumn("y", F.col("y") + 1e9)
    for weight in (None, "w"):
        a, b = (sorted(M.solve(M.normal_equations(t, ["g"], "y", ["x"], weight), ["g"], ["x"], [1, 0]).collect()) for t in (d, far))
        assert all(np.allclose([p.betas[0], p.se, p.t], [q.betas[0], q.se, q.t], rtol=1e-5) for p, q in zip(a, b, strict=True))
        parts = M.solve(M.merge_equations(M.normal_equations(far, ["g", "f"], "y", ["x"], weight).drop("f"), ["g"]), ["g"], ["x"], [1, 0])
        assert all(np.allclose([p.betas[0], p.se, p.t], [q.betas[0], q.se, q.t], rtol=1e-5) for p, q in zip(a, sorted(parts.collect()), strict=True))
    f, g = (sorted(M.one_way_anova(t, ["g"], "f", "y").collect()) for t in (d, far))
    assert all(np.isclose(p.f, q.f, rtol=1e-5) for p, q in zip(f, g, strict=True))
    m, n = (A.leave_one_out(t, ["g"], "y").orderBy("x").collect() for t in (d, far))
    assert np.allclose([p.loo_variance for p in m], [q.loo_variance for q in n], rtol=1e-4)


def test_small_groups_do_not_divide_by_zero(spark):
    d = spark.createDataFrame([(n, float(i * i)) for n in range(1, 6) for i in range(n)] + [(0, None)], "g int, x double")
    got = {r.g: (r.s, r.k) for r in d.groupBy("g").agg(A.skew("x", True).alias("s"), A.kurtosis("x", True).alias("k")).collect()}
    assert got[2][0] is None and got[3][1] is None and got[4][0] is not None and got[5][1] is not None
    three = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (1, 2.0, 1.0, 5.0), (1, 4.0, 3.0, 1.0)], "g int, x double, y double, z double")
    assert one(M.dependent_correlation_t(three, ["g"], "x", "y", "z")).df == 0


def test_formula_quotients_and_powers(spark):
    d = spark.createDataFrame([(2.0, 0.0, 3.0)], "m1 double, m2 double, m3 double")
    value = lambda f: one(P.compute(d, f)).value
    assert value("#1 ./ #2") == math.inf and value("-#1 / #2") == -math.inf and math.isnan(value("#2 / #2"))
    assert value("#3 .^ #1 ^ 2") == 81.0 and value("-#1 ^ 2") == -4.0 and value("1 + #1 * #3 - 4 / #1") == 5.0
    assert value("if(#1 > 1 & ~(#3 == 2), #1, #3)") == 2.0 and value("greatest(#1:3) - least(#1:2:3, 2.5)") == 1.0
    for wrong in ("#1 +", "(#1", "#1 #2", "java_method(#1)"):
        with pytest.raises(ValueError):
            P.rewrite(wrong)


def test_equal_events_are_trials_of_their_own(spark):
    s = spark.createDataFrame([(1, float(t), float(t)) for t in range(10)], "u int, t double, x double")
    e = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0)], "u int, c string, o double")
    got = E.event_average(s, e, ["u"], "c", "t", "x", "o", 4.0, 4.0, 1.0, (-4.0, 0.0))
    assert {r.n for r in got.collect()} == {2}


def test_as_of_by_ranges(spark):
    """However time is cut, each row gets the last value before it."""
    rng = np.random.default_rng(4)
    left = spark.createDataFrame([(int(rng.integers(3)), float(rng.integers(100)), i) for i in range(200)], "g int, t double, k int")
    right = spark.createDataFrame([(int(rng.integers(2)), float(t), int(t)) for t in rng.permutation(100)[:30]], "g int, t double, v int")
    want = {r.k: r.v for r in J.as_of(left, right, ["g"], "t", ["v"]).collect()}
    assert len(want) == 200 and all(want == {r.k: r.v for r in J.as_of(left, right, ["g"], "t", ["v"], w).collect()} for w in (1.0, 7.0, 1000.0))


def test_distances_in_blocks(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "k int, v array<double>")
    whole, parts = (sorted(V.distances_to(d, "k", "v", d.where("k % 2 = 0"), b).collect()) for b in (100, 3))
    assert whole == parts and len(whole) == 800


def test_distances_are_dealt_over_tasks(spark, tmp_path):
    """One small file makes many pairs: several tasks build them, whatever its files, and nothing is broadcast."""
    spark.range(3000).selectExpr("id AS k", "array(cast(id % 7 AS float), cast(id % 50 AS float)) AS v").coalesce(1).write.parquet(f"{tmp_path}/v")
    d = spark.read.parquet(f"{tmp_path}/v")
    j = V.distances_to(d, "k", "v", d.where("k % 5 = 0"))
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    by_task = {r[0]: r[1] for r in j.groupBy(F.spark_partition_id()).count().collect()}
    assert sum(by_task.values()) == 600 * 3000 and max(by_task.values()) <= 600 * 3000 / 2
    assert j.where(F.expr("abs(distance - sqrt(pow(query % 7 - k % 7, 2) + pow(query % 50 - k % 50, 2))) > 1e-9 OR distance IS NULL")).count() == 0


def test_distances_of_odd_vectors(spark):
    """Null where a vector is null, holds a null, or the lengths differ; queries and rows of other types and keys."""
    rows = [(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, []), (5, [0.0, None]), (None, [0.0, 0.0]), (6, [float("nan"), 0.0]), (6, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "k long, v array<float>")
    q = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0]), ("c", []), ("d", None), ("e", [None])], "k string, v array<double>")
    got = sorted(((r.query, r.k, repr(r.distance)) for r in V.distances_to(d, "k", "v", q, 2).collect()), key=str)
    own = {"a": {(1, "5.0"), (None, "0.0"), (6, "nan"), (6, "1.0")}, "b": {(3, "0.0")}, "c": {(4, "0.0")}, "d": set(), "e": set()}
    assert len(got) == 40 and {x: {(k, t) for y, k, t in got if y == x and t != "None"} for x in "abcde"} == own
    assert V.distances_to(d, "k", "v", q.where("false")).count() == V.distances_to(d.where("false"), "k", "v", q).count() == 0


def test_frames():
    from tessera.functions import frames as G

    m = G.frame((1, 2, 3), (0.3, -0.2, 0.5))
    q = G.quaternion(m)
    assert np.allclose(G.rotation(q)[:3, :3], m[:3, :3])
    assert np.allclose(m[:3, 3], [1, 2, 3]) and np.isclose(np.linalg.det(m), 1)


def test_searchlight_finds_an_informative_cell(spark):
    from tessera.operators import spatial as L

    rng = np.random.default_rng(2)
    rows = [(x, 0, k, k % 2, k % 3, float(rng.normal() + (8 * (k % 2) if x == 5 else 0))) for x in range(10) for k in range(18)]
    d = spark.createDataFrame(rows, "x int, y int, trial int, condition int, fold int, v double")
    got = {r.x: (r.measure, r.n_features) for r in L.searchlight(d, ["x", "y"], "trial", "condition", "fold", "v", 1.0).collect()}
    assert got[5][0] == 1.0 and got[4][1] == 3 and got[0][1] == 2 and got[0][0] < 0.9


def test_cluster_simulation_is_deterministic_and_monotone(spark):
    from tessera.operators import spatial as L

    a = sorted(map(tuple, L.cluster_size_simulation(spark, (10, 10), 2.0, 0.05, 40).collect()))
    assert a == sorted(map(tuple, L.cluster_size_simulation(spark, (10, 10), 2.0, 0.05, 40, slices=3).collect()))
    assert [r[4] for r in a] == sorted((r[4] for r in a), reverse=True) and a[0][4] <= 1


def test_flood_stops_at_gaps(spark):
    from tessera.operators import spatial as L

    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3)], "x int, y int")
    assert sorted(tuple(r) for r in L.flood(d, ["x", "y"], {"x": 0, "y": 0}).collect()) == [(0, 0), (0, 1), (1, 1)]


def test_interval_variability(spark):
    from tessera.operators import studies as U

    d = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.0, 3.2)], "g int, t double")
    got = one(U.interval_variability(d, ["g"], "t"))
    assert got.n == 3 and got.rmssd == pytest.approx(math.sqrt((0 + 0.04) / 2)) and got.pnn50 == 0.5


def test_series_kernels(spark):
    t = np.arange(128)
    slow, fast = np.sin(2 * np.pi * 2 * t / 128), np.sin(2 * np.pi * 30 * t / 128)
    s = spark.createDataFrame([(1, t.tolist(), (slow + fast).tolist())], "g int, ts array<int>, values array<double>")
    assert np.allclose(one(X.band_pass(s, 0.0, 0.1))["values"], slow, atol=1e-9)
    assert np.abs(np.array(one(X.low_pass(s, 0.05, 6))["values"]) - slow).max() < 0.05
    ramp = spark.createDataFrame([(1, [0, 1, 2, 3], [0.0, 1.0, 2.0, 3.0])], s.schema)
    assert one(X.shift(ramp, 0.5))["values"] == [0.5, 1.5, 2.5, 3.0]
    spiky = spark.createDataFrame([(1, list(range(9)), [1.0, 1.1, 1.0, 50.0, 1.0, 1.1, 1.0, 1.1, 1.0])], s.schema)
    assert max(one(X.despike(spiky))["values"]) < 2
    pair = spark.createDataFrame([(1, np.roll(slow + fast, 3).tolist(), (slow + fast).tolist())], "k int, a array<double>, b array<double>")
    assert one(X.best_lag(pair, "k", "a", "b", 5)).lag == 3


def test_matrices(spark):
    from tessera.functions import matrices as K

    m = [[4.0, 1.0, 1.0, 3.0]]
    d = spark.createDataFrame([(m[0],), (None,)], "m array<double>")
    r = d.where("m is not null").select(K.inverse("m").alias("i"), K.square_root("m").alias("s"), K.determinant("m").alias("d")).select("*").first()
    a = np.reshape(m[0], (2, 2))
    assert np.allclose(np.reshape(r.i, (2, 2)) @ a, np.eye(2)) and np.allclose(np.linalg.matrix_power(np.reshape(r.s, (2, 2)), 2), a) and r.d == pytest.approx(11)
    assert d.select(K.inverse("m").alias("i")).where("i is null").count() == 1
    t = spark.createDataFrame([([2.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0],)], "m array<double>")
    assert one(t.select(K.anisotropy("m").alias("f"))).f == pytest.approx(np.sqrt(1.5 * (4 / 9 + 1 / 9 + 1 / 9) / 6))


def test_number_words_and_dumps(spark):
    d = spark.createDataFrame([(0,), (7,), (42,), (115,), (900_013,), (-1,)], "n int")
    assert [r.w for r in d.select(T.number_word("n").alias("w")).collect()] == ["zero", "seven", "forty-two", "one hundred fifteen", "nine hundred thousand thirteen", None]
    assert one(spark.createDataFrame([("AZ", 5)], "b string, n int").select(T.hex_dump("b").alias("h"), T.bit_dump("n").alias("w"))).asDict() == {"h": "41 5a", "w": "00000101"}


def test_distance_transform_and_histogram_matching(spark):
    from tessera.operators import spatial as L

    d = spark.createDataFrame([(x, y) for x in range(5) for y in range(5)], "x int, y int")
    depth = {(r.x, r.y): r.depth for r in L.distance_transform(d, ["x", "y"], 9).collect()}
    assert depth[2, 2] == 3 and depth[1, 2] == 2 and depth[0, 0] == 1
    v = column(spark, range(101))
    got = L.match_histogram(v, "v", v.select((F.col("v") * 10 + 5).alias("w")), "w", 50).collect()
    assert all(r.matched == pytest.approx(r.v * 10 + 5, abs=1e-6) for r in got)


def test_linear_classifier(spark):
    from pyspark.ml.functions import array_to_vector

    from tessera.operators import spatial as L

    d = spark.createDataFrame([(float(i % 2), [i % 2 * 4.0 + 0.01 * i, 1.0]) for i in range(40)], "y double, f array<double>")
    m = L.linear_classifier(d, "y", "f")
    got = m.transform(d.select("y", array_to_vector("f").alias("features"))).collect()
    assert all(r.prediction == r.y for r in got)


def test_searchlight_query_covers_the_whole_grid(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["searchlight_accuracy"](spark, DATA)
    cells = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_partkey % 32 AS x", "l_suppkey % 32 AS y").distinct()
    assert {(r.x, r.y) for r in got.collect()} == {(r.x, r.y) for r in cells.collect()}


def test_sums_do_not_depend_on_the_order(spark):
    from tessera.functions.scalars import steady_mean, steady_sum

    rows = [0.1, 0.2, 0.3, 1e11, 33.33, -1e11, 1e-9, None, 7.77] * 5
    sums = {repr(spark.createDataFrame([(v,) for v in order], "v double").coalesce(1).agg(steady_sum("v").alias("s")).first().s) for order in (rows, rows[::-1], sorted(rows, key=lambda v: v or 0))}
    assert len(sums) == 1 and math.isclose(float(sums.pop()), math.fsum(v for v in rows if v is not None), rel_tol=1e-15)
    assert spark.createDataFrame([(None,)], "v double").agg(steady_mean("v").alias("s")).first().s is None


def test_nearest_of_crowded_targets_compares_few_pairs(spark):
    """All points see all targets within the radius; still each is compared with few, and ties go to the smallest."""
    from tessera.operators import joins as J

    p = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 37 % 101 / 10).alias("x"), (F.col("id") * 53 % 97 / 10).alias("y"))
    q = spark.range(400).select((400 - F.col("id")).alias("t"), (F.col("id") * 29 % 89 / 10).alias("x"), (F.col("id") * 31 % 83 / 10).alias("y"))
    got = {r.k: (r.t, r.distance) for r in J.nearest(p, "k", q, "t", ["x", "y"], 30.0).collect()}
    targets = q.collect()
    want = {r.k: min((math.sqrt((r.x - o.x) ** 2 + (r.y - o.y) ** 2), o.t) for o in targets)[::-1] for r in p.collect()}
    assert got == want
    seen, plain = [], J.radius_join
    J.radius_join = lambda a, b, axes, radius: (seen.append((j := plain(a, b, axes, radius)).count()), j)[1]
    try:
        J.nearest(p, "k", q, "t", ["x", "y"], 30.0).collect()
    finally:
        J.radius_join = plain
    assert sum(seen) < 0.1 * 600 * 400


def test_near_singular_and_singular_inverses(spark):
    from tessera.functions import matrices as K

    rows = [([1.0, 2.0, 2.0, 4.0],), ([2.5, 4.0, 6.0, 9.599],), (None,), ([2.0],), ([1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 4.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "m array<double>").coalesce(1).select(K.inverse("m")).collect()]
    assert [round(v, 9) for v in got[0]] == [0.04, 0.08, 0.08, 0.16]
    assert got[1][0] == 9.599 / (2.5 * 9.599 - 4.0 * 6.0)
    assert got[2] is None and got[3] == [0.5] and got[4][8] == 0.25
