"""Spark rounds equal the kernel, also for a group of a third of all rows."""

import numpy as np
import pytest

from tessera.operators import robust as R


def groups():
    rng = np.random.default_rng(3)
    rows = []
    for g, n in ((1, 900), (2, 300), (3, 401), (None, 250), (4, 30), (5, 2), (6, 260)):
        x, z = rng.normal(size=n) * 3 + 1e4, rng.normal(size=n)
        y = 2 * x - z + 5 + rng.standard_t(1.5, size=n)
        if g == 6:
            y = 2.0 * x - z
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(x, z, y, strict=True)]
    rows += [(1, float("nan"), 0.0, 1.0), (1, 1.0, None, 1.0), (2, 1.0, 1.0, float("inf")), (3, 1.0, 1.0, None)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(groups(), "g int, x double, z double, y double")


def test_order_statistics_are_exact(spark, table):
    got = {r.g: (r.median, r.n) for r in R.medians(table, ["g"], "y", gather=5).collect()}
    for g in got:
        v = [r[3] for r in groups() if r[0] == g and r[3] is not None and np.isfinite(r[3])]
        assert got[g] == (pytest.approx(np.median(v), rel=1e-15), len(v))
    odd = [(1, v) for v in [-1e308, 1e308, 0.0, -0.0, 5e-324, 1.0, 1.0, 1.0]] + [(2, 7.0)] * 50 + [(3, float(10**-i)) for i in range(14)]
    d = spark.createDataFrame(odd, "g int, v double")
    got = {r.g: r.median for r in R.medians(d, ["g"], "v", gather=1).collect()}
    assert got == {g: float(np.median([v for k, v in odd if k == g])) for g in (1, 2, 3)}


def test_mean_rounds_equal_the_kernel(table):
    one = {r.g: r for r in R.robust_mean(table, ["g"], "y", most=3).collect()}
    two = {r.g: r for r in R.robust_mean(table, ["g"], "y", most=3, small=200, gather=20).collect()}
    assert one.keys() == two.keys() and len(one) == 7
    for g, r in one.items():
        assert (two[g].robust_mean, two[g].n) == (pytest.approx(r.robust_mean, rel=1e-9), r.n)


def test_regression_rounds_equal_the_kernel(table):
    one = {r.g: r for r in R.robust_regression(table, ["g"], "y", ["x", "z"], most=3).collect()}
    two = {r.g: r for r in R.robust_regression(table, ["g"], "y", ["x", "z"], most=3, small=200, gather=20).collect()}
    assert one.keys() == two.keys() and len(one) == 7
    for g, r in one.items():
        assert two[g].n == r.n
        assert two[g].betas[:2] == pytest.approx(r.betas[:2], rel=1e-6, abs=1e-9) and two[g].betas[2] == pytest.approx(r.betas[2], rel=1e-5, abs=1e-4)
        if g != 6:
            assert (two[g].scale, two[g].mean_weight) == pytest.approx((r.scale, r.mean_weight), rel=1e-5)
    assert one[1].betas[0] == pytest.approx(2, abs=0.1)


def test_statistics_do_not_lose_digits_to_an_offset(spark):
    """Rows with 1e9 added give what they give without."""
    from tessera.operators import aggregates as A
    from tessera.operators import stats as M

    rng = np.random.default_rng(1)
    rows = [(t, q, float(np.round(rng.normal() + t, 6)), 1.0 + q / 4) for t in range(400) for q in range(3)]
    plain = spark.createDataFrame(rows, "t int, q int, x double, w double")
    moved = plain.withColumn("x", plain.x + 1e9)
    for f in (lambda d: A.tally_statistics(A.merge_tallies(A.tally(d, ["q"], "x", "w"), [])).select("variance", "se", "df"), lambda d: A.tally_statistics(A.tally(d, [], "x", "w")).select("variance", "se"), lambda d: M.intraclass_correlation(d, "t", "q", "x")):
        assert list(f(moved).first()) == pytest.approx(list(f(plain).first()), rel=1e-6)
    assert A.otsu_threshold(moved, "x").first()[0] - 1e9 == pytest.approx(A.otsu_threshold(plain, "x").first()[0], abs=1e-5)
    assert A.otsu_threshold(plain.where("t = 1 and q = 1"), "x").first()[0] == plain.where("t = 1 and q = 1").first().x
    whole = M.intraclass_correlation(plain, "t", "q", "x").first()
    odd = plain.union(plain.where("t < 3")).union(spark.createDataFrame([(999, 1, 5.0, 1.0), (998, None, None, 1.0)], plain.schema))
    assert list(M.intraclass_correlation(odd, "t", "q", "x").first()) == pytest.approx(list(whole))  # repeats are averaged, 999 is left out
    none = A.spatial_entropy(spark.createDataFrame([(None, 1.0), (None, 2.0), (1, 3.0)], "g int, x double"), ["g"], "x")
    assert {r.g for r in none.collect()} == {None, 1}
