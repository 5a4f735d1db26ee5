"""Scalar column functions: missing values, thresholds, correlation and conjunction statistics, coordinates.

All of them are built from Spark's own functions and stay in generated code.
"Good" means neither null, NaN nor infinite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def good(x: Col) -> Column:
    """``x`` where it is finite, else null, so that Spark's aggregates skip it."""
    x = col(x)
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def steady_sum(x: Col) -> Column:
    """The sum of a column's doubles, the same in whatever order they come: of values below 10^12 six decimals are added exactly, and what they leave out has hardly an error."""
    x = col(x).cast("double")
    whole = F.coalesce(x.try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    return F.sum(whole).cast("double") + F.sum(x - whole.cast("double"))


def steady_mean(x: Col) -> Column:
    x = col(x)
    return F.try_divide(steady_sum(x), F.count(x))


def is_bad(x: Col) -> Column:
    """Whether ``x`` is null, NaN or infinite."""
    return good(x).isNull()


def fill_bad(x: Col, value: float | Column) -> Column:
    """``x`` with bad values replaced."""
    return F.coalesce(good(x), value if isinstance(value, Column) else F.lit(float(value)))


def clamp(x: Col, low: float, high: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(high)), F.lit(low))


def in_range(x: Col, low: float, high: float) -> Column:
    return col(x).between(low, high)


def mask_values(x: Col, limit: float, side: int = 1) -> Column:
    """``x`` where it is at most (side < 0), equal to (0) or at least (> 0) the limit, else 0."""
    x = col(x)
    ok = x <= limit if side < 0 else x == limit if side == 0 else x >= limit
    return F.when(ok, x).otherwise(F.lit(0.0))


def threshold_map(x: Col, low: float, high: float, tails: int = 3) -> Column:
    """Values between two thresholds scaled to 0..1 with their sign; ``tails`` 1 positive, 2 negative, 3 both."""
    x = col(x)
    ok = F.abs(x) >= low
    if tails == 1:
        ok &= x > 0
    elif tails == 2:
        ok &= x < 0
    return F.when(ok, F.least(F.lit(1.0), (F.abs(x) - low) / (high - low)) * F.signum(x)).otherwise(F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.try_divide(a, b)


def correlation_t(r: Col, n: Col) -> Column:
    """t of a correlation over n pairs; 0 where the correlation is beyond 1."""
    r, n = col(r), col(n)
    return F.when(F.abs(r) > 1, F.lit(0.0)).otherwise(r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))


def t_correlation(t: Col, n: Col) -> Column:
    t = col(t)
    return t / F.sqrt(t * t + col(n) - 2)


def fisher_z(r: Col, n: Col | None = None) -> Column:
    """Fisher's z of a correlation; divided by its standard error where n > 3 is given."""
    r = col(r)
    z = 0.5 * F.log(F.try_divide(1 + r, 1 - r))
    return z if n is None else F.when(col(n) > 3, z * F.sqrt(col(n) - 3)).otherwise(z)


def fisher_r(z: Col) -> Column:
    return F.tanh(col(z))


def independent_correlations_z(r1: Col, n1: Col, r2: Col, n2: Col) -> Column:
    return (fisher_z(r1) - fisher_z(r2)) / F.sqrt(1 / (col(n1) - 3) + 1 / (col(n2) - 3))


def conjunction(*xs: Col) -> Column:
    """The value nearest to 0 where all have one sign, else 0."""

    def two(a: Column, b: Column) -> Column:
        return F.when(F.signum(a) == F.signum(b), F.signum(a) * F.least(F.abs(a), F.abs(b))).otherwise(F.lit(0.0))

    return reduce(two, map(col, xs))


def conjunction_p(*ps: Col) -> Column:
    """The signed p-value farthest from 0 where all have one sign, else 1; within -1..1, and 0 counts as 1."""

    def two(a: Column, b: Column) -> Column:
        return F.when(F.signum(a) == F.signum(b), F.signum(a) * F.greatest(F.abs(a), F.abs(b))).otherwise(F.lit(0.0))

    p = clamp(reduce(two, map(col, ps)), -1.0, 1.0)
    return F.when(p == 0, F.lit(1.0)).otherwise(p)


def crawford_t(x: Col, mean: Col, sd: Col, n: Col) -> Column:
    """t of a single case against a control sample."""
    return F.try_divide(col(x) - col(mean), col(sd) * F.sqrt((col(n) + 1) / col(n)))


def p_adjust_size(n: Col) -> Column:
    """The harmonic factor ln n + 0.5772 of dependent tests."""
    return F.log(col(n)) + 0.5772


def norm(*xs: Col) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [col(x) * col(x) for x in xs]))


def distance(xs: list[Col], ys: list[Col]) -> Column:
    return norm(*[col(a) - col(b) for a, b in zip(xs, ys, strict=True)])


def spherical(x: Col, y: Col, z: Col) -> dict[str, Column]:
    """Radius, azimuth and elevation."""
    return {"r": norm(x, y, z), "azimuth": F.atan2(col(y), col(x)), "elevation": F.atan2(col(z), norm(x, y))}


def cartesian(r: Col, azimuth: Col, elevation: Col) -> dict[str, Column]:
    r, a, e = col(r), col(azimuth), col(elevation)
    return {"x": r * F.cos(e) * F.cos(a), "y": r * F.cos(e) * F.sin(a), "z": r * F.sin(e)}


def affine(m: list[list[float]], xs: list[Col]) -> list[Column]:
    """Rows of an affine matrix (with or without a last translation column) applied to coordinates."""
    out = []
    for row in m:
        terms = [w * col(x) for w, x in zip(row, xs, strict=False)]
        if len(row) > len(xs):
            terms.append(F.lit(float(row[len(xs)])))
        out.append(reduce(lambda a, b: a + b, terms))
    return out


# fixed values: the two linear maps between the MNI and Talairach frames, above and below the commissural plane
MNI_TO_TAL_ABOVE = [[0.99, 0.0, 0.0], [0.0, 0.9688, 0.046], [0.0, -0.0485, 0.9189]]
MNI_TO_TAL_BELOW = [[0.99, 0.0, 0.0], [0.0, 0.9688, 0.042], [0.0, -0.0485, 0.839]]


def mni_to_talairach(x: Col, y: Col, z: Col) -> list[Column]:
    up, down = affine(MNI_TO_TAL_ABOVE, [x, y, z]), affine(MNI_TO_TAL_BELOW, [x, y, z])
    return [F.when(col(z) < 0, d).otherwise(u) for u, d in zip(up, down, strict=True)]


def rgb_to_hsv(r: Col, g: Col, b: Col) -> dict[str, Column]:
    """Hue 0..1, saturation 0..1 and value 0..255 of 0..255 colours."""
    r, g, b = col(r), col(g), col(b)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    h = F.when(d == 0, F.lit(0.0)).when(high == r, F.try_divide(g - b, d)).when(high == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4) / 6
    return {"h": F.when(h < 0, h + 1).otherwise(h), "s": F.when(high == 0, F.lit(0.0)).otherwise(F.try_divide(d, high)), "v": high}


def pack_colour(r: Col, g: Col, b: Col) -> Column:
    return F.shiftleft(col(r).cast("int"), 16).bitwiseOR(F.shiftleft(col(g).cast("int"), 8)).bitwiseOR(col(b).cast("int"))


def linear_index(subs: list[Col], sizes: list[int]) -> Column:
    """1-based column-major index of 1-based subscripts."""
    out, step = F.lit(1).cast("long"), 1
    for s, n in zip(subs, sizes, strict=True):
        out = out + (col(s) - 1) * step
        step *= n
    return out


def subscripts(index: Col, sizes: list[int]) -> list[Column]:
    out, step = [], 1
    for n in sizes:
        out.append(F.pmod(F.floor((col(index) - 1) / step), F.lit(n)) + 1)
        step *= n
    return out


def series_lag_kernel(r: Col, tr: float) -> Column:
    """Temporal smoothing width (FWHM, in units of tr) whose noise has the lag-1 autocorrelation r."""
    return F.when(col(r) > 0, tr * F.sqrt(-2 * F.log(F.lit(2.0)) / F.log(col(r)))).otherwise(F.lit(0.0))


#: Modulus of the draws: a prime whose squares fit into 64 bits.
PRIME = 2_147_483_647


def drawn(key: Col, seed: int) -> Column:
    """A number from 0 to PRIME that depends on an integer key and the seed alone: squares modulo a prime, which SQL can draw the same."""
    x = (col(key) % PRIME * 31 + seed * 104_729) % PRIME
    for c in (12_345, 67_891, 24_680):
        x = (x * x + c) % PRIME
    return x
