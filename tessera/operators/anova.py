"""Analysis of variance with several factors within and between subjects."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import good


def _subsets(items: list[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(items) + 1) for c in combinations(items, k)]


def factorial(df: DataFrame, subject: str, between: list[str], within: list[str], x: str) -> DataFrame:
    """effect (factors joined by ``:``), ss, df, error_ss, error_df and f of every effect of a design in which each subject has a value in every cell of the within factors.

    Sums of squares come by inclusion and exclusion from the sums of the margins,
    which one pass over grouping sets gives, about the grand mean.  An effect is
    tested against subjects (within the between factors) crossed with its within
    part.  Several values of a subject in a cell count as their mean; subjects
    with an empty cell are left out.  Groups may differ in size.
    """
    factors = [*between, *within]
    cells = df.select(subject, *factors, good(x).alias("_x")).where("_x is not null").groupBy(subject, *factors).agg(F.avg("_x").alias("_x"))
    full = cells.select(*within).distinct().agg(F.count("*").alias("_k")) if within else df.sparkSession.range(1).select(F.lit(1).alias("_k"))
    whole = cells.groupBy(subject).agg(F.count("*").alias("_c")).crossJoin(F.broadcast(full)).where("_c = _k").select(subject)
    cells = cells.join(whole, subject)
    cells = cells.crossJoin(F.broadcast(cells.agg(F.avg("_x").alias("_g")))).select(subject, *factors, (F.col("_x") - F.col("_g")).alias("_x"))
    margins = [*_subsets(factors), *[(subject, *between, *w) for w in _subsets(within)]]
    number = {frozenset(m): i for i, m in enumerate(margins)}
    columns = [F.col(c) for c in (subject, *factors)]
    sets = [[F.col(c) for c in m] for m in margins]
    bits = {c: 1 << i for i, c in enumerate(reversed([subject, *factors]))}  # of grouping_id: set if a column is summed over
    sums = cells.groupingSets(sets, *columns).agg(F.grouping_id().alias("_m"), F.sum("_x").alias("_s"), F.count("*").alias("_c"))
    u = sums.groupBy("_m").agg(F.sum(F.col("_s") * F.col("_s") / F.col("_c")).alias("_u"), F.count("*").alias("_l"))

    def value(of: str, m: frozenset):
        code = sum(b for c, b in bits.items() if c not in m)
        return F.coalesce(F.max(F.when(F.col("_m") == code, F.col(of))), F.lit(0)).cast("double")

    row = u.agg(*[value("_u", m).alias(f"u{i}") for m, i in number.items()], *[value("_l", m).alias(f"l{i}") for m, i in number.items()])

    def by_margins(of: str, base: frozenset, effect: tuple):
        """The part of ``effect`` beyond all that its margins (each with ``base``) explain."""
        total = F.lit(0.0)
        for m in _subsets(list(effect)):
            total = total + (-1) ** (len(effect) - len(m)) * F.col(f"{of}{number[base | frozenset(m)]}")
        return total

    out = []
    for effect in _subsets(factors)[1:]:
        inner = tuple(c for c in effect if c in within)
        subjects = frozenset([subject, *between])
        error = {of: by_margins(of, subjects, inner) - by_margins(of, frozenset(between), inner) for of in "ul"}
        ss, d = by_margins("u", frozenset(), effect), by_margins("l", frozenset(), effect)
        f = F.try_divide(F.try_divide(ss, d), F.try_divide(error["u"], error["l"]))
        out.append(F.struct(F.lit(":".join(effect)).alias("effect"), ss.alias("ss"), d.cast("long").alias("df"), error["u"].alias("error_ss"), error["l"].cast("long").alias("error_df"), f.alias("f")))
    return row.select(F.inline(F.array(*out)))
