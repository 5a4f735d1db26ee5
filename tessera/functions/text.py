"""String column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import Col, col


def split(s: Col, delimiters: str, collapse: bool = False) -> Column:
    """Parts between any of the delimiter characters; with ``collapse``, runs of them count once."""
    return F.split(col(s), f"[{re.escape(delimiters)}]" + "+" * collapse)


def glue(parts: Col, delimiter: str, end: bool = False) -> Column:
    out = F.array_join(col(parts), delimiter)
    return F.concat(out, F.lit(delimiter)) if end else out


def camel_case(s: Col) -> Column:
    """The first letter of every word in upper case, the rest as it is, without blanks."""
    words = F.split(F.trim(col(s)), " +")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def replace_all(s: Col, pairs: list[tuple[str, str]]) -> Column:
    """Several literal replacements, one after another."""
    out = col(s)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def label(s: Col) -> Column:
    """A valid name: other characters than letters, digits and _ become _, and a first non-letter gets a V_ in front."""
    clean = F.regexp_replace(col(s), "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[A-Za-z]"), clean).otherwise(F.concat(F.lit("V_"), clean))


def zero_filled(n: Col, width: int) -> Column:
    return F.lpad(col(n).cast("string"), width, "0")


def line(s: Col, number: Col) -> Column:
    """The line of that number, from 1; empty beyond the last."""
    number = col(number) if not isinstance(number, int) else F.lit(number)
    return F.coalesce(F.get(F.split(col(s), "\n"), number - 1), F.lit(""))


def plural(n: Col) -> Column:
    return F.when(col(n) == 1, "").otherwise("s")


def cell_reference(s: Col) -> dict[str, Column]:
    """Column and row numbers of an A1-style reference."""
    letters = F.upper(F.regexp_extract(col(s), "^([A-Za-z]+)", 1))
    number = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return {"column": number, "row": F.try_to_number(F.regexp_extract(col(s), "([0-9]+)$", 1), F.lit("999999999")).cast("int")}


def to_numbers(s: Col, delimiters: str = " ,;") -> Column:
    """Every part as a number; null where it is none."""
    return F.transform(split(F.trim(col(s)), delimiters, True), lambda x: x.try_cast("double"))


# fixed values: English number words
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "x x twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_word(n: Col) -> Column:
    """A number from 0 to 999,999 in English words; null beyond."""
    ones, tens = F.array(*[F.lit(w) for w in _ONES]), F.array(*[F.lit(w) for w in _TENS])
    n = col(n).cast("int")

    def below_hundred(v: Column) -> Column:
        small = F.get(ones, v)
        rest = v % 10
        return F.when(v < 20, small).otherwise(F.concat(F.get(tens, F.floor(v / 10).cast("int")), F.when(rest > 0, F.concat(F.lit("-"), F.get(ones, rest))).otherwise("")))

    def below_thousand(v: Column) -> Column:
        rest = v % 100
        head = F.concat(F.get(ones, F.floor(v / 100).cast("int")), F.lit(" hundred"))
        return F.when(v < 100, below_hundred(v)).otherwise(F.concat(head, F.when(rest > 0, F.concat(F.lit(" "), below_hundred(rest))).otherwise("")))

    high, low = F.floor(n / 1000).cast("int"), n % 1000
    large = F.concat(below_thousand(high), F.lit(" thousand"), F.when(low > 0, F.concat(F.lit(" "), below_thousand(low))).otherwise(""))
    return F.when((n < 0) | (n > 999_999), F.lit(None)).when(n < 1000, below_thousand(n)).otherwise(large)


def hex_dump(b: Col) -> Column:
    """Bytes as pairs of hexadecimal digits with blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.hex(col(b))), "(..)", "$1 "))


def bit_dump(n: Col, width: int = 8) -> Column:
    return F.lpad(F.bin(col(n)), width, "0")
