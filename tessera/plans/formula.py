"""Formulas over maps and predicates over point tables, as column expressions.

Both are token rewrites into Spark's own expression language: names and
functions are checked against a white list, nothing is evaluated in Python, and
Spark parses and plans the result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = frozenset("abs sqrt exp log log2 log10 pow power sign signum floor ceil round least greatest sin cos tan asin acos atan atan2 tanh sinh cosh isnan coalesce nullif if array array_min array_max".split())
_ALLOWED = re.compile(r"^[\w\s+\-*/%^~().,<>=!&|#$:'*]*$")


def _maps(text: str) -> list[int]:
    """Map numbers of ``i``, ``i:j`` or ``i:step:j``."""
    parts = [int(p) for p in text.split(":")]
    if len(parts) == 1:
        return parts
    step = parts[1] if len(parts) == 3 else 1
    return list(range(parts[0], parts[-1] + 1, step))


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|('[^']*')|[#$](\d+(?::\d+){0,2})|([A-Za-z_]\w*)|(->|\.\^|\.\*|\./|&&|\|\||==|~=|!=|<>|>=|<=|[-+*/%^(),<>=!~&|]))")
_LEVEL = {"or": 1, "|": 1, "||": 1, "and": 2, "&": 2, "&&": 2, "==": 3, "=": 3, "~=": 3, "!=": 3, "<>": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "*": 5, ".*": 5, "/": 5, "./": 5, "%": 5, "^": 7, ".^": 7}
_SQL = {"|": "OR", "||": "OR", "or": "OR", "&": "AND", "&&": "AND", "and": "AND", "==": "=", "~=": "<>", "!=": "<>", ".*": "*"}


def _quotient(a: str, b: str) -> str:
    """Division as in floating point: by zero it gives an infinity, or NaN for 0 / 0."""
    return f"if(({b}) = 0, ({a}) * double('Infinity'), ({a}) / ({b}))"


def rewrite(formula: str, prefix: str = "m", extra: frozenset[str] = frozenset()) -> str:
    """A formula as a Spark SQL expression: ``#2`` and ``$2`` are map columns, ``#1:3`` the arguments of a list function.

    Operators work element by element with or without their dot; ``^`` is a power
    that binds tighter than a sign before it; ``x / 0`` is an infinity.
    """
    if not _ALLOWED.match(formula):
        raise ValueError(f"character not allowed in a formula: {formula!r}")
    tokens, at = [], 0
    while formula[at:].strip():
        m = _TOKEN.match(formula, at)
        if not m:
            raise ValueError(f"not a formula: {formula[at:]!r}")
        tokens.append(m.groups())
        at = m.end()
    place = 0

    def ahead() -> str | None:
        if place == len(tokens):
            return None
        name, op = tokens[place][3], tokens[place][4]
        return name.lower() if name and name.lower() in ("and", "or", "not") else op

    def expect(op: str) -> None:
        nonlocal place
        if ahead() != op:
            raise ValueError(f"{op} is missing in {formula!r}")
        place += 1

    def operand() -> str:
        nonlocal place
        if place == len(tokens):
            raise ValueError(f"the formula ends early: {formula!r}")
        number, text, maps, name, op = tokens[place]
        if op in ("-", "+", "!", "~") or ahead() == "not":
            place += 1
            return f"(NOT {expression(3)})" if op in ("!", "~", None) else f"({op}{expression(6)})"
        place += 1
        if number or text:
            return number or text
        if maps:
            return ", ".join(f"{prefix}{i}" for i in _maps(maps))
        if name:
            if ahead() != "(":
                if name not in extra and not re.fullmatch(rf"{prefix}\d+", name):
                    raise ValueError(f"name not allowed in a formula: {name}")
                return name
            if name not in FUNCTIONS and name not in extra:
                raise ValueError(f"name not allowed in a formula: {name}")
            place += 1
            inner = []
            while ahead() != ")":
                inner.append(expression(1))
                if ahead() == ",":
                    place += 1
            place += 1
            return f"{name}({', '.join(inner)})"
        if op == "(":
            inner = expression(1)
            expect(")")
            return f"({inner})"
        raise ValueError(f"not a formula: {formula!r}")

    def expression(least: int) -> str:
        nonlocal place
        left = operand()
        while (op := ahead()) in _LEVEL and _LEVEL[op] >= least:
            place += 1
            level = _LEVEL[op]
            right = expression(level if level == 7 else level + 1)
            if level == 7:
                left = f"power({left}, {right})"
            elif op in ("/", "./"):
                left = _quotient(left, right)
            else:
                left = f"({left} {_SQL.get(op, op)} {right})"
        return left

    out = expression(1)
    if place < len(tokens):
        raise ValueError(f"not a formula: {formula!r}")
    return out


def compute(df: DataFrame, formula: str, out: str = "value", prefix: str = "m", extra: frozenset[str] = frozenset()) -> DataFrame:
    """``df`` with the formula's value as a column."""
    return df.withColumn(out, F.expr(rewrite(formula, prefix, extra)))


_TERM = re.compile(r"\s*\$(\w+)\s*(==|~=|!=|>=|<=|>|<)\s*('[^']*'|[-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*")


def predicate(text: str, columns: list[str]) -> Column:
    """``$Column op value`` terms joined by ``&``, ``|`` and parentheses, as a Column.

    Text is compared in any case, and ``*`` in it stands for any characters.
    A name may be cut short: the longest column that it begins with counts.
    """
    pos, n = 0, len(text)

    def column(name: str) -> Column:
        fits = [c for c in columns if name.lower() == c.lower()] or [c for c in columns if name.lower().startswith(c.lower())]
        if not fits:
            raise ValueError(f"no column {name}")
        return F.col(max(fits, key=len))

    def term() -> Column:
        nonlocal pos
        while pos < n and text[pos].isspace():
            pos += 1
        if pos < n and text[pos] == "(":
            pos += 1
            inner = either()
            while pos < n and text[pos].isspace():
                pos += 1
            if pos >= n or text[pos] != ")":
                raise ValueError("a parenthesis is missing")
            pos += 1
            return inner
        m = _TERM.match(text, pos)
        if not m:
            raise ValueError(f"not a predicate: {text[pos:]!r}")
        pos = m.end()
        name, op, value = m.groups()
        c = column(name)
        if value.startswith("'"):
            v = value[1:-1]
            pattern = "(?i)^" + ".*".join(re.escape(p) for p in v.split("*")) + "$"
            hit = c.rlike(pattern) if "*" in v else F.lower(c) == v.lower()
            if op not in ("==", "~=", "!="):
                raise ValueError("text can only be compared for equality")
            return hit if op == "==" else ~hit
        v = F.lit(float(value))
        return {"==": c == v, "~=": c != v, "!=": c != v, ">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v}[op]

    def both() -> Column:
        nonlocal pos
        out = term()
        while pos < n:
            m = re.compile(r"\s*&&?\s*").match(text, pos)
            if not m:
                break
            pos = m.end()
            out = out & term()
        return out

    def either() -> Column:
        nonlocal pos
        out = both()
        while pos < n:
            m = re.compile(r"\s*\|\|?\s*").match(text, pos)
            if not m:
                break
            pos = m.end()
            out = out | both()
        return out

    result = either()
    if text[pos:].strip():
        raise ValueError(f"not a predicate: {text[pos:]!r}")
    return result


def select_points(df: DataFrame, condition: str) -> DataFrame:
    return df.where(predicate(condition, df.columns))


def select(df: DataFrame, clause: str, group_by: list[str] | None = None) -> DataFrame:
    """``SELECT a, AVG(b) AS m WHERE c > 1 AND d LIKE 'x%'`` over a table: Spark SQL does the work on a view of ``df``."""
    m = re.fullmatch(r"\s*select\s+(.*?)(?:\s+from\s+\w+)?(?:\s+where\s+(.*?))?\s*", clause, re.I | re.S)
    if not m or ";" in clause:
        raise ValueError("SELECT list [WHERE condition] is expected")
    sql = f"SELECT {m[1]} FROM {{df}}" + (f" WHERE {m[2]}" if m[2] else "") + (f" GROUP BY {', '.join(group_by)}" if group_by else "")
    return df.sparkSession.sql(sql, df=df)
