"""Text functions over program text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def macro_references(text: Column) -> Column:
    """Names called as %name, in order."""
    return F.regexp_extract_all(text, F.lit(r"%([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def identifiers(text: Column) -> Column:
    """Distinct words that are names, in order of their first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z_][a-z0-9_]*)\b"), F.lit(1)))


def literal_value(text: Column) -> Column:
    """A wholly literal string or number as text, else null."""
    bare = F.trim(text)
    string = F.regexp_extract(bare, r"^'([^']*)'$|^\"([^\"]*)\"$", 0)
    number = F.regexp_extract(bare, r"^[+-]?[0-9]+(\.[0-9]*)?$", 0)
    return F.when(string != "", F.substring(string, F.lit(2), F.length(string) - 2)).when(number != "", number)


def dataset_name(text: Column) -> Column:
    """library.member in lower case; a bare name is in work."""
    low = F.lower(F.trim(text))
    return F.when(F.instr(low, ".") > 0, low).otherwise(F.concat(F.lit("work."), low))


def numbered_range(prefix: Column, low: Column, high: Column, width: Column) -> Column:
    """x1-x3 as x1, x2, x3, descending ranges too, padded with zeros to the width."""
    return F.transform(F.sequence(low, high), lambda i: F.concat(prefix, F.lpad(i.cast("string"), F.greatest(width, F.length(i.cast("string"))), F.lit("0"))))


def normalise_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def diagram_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")


def condition(lhs: Column, op: str, rhs: Column) -> Column:
    """A simple macro condition: text compared whatever the case; null where either side is unknown."""
    same = F.lower(lhs) == F.lower(rhs)
    if op in ("=", "eq"):
        return same
    if op in ("^=", "~=", "!=", "ne"):
        return ~same
    return F.lit(None).cast("boolean")


# Intervals of dates by their months; days and weeks (from Sunday) have none.
MONTHS = {"month": 1, "qtr": 3, "semiyear": 6, "year": 12}


def _months(date):
    return F.year(date) * 12 + F.month(date) - 1


def intck(interval: str, a, b):
    """How many starts of an interval lie after date a, up to date b."""
    if interval in MONTHS:
        of = lambda d: F.floor(_months(d) / F.lit(MONTHS[interval]))
        return (of(b) - of(a)).cast("int")
    days = {"day": F.datediff(b, a), "week": F.floor((F.datediff(b, F.lit("1970-01-04")) / 7)) - F.floor(F.datediff(a, F.lit("1970-01-04")) / 7)}
    return days[interval].cast("int")


def intnx(interval: str, date, n: int):
    """The first day of the interval that is n intervals after the date's own."""
    if interval in MONTHS:
        start = F.floor(_months(date) / F.lit(MONTHS[interval])) * MONTHS[interval] + n * MONTHS[interval]
        return F.make_date(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1))
    return {"day": F.date_add(date, n), "week": F.date_add(F.date_sub(date, F.dayofweek(date) - 1), 7 * n)}[interval]


#: Names of row functions in analysed programs, as Spark columns.  Their values are Spark's own.
SCALARS = {
    "upcase": F.upper, "lowcase": F.lower, "propcase": F.initcap, "strip": F.trim, "trim": F.rtrim, "left": lambda c: F.rpad(F.ltrim(c), F.length(c), F.lit(" ")),
    "compress": lambda c: F.regexp_replace(c, " ", ""), "compbl": lambda c: F.regexp_replace(c, " +", " "),
    "right": lambda c: F.lpad(F.rtrim(c), F.length(c), F.lit(" ")),
    "substr": lambda c, at, n: F.substring(c, at, n), "scan": lambda c, k, by: F.get(F.split(c, by), k - 1),
    "index": lambda c, s: F.instr(c, s), "find": lambda c, s: F.locate(s, c), "length": lambda c: F.greatest(F.length(F.rtrim(c)), F.lit(1)),
    "lengthn": lambda c: F.length(F.rtrim(c)), "cat": F.concat, "cats": lambda *c: F.concat(*[F.trim(x) for x in c]),
    "catt": lambda *c: F.concat(*[F.rtrim(x) for x in c]), "catx": lambda by, *c: F.concat_ws(by, *[F.trim(x) for x in c]),
    "tranwrd": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)), "translate": lambda c, to, frm: F.translate(c, frm, to),
    "coalesce": F.coalesce, "coalescec": F.coalesce, "ifn": lambda c, a, b: F.when(c, a).otherwise(b), "ifc": lambda c, a, b: F.when(c, a).otherwise(b),
    "missing": F.isnull, "sum": lambda *c: F.aggregate(F.array_compact(F.array(*c)), F.lit(0.0), lambda a, x: a + x),
    "mean": lambda *c: F.aggregate(F.array_compact(F.array(*c)), F.lit(0.0), lambda a, x: a + x) / F.size(F.array_compact(F.array(*c))),
    "min": F.least, "max": F.greatest, "n": lambda *c: F.size(F.array_compact(F.array(*c))), "nmiss": lambda *c: F.lit(len(c)) - F.size(F.array_compact(F.array(*c))),
    "round": F.round, "int": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "ceil": F.ceil, "floor": F.floor, "abs": F.abs, "mod": lambda a, b: a % b,
    "datepart": F.to_date, "timepart": lambda c: F.date_format(c, "HH:mm:ss"), "year": F.year, "month": F.month, "day": F.day,
    "mdy": lambda m, d, y: F.make_date(y, m, d), "intck": intck, "intnx": intnx,
}
