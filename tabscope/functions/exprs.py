"""Small column-expression helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio0(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 when den is 0 (for confidences)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


# SQL-text builders.  Wide passes are written as SQL expressions and handed to
# ``selectExpr`` in one call: building thousands of Column objects one py4j
# call at a time costs more than the scan itself on small tables.
def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_id(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_double(x: float) -> str:
    import math

    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return repr(float(x)) + "D"


def sql_credit_card(q: str) -> str:
    """Does the text hold a number of 13 to 19 digits that passes the Luhn check?

    Digit groups parted by single spaces or hyphens are read together; every run of whole neighbouring groups is tried, so a
    card is found beside other numbers, and no piece of a longer group counts."""
    runs = f"regexp_extract_all({q}, {sql_str('[0-9]+(?:[ -][0-9]+)*')}, 0)"
    tried = ("flatten(transform(g, (x, i) -> transform(sequence(1, least(19, size(g) - i)), n -> array_join(slice(g, i + 1, n), ''))))")
    fits = f"exists(filter({tried}, c -> length(c) BETWEEN 13 AND 19), c -> luhn_check(c))"
    groups = f"transform(filter({runs}, r -> length(r) >= 13), r -> split(r, {sql_str('[ -]')}))"
    return f"exists({groups}, g -> {fits})"


_META = set("\\^$.|?*+()[]{}")


def literal_prefix(regex: str) -> str:
    """Text that every match of an unanchored regex must begin with (may be empty)."""
    if "|" in regex or regex.startswith("(?"):
        return ""
    n = next((i for i, c in enumerate(regex) if c in _META), len(regex))
    if n < len(regex) and regex[n] in "?*{":
        n -= 1  # the last character is optional
    return regex[:max(0, n)]


def sql_matches(q: str, regex: str, needs: str = "") -> str:
    """Does the text hold a match?  Conditions that every match needs and that cost little come first: ``needs``,
    else the regex's literal beginning."""
    test = f"{q} RLIKE {sql_str(regex)}"
    start = literal_prefix(regex)
    needs = needs or (f"contains({{q}}, {sql_str(start)})" if start else "")
    return f"coalesce({needs.format(q=q)} AND {test}, false)" if needs else f"coalesce({test}, false)"
