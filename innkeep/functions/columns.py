"""Column expressions (B*, C*): all built-in Spark functions, no UDFs."""

from __future__ import annotations

import datetime as _dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_date", "date_or_col", "area", "full_name", "capacity_weight", "overlaps", "covers",
    "blank_as_null", "all_of",
    "payment_method_label", "payment_method_intake", "archive_source_label",
    "fmt_date", "fmt_timestamp", "status_slug", "view_flags",
    "toronto_today", "display_name",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(d) -> Column:
    """Literal date from ``'yyyy-mm-dd'`` / ``date`` / Column."""
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


_ISO = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def date_or_col(x) -> Column:
    """ISO date strings and ``date`` values become literals, other strings columns."""
    if isinstance(x, str) and not _ISO.match(x):
        return F.col(x)
    return as_date(x)


def area(address) -> Column:
    """B1: second comma part, trimmed of spaces only, else the whole address."""
    a = _c(address)
    return F.coalesce(F.nullif(F.btrim(F.split_part(a, F.lit(","), F.lit(2))), F.lit("")), a)


def full_name(first, last) -> Column:
    """B2: ``first || ' ' || last`` (NULL if either part is NULL)."""
    return F.concat(_c(first), F.lit(" "), _c(last))


# Guests per capacity class (anything else counts 0).


def capacity_weight(capacity) -> Column:
    """Capacity -> number of guests."""
    c = _c(capacity)
    expr = F.when(c == "single", 1).when(c == "double", 2).when(c == "suite", 3) \
        .when(c == "family", 4).otherwise(0)
    return expr


def overlaps(s1, e1, s2, e2) -> Column:
    """Half-open ``[s1,e1) && [s2,e2)``; empty ranges overlap nothing."""
    s1, e1, s2, e2 = (date_or_col(x) for x in (s1, e1, s2, e2))
    return (s1 < e2) & (s2 < e1) & (s1 < e1) & (s2 < e2)


def covers(start, end, day) -> Column:
    """``[start,end) @> day``."""
    d = date_or_col(day)
    return (_c(start) <= d) & (d < _c(end))


def blank_as_null(c) -> Column:
    """C4: NULL when the value is NULL or only spaces."""
    return F.nullif(F.btrim(_c(c)), F.lit(""))


def all_of(conds) -> Column:
    """AND of a list of optional conjuncts (C1); TRUE when empty."""
    conds = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def payment_method_label(method) -> Column:
    """B6 (report side): stored ``credit`` is shown as ``card``."""
    m = _c(method)
    return F.when(m == "credit", F.lit("card")).otherwise(m)


def payment_method_intake(method) -> Column:
    """B6 (intake side): ``card`` is stored as ``credit``."""
    m = F.lower(F.btrim(_c(method)))
    return F.when(m == "card", F.lit("credit")).otherwise(m)


def archive_source_label(record_type, booking_id, renting_id) -> Column:
    """``B#id`` / ``R#id`` / ``-``."""
    rt = _c(record_type)
    b = F.concat(F.lit("B#"), _c(booking_id).cast("string"))
    r = F.concat(F.lit("R#"), _c(renting_id).cast("string"))
    return F.coalesce(F.when(rt == "booking", b).otherwise(r), F.lit("-"))


def fmt_date(c) -> Column:
    """Date as ``yyyy-MM-dd``."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def fmt_timestamp(c) -> Column:
    """Timestamp as ``yyyy-MM-dd HH:mm``."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm")


def status_slug(c) -> Column:
    """Lower-case status with every char outside ``[a-z_]`` -> ``_``."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z_]", "_")


def view_flags(view) -> tuple[Column, Column]:
    """Legacy view code -> (has_sea_view, has_mountain_view), exact codes."""
    v = _c(view)
    return v.isin("sea", "sea_mountain"), v.isin("mountain", "sea_mountain")


def toronto_today(ts) -> Column:
    """Local calendar day in America/Toronto for a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(_c(ts), "America/Toronto"))


def display_name(emp_first, emp_last, cust_first, cust_last) -> Column:
    """Employee name, else customer name, else 'Administrator'."""
    return F.coalesce(full_name(emp_first, emp_last), full_name(cust_first, cust_last),
                      F.lit("Administrator"))
