"""Value rules for raw text fields, as Spark column expressions.

Each rule maps a raw string column to ``(clean value, reject reason)``;
reason is NULL when the value passes.  All rules are built-in SQL
functions (regex, casts), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted boolean words.
TRUE_WORDS = ["true", "1", "yes", "on", "active", "enabled", "enable"]
FALSE_WORDS = ["false", "0", "no", "off", "inactive", "disabled", "disable"]
EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
USERNAME_RE = r"^[a-z0-9._-]{3,60}$"
INT_PREFIX_RE = r"^[+-]?[0-9]+"
NUM_PREFIX_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
ISO_DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def js_trim(c: Column) -> Column:
    """Trim all leading/trailing whitespace (not only spaces); NULL -> ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def rule_string(c: Column, max_len: int, required: bool = True):
    v = js_trim(c)
    reason = F.when(F.lit(required) & (F.length(v) == 0), "required") \
        .when(F.length(v) > max_len, "too_long")
    return F.when(F.length(v) > 0, v), reason


def rule_email(c: Column, max_len: int = 120):
    v = F.lower(js_trim(c))
    reason = F.when(F.length(v) == 0, "required").when(F.length(v) > max_len, "too_long") \
        .when(~v.rlike(EMAIL_RE), "invalid_email")
    return v, reason


def _digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def rule_phone(c: Column):
    d = _digits(c)
    return d, F.when(F.length(d) != 10, "phone_not_10_digits")


def rule_sin(c: Column):
    d = _digits(c)
    return d, F.when(F.length(d) != 9, "sin_not_9_digits")


def rule_int(c: Column, min_value: int = 1):
    """Leading-integer parse (``'12abc'`` -> 12) with a lower bound."""
    p = F.regexp_extract(js_trim(c), INT_PREFIX_RE, 0)
    v = F.when(p != "", p).try_cast("decimal(38,0)")  # ANSI mode: never raise on dirty input
    v = v.try_cast("bigint")  # a whole number past bigint is no id either
    ok = v.isNotNull() & (v >= min_value)
    return F.when(ok, v), F.when(~ok | v.isNull(), "not_int_ge_min")


def rule_number(c: Column, min_value: float = 0.01):
    p = F.regexp_extract(js_trim(c), NUM_PREFIX_RE, 0)
    v = F.when(p != "", p).try_cast("double")
    ok = v.isNotNull() & (v >= min_value) & (v < float("inf"))  # 1e999 is not finite
    return F.when(ok, v), F.when(~ok | v.isNull(), "not_number_ge_min")


def rule_enum(c: Column, allowed: list[str]):
    v = js_trim(c)
    return F.when(v.isin(*allowed), v), F.when(~v.isin(*allowed), "not_allowed")


def rule_date(c: Column):
    v = js_trim(c)
    d = F.when(v.rlike(ISO_DATE_RE), F.try_to_date(v, "yyyy-MM-dd"))
    return d, F.when(d.isNull(), "invalid_date")


def rule_bool(c: Column):
    v = F.lower(js_trim(c))
    val = F.when(v.isin(*TRUE_WORDS), True).when(v.isin(*FALSE_WORDS), False)
    return val, F.when(val.isNull(), "invalid_boolean")


def rule_username(c: Column):
    v = F.lower(js_trim(c))
    return v, F.when(~v.rlike(USERNAME_RE), "invalid_username")


def rule_checkbox(c: Column):
    return (F.coalesce(c, F.lit("")) == "on"), F.lit(None).cast("string")


RULES = {"string": rule_string, "email": rule_email, "phone": rule_phone, "sin": rule_sin,
         "int": rule_int, "number": rule_number, "enum": rule_enum, "date": rule_date,
         "bool": rule_bool, "username": rule_username, "checkbox": rule_checkbox}
