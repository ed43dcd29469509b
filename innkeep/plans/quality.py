"""Data quality: intake normalisation (J22), constraint audit (J21),
unique-violation classification (J28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.intake import RULES
from innkeep.sources.schemas import ENUMS, FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_KEYS


def normalise_intake(df: DataFrame, spec: dict[str, tuple], keys: list[str]):
    """Apply ``spec`` ``{column: (rule, *args)}`` to ``df``.

    Returns ``(clean, rejects)``: ``clean`` has the normalised columns and
    an ``is_valid`` flag; ``rejects`` is long form ``(keys..., column,
    reason)``, built in one pass (array of structs, exploded).
    """
    cleaned, checks = [], []
    for col, (rule, *args) in spec.items():
        val, reason = RULES[rule](F.col(col), *args)
        cleaned.append(val.alias(col))
        checks.append(F.struct(F.lit(col).alias("column"), reason.alias("reason")))
    all_ok = F.lit(True)
    for chk in checks:
        all_ok = all_ok & chk["reason"].isNull()
    clean = df.select(*keys, *cleaned, all_ok.alias("is_valid"))
    rejects = df.select(*keys, F.inline(F.array(*checks))).filter(F.col("reason").isNotNull())
    return clean, rejects


def _key_str(cols):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def audit_constraints(T, tables: list[str] | None = None) -> DataFrame:
    """``(table_name, rule, n_violations, sample_key)`` per violated rule.

    Rules: primary key null/duplicate, unique keys, enums, row checks and
    foreign keys (non-null child value without a parent row).  Counts are
    aggregated per rule, so the output is small whatever the input size.
    """
    tables = tables or [t for t in PRIMARY_KEYS if t in T]
    parts: list[DataFrame] = []

    def add(table, rule, rows: DataFrame, key_cols):
        parts.append(rows.select(_key_str(key_cols).alias("k")).agg(
            F.count(F.lit(1)).alias("n_violations"), F.min("k").alias("sample_key"))
            .filter("n_violations > 0")
            .select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                    "n_violations", "sample_key"))

    for t in tables:
        df = T[t]
        pk = PRIMARY_KEYS[t]
        # row rules: one pass over the table, one (count, sample) pair per rule
        row_rules = [("pk_null", F.col(pk[0]).isNull())]
        for (tab, col), values in ENUMS.items():
            if tab == t:
                row_rules.append((f"enum_{col}", F.col(col).isNotNull() & ~F.col(col).isin(*values)))
        row_rules += [(rule, ~cond) for rule, cond in _checks(t)]
        key = _key_str(pk)
        aggs = []
        for i, (_rule, bad) in enumerate(row_rules):
            aggs += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, key)).alias(f"k{i}")]
        wide = df.agg(*aggs)
        long = wide.select(F.inline(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("n_violations"),
                     F.col(f"k{i}").alias("sample_key")) for i, (rule, _b) in enumerate(row_rules)])))
        parts.append(long.filter("n_violations > 0").select(
            F.lit(t).alias("table_name"), "rule", "n_violations", "sample_key"))
        add(t, "pk_duplicate", df.filter(F.col(pk[0]).isNotNull()).groupBy(*pk).count()
            .filter("count > 1"), pk)
        for uk in UNIQUE_KEYS.get(t, []):
            nn = df
            for c in uk:
                nn = nn.filter(F.col(c).isNotNull())
            add(t, "unique_" + "_".join(uk), nn.groupBy(*uk).count().filter("count > 1"), uk)
    # foreign keys: references are counted per value first (a hot value is one
    # row per task); all references to one parent key are then checked together,
    # so each parent is scanned and shuffled once (one anti-join per parent)
    by_parent: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for child, ccol, parent, pcol, _action in FOREIGN_KEYS:
        if child in tables and parent in T:
            by_parent.setdefault((parent, pcol), []).append((child, ccol))
    for (parent, pcol), refs in by_parent.items():
        vtype = T[parent].schema[pcol].dataType
        refs_df = None
        for child, ccol in refs:
            r = T[child].filter(F.col(ccol).isNotNull()).select(
                F.lit(child).alias("table_name"), F.lit(f"fk_{ccol}").alias("rule"),
                F.col(ccol).cast(vtype).alias("_v")).groupBy("table_name", "rule", "_v").agg(F.count(F.lit(1)).alias("_n"))
            refs_df = r if refs_df is None else refs_df.unionByName(r)
        orphans = refs_df.join(T[parent].select(F.col(pcol).alias("_v")), "_v", "left_anti")
        parts.append(orphans.groupBy("table_name", "rule").agg(
            F.sum("_n").alias("n_violations"), F.min(F.col("_v").cast("string")).alias("sample_key"))
            .select("table_name", "rule", "n_violations", "sample_key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _checks(t):
    c = F.col
    rules = {
        "hotel": [("check_category", c("category").between(1, 5)),
                  ("check_total_rooms", c("total_rooms") >= 1)],
        "person": [("check_id_type", c("id_type") == "SIN"),
                   ("check_legal_id", c("legal_id").rlike("^[0-9]{9}$"))],
        "room": [("check_base_price", c("base_price") > 0)],
        "booking": [("check_dates", c("end_date") > c("start_date"))],
        "renting": [("check_dates", c("end_date") > c("start_date"))],
        "payment": [("check_amount", c("amount") > 0)],
        "auth_account": [("check_role_ids",
                          F.when(c("role") == "admin", c("employee_id").isNull() & c("customer_id").isNull())
                          .when(c("role").isin("manager", "employee"),
                                c("employee_id").isNotNull() & c("customer_id").isNull())
                          .when(c("role") == "customer",
                                c("customer_id").isNotNull() & c("employee_id").isNull())
                          .otherwise(True))],
        "archive": [("check_source",
                     F.when(c("record_type") == "booking", c("source_renting_id").isNull())
                     .otherwise(True))],
    }
    return [(n, F.coalesce(cond, F.lit(True))) for n, cond in rules.get(t, [])]


# Unique key -> violation code.
VIOLATION_CODES = {"unique_username": "username_taken", "unique_email": "email_registered",
                   "unique_legal_id": "sin_registered"}


def classify_violation(reason_col) -> F.Column:
    """Map a unique-rule name to a user-facing code."""
    r = F.col(reason_col) if isinstance(reason_col, str) else reason_col
    out = F.lit("duplicate_unique_value")
    for k, v in reversed(list(VIOLATION_CODES.items())):
        out = F.when(r == k, F.lit(v)).otherwise(out)
    return out
