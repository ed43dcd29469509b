"""J18 (new customers) + J22 + J28: a batch of sign-ups, first come first served.

Each request is validated field by field (first failing rule wins: SIN,
names, e-mail, phone, address, user name).  A valid request is then
rejected when its SIN or e-mail is already a person, or its user name an
account ('sin_registered', 'email_registered', 'username_taken' - J28
codes, checked in that order).  Inside the batch, requests are replayed in
arrival order: a request is rejected when an earlier *accepted* request
has the same SIN, e-mail or user name (``first_come`` over these values);
rejected requests reserve nothing.  Accepted requests get new customer ids
after the current maximum, in arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions import intake as R
from innkeep.operators.first_come import first_come
from innkeep.operators.rank import global_rank

KEYS = [("legal_id", "sin_registered"), ("email", "email_registered"), ("username", "username_taken")]


def _validate(req: DataFrame) -> DataFrame:
    sin, sin_r = R.rule_sin(F.col("sin_raw"))
    fn, fn_r = R.rule_string(F.col("first_name_raw"), 80)
    ln, ln_r = R.rule_string(F.col("last_name_raw"), 80)
    em, em_r = R.rule_email(F.col("email_raw"))
    ph, ph_r = R.rule_phone(F.col("phone_raw"))
    ad, ad_r = R.rule_string(F.col("address_raw"), 255)
    un, un_r = R.rule_username(F.col("username_raw"))
    reason = F.coalesce(sin_r, fn_r, ln_r, em_r, ph_r, ad_r, un_r)
    return req.select("request_id", "arrival", sin.alias("legal_id"), fn.alias("first_name"),
                      ln.alias("last_name"), em.alias("email"), ph.alias("phone"),
                      ad.alias("address_line"), un.alias("username"), reason.alias("reason"))


def register_customers(T, requests: DataFrame, as_of) -> DataFrame:
    """``requests``: request_id, arrival, sin_raw, first_name_raw,
    last_name_raw, email_raw, phone_raw, address_raw, username_raw.
    Returns ``(request_id, accepted, reason, customer_id, legal_id, email,
    username)``."""
    v = _validate(requests).checkpoint(eager=True)
    invalid = v.filter(F.col("reason").isNotNull())
    valid = v.filter(F.col("reason").isNull())
    stored = {"legal_id": T["person"].select("legal_id"), "email": T["person"].select("email"),
              "username": T["auth_account"].select(F.lower("username").alias("username"))}
    reason = F.lit(None).cast("string")
    flagged = valid
    for key, code in reversed(KEYS):
        hit = stored[key].filter(F.col(key).isNotNull()).distinct().withColumn(f"_{key}", F.lit(True))
        flagged = flagged.join(hit, key, "left")
        reason = F.when(F.col(f"_{key}").isNotNull(), F.lit(code)).otherwise(reason)
    flagged = flagged.withColumn("reason", reason).drop(*[f"_{k}" for k, _ in KEYS]).checkpoint(eager=True)
    taken = flagged.filter(F.col("reason").isNotNull())
    live = flagged.filter(F.col("reason").isNull())
    claims = live.select("request_id", "arrival", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rule"), F.col(key).alias("value")) for i, (key, _code) in enumerate(KEYS)])).alias("c")) \
        .select("request_id", "arrival", "c.rule", "c.value").filter("value is not null").checkpoint(eager=True)
    state = first_come(live, claims, ["rule", "value"]).checkpoint(eager=True)
    # the first key shared with an earlier accepted request, the only one that holds the value
    held = claims.join(state.filter("accepted").select("request_id"), "request_id", "left_semi") \
        .select("rule", "value", F.struct("arrival", "request_id").alias("holder"))
    why = (claims.join(state.filter("not accepted").select("request_id"), "request_id", "left_semi")
           .join(held, ["rule", "value"]).filter(F.col("holder") < F.struct("arrival", "request_id"))
           .groupBy("request_id").agg(F.min("rule").alias("rule")))
    codes = F.array(*[F.lit(code) for _key, code in KEYS])
    decided = state.join(why, "request_id", "left").select(
        "request_id", "accepted", F.when(~F.col("accepted"), F.get(codes, F.col("rule"))).alias("reason"))
    out = invalid.select("request_id", F.lit(False).alias("accepted"), "reason") \
        .unionByName(taken.select("request_id", F.lit(False).alias("accepted"), "reason")).unionByName(decided)
    accepted = v.join(out.filter("accepted").select("request_id"), "request_id", "left_semi")
    mx = T["customer"].agg(F.coalesce(F.max("customer_id"), F.lit(0))).scalar()
    ids = global_rank(accepted.select("request_id", "arrival"), ["arrival", "request_id"], "_rk") \
        .select("request_id", (mx + F.col("_rk")).alias("customer_id"))
    return out.join(ids, "request_id", "left").join(v.select("request_id", "legal_id", "email", "username"),
                                                    "request_id", "left") \
        .select("request_id", "accepted", "reason", "customer_id",
                F.when(F.col("accepted"), F.col("legal_id")).alias("legal_id"),
                F.when(F.col("accepted"), F.col("email")).alias("email"),
                F.when(F.col("accepted"), F.col("username")).alias("username"))
