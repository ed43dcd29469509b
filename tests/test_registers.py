"""The registers written in order, against a replay over the given tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from innkeep.functions import intake
from innkeep.plans import registers
from innkeep.sources.bindings import register_changes


class Values:
    """Who holds the values of one unique key."""

    def __init__(self, pairs):
        self.by_value, self.by_owner = defaultdict(set), {}
        for owner, value in pairs:
            self.put(owner, value)

    def free(self, owner, value):
        return value is None or not self.by_value[value] - {owner}

    def put(self, owner, value):
        self.by_value[self.by_owner.pop(owner, None)].discard(owner)
        if value is not None:
            self.by_owner[owner] = value
            self.by_value[value].add(owner)


def rows(df):
    return [r.asDict() for r in df.collect()]


def replay(kind, T, changes):
    """One change after another over the tables as they then are."""
    t = {n: rows(T[n]) for n in ("hotel_chain", "hotel", "room", "customer", "employee", "person", "auth_account")}
    key = f"{kind}_id"
    now = {r[key]: dict(r) for r in t[kind]}
    top = max(now)
    person = {r["legal_id"]: r for r in t["person"]}
    owner_of = {r["legal_id"]: ("c", r["customer_id"]) for r in t["customer"]} | {r["legal_id"]: ("e", r["employee_id"]) for r in t["employee"]}
    who = lambda i: (kind[0], i)
    legal = Values((owner_of.get(p, p), p) for p in person)
    email = Values((owner_of.get(p, p), r["email"]) for p, r in person.items())
    names = Values((("c", a["customer_id"]) if a["customer_id"] is not None else ("e", a["employee_id"]), a["username"]) for a in t["auth_account"])
    role = {a["employee_id"]: a["role"] for a in t["auth_account"] if a["employee_id"] is not None}
    boss = Values((who(r["employee_id"]), r["hotel_id"]) for r in t["employee"] if r["is_manager"])
    number = Values((who(r["room_id"]), (r["hotel_id"], r["room_number"])) for r in t["room"])
    title = Values((who(r["hotel_id"]), (r["chain_id"], r["hotel_name"])) for r in t["hotel"])
    hotels, chains = {r["hotel_id"] for r in t["hotel"]}, {r["chain_id"] for r in t["hotel_chain"]}
    out = {}
    for c in sorted(changes, key=lambda c: (c["ord"], c["change_id"])):
        insert, scope, why = c["op"] == "insert", c.get("scope_hotel"), None
        if insert:
            top += 1
        i = top if insert else c[key]
        mail = (c.get("email") or "").strip().lower()
        if kind == "customer":
            why = "invalid_email" if "@" not in mail else None
            user = f"customer{i}" if insert and c["username"] is None else c["username"]
            wants = [(legal, "taken_legal_id", c["legal_id"])] * insert + [(email, "taken_email", mail)] + \
                [(names, "taken_username", user)] * (user is not None)
            home = now.get(i, {}).get("hotel_id")
        elif kind == "employee":
            hotel = scope if scope is not None else c["hotel_id"]
            rank = "employee" if scope is not None else c["account_role"]
            why = "not_int_ge_min" if hotel < 1 else "not_allowed" if rank == "owner" else "no_such_hotel" if hotel not in hotels else None
            wants = [(boss, "second_manager", hotel if rank == "manager" else None)] + [(legal, "taken_legal_id", c["legal_id"])] * insert + \
                [(email, "taken_email", mail), (names, "taken_username", c["username"])]
            home = now[i]["hotel_id"] if i in now and role.get(i) == "employee" else None
        elif kind == "hotel":
            why = "not_int_ge_min" if c["category"] not in "12345" else "no_such_chain" if c["chain_id"] not in chains else None
            wants, home = [(title, "taken_name", (c["chain_id"], c["hotel_name"]))], None
        else:
            why = "not_allowed" if c["capacity"] == "other" else "no_such_hotel" if c["hotel_id"] not in hotels else None
            wants, home = [(number, "taken_number", (c["hotel_id"], c["room_number"]))], None
        if why is None and not insert and i not in now:
            why = "not_found"
        if why is None and not insert and scope is not None and home != scope:
            why = "out_of_scope"
        why = why or next((n for v, n, x in wants if not v.free(who(i), x)), None)
        if why is None:
            for v, _, x in wants:
                v.put(who(i), x)
            row = now.setdefault(i, {key: i})
            if kind == "customer" and insert:
                row.update(hotel_id=scope)
            if kind == "employee":
                row.update(hotel_id=hotel)
                role[i] = rank
            if kind in ("hotel", "room"):
                row.update({k: c[k] for k in ("chain_id", "hotel_name", "hotel_id", "room_number") if k in c and k != key})
        out[c["change_id"]] = (i, why)
    return out, now, legal, email, names


@pytest.mark.parametrize("kind", ["customer", "employee", "hotel", "room"])
def test_register_equals_replay(spark, T_small, kind):
    changes = register_changes(T_small["_raw"])[kind].checkpoint()
    want, now, legal, email, names = replay(kind, T_small, rows(changes))
    done = getattr(registers, f"write_{kind}s")(T_small, changes)
    got = {r["change_id"]: (r["id"], r["reason"]) for r in rows(done.decided)}
    assert got == want
    assert len({w for _, w in want.values()}) >= 4 and None in {w for _, w in want.values()}
    after = {r[f"{kind}_id"]: r for r in rows(done.tables[kind])}
    assert after.keys() == now.keys()
    same = {"customer": ["hotel_id"], "employee": ["hotel_id"], "hotel": ["chain_id", "hotel_name"], "room": ["hotel_id", "room_number"]}[kind]
    assert all(after[i][c] == now[i][c] for i in now for c in same)
    if kind in ("customer", "employee"):
        people = {r["legal_id"]: r for r in rows(done.tables["person"])}
        assert {v for v in people} == {v for v, o in legal.by_value.items() if o and v is not None}
        assert {i: people[r["legal_id"]]["email"] for i, r in after.items()} == {i: email.by_owner[kind[0], i] for i in after}
        users = {r[f"{kind}_id"]: r["username"] for r in rows(done.tables["auth_account"]) if r[f"{kind}_id"] is not None}
        assert users == {i: n for (k, i), n in names.by_owner.items() if k == kind[0] and i in users}


def test_dirty_numbers_are_rejected_not_raised(spark):
    texts = ["99999999999999999999", "9223372036854775807", "-5", "1e999", "-1e999", "1e308", "", None, "7x", ".5", "nan", "9" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    i, why_i = intake.rule_int(F.col("t"))
    n, why_n = intake.rule_number(F.col("t"))
    got = {r.t: (r.i, r.wi, r.n, r.wn) for r in df.select("t", i.alias("i"), why_i.alias("wi"), n.alias("n"), why_n.alias("wn")).collect()}
    assert [t for t in texts if got[t][1] is None] == ["9223372036854775807", "1e999", "1e308", "7x"]
    assert got["1e999"][2:] == (None, "not_number_ge_min") and got["1e308"][2] == 1e308 and got[".5"][2] == 0.5
    assert got["99999999999999999999"][:2] == (None, "not_int_ge_min") and got["9" * 400][2:] == (None, "not_number_ge_min")
