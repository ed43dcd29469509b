"""Batch sign-ups equal a sequential replay."""

import datetime as dt
import random

from innkeep.plans.signup import register_customers


def sequential(reqs, persons, emails, usernames):
    sins, mails, users = set(persons), set(emails), {u.lower() for u in usernames}
    out = {}
    for r in sorted(reqs, key=lambda r: (r[1], r[0])):
        rid, _a, sin, email, user = r
        if sin in sins:
            out[rid] = "sin_registered"
        elif email in mails:
            out[rid] = "email_registered"
        elif user in users:
            out[rid] = "username_taken"
        else:
            out[rid] = None
            sins.add(sin), mails.add(email), users.add(user)
    return out


def test_signup_random(spark, T_small):
    persons = [r.legal_id for r in T_small["person"].select("legal_id").collect()]
    emails = [r.email for r in T_small["person"].select("email").collect()]
    users = [r.username for r in T_small["auth_account"].select("username").collect()]
    rnd = random.Random(5)
    reqs = []
    for i in range(60):
        reqs.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 40)),
                     f"{300000000 + rnd.randint(0, 12):09d}" if rnd.random() < 0.9 else persons[0],
                     f"u{rnd.randint(0, 12)}@mail.example", f"user{rnd.randint(0, 12)}"))
    df = spark.createDataFrame(
        [(i, a, s, "Ann", "Lee", e, "6135550101", "1 Main St", u) for i, a, s, e, u in reqs],
        "request_id long, arrival timestamp, sin_raw string, first_name_raw string, last_name_raw string, "
        "email_raw string, phone_raw string, address_raw string, username_raw string")
    got = {r.request_id: r.reason for r in register_customers(T_small, df, "2024-01-01").collect()}
    assert got == sequential(reqs, persons, emails, users)


def test_signup_validation_order(spark, T_small):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "12", "", "Lee", "bad", "1", "", "x"),
         (2, dt.datetime(2024, 1, 1), "300000001", "Ann", "Lee", "bad", "1", "", "x")],
        "request_id long, arrival timestamp, sin_raw string, first_name_raw string, last_name_raw string, "
        "email_raw string, phone_raw string, address_raw string, username_raw string")
    got = {r.request_id: r.reason for r in register_customers(T_small, df, "2024-01-01").collect()}
    assert got == {1: "sin_not_9_digits", 2: "invalid_email"}
