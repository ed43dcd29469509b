"""Streams equal their batch forms."""

from innkeep.registry import registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_archive_equals_batch(T_small):
    reg = registry()
    assert rows(reg["stream_archive"][0](T_small)) == rows(reg["archive_transitions"][0](T_small))


def test_stream_admission_equals_batch(T_small):
    import pyspark.sql.functions as F

    from innkeep.plans import transitions
    from innkeep.registry import INTAKE_AS_OF, admission_requests, admit_requests
    reg = registry()
    streamed = {r.request_id: r.accepted for r in reg["stream_admission"][0](T_small).collect()}
    intake = transitions.intake_bookings(T_small, admission_requests(T_small), INTAKE_AS_OF)
    q = intake.filter("qualified").select("request_id", "arrival", "room_id", "customer_id",
                                         "start_date", "end_date")
    batch = {r.request_id: r.accepted for r in admit_requests(T_small, q).collect()}
    unq = {r.request_id for r in intake.filter(~F.col("qualified")).collect()}
    assert {k: v for k, v in streamed.items() if k not in unq} == batch
    assert all(not streamed[k] for k in unq)


def test_archive_stream_split_points(spark, T_small):
    """Same archive whether the change files arrive one or three per batch."""
    from innkeep.plans import archive as arch
    from innkeep.registry import _stage_changes
    from innkeep.streaming import jobs
    src, _per = _stage_changes(T_small)
    results = []
    for per in (1, 3):
        out = jobs.archive_stream(spark, T_small, src, arch.archive_backfill(T_small),
                                  jobs.scratch_dir(spark, "a-out"), jobs.scratch_dir(spark, "a-ck"),
                                  files_per_trigger=per)
        results.append(rows(out))
    assert results[0] == results[1]


def test_admission_batches_split_points(spark, T_small):
    """Admitting in 1, 3 or 6 arrival batches gives the same decisions."""
    from innkeep.plans import transitions
    from innkeep.registry import INTAKE_AS_OF, admission_requests, admit_requests
    from innkeep.streaming import jobs
    intake = transitions.intake_bookings(T_small, admission_requests(T_small), INTAKE_AS_OF)
    q = intake.filter("qualified").select("request_id", "arrival", "room_id", "customer_id",
                                         "start_date", "end_date")
    outs = [{r.request_id: r.accepted for r in jobs.admit_landed(T_small, q, admit_requests, n).collect()}
            for n in (1, 3, 6)]
    assert outs[0] == outs[1] == outs[2]


def test_status_stream_of_both_tables_after_each_batch(spark):
    """Random inserts, updates (of room, days, status) and deletes of both tables: after every
    micro-batch the status is J3's over the tables as the changes so far leave them."""
    import datetime as dt
    import random

    from innkeep.plans.status import status_as_of
    from innkeep.streaming import jobs
    rng, today = random.Random(8), dt.date(2024, 5, 10)
    states = {"booking": ["reserved", "checked_in", "cancelled", "completed"], "renting": ["active", "completed"]}

    def row(kind):
        a = today + dt.timedelta(rng.randrange(-4, 3))
        return (rng.randint(1, 8), rng.choice(states[kind]), a, a + dt.timedelta(rng.randrange(4)))

    now = {k: {i: row(k) for i in range(6)} for k in states}
    schema = "{0}_id long, room_id long, status string, start_date date, end_date date"

    def frames():
        T = {k: spark.createDataFrame([(i, *r) for i, r in rows.items()], schema.format(k)) for k, rows in now.items()}
        return {**T, "room": spark.createDataFrame([(i, "maintenance" if i == 8 else "available") for i in range(1, 9)],
                                                   "room_id long, current_status string")}

    T = frames()
    src, out, ckpt = (jobs.scratch_dir(spark, x) for x in ("bc", "bo", "bk"))
    touched, nothing = set(), (None,) * 4
    cols = "room_id long, status string, start_date date, end_date date"
    for _ in range(3):
        changes = []
        for _ in range(12):
            kind = rng.choice(["booking", "renting"])
            ident = rng.choice([*now[kind], 100 + rng.randrange(900)])
            old = now[kind].pop(ident, None)
            new = None if old and rng.random() < 0.3 else row(kind)
            if new:
                now[kind][ident] = new
            changes.append((kind, *(new or nothing), *(old or nothing)))
            touched |= {r[0] for r in (old, new) if r}
        rng.shuffle(changes)
        spark.createDataFrame(changes, f"record_type string, {cols}, " + ", ".join(f"old_{c}" for c in cols.split(", "))) \
            .coalesce(1).write.mode("append").parquet(src)
        emitted = jobs.status_stream_both(spark, T, src, today, out, ckpt)
        want = {r.room_id: r.status for r in status_as_of(frames(), today).collect() if r.room_id in touched}
        assert {r.room_id: r.status for r in jobs.latest_status(emitted).collect()} == want


def test_status_of_both_tables_is_a_running_aggregate(spark, monkeypatch):
    """No Python call per room and micro-batch; a room listed twice meets each change twice."""
    import datetime as dt

    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from innkeep.streaming import jobs

    def called(*_, **__):
        raise AssertionError("a Python call per room")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandasWithState", called)
    today = dt.date(2024, 5, 10)
    cols, (a, b) = "room_id long, status string, start_date date, end_date date", (today, today + dt.timedelta(2))
    old = "record_type string, " + cols + ", " + ", ".join(f"old_{c}" for c in cols.split(", "))
    nothing, src, out = (None,) * 4, jobs.scratch_dir(spark, "rc"), jobs.scratch_dir(spark, "ro")
    T = {"booking": spark.createDataFrame([(1, 2, "reserved", a, b), (2, 3, "reserved", a, b), (3, 3, "reserved", a, b), (4, 3, "reserved", a, b)], f"booking_id long, {cols}"),
         "renting": spark.createDataFrame([], f"renting_id long, {cols}"),
         "room": spark.createDataFrame([(1, "available"), (2, None), (3, "available"), (3, "available"), (4, "maintenance"), (None, "available")], "room_id long, current_status string")}
    emitted = []
    for changes in ([("booking", 1, "reserved", a, b, *nothing), ("booking", *nothing, 2, "reserved", a, b), ("booking", *nothing, 3, "reserved", a, b)],
                    [("renting", 1, "active", a, b, 4, "active", a, b), ("booking", *nothing, 3, "reserved", a, b), ("booking", 9, "reserved", a, b, *nothing)]):
        spark.createDataFrame(changes, old).coalesce(1).write.mode("append").parquet(src)
        got = jobs.status_stream_both(spark, T, src, today, out, out + "-ckpt")
        emitted.append({(r.room_id, r.n_changes, r.status) for r in got.collect()} - set().union(*emitted))
    assert emitted == [{(1, 1, "booked"), (2, 1, "available"), (3, 2, "booked")}, {(1, 2, "rented"), (4, 1, "maintenance"), (3, 4, "available")}]


def test_bounded_archive_stream(spark, T_small):
    """Each renting once over a long run of repeated deliveries; the state stops growing."""
    import time

    from pyspark.sql import functions as F

    from innkeep.plans import archive as arch
    from innkeep.registry import renting_changes
    from innkeep.streaming import jobs
    part = F.crc32(F.col("renting_id").cast("string")) % 60
    changes = renting_changes(T_small).filter(part < 6).withColumn("part", part).checkpoint()
    src, base = jobs.scratch_dir(spark, "long"), jobs.scratch_dir(spark, "long-out")
    before = arch.archive_backfill(T_small).checkpoint()
    sizes = []
    for k in range(5):  # every file repeats half of the one before it
        changes.filter(F.col("part").between(k, k + 1)).drop("part").coalesce(1).write.mode("append").parquet(src)
        got, seen = jobs.archive_stream_bounded(spark, T_small, src, before, base, "renting", delay="1 second")
        sizes += seen
        time.sleep(2)
    rows_ = [tuple(r) for r in got.collect()]
    assert len({r[2] for r in rows_}) == len(rows_) > 0
    want = arch.archive_transitions(T_small, changes.dropDuplicates(["change_id"]), before, "renting")
    assert sorted(rows_, key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
    assert 0 < max(sizes) < 0.7 * changes.select("change_id").distinct().count()


def test_staged_batches_have_a_file_a_task(spark, T_small):
    """A micro-batch is dealt over as many tasks as a shuffle has, not written by one."""
    from innkeep.streaming import jobs
    df = spark.range(1000)
    path, per = jobs.stage_files(jobs.dealt(df, 4), jobs.scratch_dir(spark, "dealt"), 4)
    files = spark.read.parquet(path).inputFiles()
    assert len(files) == 8 and per == 2
    assert spark.read.parquet(path).count() == 1000


def test_stays_once_keeps_rows_and_types(T_small):
    from innkeep.registry import _stays_once
    once = _stays_once(T_small)
    for name in ("booking", "renting"):
        assert once[name].dtypes == T_small[name].dtypes
        assert rows(once[name].select("room_id", "customer_id", f"{name}_id")) == rows(T_small[name].select("room_id", "customer_id", f"{name}_id"))
        assert "stays" in once[name].inputFiles()[0]
