"""Structured Streaming forms of the trigger-driven jobs (L1-L3).

Most streams are declarative plans without callbacks (file source -> stream-static joins -> stateful de-duplication ->
file sink), run with ``trigger(availableNow=True)``.  Exactly-once comes
from the checkpoint + file sink protocol; a restarted query resumes from
its checkpoint (executor or driver loss does not duplicate output).

* L1 ``archive_stream``: change records -> archive rows, once per
  ``(record_type, source id)`` (state = archived keys, kept in the
  distributed state store), anti-joined with the existing archive.
* L2 ``status_stream``: change records -> room status of touched rooms,
  from a running count per room of the open bookings that cover the day.
* L3 ``admission_stream``: bookings and rentings are decided in the micro-batch they come in,
  against the stored stays and all that were accepted before; ``foreachBatch`` writes whole
  micro-batches by number.
* L3, second form, ``land_requests`` + ``admit_landed``: requests land through a stream
  (intake reason attached); the landed requests are then admitted in
  arrival-time batches, each against everything accepted before it.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from innkeep.functions.columns import as_date, covers
from innkeep.plans import archive as arch
from innkeep.plans.common import active_rentings, open_bookings
from innkeep.session import ensure_checkpoint_dir
from innkeep.sources.schemas import BLOCKING_BOOKING, BLOCKING_RENTING


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint area."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def stage_files(df: DataFrame, path: str, n_batches: int) -> tuple[str, int]:
    """Write ``df`` in one job with its natural parallelism (no funnel into a
    few tasks) and return ``(path, files_per_trigger)`` so that a file
    stream reads it in about ``n_batches`` micro-batches.  Used to stage
    test input; the stream jobs accept any source folder."""
    df.write.mode("overwrite").parquet(path)
    n_files = len(df.sparkSession.read.parquet(path).inputFiles())
    return path, max(1, -(-n_files // n_batches))


def dealt(df: DataFrame, n_batches: int) -> DataFrame:
    """``df`` dealt over a multiple of ``n_batches`` tasks, at least as many as a shuffle has: one task a
    micro-batch would read its whole share."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n_batches * max(1, -(-tasks // n_batches)))


def _run(stream_df: DataFrame, out: str, ckpt: str, mode: str = "append"):
    q = (stream_df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def archive_stream(spark: SparkSession, T, changes_dir: str, archive: DataFrame | None,
                   out_dir: str, ckpt_dir: str, record_type: str = "booking",
                   files_per_trigger: int = 1) -> DataFrame:
    """L1: run the archive stream to completion and return the sink table."""
    schema = spark.read.parquet(changes_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(changes_dir)
    if archive is not None:
        # static side of the anti-join: materialise once, not per micro-batch
        archive = archive.select("record_type", "source_booking_id", "source_renting_id") \
            .checkpoint(eager=True)
    rows = arch.archive_transitions(T, stream, archive, record_type)
    rows = rows.dropDuplicates(["record_type", "source_booking_id", "source_renting_id"])
    _run(rows, out_dir, ckpt_dir)
    return spark.read.schema(rows.schema).parquet(out_dir)


def _running_status(key, frames, state):
    """State of a room: changes seen, and their net effect on the bookings covering the day."""
    seen, net = state.get if state.exists else (0, 0)
    first = None
    for f in frames:
        first = f.iloc[0] if first is None else first
        seen, net = seen + len(f), net + int(f["delta"].sum())
    state.update((seen, net))
    status = ("maintenance" if first["maintenance"] else "rented" if first["rented"]
              else "booked" if first["booked"] + net > 0 else "available")
    yield pd.DataFrame({"room_id": [key[0]], "n_changes": [seen], "status": [status]})


def status_stream(spark: SparkSession, T, changes_dir: str, as_of, out_dir: str,
                  ckpt_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """L2: (room_id, n_changes, status) of the rooms touched by each micro-batch (append).

    A change adds or takes away one booking covering ``as_of``, by the states before and after
    it (``transition_changes``), so the status follows from the stored count and the changes
    landed so far, in any order of files.  State is two numbers per touched room.
    """
    d = as_date(as_of)
    schema = spark.read.parquet(changes_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(changes_dir)
    covering = lambda st, a, b: F.coalesce(
        (F.col(st).isin(*BLOCKING_BOOKING) & (F.col(a) <= d) & (d < F.col(b))).cast("int"), F.lit(0))
    delta = covering("status", "start_date", "end_date") - covering("old_status", "old_start_date", "old_end_date")
    rented = active_rentings(T).filter(covers("start_date", "end_date", as_of)) \
        .select("room_id").distinct().withColumn("rented", F.lit(True))
    booked = open_bookings(T).filter(covers("start_date", "end_date", as_of)) \
        .groupBy("room_id").agg(F.count(F.lit(1)).alias("booked"))
    static = T["room"].select("room_id", "current_status").join(rented, "room_id", "left").join(booked, "room_id", "left") \
        .select("room_id", F.coalesce(F.col("current_status") == "maintenance", F.lit(False)).alias("maintenance"),
                F.coalesce("rented", F.lit(False)).alias("rented"), F.coalesce("booked", F.lit(0)).alias("booked")) \
        .checkpoint(eager=True)  # static side, once
    out = "room_id bigint, n_changes bigint, status string"
    rows = stream.select(F.col("room_id").cast("bigint").alias("room_id"), delta.alias("delta")).join(static, "room_id").groupBy("room_id") \
        .applyInPandasWithState(_running_status, out, "seen bigint, net bigint", "append", GroupStateTimeout.NoTimeout)
    _run(rows, out_dir, ckpt_dir)
    return spark.read.schema(out).parquet(out_dir)


def latest_status(emitted: DataFrame) -> DataFrame:
    """Each touched room's status after the micro-batches so far."""
    return emitted.groupBy("room_id").agg(F.max_by("status", "n_changes").alias("status"))


def land_requests(spark: SparkSession, requests_dir: str, intake_fn, out_dir: str,
                  ckpt_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """L3 (landing): stream requests, attach intake reasons, tag the batch."""
    schema = spark.read.parquet(requests_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(requests_dir)
    landed = intake_fn(stream).withColumn("landed_at", F.current_timestamp())
    _run(landed, out_dir, ckpt_dir)
    return spark.read.schema(landed.schema).parquet(out_dir)


def admit_landed(T, landed: DataFrame, admit_fn, n_batches: int = 4) -> DataFrame:
    """L3 (admission): admit landed requests batch by batch in arrival
    order; every batch sees the requests accepted in earlier batches as
    existing bookings.  Batches are arrival-time ranges (quantile bounds,
    ``n_batches - 1`` values to the driver), so the outcome does not depend
    on file or landing order and equals one sequential replay.  The loop
    runs ``n_batches`` distributed steps."""
    from innkeep.sources.schemas import BLOCKING_BOOKING, BLOCKING_RENTING
    t = F.unix_micros(F.col("arrival").cast("timestamp"))
    qs = [i / n_batches for i in range(1, n_batches)]
    bounds = landed.agg(F.percentile_approx(t, qs, 10000).alias("b")).first()["b"] or []
    bounds = sorted(set(int(b) for b in bounds))
    bidx = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < t)) if bounds else F.lit(0)
    landed = landed.withColumn("_batch", bidx).checkpoint(eager=True)
    # only blocking stays matter to the conflict rules: materialise them once
    T = dict(T)
    T["booking"] = T["booking"].filter(F.col("status").isin(*BLOCKING_BOOKING)).checkpoint(eager=True)
    T["renting"] = T["renting"].filter(F.col("status").isin(*BLOCKING_RENTING)).checkpoint(eager=True)
    accepted = None
    out = None
    for b in range(len(bounds) + 1):
        part = landed.filter(F.col("_batch") == b).drop("_batch")
        T_b = dict(T)
        if accepted is not None:
            extra = accepted.select(
                (-F.col("request_id") - 1).alias("booking_id"), "room_id", "customer_id",
                F.lit(None).cast("bigint").alias("created_by_employee_id"), "start_date",
                "end_date", F.lit("reserved").alias("status"),
                F.lit(None).cast("timestamp_ntz").alias("created_at"))
            T_b["booking"] = T["booking"].unionByName(extra)
        res = admit_fn(T_b, part).checkpoint(eager=True)
        acc = part.join(res.filter("accepted").select("request_id"), "request_id", "left_semi") \
            .select("request_id", "room_id", "customer_id", "start_date", "end_date")
        accepted = acc if accepted is None else accepted.unionByName(acc)
        accepted = accepted.checkpoint(eager=True)
        out = res if out is None else out.unionByName(res)
    return out


def _by_batch(spark: SparkSession, path: str, schema, before: int) -> DataFrame:
    """Rows that the micro-batches before ``before`` have written under ``path``."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch_id") < before)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch's rows; a repeated micro-batch replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def admission_stream(spark: SparkSession, T, requests_dir: str, base: str, decide, grow, files_per_trigger: int = 1) -> DataFrame:
    """L3: requests are decided in the micro-batch they come in, in arrival order inside it.

    The state is the stays accepted so far, kept under ``base`` by micro-batch: a batch reads those
    of the batches before it and adds its own, beside its decisions.  Both are written as a whole
    under the batch's number, so a batch that is repeated after a restart replaces itself and
    no decision is emitted twice.  ``decide(T, requests)`` decides a batch, ``grow(T, accepted)``
    adds accepted requests to the stored stays.
    """
    schema = spark.read.parquet(requests_dir).schema
    stays, out = f"{base}/accepted", f"{base}/decisions"
    state = spark.createDataFrame([], schema)
    kept = state.withColumn("batch_id", F.lit(0)).schema
    state.write.mode("ignore").parquet(f"{stays}/batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.checkpoint(eager=True)
        before = _by_batch(spark, stays, kept, batch_id).drop("batch_id")
        decisions = decide(grow(T, before), batch).checkpoint(eager=True)
        _write_batch(batch.join(decisions.filter("accepted").select("request_id"), "request_id", "left_semi").select(*schema.names), stays, batch_id)
        _write_batch(decisions, out, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(requests_dir)
    query = (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def status_stream_both(spark: SparkSession, T, changes_dir: str, as_of, out_dir: str, ckpt_dir: str,
                       files_per_trigger: int = 1) -> DataFrame:
    """L2: (room_id, n_changes, status) of rooms touched by changes of bookings and of rentings.

    A change is an insert (no ``old_*``), an update or a delete (no new values) of a row of
    ``record_type``: room_id, status, start_date, end_date and their ``old_*``.  It takes its old
    row off the old room and puts the new one on the new room, in one keyed state per room of
    three numbers, so files may come in any order and a row may change its room.  The state is
    that of a running aggregate; a micro-batch is written as a whole under its number, so one that is
    repeated replaces itself.
    """
    d = as_date(as_of)
    schema = spark.read.parquet(changes_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(changes_dir)
    is_booking = F.col("record_type") == "booking"
    blocking = lambda st: F.when(is_booking, F.col(st).isin(*BLOCKING_BOOKING)).otherwise(F.col(st).isin(*BLOCKING_RENTING))

    def effect(old: str, sign: int):
        on = F.coalesce(blocking(f"{old}status") & (F.col(f"{old}start_date") <= d) & (d < F.col(f"{old}end_date")), F.lit(False))
        n = F.when(on, F.lit(sign)).otherwise(F.lit(0))
        return F.struct(F.col(f"{old}room_id").cast("bigint").alias("room_id"), F.when(is_booking, n).otherwise(0).alias("booking"),
                        F.when(is_booking, 0).otherwise(n).alias("renting"))

    moved = stream.select(F.explode(F.array(effect("", 1), effect("old_", -1))).alias("e")).select("e.*").filter("room_id is not null")
    count = lambda rows, name: rows.filter(covers("start_date", "end_date", as_of)).groupBy("room_id").agg(F.count(F.lit(1)).alias(name))
    static = T["room"].select("room_id", "current_status").join(count(active_rentings(T), "rented"), "room_id", "left") \
        .join(count(open_bookings(T), "booked"), "room_id", "left") \
        .groupBy("room_id").agg(  # a room listed n times meets each change n times
            F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("current_status") == "maintenance", F.lit(False))).alias("maintenance"),
            F.max(F.coalesce("rented", F.lit(0))).alias("rented"), F.max(F.coalesce("booked", F.lit(0))).alias("booked")) \
        .checkpoint(eager=True)  # static side, once
    n, rented, booked = F.col("n"), F.col("rented"), F.col("booked")
    status = F.when(F.col("maintenance"), "maintenance").when(rented + n * F.col("net_r") > 0, "rented") \
        .when(booked + n * F.col("net_b") > 0, "booked").otherwise("available")
    out = "room_id bigint, n_changes bigint, status string"
    spark.createDataFrame([], out).write.mode("ignore").parquet(f"{out_dir}/batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.join(static, "room_id").select("room_id", (n * F.col("seen")).alias("n_changes"), status.alias("status"))
        _write_batch(rows, out_dir, batch_id)

    so_far = moved.groupBy("room_id").agg(F.count(F.lit(1)).alias("seen"), F.sum("booking").alias("net_b"), F.sum("renting").alias("net_r"))
    query = (so_far.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", ckpt_dir)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(out).parquet(out_dir).select("room_id", "n_changes", "status")


def archive_stream_bounded(spark: SparkSession, T, changes_dir: str, archive: DataFrame | None, base: str,
                           record_type: str = "booking", delay: str = "1 hour", files_per_trigger: int = 1) -> tuple[DataFrame, list[int]]:
    """L1 with bounded state: (the archive rows, state rows after each micro-batch).

    ``changes`` carry ``change_id`` (one per delivered change) and ``seq``.  A change that is
    delivered again is dropped by ``dropDuplicatesWithinWatermark``, whose state forgets ids older
    than ``delay``.  The watermark runs on the time the files landed, so no change is ever too
    late.  That a source id is archived once doesn't rest on state at all: each micro-batch
    looks its ids up in the stored archive, the given one and what the batches before it wrote.
    A repeated micro-batch replaces what it wrote.
    """
    schema = spark.read.parquet(changes_dir).schema
    keys = ["record_type", "source_booking_id", "source_renting_id"]
    path, sizes = f"{base}/archive", []
    shape = arch.archive_transitions(T, spark.createDataFrame([], schema), None, record_type).schema
    kept = spark.createDataFrame([], shape).withColumn("batch_id", F.lit(0)).schema
    spark.createDataFrame([], shape).write.mode("ignore").parquet(f"{path}/batch_id=-1")
    if archive is not None:
        archive = archive.select(*keys).checkpoint(eager=True)

    def step(batch: DataFrame, batch_id: int) -> None:
        known = _by_batch(spark, path, kept, batch_id).select(*keys)
        known = known.unionByName(archive) if archive is not None else known
        _write_batch(arch.archive_transitions(T, batch.drop("landed_at"), known, record_type), path, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(changes_dir)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("landed_at"))
    once = stream.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["change_id"])
    query = (once.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(kept).option("basePath", path).parquet(path).drop("batch_id"), sizes


def stage_in_order(df: DataFrame, path: str, order: list[str], n_files: int) -> str:
    """Test input: ``df`` as ``n_files`` files that a file stream reads in the order of ``order``."""
    ordered = df.repartitionByRange(n_files, *order).sortWithinPartitions(*order).withColumn("_file", F.spark_partition_id()).checkpoint(eager=True)
    for (n,) in sorted(ordered.select("_file").distinct().collect()):
        ordered.filter(F.col("_file") == n).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return path
