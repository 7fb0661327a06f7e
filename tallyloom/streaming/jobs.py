"""Structured Streaming jobs. State is bounded by watermarks; sinks are idempotent by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyloom.functions.redaction import sanitize_events
from tallyloom.operators.records import KEY, upsert_records
from tallyloom.operators.telemetry import ingest_defaults, provider_summary, retain_newest, usage_alerts
from tallyloom.sources.sinks import write_report


def ingest_usage(stream: DataFrame, ts: str = "ts", key: str = "id", late: str = "1 hour", texts: list[str] | None = None) -> DataFrame:
    """Sanitised usage events with defaults; an id counts once within the watermark (older repeats are a documented loss)."""
    out = sanitize_events(stream, texts or [], "metadata" if "metadata" in stream.columns else None)
    if "reasoning_tokens" in out.columns and "occurred_at" in out.columns:
        out = ingest_defaults(out)
    return out.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def backend_stream(calls: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Calls, errors and the last event by event time, a row a backend and window; late events are placed by their time."""
    own = calls.filter(F.col("operation") == "tools/call").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    agg = own.groupBy(F.window("at", every).alias("w"), "backend").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.max_by(F.struct("at", "ok", "error_type"), F.struct("at", "seq")).alias("last"))
    return agg.select(F.col("w.start").alias("window_start"), "backend", "calls", "errors", F.col("last.at").alias("last_at"), F.when(~F.col("last.ok"), F.col("last.error_type")).alias("last_error"))


def track_cursor(events: DataFrame) -> DataFrame:
    """Per scope the last event, the high watermark of update times, and how many durable records came; for `update` or `complete` mode."""
    return events.groupBy("scope").agg(F.max_by("event_id", F.struct("updated_at_ms", "event_id")).alias("last_event_id"), F.max("updated_at_ms").alias("watermark"), F.max("generation").alias("generation"), F.count_if("durable").alias("persisted"))


BUCKET, VERSION = "bucket_", "version_"


def latest_by_id(key: str | list[str], order: str, path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key in a bucketed table (see `read_state`).

    A batch rewrites the buckets that it touches, under its own version; run again, it writes the same.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def run(batch: DataFrame, batch_id: int) -> None:
        both = batch
        old = _touched(batch, keys, path, batch_id, buckets, batch)
        if old is not None:
            both = old.unionByName(batch)
        one = both.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        _write_state(one, keys, path, batch_id, buckets)

    return run


def upsert_sink(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts records into a bucketed table (see `upsert_records` and `read_state`)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        empty = batch.drop("seq").limit(0)
        old = _touched(batch, KEY, path, batch_id, buckets, empty)
        _write_state(upsert_records(empty if old is None else old, batch).drop("outcome"), KEY, path, batch_id, buckets)

    return run


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write_state(df: DataFrame, keys: list[str], path: str, batch_id: int, buckets: int) -> None:
    out = df.withColumns({BUCKET: _bucket(keys, buckets), VERSION: F.lit(batch_id).cast("long")}).hint("rebalance", BUCKET)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(path)


def _touched(batch: DataFrame, keys: list[str], path: str, batch_id: int, buckets: int, like: DataFrame) -> DataFrame | None:
    """The state before this batch in the buckets that the batch touches."""
    old = read_state(batch.sparkSession, path, batch_id, like.schema)
    if old is None:
        return None
    hit = batch.select(_bucket(keys, buckets).alias(BUCKET)).distinct()  # no more rows than buckets
    return old.join(F.broadcast(hit), BUCKET, "left_semi").drop(BUCKET)


def read_state(spark: SparkSession, path: str, below: int | None = None, schema: StructType | None = None) -> DataFrame | None:
    """The newest version of each bucket (with `below`: before that batch, and with its bucket); null before the first batch."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType()), StructField(VERSION, LongType())]))
    try:
        df = reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if below is not None:
        df = df.filter(F.col(VERSION) < below)
    newest = df.groupBy(BUCKET).agg(F.max(VERSION).alias(VERSION))  # a row a bucket, from folder names alone
    out = df.join(F.broadcast(newest), [BUCKET, VERSION]).drop(VERSION)
    return out if below is not None else out.drop(BUCKET)


def sessions_of(latest: DataFrame) -> DataFrame:
    """Sessions from the newest `register` and the newest `end` of each id (id, action, seq, at): a later end ends it, a later start revives it.

    Ends of unknown sessions are left out. Keep the input with `latest_by_id(["id", "action"], "seq", path)`.
    """
    last = lambda action, field: F.max_by(F.when(F.col("action") == action, F.col(field)), F.when(F.col("action") == action, F.col("seq")))
    one = latest.groupBy("id").agg(*[last(a, f).alias(f"{a}_{f}") for a in ("register", "end") for f in ("seq", "at")])
    over = F.coalesce(F.col("end_seq") > F.col("register_seq"), F.lit(False))
    return one.filter(F.col("register_seq").isNotNull()).select("id", F.col("register_at").alias("started_at"), F.when(over, F.col("end_at")).alias("ended_at"), F.when(over, "ended").otherwise("active").alias("state"))


def snapshot_sink(quotas: DataFrame, path: str, keep: int, recent: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for usage events: each trigger writes `path/sequence=<batch>` with a summary by provider, alerts and recent events.

    Snapshots show the `keep` newest events by seq, held in `path/buffer` by batch, so that a trigger's work doesn't grow with the past.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held, schema = batch, StructType([*batch.schema.fields, StructField(VERSION, LongType())])
        if batch_id > 0:
            before = spark.read.schema(schema).parquet(f"{path}/buffer").filter(F.col(VERSION) == batch_id - 1).drop(VERSION)
            held = before.unionByName(batch)
        out = retain_newest(held, keep).withColumn(VERSION, F.lit(batch_id).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(VERSION).parquet(f"{path}/buffer")
        now = spark.read.schema(schema).parquet(f"{path}/buffer").filter(F.col(VERSION) == batch_id).drop(VERSION)
        write_report({"summary": provider_summary(now, quotas), "alerts": usage_alerts(now, quotas), "recent": retain_newest(now, recent)}, f"{path}/sequence={batch_id}")

    return run
