"""Queries over streams of several micro-batches: tables arrive in slices, and each slice is a run that restarts from the checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.scratch import scratch_dir
from tallyloom.plans.bindings import table
from tallyloom.plans.stores import ORACLES as STORE_ORACLES
from tallyloom.streaming.statetable import StateTable, ingest_once, latest_log, upsert_log
from tallyloom.streaming.stateful import claim_stream, cursor_stream, start_stateful

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def in_slices(df, order: str, start, n: int = 3) -> str:
    """Cut df into n slices by `order`; write one at a time and run the stream to its end. Returns the folder that it all lies in.

    start: (stream, folder) -> StreamingQuery, with its checkpoint in `folder/state`.
    """
    spark = df.sparkSession
    top = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    low, high = df.agg(F.min(order), F.max(order)).first()
    low, high = low or 0, high or 0
    part = F.floor((F.col(order) - low) * n / (high - low + 1))
    for k in range(n):
        df.filter(part == k).write.parquet(f"{top}/in/{k}")
        start(spark.readStream.schema(df.schema).parquet(f"{top}/in/*"), top).awaitTermination()
    return top


def _steps(spark, sf_dir):
    step = F.when(F.col("event_type") == "click", "validated").when(F.col("event_type") == "purchase", "active").when(F.col("event_type") == "view", "superseded").when(F.col("event_type") == "error", "rejected").otherwise("tombstoned")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), step.alias("to_state"))


@query(STORE_ORACLES["r10_fold_claims"])
def r10_claim_stream(spark, sf_dir):
    state = lambda top: StateTable(spark, f"{top}/claims", ["claim_id"], spark.createDataFrame([], "claim_id long, state string, refused long, last long").schema, "last")
    top = in_slices(_steps(spark, sf_dir), "seq", lambda s, top: start_stateful(claim_stream(s), latest_log(state(top), "last"), f"{top}/state"))
    return state(top).read().select("claim_id", "state", "refused")


@query("SELECT event_type AS scope, arg_max(event_id, (event_id * 7919 % 100003, event_id::VARCHAR))::VARCHAR AS last_event_id, max(event_id * 7919 % 100003) AS watermark, max(event_id // 1000) AS generation, count(*) FILTER (user_id % 2 = 0) AS persisted FROM events GROUP BY 1")
def r6_cursor_stream(spark, sf_dir):
    """Update times are out of order, so that the watermark has to hold against later rows."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event_id"), (F.col("event_id") * 7919 % 100003).alias("updated_at_ms"), F.floor(F.col("event_id") / 1000).alias("generation"), (F.col("user_id") % 2 == 0).alias("durable"))
    state = lambda top: StateTable(spark, f"{top}/cursors", ["scope"], spark.createDataFrame([], "scope string, last_event_id string, watermark long, generation long, persisted long, last long").schema, "last")
    top = in_slices(e, "seq", lambda s, top: start_stateful(cursor_stream(s), latest_log(state(top), "last"), f"{top}/state"))
    return state(top).read().select("scope", "last_event_id", "watermark", "generation", "persisted")


def _started(stream, sink, top: str):
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()


@query("SELECT user_id AS id, min(event_id) AS seq, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1")
def r1_ingest_once(spark, sf_dir):
    """An id comes in every slice, at any distance in time, and counts once."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))

    def start(s, top):
        ids = StateTable(spark, f"{top}/ids", ["id"], spark.createDataFrame([], "id long").schema, bloom=True)
        return _started(s, ingest_once(ids, ["seq"], lambda b, n: b.write.mode("overwrite").parquet(f"{top}/out/batch={n}")), top)

    top = in_slices(e, "seq", start)
    return spark.read.parquet(f"{top}/out").select("id", "seq", "kind")


@query("SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def r2_state_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    state = lambda top: StateTable(spark, f"{top}/latest", ["id"], e.schema, "seq")
    top = in_slices(e, "seq", lambda s, top: _started(s, latest_log(state(top), "seq"), top), n=5)
    return state(top).read()


@query("""WITH e AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS state FROM lineitem),
b AS (SELECT *, least(2, floor((seq - (SELECT min(seq) FROM e)) * 3 / ((SELECT max(seq) FROM e) - (SELECT min(seq) FROM e) + 1))) AS slice FROM e),
last AS (SELECT k, slice, arg_max(state, seq) AS state FROM b GROUP BY ALL),
steps AS (SELECT k, slice, state, lag(state) OVER (PARTITION BY k ORDER BY slice) AS before FROM last)
SELECT k::VARCHAR AS native_id, arg_max(state, slice) AS state, count(*) FILTER (before IS NULL OR before <> state) AS revision FROM steps GROUP BY k""")
def r7_upsert_log(spark, sf_dir):
    """Records change over three slices; a slice's last row of a key is a new revision if its state differs."""
    k = F.col("l_partkey").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(k.alias("id"), F.lit("part").alias("kind"), F.lit("p").alias("origin_platform"), k.alias("native_id"), F.lit("w").alias("workspace_key"), F.lit(None).cast("string").alias("parent_id"), F.col("l_returnflag").alias("state"), F.lit("low").alias("sensitivity"), F.lit("h").alias("payload_hash"), F.lit(None).cast("long").alias("expires_at_ms"), F.lit(1).cast("long").alias("revision"), F.lit(None).cast("long").alias("tombstoned_at_ms"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"))
    state = lambda top: StateTable(spark, f"{top}/records", ["kind", "origin_platform", "native_id"], rows.drop("seq").schema)
    top = in_slices(rows, "seq", lambda s, top: _started(s, upsert_log(state(top)), top))
    return state(top).read().select("native_id", "state", "revision")
