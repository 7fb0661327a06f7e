"""Sharding by fixed virtual slots.

A record's virtual slot is a hash of its text modulo SLOTS, for ever, so equal texts share a slot and with it a shard.
Bytes and rows are summed by slot (map-side), and a versioned map of SLOTS rows, slot -> shard, is stored and says
where each slot lives. The map is the only thing that is ever edited: `rebalance` moves slots from the fullest
shards to the emptiest, and a new shard takes slots from all others. The driver sees SLOTS rows, whatever the
input's size.

A group of equal texts is one unit, placed with its slot, however large, unless it alone has more bytes than a shard's share
(all bytes / shards): only such a group can't be placed whole, and it alone is dealt over all slots, by a hash of doc_id. It can only
lie in a slot of that size, which the sums by slot show, so no group of any other slot is counted.

The law kept is `bytes`: slots are given out largest first to the emptiest shard, so shard sizes differ by
less than the smallest slots' bytes (unless one record alone exceeds a shard's share).

A record's place within its shard (`slot` of `place`) is gapless from 0: the slot's offset in its shard plus the rank within the
slot. Records are cut into even ranges by (slot, doc_id, checksum, size) and ranked with offsets by range, so that no task holds a slot.

Defined cases: a null text has size 1, the checksum of no bytes, 0, and is one group with the empty text's. Rows that
agree in doc_id and text have places of their own. In a group that is dealt out, rows without doc_id are dealt in turn. An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, scratch_dir

SLOTS = 4096
SHARDS = 8


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, th (the text's hash), vslot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    th = F.xxhash64(text)
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), th.alias("th"), F.pmod(th, F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows) of the slots in use: SLOTS rows at most."""
    return [tuple(r) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count("*")).orderBy("vslot").collect()]


def spread_large_groups(rows: DataFrame, stats: list[tuple[int, int, int]], shards: int, slots: int) -> DataFrame | None:
    """`rows` with the records of groups of more bytes than a shard's share dealt over all slots; None where there are none."""
    share = sum(b for _, b, _ in stats) / shards
    large = [v for v, b, n in stats if n > 1 and b > share]  # fewer than shards
    if not large:
        return None
    groups = rows.filter(F.col("vslot").isin(large)).groupBy("th").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    hot = groups.filter((F.col("n") > 1) & (F.col("b") > share)).select(F.col("th").alias("__th")).collect()
    if not hot:
        return None
    turn = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "th"))
    return rows.withColumn("vslot", F.when(F.col("th").isin([r[0] for r in hot]), F.pmod(turn, F.lit(slots)).cast("int")).otherwise(F.col("vslot")))


def slot_ranks(rows: DataFrame) -> DataFrame:
    """`rows` with `rank`, the place within the slot from 0; rows that agree in all columns are ranked as they are stored."""
    keys = ["vslot", "doc_id", "text_crc32", "size", "__u"]
    # written, so that a range keeps its rows if a task is run again
    cut = materialize(materialize(rows.withColumn("__u", F.monotonically_increasing_id())).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    parts = cut.groupBy("vslot", "__p").agg(F.count("*").alias("__n"))  # no more rows than slots and ranges together
    before = (F.sum("__n").over(W.partitionBy("vslot").orderBy("__p")) - F.col("__n")).alias("__before")
    inside = F.row_number().over(W.partitionBy("__p", "vslot").orderBy(*keys[1:]))
    ranked = cut.withColumn("__r", inside).join(parts.select("vslot", "__p", before), ["vslot", "__p"])
    return ranked.withColumn("rank", F.col("__before") + F.col("__r") - 1).drop("__u", "__p", "__r", "__before")


def first_map(stats: list[tuple[int, int, int]], shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """Version 1: the largest slots first, each to the shard with the fewest bytes; unused slots in turn."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for v, size, _ in sorted(stats, key=lambda x: (-x[1], x[0])):
        b, s = heapq.heappop(load)
        out[v] = s
        heapq.heappush(load, (b + size, s))
    for v in range(slots):
        out.setdefault(v, v % shards)
    return out


def rebalance(old: dict[int, int], stats: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """An edited map: slots move, one at a time, from the fullest shard to the emptiest while that narrows the gap.

    When shards are added, slots move into the new ones only.
    """
    size = {v: b for v, b, _ in stats}
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    new = dict(old)
    takers = set(range(shards)) - set(old.values()) or set(range(shards))
    for v in sorted(size):
        held[new[v]].append(v)
    load = {s: sum(size[v] for v in vs) for s, vs in held.items()}
    for _ in range(len(size)):
        full, low = max(load, key=lambda s: (load[s], -s)), min(takers, key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        fit = [v for v in held[full] if 0 < size[v] < gap]
        if not fit:
            break
        v = min(fit, key=lambda v: (abs(gap - 2 * size[v]), v))
        held[full].remove(v)
        held[low].append(v)
        load[full] -= size[v]
        load[low] += size[v]
        new[v] = low
    return new


def map_table(spark: SparkSession, slot_map: dict[int, int], stats: list[tuple[int, int, int]], version: int = 1) -> DataFrame:
    """(version, vslot, shard, bytes, rows, first): first is the place of the slot's first row in its shard."""
    by = {v: (b, n) for v, b, n in stats}
    at: dict[int, int] = {}
    rows = []
    for v in sorted(slot_map):
        b, n = by.get(v, (0, 0))
        s = slot_map[v]
        rows.append((version, v, s, b, n, at.get(s, 0)))
        at[s] = at.get(s, 0) + n
    return spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long, rows long, first long")


def save_map(table: DataFrame, path: str) -> None:
    """Append one version; earlier versions stay readable."""
    table.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """The named version of a saved map, or the newest: SLOTS rows."""
    df = spark.read.parquet(path)
    version = df.agg(F.max("version")).first()[0] if version is None else version
    return {r.vslot: r.shard for r in df.filter(F.col("version") == version).select("vslot", "shard").collect()}


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: dict[int, int] | None = None, version: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version for every record.

    The map (the given one, or the first) is stored as `version` under `path`, by default a folder of its own in the
    scratch folder, and records are placed by what is stored.
    """
    spark = docs.sparkSession
    rows = materialize(slotted(docs, slots))
    stats = slot_bytes(rows)
    dealt = spread_large_groups(rows, stats, shards, slots)
    if dealt is not None:
        rows = materialize(dealt)
        stats = slot_bytes(rows)
    path = path or f"{scratch_dir(spark)}/slot_maps/{uuid.uuid4().hex}"
    save_map(map_table(spark, slot_map or first_map(stats, shards, slots), stats, version), path)
    table = F.broadcast(spark.read.parquet(path).filter(F.col("version") == version))  # SLOTS rows
    out = slot_ranks(rows).join(table.select("vslot", "shard", "first"), "vslot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.lit(version).alias("map_version"))
