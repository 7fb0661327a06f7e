"""A log-structured table for streaming state, and an index of ids that have been seen.

A batch writes a run: its own rows, in buckets by a hash of the key. Runs of one level are merged into one of the next when there
are FAN of them, so that a row is written once a level (log FAN of all batches), never with each batch. A run has
one bucket for each `split` rows, so buckets split as runs grow. What is live stands in the manifest, one file a version, which
appears at once when it is complete: readers see all of a batch or nothing. `vacuum` deletes runs that no kept version names.

A batch that runs again finds its version committed and leaves it, or writes it anew from the version before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.records import KEY, upsert_records

FAN, SPLIT = 4, 1_000_000
#: Buckets of a run at most; a run's list of touched buckets is this long at most.
MOST_BUCKETS = 4096
#: Bits a key and hashes of a bucket's Bloom filter.
BLOOM_BITS, BLOOM_HASHES = 12, 3
BUCKET, RUN = "bucket_", "run_"
MANIFEST = "run string, number long, level int, buckets int, rows long, bloom_words int"


class StateTable:
    """The rows of each key that came last, under `path`. With `bloom`, lookups skip buckets that can't hold their keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, order: str | None = None, split: int = SPLIT, fan: int = FAN, bloom: bool = False):
        self.spark, self.path, self.keys, self.schema, self.order, self.split, self.fan, self.bloom = spark, path, keys, schema, order, split, fan, bloom

    # ---- versions ----

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        try:
            df = self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r[0] for r in df.select("version").distinct().collect())

    def manifest(self, version: int | None) -> list:
        """The live runs of a version, newest first: a few a level."""
        if version is None:
            return []
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").orderBy(F.desc("number"), F.desc("run")).collect()

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    # ---- reading ----

    def _run(self, r) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, *StructType.fromDDL(f"{BUCKET} int").fields])).parquet(f"{self.path}/data/{r.run}")

    def _newest(self, parts: list[DataFrame]) -> DataFrame:
        """Of each key the row with the greatest order, or that of the newest run."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        both = reduce(DataFrame.unionByName, parts)
        rank = F.struct(*([self.order] if self.order else []), RUN)
        return both.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(F.max_by(F.struct(*self.schema.names), rank).alias("r")).select("r.*")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is named; none before the first batch."""
        version = max(self.versions(), default=None) if version is None else version
        return self._newest([self._run(r).drop(BUCKET).withColumn(RUN, F.lit(r.number)) for r in self.manifest(version)])

    def _may_hold(self, keys: DataFrame, r) -> DataFrame:
        """The keys that a run may hold, by its Bloom filters."""
        bits = 64 * r.bloom_words
        at = keys.withColumn(BUCKET, self._bucket(r.buckets)).withColumn("__at", F.explode(_bloom_bits(self.keys, bits)))
        want = at.withColumn("word", F.shiftright("__at", 6).cast("int"))
        filters = self.spark.read.schema(f"word int, mask long, {BUCKET} int").parquet(f"{self.path}/bloom/{r.run}")
        hit = want.join(filters, [BUCKET, "word"]).filter(F.expr("(mask & shiftleft(1L, cast(__at & 63 AS int))) != 0"))
        return hit.groupBy(*self.keys).agg(F.countDistinct("__at").alias("n"), F.first(BUCKET).alias(BUCKET)).join(want.groupBy(*self.keys).agg(F.countDistinct("__at").alias("m")), self.keys).filter("n = m").drop("n", "m")

    def lookup(self, keys: DataFrame, version: int | None) -> DataFrame:
        """The rows of the given keys (distinct; with Bloom filters, not null); of each run only buckets are read that may hold one of them."""
        parts = []
        named = keys.select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
        for r in self.manifest(version):
            asked = self._may_hold(keys, r) if self.bloom and r.bloom_words else keys.withColumn(BUCKET, self._bucket(r.buckets))
            hit = [x[0] for x in asked.select(BUCKET).distinct().collect()]  # MOST_BUCKETS numbers at most
            if hit:
                parts.append(self._run(r).filter(F.col(BUCKET).isin(hit)).drop(BUCKET).join(named, same, "left_semi").select(*self.schema.names).withColumn(RUN, F.lit(r.number)))
        return self._newest(parts)

    # ---- writing ----

    def _write(self, rows: DataFrame, run: str, number: int, level: int, n: int) -> tuple:
        buckets = 1
        while buckets * self.split < n and buckets < MOST_BUCKETS:
            buckets *= 2
        rows.select(*self.schema.names).withColumn(BUCKET, self._bucket(buckets)).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{run}")
        words = 0
        if self.bloom and n:
            words = 1
            while 64 * words * buckets < BLOOM_BITS * n:
                words *= 2
            r = _Run(run, number, buckets)
            bit = self._run(r).select(BUCKET, F.explode(_bloom_bits(self.keys, 64 * words)).alias("__at"))
            masks = bit.groupBy(BUCKET, F.shiftright("__at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at & 63 AS int))")).alias("mask"))
            masks.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/bloom/{run}")
        return (run, number, level, buckets, n, words)

    def append(self, rows: DataFrame, version: int) -> None:
        """Commit `rows` (one a key at most) as `version`, and merge levels that are full."""
        versions = self.versions()
        if version in versions:
            return
        before = max((v for v in versions if v < version), default=None)
        live = [tuple(r) for r in self.manifest(before)]
        rows = rows.persist()
        n = rows.count()
        if n:
            live.append(self._write(rows, f"{version:012d}-0", version, 0, n))
        rows.unpersist()
        level = 0
        while len(full := [r for r in live if r[2] == level]) >= self.fan:
            merged = self._newest([self._run(_Run(r[0], r[1], r[3])).drop(BUCKET).withColumn(RUN, F.lit(r[1])) for r in full])
            live = [r for r in live if r[2] != level]
            top = max(r[1] for r in full)
            live.append(self._write(merged, f"{version:012d}-{level + 1}", top, level + 1, sum(r[4] for r in full)))
            level += 1
        self.spark.createDataFrame(live, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the `keep` newest versions, and runs up to the newest that none of them names; the names of those runs."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        live = {r.run for v in kept for r in self.manifest(v)}
        conf, path_of = self.spark._jsparkSession.sessionState().newHadoopConf(), self.spark._jvm.org.apache.hadoop.fs.Path
        data = path_of(f"{self.path}/data")
        files = data.getFileSystem(conf)
        there = [p.getPath().getName() for p in files.listStatus(data)] if versions and files.exists(data) else []
        # a run of a later version belongs to a batch that is under way
        gone = sorted(r for r in there if r not in live and int(r.split("-")[0]) <= versions[-1])
        for p in [f"manifest/version={v}" for v in old] + [f"{d}/{run}" for run in gone for d in ("data", "bloom")]:
            files.delete(path_of(f"{self.path}/{p}"), True)
        return gone


class _Run:
    def __init__(self, run: str, number: int, buckets: int):
        self.run, self.number, self.buckets = run, number, buckets


def _bloom_bits(keys: list[str], bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(bits)) for i in range(BLOOM_HASHES)])


def _before(table: StateTable, batch_id: int) -> int | None:
    return max((v for v in table.versions() if v < batch_id), default=None)


def latest_log(table: StateTable, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the newest row of each key by `order` (the table's own). Writes the batch's rows, reads nothing of the past."""

    def run(batch: DataFrame, batch_id: int) -> None:
        one = batch.groupBy(*[F.col(k).alias(f"__{k}") for k in table.keys]).agg(F.max_by(F.struct(*table.schema.names), order).alias("r")).select("r.*")
        table.append(one, batch_id)

    return run


def upsert_log(table: StateTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts records (see `upsert_records`): looks up the batch's keys, writes the rows that change."""

    def run(batch: DataFrame, batch_id: int) -> None:
        keys = batch.select(*KEY).distinct()
        old = table.lookup(keys, _before(table, batch_id))
        out = upsert_records(old, batch)
        table.append(out.filter(F.col("outcome").isin("insert", "update")).drop("outcome"), batch_id)

    return run


def ingest_once(table: StateTable, order: list[str], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: `sink` gets the rows whose id never came before, of a batch's repeats the first by `order`.

    table: a StateTable of the ids alone, with Bloom filters. Rows without an id are passed on, as nothing says that they are repeats.
    The sink is called before the ids are committed, and once more if the batch fails after it: it must be idempotent by batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in table.keys])
        first = batch.filter(known).groupBy(*[F.col(k).alias(f"__{k}") for k in table.keys]).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        seen = table.lookup(first.select(*table.keys), _before(table, batch_id))
        new = first.join(seen, table.keys, "left_anti").select(*batch.columns).persist()
        sink(new.unionByName(batch.filter(~known)), batch_id)
        table.append(new.select(*table.keys), batch_id)
        new.unpersist()

    return run
