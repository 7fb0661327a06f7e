"""A stored hash tree over files: a change set rewrites only the nodes above its paths, a diff descends only into unequal ones.

A node is a prefix of the path's MD5, two digits longer at each level; a leaf lists its (path, digest), an inner node its at most 256
children. Nodes lie in a log-structured table by prefix (`streaming/statetable.py`): an update looks up the nodes that it touches,
and writes those whose digest changes as one version. The root is `changes.fingerprint` of the same files with the same `rows`.

A tree has the depth that `fingerprint` takes for its number of files. An update that passes a bound (16 to the power 2, 4, ... times
`rows`) builds a new tree from all leaves; a diff across such an update reads both versions whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyloom.functions.scratch import materialize
from tallyloom.operators.changes import diff_snapshots, fingerprint_digits
from tallyloom.streaming.statetable import FAN, StateTable

#: Files a leaf, or so; nodes a bucket of a run.
ROWS, NODES = 256, 4096
PARTS = ArrayType(StructType([StructField("key", StringType()), StructField("x", StringType()), StructField("n", LongType())]))
NODE = StructType([StructField("k", StringType()), StructField("n", LongType()), StructField("x", StringType()), StructField("parts", PARTS)])


def _nodes(parts: DataFrame, leaf: bool) -> DataFrame:
    """The nodes of parts (k, key, x, n)."""
    line = F.concat_ws("\x00", "key", "x") if leaf else F.col("x")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)
    return parts.groupBy("k").agg(F.sum("n").alias("total"), digest.alias("digest"), F.collect_list(F.struct("key", "x", "n")).alias("parts")).select("k", F.col("total").alias("n"), F.col("digest").alias("x"), "parts")


def _parts(nodes: DataFrame) -> DataFrame:
    return nodes.select("k", F.inline("parts"))


def _above(nodes: DataFrame, digits: int) -> DataFrame:
    """Nodes as the parts of their parents, whose prefixes have so many digits."""
    return nodes.select(F.substring("k", 1, digits).alias("k"), F.col("k").alias("key"), "x", "n")


class HashTree:
    """The tree under `path`. Rows without a path are left out; of a path's rows in one change set the greatest digest counts."""

    def __init__(self, spark: SparkSession, path: str, rows: int = ROWS, fan: int = FAN):
        self.spark, self.path, self.rows, self.fan = spark, path, rows, fan

    # ---- versions ----

    def _table(self, built: int) -> StateTable:
        return StateTable(self.spark, f"{self.path}/tree-{built}", ["k"], NODE, split=NODES, fan=self.fan)  # the oldest run holds most nodes: filters would skip little

    def versions(self) -> dict[int, tuple[int, int]]:
        """Of each version the one that its tree was built for, and the digits of the tree's leaves."""
        try:
            trees = self.spark.read.schema("digits int, built long").parquet(f"{self.path}/trees").collect()  # one row a rebuild
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {v: (t.built, t.digits) for t in sorted(trees, key=lambda t: t.built) for v in self._table(t.built).versions()}

    def _at(self, version: int | None) -> tuple[int, int, int]:
        found = self.versions()
        version = max(found) if version is None else version
        return version, *found[version]

    # ---- reading ----

    def root(self, version: int | None = None) -> DataFrame:
        """fingerprint, files; no row for an empty tree."""
        version, built, _ = self._at(version)
        top = self._table(built).lookup(self._root(), version)
        return top.filter("n > 0").select(F.col("x").alias("fingerprint"), F.col("n").alias("files"))

    def files(self, version: int | None = None) -> DataFrame:
        """path, digest of all files."""
        version, built, digits = self._at(version)
        leaves = self._table(built).read(version).filter(F.length("k") == digits)
        return _parts(leaves).select(F.col("key").alias("path"), F.col("x").alias("digest"))

    def diff(self, old: int, new: int, generation: str) -> DataFrame:
        """`diff_snapshots` of two versions, from the leaves that differ."""
        (old, built, digits), (new, other, _) = self._at(old), self._at(new)
        if built != other:
            return diff_snapshots(self.files(old), self.files(new), generation)
        table, touched = self._table(built), self._root()
        for d in range(0, digits + 1, 2):
            a, b = (_parts(table.lookup(touched, v)) for v in (old, new))
            if d < digits:
                pair = a.select("key", F.col("x").alias("was")).join(b.select("key", F.col("x").alias("now")), "key", "full_outer")
                touched = materialize(pair.filter(~F.col("was").eqNullSafe(F.col("now"))).select(F.col("key").alias("k")))
        a, b = (p.select(F.col("key").alias("path"), F.col("x").alias("digest")) for p in (a, b))
        return diff_snapshots(a, b, generation)

    def _root(self) -> DataFrame:
        return self.spark.createDataFrame([("",)], "k string")

    # ---- writing ----

    def update(self, changes: DataFrame, version: int) -> None:
        """Commit a change set (path, digest; without a digest the path goes) as `version`. A version that is there already is left."""
        found = self.versions()
        if version in found:
            return
        given = materialize(changes.filter("path IS NOT NULL").groupBy("path").agg(F.max("digest").alias("digest")))
        before = max((v for v in found if v < version), default=None)
        if before is None:
            return self._build(given.filter("digest IS NOT NULL"), version)
        built, digits = found[before]
        table = self._table(built)
        late = given.select(F.substring(F.md5("path"), 1, digits).alias("k"), F.col("path").alias("key"), F.col("digest").alias("x"), F.lit(1).cast("long").alias("n"))
        levels = []
        for d in range(digits, -1, -2):
            touched = late.select("k").distinct()
            old = materialize(table.lookup(touched, before))
            both = _parts(old).withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
            newest = both.groupBy("k", "key").agg(F.max_by(F.struct("x", "n"), "late").alias("p")).select("k", "key", "p.*").filter("x IS NOT NULL")
            nodes = touched.join(_nodes(newest, d == digits), "k", "left").join(old.select("k", F.col("x").alias("was")), "k", "left")
            # a prefix that lost all its files stays as an empty node, so that lookups find it rather than what it was
            levels.append(materialize(nodes.filter(~F.col("x").eqNullSafe(F.col("was"))).select("k", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "x", F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))))
            late = _above(levels[-1], max(d - 2, 0))
        top = levels[-1].first() or table.lookup(self._root(), before).first()
        if fingerprint_digits(top.n if top else 0, self.rows) != digits:
            kept = self.files(before).join(given.select("path"), "path", "left_anti")
            return self._build(kept.unionByName(given.filter("digest IS NOT NULL")), version)
        nodes = levels[0]
        for level in levels[1:]:
            nodes = nodes.unionByName(level)
        table.append(nodes, version)

    def _build(self, files: DataFrame, version: int) -> None:
        files = materialize(files)
        n = files.count()
        digits = fingerprint_digits(n, self.rows)
        parts = files.select(F.substring(F.md5("path"), 1, digits).alias("k"), F.col("path").alias("key"), F.col("digest").alias("x"), F.lit(1).cast("long").alias("n"))
        level = nodes = materialize(_nodes(parts, True))
        for d in range(digits - 2, -1, -2):
            level = materialize(_nodes(_above(level, d), False))
            nodes = nodes.unionByName(level)
        if not n:  # an empty table has no version
            nodes = self.spark.createDataFrame([("", 0, None, [])], NODE)
        self._table(version).append(nodes, version)
        # the row that makes the tree visible comes last
        self.spark.createDataFrame([(digits,)], "digits int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/trees/built={version}")
