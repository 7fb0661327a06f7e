"""A stored inverted index: a change set writes a run of its own postings, searches read only the query's terms.

Postings lie in blocks of (term, chunk), sorted by term, so that equal terms and prefixes are found by file statistics. A chunk is a
part of one run's documents of similar length, `CHUNK` or so of them, the same for all terms; so a block is bounded however frequent its
term, and the best score that a chunk can hold is a sum over its blocks' heads (most weight, shortest document).
Runs of one level are merged when there are `fan` of them. A document's row in the table `docs` says in which version it was indexed
last; postings of an older version are dead, and leave when their run is merged. The manifest, one folder a version, is written last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.functions.columns import query_tokens
from tallyloom.functions.scratch import materialize
from tallyloom.operators.changes import in_scope
from tallyloom.operators.search import KIND_BOOSTS, WEIGHTS, boosted, gain, inverse_frequency, page_of, terms_of
from tallyloom.streaming.statetable import StateTable

CHUNK, FAN = 4096, 4
#: Chunks that are scored first, to learn which score the page needs.
FIRST = 4
MANIFEST = "run string, low long, high long, made long, level int, counts map<int,long>, n long, total long"


def _length_class(dl: Column) -> Column:
    """Four classes for each doubling of the length."""
    return F.floor(F.log2(dl + 1) * 4).cast("int")


def _weighed(weight: int):
    return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))


class TextIndex:
    """The index under `path` of documents (fact_key, kind, path, title, body); `key`: the type of fact_key."""

    def __init__(self, spark: SparkSession, path: str, key, fan: int = FAN, chunk: int = CHUNK):
        self.spark, self.path, self.fan, self.chunk = spark, path, fan, chunk
        fields = [StructField("fact_key", key), StructField("kind", StringType()), StructField("path", StringType()), StructField("dl", LongType()), StructField("born", LongType())]
        self.docs = StateTable(spark, f"{path}/docs", ["fact_key"], StructType(fields), bloom=True, fan=fan)
        self.gone_schema = StructType([fields[0], fields[4], StructField("version", LongType())])

    # ---- versions ----

    def _load(self, folder: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> list[int]:
        return sorted(r[0] for r in self._load("manifest", f"{MANIFEST}, version long").select("version").distinct().collect())

    def _manifest(self, version: int | None) -> tuple[list[dict], int, int]:
        """The live runs of a version, how many documents are live, and the sum of their lengths."""
        if version is None:
            return [], 0, 0
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        runs = [{k: r[k] for k in ("run", "low", "high", "made", "level", "counts")} for r in rows if r.run is not None]
        return runs, rows[0].n, rows[0].total

    def _gone(self, runs: list[dict], version: int) -> DataFrame:
        """(fact_key, born) of dead postings that the runs still hold."""
        held = reduce(lambda a, b: a | b, [F.col("born").between(r["low"], r["high"]) & (F.col("version") > r["made"]) for r in runs], F.lit(False))
        return self._load("gone", self.gone_schema).filter(held & (F.col("version") <= version)).select("fact_key", "born")

    # ---- writing ----

    def _write_run(self, postings: DataFrame, counts: dict[int, int], run: str) -> None:
        """postings (term, fact_key, born, wtf, dl), in blocks sorted by term."""
        parts = F.create_map(*[F.lit(int(x)) for c, n in counts.items() for x in (c, -(-n // self.chunk))])
        c = _length_class(F.col("dl"))
        chunk = c.cast("long") * (1 << 32) + F.pmod(F.xxhash64("fact_key"), F.element_at(parts, c))
        # one range shuffle clusters and sorts by (term, chunk); the grouping needs no other
        by = postings.withColumn("chunk", chunk).repartitionByRange("term", "chunk").groupBy("term", "chunk")
        blocks = by.agg(F.count("*").alias("n"), F.max("wtf").alias("most"), F.min("dl").alias("shortest"), F.collect_list(F.struct("fact_key", "born", "wtf", "dl")).alias("postings"))
        blocks.sortWithinPartitions("term", "chunk").write.mode("overwrite").parquet(f"{self.path}/blocks/{run}")

    def update(self, docs: DataFrame, version: int, deleted: DataFrame | None = None) -> None:
        """Commit added and changed documents (one row a fact_key) and keys that are deleted. A version that is there already is left."""
        versions = self.versions()
        if version in versions:
            return
        if versions and version < versions[-1]:
            raise ValueError(f"version {version} is older than {versions[-1]}")
        before = versions[-1] if versions else None
        runs, n, total = self._manifest(before)
        rows = docs.repartition("fact_key").select("fact_key", "kind", "path", *[F.coalesce(query_tokens(F.col(c)), F.array().cast("array<string>")).alias(f"t_{c}") for c in WEIGHTS])
        rows = rows.withColumn("dl", sum((F.size(f"t_{c}") for c in WEIGHTS), F.lit(0)).cast("long"))
        sized = materialize(rows.select("fact_key", "kind", "path", "dl").withColumn("born", F.lit(version).cast("long")))
        dead = None if deleted is None else deleted.select("fact_key").distinct().join(sized, "fact_key", "left_anti")
        touched = sized.select("fact_key") if dead is None else sized.select("fact_key").unionByName(dead)
        old = materialize(self.docs.lookup(touched, before).filter("born is not null"))
        m, less = old.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        classes = {r.c: (r.n, r.t) for r in sized.groupBy(_length_class(F.col("dl")).alias("c")).agg(F.count("*").alias("n"), F.sum("dl").alias("t")).collect()}  # a few hundred at most
        n, total = n + sum(a for a, _ in classes.values()) - m, total + sum(b for _, b in classes.values()) - less
        if m:
            old.select("fact_key", "born").write.mode("overwrite").parquet(f"{self.path}/gone/version={version}")
        state = sized if dead is None else sized.unionByName(dead.select("fact_key", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.docs.schema.fields[1:]]))
        self.docs.append(state, version)
        if classes:
            terms = F.explode(F.concat(*[F.transform(f"t_{c}", _weighed(w)) for c, w in WEIGHTS.items()])).alias("x")
            postings = rows.select("fact_key", "dl", terms).groupBy("fact_key", "dl", "x.term").agg(F.sum("x.w").cast("double").alias("wtf")).withColumn("born", F.lit(version).cast("long"))
            counts = {c: a for c, (a, _) in classes.items()}
            self._write_run(postings, counts, f"{version:012d}-0")
            runs.append({"run": f"{version:012d}-0", "low": version, "high": version, "made": version, "level": 0, "counts": counts})
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fan:
            runs = [r for r in runs if r["level"] != level] + [self._merge(full, version, level + 1)]
            level += 1
        none = {k: None for k in ("run", "low", "high", "made", "level", "counts")}
        out = [tuple(r.values()) + (n, total) for r in runs or [none]]
        self.spark.createDataFrame(out, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _merge(self, full: list[dict], version: int, level: int) -> dict:
        counts: dict[int, int] = {}
        for r in full:
            for c, k in r["counts"].items():
                counts[c] = counts.get(c, 0) + k
        run = f"{version:012d}-{level}"
        live = self._blocks(full).select("term", F.explode("postings").alias("p")).select("term", "p.*").join(self._gone(full, version), ["fact_key", "born"], "left_anti")
        self._write_run(live, counts, run)
        return {"run": run, "low": min(r["low"] for r in full), "high": max(r["high"] for r in full), "made": version, "level": level, "counts": counts}

    # ---- searching ----

    def _blocks(self, runs: list[dict]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/blocks/{r['run']}").withColumn("run", F.lit(r["run"])) for r in runs])

    def search(self, query: str, kinds: list[str] | None = None, prefixes: list[str] | None = None, mode: str = "all", limit: int | None = None, offset: int = 0, boost: str = "multiply", version: int | None = None) -> DataFrame:
        """What `search` gives for the live documents of a version (the newest if none is named).

        With a limit, `FIRST` chunks are scored to learn a score that the page reaches; of the others, only those are opened whose
        bound is not below it. Without one, all blocks of the query's terms are.
        """
        version = max(self.versions(), default=None) if version is None else version
        runs, n, total = self._manifest(version)
        wanted = terms_of(query)
        if not wanted or not runs or not n:
            none = self.docs.read(version).limit(0).select("fact_key", "kind", "path", F.lit(0.0).alias("score"))
            return none if limit is None else none.withColumn("has_more", F.lit(False))
        mean = total / n
        blocks = self._blocks(runs)
        heads = reduce(DataFrame.unionByName, [blocks.filter(F.col("term").startswith(t) if p else F.col("term") == t).withColumn("q", F.lit(i)) for i, (t, p) in enumerate(wanted)])
        gone = self._gone(runs, version)
        if gone.limit(1).count() or wanted[-1][1]:  # a document may have several terms of one prefix
            keys = heads.select("q", F.explode("postings").alias("p")).select("q", "p.fact_key", "p.born").distinct().join(gone, ["fact_key", "born"], "left_anti")
            df = keys.groupBy("q").agg(F.count("*").alias("df"))
        else:
            df = heads.groupBy("q").agg(F.sum("n").alias("df"))
        found = {r.q: r.df for r in df.collect()}  # a number a term of the query
        idf = F.element_at(F.create_map(*[x for q in range(len(wanted)) for x in (F.lit(q), inverse_frequency(F.lit(n), F.lit(found.get(q, 0))))]), F.col("q"))

        def scored(opened: DataFrame) -> DataFrame:
            hits = opened.select("q", F.explode("postings").alias("p")).select("q", "p.*").groupBy("q", "fact_key", "born", "dl").agg(F.sum("wtf").alias("wtf"))
            by = hits.groupBy("fact_key", "born").agg(F.sum(gain(idf, F.col("wtf"), F.col("dl"), F.lit(mean))).alias("raw"), F.count("*").alias("terms"))
            if mode == "all":
                by = by.filter(F.col("terms") == len(wanted))
            if limit is None:
                live = self.docs.read(version)
            else:
                by = materialize(by)
                live = self.docs.lookup(by.select("fact_key").distinct(), version)
            out = live.join(by, ["fact_key", "born"]).filter(in_scope(F.col("path"), prefixes or []))
            if kinds:
                out = out.filter(F.col("kind").isin(kinds))
            return out.select("fact_key", "kind", "path", boosted(F.col("raw"), F.col("kind"), boost).alias("score"))

        order = [F.desc("score"), F.col("fact_key")]
        if limit is None:
            return page_of(scored(heads), order, offset, None)
        by_chunk = heads.groupBy("q", "run", "chunk").agg(F.sum("most").alias("most"), F.min("shortest").alias("shortest"))
        bound = by_chunk.groupBy("run", "chunk").agg(F.sum(gain(idf, F.col("most"), F.col("shortest"), F.lit(mean))).alias("bound"), F.count("*").alias("terms"))
        if mode == "all":
            bound = bound.filter(F.col("terms") == len(wanted))
        bound = materialize(bound.select("run", "chunk", "bound"))
        best = bound.orderBy(F.desc("bound"), "run", "chunk").limit(FIRST)
        need = scored(heads.join(F.broadcast(best.select("run", "chunk")), ["run", "chunk"])).orderBy(*order).offset(offset + limit).limit(1).collect()
        if need:
            # a boost never lifts a score by more than this, and sums of floats may differ in their last digits
            lift = max(KIND_BOOSTS.values()) if boost == "multiply" else 1.0
            bound = bound.filter(F.col("bound") * lift >= need[0].score * (1 - 1e-9))
        return page_of(scored(heads.join(bound.select("run", "chunk"), ["run", "chunk"])), order, offset, limit)
