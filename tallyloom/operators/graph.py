"""Dependency graphs as edge tables: eligible edges, consumers, impact, cycles, closures, attribution, beams.

Loops write each step's small table to the shared folder, so that lineage doesn't grow.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyloom.functions.scratch import materialize, scratch_dir

#: Hops of a closure between two writes.
STEPS = 3


def eligible_edges(rows: DataFrame, manifest: bool = False) -> DataFrame:
    """Resolved semantic edges (and manifest metadata when asked) with both ends, one a (source, target, table)."""
    kinds = F.col("evidence_kind") == "semantic"
    if manifest:
        kinds = kinds | (F.col("evidence_kind") == "metadata") & (F.col("authority") == "manifest")
    ok = (F.col("resolution_status") == "resolved") & kinds & F.col("source_path").isNotNull() & F.col("target_path").isNotNull()
    return rows.filter(ok).groupBy("source_path", "target_path", "table").agg(F.min("evidence_id").alias("evidence_id"))


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_path").alias("source"), F.col("target_path").alias("target")).distinct()


def consumers(edges: DataFrame, tables: tuple = ("imports", "calls")) -> DataFrame:
    """Reversed edges of imports and calls."""
    return edges.filter(F.col("table").isin(*tables)).select(F.col("target_path").alias("path"), F.col("source_path").alias("consumer")).distinct()


def impact(deps: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(node, depth, path): what depends on the seeds, breadth first, each node by its first path.

    The order of a level is (parent's order, name), which is the order of the paths themselves. The search keeps a node, its
    depth, its parent and the parent's place in its level; a level is sorted once, so no path travels. Paths are put together at the
    end, level by level for the rows that are returned. A level joins its frontier once with the edges and once with the nodes seen,
    which lie in a table a level. Seeds are never rows.
    """
    edges = materialize(deps.select("source", "target").distinct())
    spark = edges.sparkSession
    folder = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"

    def put(level: DataFrame, depth: int) -> DataFrame:
        """Write a level (node, parent, up) and read it back with `place`, which grows with (up, the node's text)."""
        name = F.col("node").cast("string")
        ranked = level.repartitionByRange("up", name).sortWithinPartitions("up", name).withColumn("place", F.monotonically_increasing_id())
        ranked.write.parquet(f"{folder}/depth={depth}")
        return spark.read.schema(ranked.schema).parquet(f"{folder}/depth={depth}")

    first = seeds.select("node").distinct()
    front = put(first.select("node", F.lit(None).cast(first.schema["node"].dataType).alias("parent"), F.lit(0).cast("long").alias("up")), 0)
    shape, depth = front.schema, 0
    while (max_depth is None or depth < max_depth) and front.limit(1).count():
        depth += 1
        step = edges.join(front.select(F.col("node").alias("target"), "place"), "target").groupBy(F.col("source").alias("node")).agg(F.min(F.struct("place", "target")).alias("b"))
        seen = spark.read.schema(shape).parquet(*[f"{folder}/depth={d}" for d in range(depth)]).select("node")
        front = put(step.join(seen, "node", "left_anti").select("node", F.col("b.target").alias("parent"), F.col("b.place").alias("up")), depth)
    every = spark.read.schema(StructType([*shape.fields, StructField("depth", IntegerType())])).parquet(folder)
    out = every.filter("depth > 0")
    if max_rows is not None:
        out = out.orderBy("depth", "place").limit(max_rows)
    out = _paths(every, out, depth)
    if max_bytes is not None:
        out = _within(out, F.octet_length(F.array_join("path", "/")), max_bytes)
    if max_rows is not None:
        out = out.orderBy("depth", "place")
    return out.select("node", "depth", "path")


def _paths(every: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """(node, depth, place, path) of rows by their parents: pointers double, so a path of n nodes takes about log n joins."""
    text = lambda c: F.col(c).cast("string")
    # a jump of a node: the ancestor it ends at, and the names from below that ancestor down to the node
    jump = every.select("node", F.col("parent").alias("to"), F.array(text("node")).alias("tail"))
    span = 1
    while span <= depth:
        j = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("tail").alias("head"))
        jump = materialize(jump.join(j, "to", "left").select("node", F.col("to2").alias("to"), F.concat(F.coalesce("head", F.array().cast("array<string>")), "tail").alias("tail")))
        span *= 2
    return rows.select("node", "depth", "place").join(jump.select("node", F.col("tail").alias("path")), "node")


def _within(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """The first rows by (depth, place) whose sizes add up to `most` at most; sums of parts in order, then within a part."""
    cut = materialize(rows.withColumn("__s", size).repartitionByRange("depth", "place").sortWithinPartitions("depth", "place").withColumn("__p", F.spark_partition_id()))
    before, n = {}, 0
    for r in sorted(cut.groupBy("__p").agg(F.sum("__s").alias("s")).collect(), key=lambda r: r["__p"]):  # a number a part
        before[r["__p"]], n = n, n + r.s
    if not before:
        return cut.drop("__s", "__p")
    base = F.element_at(F.create_map(*[F.lit(x) for p, k in before.items() for x in (p, k)]), F.col("__p")).cast("long")
    upto = base + F.sum("__s").over(W.partitionBy("__p").orderBy("depth", "place").rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("__u", upto).filter(F.col("__u") <= most).drop("__s", "__p", "__u")


def strong_components(deps: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, and self-loops; named by their smallest node.

    Nodes without a way in or out are trimmed; colours (the smallest node that reaches a node) are spread forward, and each
    colour's root collects, backward within its colour, its component. Settled nodes leave; the rest goes round again.
    """
    edges = materialize(deps.select("source", "target").distinct())
    loops = edges.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    live = materialize(edges.filter("source <> target"))
    out = None
    while True:
        n = live.count()
        while n:
            kept = live
            for _ in range(STEPS):
                kept = kept.join(kept.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
                kept = kept.join(kept.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
            kept = materialize(kept)
            m = kept.count()
            live = kept
            if m == n:
                break
            n = m
        if not n:
            break
        nodes = live.select(F.col("source").alias("node")).unionByName(live.select(F.col("target").alias("node"))).distinct()
        colour = materialize(nodes.withColumn("c", F.col("node")))
        while True:
            new = colour.select("node", "c", F.col("c").alias("old"))
            for _ in range(STEPS):
                sent = live.join(new, F.col("source") == F.col("node")).groupBy("target").agg(F.min("c").alias("m"))
                new = new.join(sent, F.col("node") == F.col("target"), "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), "old")
            new = materialize(new)
            colour = new.select("node", "c")
            if not new.filter("c < old").limit(1).count():
                break
        a, b = colour.select(F.col("node").alias("source"), F.col("c").alias("cs")), colour.select(F.col("node").alias("target"), F.col("c").alias("ct"))
        inner = materialize(live.join(a, "source").join(b, "target").filter("cs = ct").select("source", "target", "cs"))
        found = front = materialize(colour.filter("node = c"))
        while True:
            near = front
            for _ in range(STEPS):
                back = inner.join(near, (F.col("target") == F.col("node")) & (F.col("cs") == F.col("c"))).select(F.col("source").alias("node"), "c")
                near = near.unionByName(back).distinct()
            front = materialize(near.join(found, ["node", "c"], "left_anti"))
            if not front.limit(1).count():
                break
            found = found.unionByName(front)
        sizes = found.groupBy("c").agg(F.count("*").alias("n"), F.min("node").alias("component"))
        comp = materialize(found.join(sizes, "c").select("node", "component", "n"))
        big = comp.filter("n > 1").select("node", "component")
        out = big if out is None else out.unionByName(big)
        gone = comp.select("node")
        live = materialize(live.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"))
    if out is None:
        return loops.distinct()
    return out.unionByName(loops.join(out.select("node"), "node", "left_anti")).distinct()


def cycles(deps: DataFrame) -> DataFrame:
    """(cycle_id, members, size): sorted members and their digest. A cycle's members are one row; where one may have millions, take `strong_components`, a row a node."""
    by = strong_components(deps).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return by.select(F.sha2(F.array_join(F.transform("members", lambda x: x.cast("string")), "\x00"), 256).alias("cycle_id"), "members", F.size("members").alias("size"))


def dead_code(symbols: DataFrame, entrypoints: DataFrame, consumed: DataFrame) -> DataFrame:
    """Resolved semantic symbols whose path is neither an entry point nor consumed; 0.65 sure, or 0.35 when uncertain, never surer than the symbol."""
    s = symbols.filter((F.col("resolution_status") == "resolved") & (F.col("evidence_kind") == "semantic"))
    s = s.join(entrypoints.select("path"), "path", "left_anti").join(consumed.select("path"), "path", "left_anti")
    cap = F.when(F.col("uncertain"), 0.35).otherwise(0.65)
    return s.select("symbol_id", "path", F.when(F.col("uncertain"), "uncertain").otherwise("likely").alias("certainty"), F.least("confidence", cap).alias("confidence"))


def attribute_processes(processes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each process with the session of its nearest registered ancestor; pointers double, so deep trees take few rounds."""
    own = processes.select("pid", "parent_pid", "cpu_percent").join(sessions.select(F.col("root_pid").alias("pid"), "session_id"), "pid", "left").select("pid", "parent_pid", "cpu_percent", F.col("session_id").alias("s"))
    up = materialize(own.select("pid", F.when(F.col("s").isNull() & (F.col("parent_pid") != F.col("pid")), F.col("parent_pid")).alias("up"), "s"))
    while True:
        p = up.select(F.col("pid").alias("p2"), F.col("up").alias("u2"), F.col("s").alias("s2"))
        new = materialize(up.join(p, F.col("up") == F.col("p2"), "left").select("pid", F.when(F.col("s").isNull() & F.col("s2").isNull(), F.col("u2")).alias("up"), F.coalesce("s", "s2").alias("s")))
        up = new
        if not new.filter("up is not null").limit(1).count():
            break
    j = own.select("pid", "cpu_percent", F.col("s").isNotNull().alias("root")).join(up.select("pid", F.col("s").alias("session_id")), "pid")
    method = F.when(F.col("root"), "registered").when(F.col("session_id").isNotNull(), "ancestor").otherwise("none")
    sure = F.when(F.col("root"), 1.0).when(F.col("session_id").isNotNull(), 0.95).otherwise(0.0)
    return j.select("pid", "session_id", method.alias("method"), sure.alias("confidence"), (F.col("session_id").isNotNull() & (F.col("cpu_percent") >= 80)).alias("cpu_alert"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The nodes that `start` (node) reaches over (source, target), itself included."""
    e = materialize(edges.select("source", "target").distinct())
    seen = front = materialize(start.select("node").distinct())
    while True:
        near = front
        for _ in range(STEPS):
            near = near.unionByName(e.join(near, F.col("source") == F.col("node")).select(F.col("target").alias("node"))).distinct()
        front = materialize(near.join(seen, "node", "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def package_edges(packages: DataFrame) -> DataFrame:
    """(source, target) from the arrays of dependencies, inside the workspace."""
    e = packages.select(F.col("name").alias("source"), F.explode(F.concat(F.coalesce("dependencies", F.array().cast("array<string>")), F.coalesce("dev_dependencies", F.array().cast("array<string>")))).alias("target"))
    return e.join(packages.select(F.col("name").alias("target")), "target", "left_semi").distinct()


def package_scope(edges: DataFrame, start: DataFrame, dependents: bool = False) -> DataFrame:
    """The closure of what the packages depend on; with dependents also of what depends on them."""
    down = closure(edges, start)
    if not dependents:
        return down
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return down.unionByName(closure(back, start)).distinct()


def affected_packages(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed packages and one hop of dependents."""
    one = edges.join(changed.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node"))
    return changed.select("node").unionByName(one).distinct()


def policy_evidence(policies: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(policy_id, path, hop, label) within two hops of each policy's targets over typed edges, undirected, the nearest hop of each path."""
    both = edges.select("source", "target", "label").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "label"))
    start = policies.select("policy_id", F.col("target").alias("path")).distinct()
    one = start.join(both, F.col("path") == F.col("source")).groupBy("policy_id", F.col("target").alias("p")).agg(F.min("label").alias("label")).select("policy_id", F.col("p").alias("path"), "label")
    one = materialize(one.join(start, ["policy_id", "path"], "left_anti"))
    two = one.drop("label").join(both, F.col("path") == F.col("source")).groupBy("policy_id", F.col("target").alias("p")).agg(F.min("label").alias("label")).select("policy_id", F.col("p").alias("path"), "label")
    two = two.join(start.unionByName(one.drop("label")), ["policy_id", "path"], "left_anti")
    out = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    if most is None:
        return out
    return out.withColumn("__r", F.row_number().over(W.partitionBy("policy_id").orderBy("hop", "path"))).filter(F.col("__r") <= most).drop("__r")


def expand_relations(hits: DataFrame, edges: DataFrame, depth: int, limit: int) -> DataFrame:
    """(row_key, distance, score): the best hits, then layers of neighbours of at most limit / (depth + 1) rows, then what is left of the hits, up to limit."""
    each = max(1, limit // (depth + 1))
    both = materialize(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    front = materialize(hits.orderBy(F.desc("score"), "row_key").limit(each).select("row_key", F.lit(0).alias("distance"), "score"))
    seen = front
    for d in range(1, depth + 1):
        nxt = both.join(front, F.col("source") == F.col("row_key")).groupBy("target").agg(F.max("score").alias("score")).select(F.col("target").alias("row_key"), F.lit(d).alias("distance"), "score")
        front = materialize(nxt.join(seen, "row_key", "left_anti").orderBy(F.desc("score"), "row_key").limit(each))
        seen = seen.unionByName(front)
    rest = hits.join(seen, "row_key", "left_anti").select("row_key", F.lit(None).cast("int").alias("distance"), "score")
    every = seen.withColumn("__o", F.col("distance")).unionByName(rest.withColumn("__o", F.lit(depth + 1)))
    return every.orderBy("__o", F.desc("score"), "row_key").limit(limit).drop("__o")
