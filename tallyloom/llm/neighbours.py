"""Nearest neighbours by stable low-dimensional projections in kd-trees, with a chi-square stopping test.

Vectors are projected on DIMS Gaussian directions; for vectors at distance s the squared projected distance
over s squared follows a chi-square law with DIMS degrees of freedom. Points are visited by growing projected
distance and verified on the original vectors; once the next projected distance r satisfies
r^2 > q * d_k^2 (d_k: k-th best distance found, q: the law's CONFIDENCE quantile), a nearer vector is still
unseen with probability 1 - CONFIDENCE at most, and the search stops.

The plane cuts of a top tree, set by medians of a bounded SAMPLE of projections, split the vectors into leaves of
about LEAF rows; each leaf is one task's kd-tree. A query first searches its home leaf, which bounds d_k, and
then visits the leaves whose boxes pass the same test. Every vector is in the index.

Equal vectors are one entry that keeps its k + 1 smallest vec_ids, all that can appear in a list; so
thousands of copies cost one entry and ties stay exact.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do
rows without vec_id or of another length than the most frequent one. With fewer candidates than k all are
returned. Rows that agree in vec_id count as one per distinct vector. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize

K, QUERY_STEP = 10, 100
DIMS, CONFIDENCE = 8, 0.995
SAMPLE, LEAF, BUCKET = 20_000, 20_000, 32


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """The quantile for an even number of degrees of freedom, by bisection of its finite series."""

    def cdf(x):
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(29).standard_normal((width, dims))


def project(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Row by row the same result, whatever the batch."""
    return np.stack([(x * d[:, j]).sum(1) for j in range(d.shape[1])], 1)


class Tree:
    """A kd-tree as arrays: nodes split at the median of their widest side, boxes are tight."""

    def __init__(self, points: np.ndarray, bucket: int = BUCKET):
        self.order = np.arange(len(points))
        self.nodes = []  # (start, end, left, right)
        low, high = [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            s, e, parent, side = stack.pop()
            own = points[self.order[s:e]]
            me = len(self.nodes)
            self.nodes.append([s, e, -1, -1])
            low.append(own.min(0))
            high.append(own.max(0))
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            if e - s > bucket:
                axis = int((high[-1] - low[-1]).argmax())
                half = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(own[:, axis], half)]
                stack += [(s, s + half, me, 0), (s + half, e, me, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def gap(self, node, q):
        """Squared distance from q to a node's box."""
        d = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return (d * d).sum(-1)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, pq: np.ndarray, k: int, quantile: float, bound: float) -> list[tuple[float, int]]:
    """The k + 1 best (squared distance, row) entries; bound: a known squared distance of the k-th."""
    best: list[tuple[float, int, int]] = []
    heap = [(float(tree.gap(0, pq)), 0)]
    limit = bound
    while heap:
        r, node = heapq.heappop(heap)
        if r > quantile * limit:
            break
        s, e, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(heap, (float(tree.gap(child, pq)), child))
            continue
        rows = tree.order[s:e]
        diff = vectors[rows] - q
        for d, i in zip((diff * diff).sum(1).tolist(), rows.tolist()):
            entry = (-d, -int(ids[i]), i)
            if len(best) <= k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        if len(best) > k:
            limit = min(bound, -best[0][0])
    return [(-d, i) for d, _, i in best]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    df = vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    width = df.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return df.filter(F.size("v") == (width[0] if width else 0))


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, confidence: float = CONFIDENCE, leaf: int = LEAF, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance); queries: vec_ids divisible by `step`, or a table of vec_id."""
    rows = materialize(usable(vectors).withColumn("h", F.xxhash64("v")))
    asked = rows.filter(F.col("vec_id") % step == 0) if queries is None else rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    # the k + 1 smallest ids of each distinct vector; the rank limit is applied before the shuffle as well
    rank = F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id"))
    entries = rows.dropDuplicates(["vec_id", "h"]).withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries.withColumn("e", F.element_at("ids", 1)))
    n = entries.count()
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantile = chi_square_quantile(confidence)
    sample = np.array([r[0] for r in entries.orderBy(F.xxhash64("e", "h")).limit(SAMPLE).select("v").collect()])
    base = directions(sample.shape[1])
    seen = project(sample, base)
    top = Tree(seen, max(1, -(-leaf * len(seen) // n)))
    # a split plane for each inner node: halfway between its children's boxes on the axis that parts them
    planes: dict[int, tuple[int, float]] = {}
    for i, (_, _, a, b) in enumerate(top.nodes):
        if a >= 0:
            axis = int((top.high[i] - top.low[i]).argmax())
            planes[i] = (axis, float((top.high[a][axis] + top.low[b][axis]) / 2))

    def home(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        todo = [(0, np.arange(len(p)))]
        while todo:
            node, at = todo.pop()
            if node not in planes:
                out[at] = node
                continue
            axis, c = planes[node]
            left = p[at, axis] <= c
            todo += [(top.nodes[node][2], at[left]), (top.nodes[node][3], at[~left])]
        return out

    def place(batches):
        for b in batches:
            if len(b):
                p = project(np.stack(b["v"].to_numpy()), base)
                yield b.assign(p=list(p), leaf=home(p))

    placed = materialize(entries.mapInPandas(place, "h long, v array<double>, ids array<long>, e long, p array<double>, leaf long"))
    spans = placed.groupBy("leaf").agg(*[f(F.get("p", F.lit(j))).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(DIMS)]).collect()  # one row a leaf
    boxes = {r["leaf"]: (np.array([r[f"min{j}"] for j in range(DIMS)]), np.array([r[f"max{j}"] for j in range(DIMS)])) for r in spans}
    wanted = materialize(asked.select("h", "v").distinct().join(placed.select("h", "v", "e", "p", "leaf"), ["h", "v"]).select("e", "h", "v", "p", "leaf"))
    out = "e long, qh long, ch long, ce long, cids array<long>, d double"

    def look(first: bool):
        def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(qs) and len(cs):
                v, ids = np.stack(cs["v"].to_numpy()), cs["e"].to_numpy()
                tree = Tree(np.stack(cs["p"].to_numpy()))
                for q in qs.itertuples():
                    bound = np.inf if first else q.bound
                    for d, i in search(tree, v, ids, np.asarray(q.v), np.asarray(q.p), k, quantile, bound):
                        found.append((q.e, q.h, cs["h"].iat[i], ids[i], cs["ids"].iat[i], d))
            return pd.DataFrame(found, columns=["e", "qh", "ch", "ce", "cids", "d"])

        return run

    at_home = materialize(wanted.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(look(True), out))
    held = at_home.groupBy("e", "qh").agg(F.sort_array(F.collect_list(F.struct("d", F.size("cids").alias("n")))).alias("best"))  # k + 1 entries a query at most
    # the k + 1-th id's distance; unknown while the home leaf holds fewer
    reach = F.aggregate("best", F.struct(F.lit(0).alias("n"), F.lit(float("inf")).alias("d")), lambda a, x: F.when(a["n"] > k, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), F.when(a["n"] + x["n"] > k, x["d"]).otherwise(F.lit(float("inf"))).alias("d"))), lambda a: a["d"])
    bounds = held.select(F.col("e").alias("e2"), "qh", reach.alias("bound"))

    def spread(batches):
        names = np.array(list(boxes))
        low, high = np.stack([boxes[i][0] for i in boxes]), np.stack([boxes[i][1] for i in boxes])
        for b in batches:
            for q in b.itertuples():
                p = np.asarray(q.p)
                d = np.maximum(np.maximum(low - p, p - high), 0)
                near = names[((d * d).sum(1) <= quantile * q.bound) & (names != q.leaf)]
                if len(near):
                    yield pd.DataFrame({"e": q.e, "h": q.h, "v": [q.v] * len(near), "p": [q.p] * len(near), "bound": q.bound, "leaf": near})

    away = wanted.join(bounds, (wanted["e"] == bounds["e2"]) & (wanted["h"] == bounds["qh"])).select("e", "h", "v", "p", "bound", "leaf")
    away = away.mapInPandas(spread, "e long, h long, v array<double>, p array<double>, bound double, leaf long")
    others = away.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(look(False), out)
    both = at_home.unionByName(others)
    ids = both.select("e", "qh", "d", F.explode("cids").alias("vec_id"))
    best = ids.withColumn("r", F.row_number().over(W.partitionBy("e", "qh").orderBy("d", "vec_id"))).filter(F.col("r") <= k + 1)
    # each asking id drops itself from its vector's list
    who = asked.select("vec_id", "h", "v").distinct().join(wanted.select("e", "h", "v"), ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("e").alias("e3"), F.col("h").alias("h3"))
    listed = who.join(best, (who["e3"] == best["e"]) & (who["h3"] == best["qh"])).filter(F.col("vec_id") != F.col("query_id"))
    listed = listed.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "h3").orderBy("d", "vec_id"))).filter(F.col("rank") <= k)
    return listed.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d").alias("score"))
