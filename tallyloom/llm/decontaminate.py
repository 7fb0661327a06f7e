"""Benchmark decontamination by exact word windows, in DataFrame functions only.

The windows of the benchmark (13 words, or a shorter item as a whole) form a set that is
broadcast while it holds at most BROADCAST_WINDOWS windows and is shuffled beyond that.
Texts are scanned once for seeds: a window of n words holds, at each place, a run of SEED words at a
multiple of n - SEED + 1, so only those runs are probed in the set of the benchmark's runs. Texts with a
known seed are scanned again for whole windows, probed by hash and confirmed by their full words.
Texts are cut into segments of window starts, so that no row ever holds more than one segment's windows.

Defined cases: a null text, or one without words, has no windows and is clean. An item without
words has no window. Repeated items all count (by their item_id). Rows that share doc_id and text
share one result, given for each row. Extra columns are ignored by `report` and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, join_keys, materialize

WINDOW = 13
SEED = 4
#: Window starts of a segment: in the scan for seeds, and for whole windows.
SEED_SEGMENT, SEGMENT = 2048, 512
BROADCAST_WINDOWS = 500_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before folding.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _windows(ws: Column, length: int, starts: Column) -> Column:
    """array<struct<i, len, win>>: windows of `length` words at 0 .. starts - 1."""
    return F.when(starts > 0, F.transform(F.sequence(F.lit(0), F.greatest(starts, F.lit(1)) - 1), lambda i: F.struct(i.alias("i"), F.lit(length).alias("len"), F.array_join(F.slice(ws, i + 1, length), " ").alias("win"))))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, len, items): each distinct window and the sorted item ids that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
    n = F.size("ws")
    full = items.filter(n >= window).select("item", F.explode(_windows(F.col("ws"), window, n - (window - 1))).alias("x")).select("item", "x.len", "x.win")
    short = items.filter((n > 0) & (n < window)).select("item", n.alias("len"), F.array_join("ws", " ").alias("win"))
    return full.unionByName(short).groupBy("win", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else df


def _segments(ws: Column, size: int, overlap: int) -> Column:
    """array<struct<s, part>>: pieces of `size` starts and `overlap` further words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice(ws, s + 1, size + overlap).alias("part")))


def _runs(part: Column, k: int, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(part, i, k), " ").alias("gram")))


def seed_scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, n_words, rows, seeded), materialized: th = xxhash64(text), rows = how many rows agree in both."""
    lengths = sorted(r[0] for r in bench.select("len").distinct().collect())  # at most `window` numbers
    grams = bench.select(F.least("len", F.lit(SEED)).alias("k"), F.split("win", " ").alias("w"))
    grams = grams.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("gram")).distinct()
    known = _small(materialize(grams)).select("k", "gram", F.lit(True).alias("known"))
    tokens = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws"))
    parts = tokens.select("doc_id", "th", F.size("ws").alias("n"), F.explode(_segments(F.col("ws"), SEED_SEGMENT, window - 1)).alias("g"))
    part = F.col("g.part")
    # the first piece carries the number of words
    probes = [F.when(F.col("g.s") == 0, F.array(F.struct(F.lit(0).alias("k"), F.col("n").cast("string").alias("gram")))).otherwise(F.array().cast("array<struct<k:int,gram:string>>"))]
    for n in lengths:
        k = min(SEED, n)
        starts = F.sequence(F.lit(1), F.greatest(F.size(part) - (k - 1), F.lit(1)), F.lit(n - k + 1))
        probes.append(F.when(F.size(part) >= k, _runs(part, k, starts)).otherwise(F.array().cast("array<struct<k:int,gram:string>>")))
    found = parts.select("doc_id", "th", F.explode(F.concat(*probes)).alias("x")).select("doc_id", "th", "x.k", "x.gram").join(known, ["k", "gram"], "left").filter((F.col("k") == 0) | F.col("known"))
    count = F.when(F.col("k") == 0, F.col("gram").cast("long"))
    return materialize(found.groupBy("doc_id", "th").agg(F.max(count).alias("n_words"), F.count(count).alias("rows"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("seeded")))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The seed scan, and (doc_id, th, spans array<struct<i, len>>, items) for the documents that hold any window."""
    bench = materialize(benchmark_windows(benchmark, window))
    scan = seed_scan(docs, bench, window)
    lengths = sorted(r[0] for r in bench.select("len").distinct().collect())
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    some = join_keys(keyed, scan.filter("seeded").select("doc_id", "th"), ["doc_id", "th"], "left_semi")
    segments = some.select("doc_id", "th", words(F.col("text")).alias("ws")).select("doc_id", "th", F.explode(_segments(F.col("ws"), SEGMENT, window - 1)).alias("g"))
    part = F.col("g.part")
    made = [_windows(part, n, F.least(F.size(part) - (n - 1), F.lit(SEGMENT))) for n in lengths or [window]]
    found = segments.select("doc_id", "th", F.col("g.s").alias("s"), F.explode(F.concat(*[F.coalesce(m, F.array().cast("array<struct<i:int,len:int,win:string>>")) for m in made])).alias("x"))
    found = found.select("doc_id", "th", (F.col("s") + F.col("x.i")).alias("i"), F.col("x.len").alias("len"), F.col("x.win").alias("win")).join(_small(bench), ["win", "len"])
    return scan, found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("i", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Number of words inside the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda a, x: F.struct(F.greatest(a["end"], x["i"] + x["len"]).alias("end"), (a["n"] + F.greatest(x["i"] + x["len"] - F.greatest(a["end"], x["i"]), F.lit(0))).alias("n")), lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keyed: bool = False) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated (keyed: and th, the text's hash)."""
    base, found = hits(docs, benchmark, window)
    found = found.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), covered(F.col("spans")).alias("n_hit"), "items")
    out = base.join(found, base["doc_id"].eqNullSafe(found["__d"]) & (base["th"] == found["__t"]), "left")
    out = out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *(["th"] if keyed else []))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those of which 5 % of the words or more stand in benchmark windows; all columns kept."""
    bad = report(docs, benchmark, window, keyed=True).filter("contaminated").select("doc_id", "th").distinct()
    # a row travels as one struct, so that no column of the caller meets the key's
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("th"))
    return join_keys(packed, materialize(bad), ["doc_id", "th"], "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, words): the words of each document that stand in no benchmark window, joined by spaces."""
    found = hits(docs, benchmark, window)[1].select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spans")
    base = docs.select("doc_id", F.xxhash64("text").alias("__h"), words(F.col("text")).alias("ws"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["__d"]) & (base["__h"] == found["__t"]), "left")
    inside = lambda i: F.exists(F.coalesce("spans", F.array().cast("array<struct<i:int,len:int>>")), lambda s: (s["i"] <= i) & (i < s["i"] + s["len"]))
    return out.select("doc_id", F.array_join(F.filter("ws", lambda w, i: ~inside(i)), " ").alias("words"))


__all__ = ["benchmark_windows", "decontaminate", "hits", "remove_spans", "report", "seed_scan"]
