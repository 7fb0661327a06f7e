"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document has a rate w, the number of times it is taken. The mix is the one of least relative entropy to
taking all once, with 0 <= w <= CAP, under these constraints on words:
* the words of each source s sum to its target T_s;
* the mean log length of the documents, weighted by words, stays that of the corpus, so that a source can't be cut
  by dropping its long texts alone. This one is soft (RIDGE), as it may be out of reach.
So w = min(CAP, exp(lambda_s + beta * x)), where x is the log of the document's size less the corpus' mean. beta couples
all sources, and (lambda, beta) minimise a convex dual. Each of Newton's steps sums gradient and Hessian over all
documents: these are reduced once, without loss, to counts by (source, size), which stay a distributed table; a
step is one map-side aggregation to a row a source, of which only the sums that set beta's step reach the driver.

Rounding: a document has floor(w) copies. The words that its source lacks are dealt as further copies in the order of
u / (w - floor(w)), u being uniform from md5(doc_id) (sequential Poisson sampling), so that documents gain a copy in
proportion to what their rate was cut by; the last of these is cut at a word. So the words taken meet the target
to one word. Running sums are taken within parts of a source, which grow in number with its rows, and then over
the parts, so a source with a third of all rows is spread out.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target
stops at CAP times its source's size and the excess is shared by weight among the others.

Defined cases: a null or blank text has size 0 and takes 0 words. A null source is a source of its
own, the last. Sources without words have target 0. Rows that agree in doc_id are ordered by size
and text hash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize

CAP = 3
WEIGHTS = (5, 2, 1)
RIDGE, NEWTON_STEPS, TOLERANCE = 0.05, 40, 1e-11
#: A table of at most this many sources may be broadcast.
SOURCES = 100_000
#: Rows of a part of a source, about.
PART_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> with target: min(cap * size, weight * level), the level filled so that the targets sum to all words.

    Sources are few against documents; they are ordered in one window.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sources.select("*", w.cast("long").alias("w"), (cap * F.col("source_size")).alias("most"))
    by_ratio = W.orderBy((F.col("most").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.withColumns({"below": F.coalesce(F.sum("most").over(by_ratio), F.lit(0)), "w_below": F.coalesce(F.sum("w").over(by_ratio), F.lit(0)), "total": F.sum("source_size").over(every), "w_all": F.sum("w").over(every)})
    level = (F.col("total") - F.col("below")).cast("double") / (F.col("w_all") - F.col("w_below"))
    s = s.withColumn("level", level)
    free = F.when(F.col("most").cast("double") / F.col("w") >= F.col("level"), F.struct("w_below", "level"))
    s = s.withColumn("mu", F.min(free).over(every)["level"])
    return s.select(*sources.columns, F.least(F.col("most").cast("double"), F.coalesce(F.col("w") * F.col("mu"), F.col("most").cast("double"))).alias("target"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SOURCES + 1).count() <= SOURCES else df


def _x(mean: float):
    return F.when(F.col("size") > 0, F.log(F.col("size").cast("double"))).otherwise(F.lit(mean)) - F.lit(mean)


def _rate(mean: float, beta: float, cap: int):
    """w of a row of (size, full, lam); a source at its cap is full."""
    tilted = F.exp(F.least(F.col("lam") + F.lit(beta) * _x(mean), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilted))


def _clip(x, most: float):
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def solve(cells: DataFrame, sources: DataFrame, cap: int = CAP) -> tuple[DataFrame, float, float, int]:
    """((source, source_size, target, full, lam, rows), mean, beta, steps) by Newton's method on the dual.

    cells: (source, size, n) with size > 0; sources: (source, source_size, target, rows).
    """
    x = F.log(F.col("size").cast("double"))
    words = F.col("n") * F.col("size")
    total, logs = cells.agg(F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum(words * x), F.lit(0.0))).first()
    mean = logs / total if total else 0.0
    open_ = (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size"))
    lam = materialize(sources.withColumns({"full": ~open_, "lam": F.when(open_, F.log(F.col("target") / F.col("source_size"))).otherwise(0.0)}))
    beta, steps = 0.0, 0
    if not total:
        return lam, mean, beta, steps
    while steps < NEWTON_STEPS:
        now = _small(lam).withColumnRenamed("source", "s2")
        w = _rate(mean, beta, cap)
        free = F.when(w < cap, w * words).otherwise(0.0)
        rows = cells.join(now, cells["source"].eqNullSafe(now["s2"])).withColumns({"ww": w * words, "free": free, "x": _x(mean)})
        keys = ["source", "source_size", "target", "full", "lam", "rows"]
        sums = materialize(rows.groupBy(*keys).agg(F.sum("ww").alias("W"), F.sum(F.col("ww") * F.col("x")).alias("V"), F.sum("free").alias("A"), F.sum(F.col("free") * F.col("x")).alias("B"), F.sum(F.col("free") * F.col("x") * F.col("x")).alias("C")))
        gap, moves = F.col("W") - F.col("target"), ~F.col("full") & (F.col("A") > 0)
        part = lambda c: F.coalesce(F.sum(F.when(moves, c)), F.lit(0.0))
        v, bg, curve, off = sums.agg(F.sum("V"), part(F.col("B") * gap / F.col("A")), part(F.col("C") - F.col("B") * F.col("B") / F.col("A")), F.coalesce(F.max(F.when(moves, F.abs(gap) / F.col("target"))), F.lit(0.0))).first()
        slope = v + RIDGE * total * beta
        if off <= TOLERANCE and abs(slope) <= TOLERANCE * total:
            break
        step = max(-1.0, min(1.0, -(slope - bg) / (RIDGE * total + curve)))
        new = F.when(moves, F.col("lam") - _clip((gap + F.col("B") * step) / F.col("A"), 2.0)).otherwise(F.col("lam"))
        empty = lam.join(sums.select(F.col("source").alias("s3")), lam["source"].eqNullSafe(F.col("s3")), "left_anti")
        lam = materialize(sums.select("source", "source_size", "target", "rows", "full", new.alias("lam")).unionByName(empty))
        beta += step
        steps += 1
    return lam, mean, beta, steps


def _key():
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _copies(rate):
    """(whole copies, order of the further ones) of a row with `k`; rates are rounded first, so that a whole number is one."""
    w = F.round(rate, 9)
    whole = F.floor(w)
    u = F.conv(F.substring("k", 1, 13), 16, 10).cast("double") / 2.0**52
    return whole.cast("long"), F.when(w > whole, u / (w - whole)).otherwise(F.lit(float("inf")))


def _planned(docs: DataFrame, weights: tuple, cap: int) -> tuple[DataFrame, DataFrame, float, float, int]:
    base = materialize(docs.select("doc_id", "source", F.xxhash64("text").alias("th"), _size().alias("size"), _key().alias("k")))
    cells = materialize(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"))
    return base, *solve(cells.filter("size > 0"), source_targets(sums, weights, cap), cap)


def _balanced(base: DataFrame, sources: DataFrame, mean: float, beta: float, cap: int) -> DataFrame:
    own = _small(sources).withColumnRenamed("source", "s2")
    rows = base.join(own, base["source"].eqNullSafe(own["s2"])).withColumn("rate", _rate(mean, beta, cap))
    whole, order = _copies(F.col("rate"))
    rows = rows.withColumns({"base_copies": whole, "q": order})
    # q in (0, inf) to a part in [0, parts)
    parts = F.greatest(F.lit(256), F.ceil(F.col("rows") / PART_ROWS))
    rows = materialize(rows.withColumn("part", F.when(F.col("q") < float("inf"), F.floor(parts * F.col("q") / (1 + F.col("q")))).otherwise(parts)).drop("s2"))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"), F.sum(F.col("base_copies") * F.col("size")).alias("taken_whole"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("s1"), F.col("part").alias("p1"), before.alias("before"), F.sum("taken_whole").over(W.partitionBy("source")).alias("taken_whole"))
    # a source's last part holds the documents without a fraction: they take no further copy and need no order
    some = rows.filter(F.col("q") < float("inf"))
    srt = W.partitionBy("source", "part").orderBy("q", "k", "size", "th").rowsBetween(W.unboundedPreceding, -1)
    some = some.withColumn("inner", F.coalesce(F.sum("size").over(srt), F.lit(0)))
    out = some.unionByName(rows.filter(F.col("q") == float("inf")).withColumn("inner", F.lit(None).cast("long")))
    out = out.join(offsets, out["source"].eqNullSafe(offsets["s1"]) & (out["part"] == offsets["p1"])).drop("s1", "p1")
    rest = F.round("target").cast("long") - F.col("taken_whole") - F.col("before") - F.col("inner")
    return out.withColumn("extra", F.when(F.col("inner").isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))).otherwise(F.lit(0).cast("long")))


def balance(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: size, source, source_size, target, rate, copies, partial, taken, newton_steps (and the order's columns)."""
    base, sources, mean, beta, steps = _planned(docs, weights, cap)
    rows = _balanced(base, sources, mean, beta, cap)
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return rows.select("doc_id", "th", "k", "q", "base_copies", "extra", "size", "source", "source_size", "target", F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0).alias("rate"), (F.col("base_copies") + F.when(full, 1).otherwise(0)).alias("copies"), F.when(full, 0).otherwise(F.col("extra")).alias("partial"), (F.col("base_copies") * F.col("size") + F.col("extra")).alias("taken"), F.lit(steps).alias("newton_steps"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies, all columns kept.

    The one document a source whose last copy is cut counts as a whole copy when half of it or more is taken. Rates
    follow from a document's own size and its source's row, and the further copies go to a prefix of each source's
    order, so a table of one row per source (its rate's terms, the end of the prefix) is all that meets the texts; they
    are not shuffled while that table has at most SOURCES rows. Texts without words are not taken.
    """
    base, sources, mean, beta, _ = _planned(docs, weights, cap)
    rows = _balanced(base, sources, mean, beta, cap)
    taken = (F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size"))
    ends = rows.groupBy("source").agg(F.max(F.when(taken, F.struct("q", "k", "size", "th"))).alias("end")).withColumnRenamed("source", "s2")
    terms = sources.join(ends, sources["source"].eqNullSafe(ends["s2"]), "left")
    terms = _small(materialize(terms.select(F.struct("source", "full", "lam", "end").alias("terms"))))
    # the documents' own columns are one struct, so that no name clashes
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "source", "text", "doc_id").select("doc", "source", _size().alias("size"), F.xxhash64("text").alias("th"), _key().alias("k"))
    j = whole.join(terms, F.col("source").eqNullSafe(F.col("terms.source"))).select("doc", "size", "th", "k", "terms.full", "terms.lam", "terms.end").filter("size > 0")
    n, order = _copies(_rate(mean, beta, cap))
    j = j.withColumns({"n": n, "q": order})
    more = F.coalesce(F.struct("q", "k", "size", "th") <= F.col("end"), F.lit(False)) & (F.col("q") < float("inf"))
    j = j.withColumn("n", F.col("n") + F.when(more, 1).otherwise(0)).filter("n > 0")
    return j.select("doc", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc.*")


def oracle_sql(steps: int = 25) -> str:
    """The same mix in DuckDB's SQL: the targets, Newton's steps one by one, the further copies in their order."""
    w = "CASE WHEN l.full_ THEN 3.0 ELSE least(3.0, exp(least(l.lam + b.beta * c.x, 50.0))) END"
    step = "\n".join(
        f"""
s{i} AS MATERIALIZED (
  SELECT source, any_value(size_) AS size_, any_value(target) AS target, any_value(full_) AS full_, any_value(lam) AS lam, sum(w * words) AS ww, sum(w * words * x) AS v,
         sum(CASE WHEN w < 3 THEN w * words ELSE 0 END) AS a, sum(CASE WHEN w < 3 THEN w * words * x ELSE 0 END) AS bb, sum(CASE WHEN w < 3 THEN w * words * x * x ELSE 0 END) AS cc
  FROM (SELECT l.*, c.x, c.words, {w} AS w FROM cells c JOIN l{i} l ON c.source IS NOT DISTINCT FROM l.source, b{i} b) GROUP BY source),
b{i + 1} AS MATERIALIZED (
  SELECT b.beta + greatest(-1.0, least(1.0, -(v + {RIDGE} * total * b.beta - bg) / ({RIDGE} * total + curve))) AS beta, total
  FROM b{i} b, (SELECT sum(v) AS v, coalesce(sum(bb * (ww - target) / a) FILTER (WHERE NOT full_ AND a > 0), 0) AS bg,
                coalesce(sum(cc - bb * bb / a) FILTER (WHERE NOT full_ AND a > 0), 0) AS curve FROM s{i})),
l{i + 1} AS MATERIALIZED (
  SELECT source, size_, target, full_, CASE WHEN NOT full_ AND a > 0 THEN lam - greatest(-2.0, least(2.0, (ww - target + bb * (n.beta - o.beta)) / a)) ELSE lam END AS lam
  FROM s{i}, b{i} o, b{i + 1} n),"""
        for i in range(steps)
    )
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, hash(text) AS th,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS most, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
bl AS (SELECT *, coalesce(sum(most) OVER o, 0)::BIGINT AS below, coalesce(sum(w) OVER o, 0)::BIGINT AS w_below,
             sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS w_all
      FROM r WINDOW o AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, (total - below)::DOUBLE / (w_all - w_below) AS level FROM bl),
m AS (SELECT *, first(level) OVER (ORDER BY CASE WHEN most::DOUBLE / w >= level THEN w_below END NULLS LAST) AS mu FROM lv),
t AS MATERIALIZED (SELECT source, source_size, least(most::DOUBLE, w * mu) AS target FROM m),
g AS (SELECT sum(size)::DOUBLE AS total, sum(size * ln(size)) / sum(size) AS mean FROM d WHERE size > 0),
cells AS MATERIALIZED (SELECT source, (count(*) * any_value(size))::DOUBLE AS words, any_value(ln(size) - mean) AS x FROM d, g WHERE size > 0 GROUP BY source, size),
b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS beta, total FROM g),
l0 AS MATERIALIZED (SELECT source, source_size AS size_, target, NOT (target < 3 * source_size) AS full_, CASE WHEN target < 3 * source_size THEN ln(target / source_size) ELSE 0.0 END AS lam FROM t WHERE source_size > 0),
{step}
p AS (SELECT d.doc_id, d.source, d.k, d.th, d.size, t.source_size, t.target,
             round(CASE WHEN l.full_ THEN 3.0 ELSE least(3.0, exp(least(l.lam + b.beta * (ln(greatest(d.size, 1)) - g.mean), 50.0))) END, 9) AS w
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l{steps} l ON d.source IS NOT DISTINCT FROM l.source, b{steps} b, g),
o AS (SELECT *, floor(w)::BIGINT AS whole, CASE WHEN w > floor(w) THEN ('0x' || substr(k, 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 / (w - floor(w)) END AS q FROM p),
e AS (SELECT *, round(target)::BIGINT - coalesce(sum(whole * size) OVER (PARTITION BY source), 0)
             - coalesce(sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM o)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE whole * size + CASE WHEN q IS NULL THEN 0 ELSE greatest(0, least(size, rest)) END END::BIGINT AS taken FROM e
"""
