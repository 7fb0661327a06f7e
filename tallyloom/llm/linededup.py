"""Removal of repeated runs of lines by a suffix array of line ids, in DataFrame functions only.

A text is the sequence of the ids (64-bit hashes) of its lines that aren't blank.
1. Prefix doubling: suffixes of all sequences are ranked by their first line, then by pairs of ranks h apart for
   h = 1, 2, 4, ..., so that after each step equal ranks mean equal runs of 2 h lines and the ranks' order is that of the
   runs. Ranks are dealt out by a range partitioning of the distinct pairs, with offsets by partition. A suffix whose
   run occurs once is settled and leaves; doubling ends when all are settled. The suffixes of one rank are an
   interval of a common prefix, and its first member, by (doc_id, text hash, line), is the place that is kept.
2. A suffix is a later copy when the first member of its interval lies before it without overlap (in another text, or at
   least MIN_RUN lines before in the same one; `a a a x` has no later copy, `a a a a` one). The lines of all later copies of
   MIN_RUN lines are deleted; longer runs are covered by these. Of a line of more than LONG words later copies
   are deleted, too; shorter lines that stand alone are kept.
3. The length of the maximal run that a later copy shares with its kept place is the length of their common prefix: from the
   deepest interval that holds both, ranks of ever shorter runs behind it are compared, as in the doubling.

Equal texts are collapsed first: the one of the smallest doc_id goes through the array, and all others are later copies
as a whole. Hot lines and pairs are counted in each task first, and the joins back to positions are plain equi-joins
that Spark splits where they are skewed.

Defined cases: a null or blank text has no lines. Rows without doc_id come first in the order. Rows that agree in doc_id
and text are one document and get one result each. Texts are matched by 64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize

#: Lines of the shortest run that is deleted, and words of a line beyond which it is one alone.
MIN_RUN, LONG = 2, 50
WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the comparison of runs between two writes.
STEPS = 3


def _lines(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def _long(line):
    return F.when(F.length(line) > 2 * LONG, F.regexp_count(line, F.lit(WORD)) > LONG).otherwise(False)


def ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Dense ranks, from 1, of distinct rows in the order of `keys`: ranges in parallel, then offsets of the ranges."""
    dealt = materialize(groups.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n_part")).select("part", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(*keys))
    return dealt.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + rank).drop("part", "before")


def _place(prefix: str = ""):
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("doc_id", "th", "d", "pos")])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(th, rep, n), materialized: each distinct text's smallest doc_id, null first, and its number of rows."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("th"))
    return materialize(ids.groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id")).alias("m"), F.count("*").alias("n")).select("th", F.col("m.doc_id").alias("rep"), "n"))


def suffix_ranks(docs: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """For each doubling step k the suffixes whose first 2^k lines occur again: (d, pos, doc_id, th, long, rank, first).

    d identifies the text, first is the place of the first suffix of that rank, long belongs to the first line.
    """
    # texts become line ids before anything is joined
    seq = docs.select("doc_id", F.xxhash64("text").alias("th"), F.transform(_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("a"), _long(x).alias("long"))).alias("ids"))
    copies = texts.filter("n > 1").select(F.col("th").alias("t2"), "rep")
    one = seq.join(copies, seq["th"] == copies["t2"], "left").filter(F.col("t2").isNull() | F.col("doc_id").eqNullSafe(F.col("rep")))
    at = one.select("doc_id", "th", F.xxhash64("doc_id", "th").alias("d"), F.posexplode("ids").alias("pos", "x")).select("doc_id", "th", "d", "pos", "x.a", "x.long").distinct()
    at = materialize(at).withColumn("b", F.lit(0).cast("long"))
    out: list[DataFrame] = []
    while True:
        shared = at.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1").select("a", "b", "first")
        ranks = materialize(at.join(ranked(shared, ["a", "b"]), ["a", "b"]).select("d", "pos", "doc_id", "th", "long", "rank", "first"))
        if not ranks.limit(1).count():
            return out
        h = 1 << len(out)
        out.append(ranks)
        behind = ranks.select("d", (F.col("pos") - h).alias("pos"), F.col("rank").alias("b"))
        at = ranks.withColumnRenamed("rank", "a").drop("first").join(behind, ["d", "pos"])


def later_copies(ranks: list[DataFrame]) -> DataFrame | None:
    """(doc_id, th, d, pos, k, first): later copies with the deepest step k that has them, and the kept place there."""
    apart = (F.col("first.d") != F.col("d")) | (F.col("first.pos") <= F.col("pos") - MIN_RUN)
    found = None
    for k, r in enumerate(ranks):
        # a line alone can't overlap its copy
        own = r.filter("long" if k == 0 else apart).filter(_place() > F.col("first")).select("doc_id", "th", "d", "pos", F.lit(k).alias("k"), "first")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return None
    return found.groupBy("d", "pos").agg(F.max_by(F.struct("doc_id", "th", "k", "first"), "k").alias("x")).select("d", "pos", "x.*")


def common_prefixes(later: DataFrame, ranks: list[DataFrame]) -> DataFrame:
    """`later` with `run`, the lines that each shares with its kept place (their distance at most, in one text)."""
    now = materialize(later.withColumn("run", F.expr("shiftleft(1, k)")))
    for t in range(len(ranks) - 2, -1, -1):
        a = ranks[t].select("d", F.col("pos").alias("p"), F.col("rank").alias("ra"))
        b = ranks[t].select(F.col("d").alias("e"), F.col("pos").alias("q"), F.col("rank").alias("rb"))
        open_ = now.filter(F.col("k") > t).withColumns({"p": F.col("pos") + F.col("run"), "e": F.col("first.d"), "q": F.col("first.pos") + F.col("run")})
        more = open_.join(a, ["d", "p"], "left").join(b, ["e", "q"], "left").withColumn("run", F.col("run") + F.when(F.col("ra") == F.col("rb"), 1 << t).otherwise(0))
        now = now.filter(F.col("k") <= t).unionByName(more.select(*now.columns))
        if t % STEPS == 0:
            now = materialize(now)
    return now.withColumn("run", F.when(F.col("first.d") == F.col("d"), F.least("run", F.col("pos") - F.col("first.pos"))).otherwise(F.col("run")))


def deleted_lines(docs: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(doc_id, th, gone, longest): the sorted numbers, from 0, of each text's deleted lines, and its longest run that is a later copy."""
    ranks = suffix_ranks(docs, texts)
    later = later_copies(ranks)
    if later is None:
        return None
    runs = common_prefixes(later, ranks)
    lines = runs.select("doc_id", "th", "run", F.explode(F.sequence("pos", F.col("pos") + F.when(F.col("k") > 0, MIN_RUN - 1).otherwise(0))).alias("line"))
    return lines.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("gone"), F.max("run").alias("longest"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_run, kept (the lines left, joined).

    n_runs counts the maximal runs of deleted lines; longest_run is the longest run that is a later copy.
    """
    texts = distinct_texts(docs)
    found = deleted_lines(docs, texts)
    if found is None:
        found = docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("th"), F.array(F.lit(0)).alias("gone"), F.lit(0).alias("longest"))
    # what is known by text alone, or by the text's first document
    facts = texts.filter("n > 1").join(found.select(F.col("th").alias("t2"), "doc_id", "gone", "longest"), F.col("th") == F.col("t2"), "full_outer")
    facts = materialize(facts.select(F.coalesce("th", "t2").alias("__t"), F.coalesce("n", F.lit(1)).alias("n"), F.when(F.col("n") > 1, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"), "gone", "longest"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__h"), "text")
    out = keyed.join(facts.hint("merge"), keyed["__h"] == facts["__t"], "left").withColumn("lines", _lines(F.col("text")))
    size = F.size("lines")
    copy = (F.col("n") > 1) & ~F.col("doc_id").eqNullSafe(F.col("rep"))
    whole = F.coalesce(copy, F.lit(False)) & ((size >= MIN_RUN) | (size == 1) & _long(F.get("lines", F.lit(0))))
    none = F.array().cast("array<int>")
    gone = F.when(whole, F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))).when(copy, none).otherwise(F.coalesce("gone", none))
    longest = F.when(whole, size).when(copy, 0).otherwise(F.coalesce("longest", F.lit(0)))
    start = F.struct(F.lit(0).alias("runs"), F.lit(-2).alias("last"))
    step = lambda a, x: F.struct((a["runs"] + F.when(x == a["last"] + 1, 0).otherwise(1)).alias("runs"), x.alias("last"))
    out = out.select("doc_id", "lines", size.alias("n"), gone.alias("gone"), longest.alias("longest")).withColumn("runs", F.aggregate("gone", start, step, lambda a: a["runs"]))
    # the lines between deleted ones, as slices of given ends, so that long texts take linear time
    out = out.withColumn("ends", F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("a"), F.concat("gone", F.array("n")).alias("b")))
    kept = F.flatten(F.transform("ends", lambda x: F.slice("lines", x["a"] + 2, x["b"] - x["a"] - 1)))
    return out.select("doc_id", F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.col("runs").cast("long").alias("n_runs"), F.col("longest").cast("long").alias("longest_run"), F.array_join(F.when(F.size("gone") > 0, kept).otherwise(F.col("lines")), "\n").alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """`deduplicate` with the digest of the kept lines in place of them."""
    return deduplicate(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def oracle_sql(steps: int = 12) -> str:
    """The same in DuckDB's SQL, for runs below 2^(steps + 1) lines and distinct, non-null doc_ids."""
    doubling = "\n".join(
        f"""r{k} AS MATERIALIZED (
  SELECT *, first_value(doc_id) OVER w AS fd, first_value(pos) OVER w AS fp FROM {'l' if k == 0 else f'''(
    SELECT a.doc_id, a.pos, md5(a.key || b.key) AS key, a.long FROM r{k - 1} a JOIN r{k - 1} b ON a.doc_id = b.doc_id AND b.pos = a.pos + {1 << k >> 1})'''}
  WINDOW w AS (PARTITION BY key ORDER BY doc_id, pos)),"""
        for k in range(steps + 1)
    )
    later = " UNION ALL ".join(f"SELECT doc_id, pos, fd, fp, {k} AS k FROM r{k} WHERE (doc_id, pos) > (fd, fp) AND {'long' if k == 0 else f'(fd <> doc_id OR fp <= pos - {MIN_RUN})'}" for k in range(steps + 1))
    lifting = "\n".join(
        f"""c{t} AS MATERIALIZED (
  SELECT p.doc_id, p.pos, p.fd, p.fp, p.k, p.run + CASE WHEN p.k > {t} AND a.key = b.key THEN {1 << t} ELSE 0 END AS run
  FROM c{t + 1} p LEFT JOIN r{t} a ON p.k > {t} AND a.doc_id = p.doc_id AND a.pos = p.pos + p.run LEFT JOIN r{t} b ON p.k > {t} AND b.doc_id = p.fd AND b.pos = p.fp + p.run),"""
        for t in range(steps - 1, -1, -1)
    )
    return f"""
WITH s AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS copy, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
n AS MATERIALIZED (SELECT doc_id, copy, i - 1 AS pos, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+')) > {LONG} AS long FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM s)),
l AS (SELECT doc_id, pos, md5(line) AS key, long FROM n WHERE NOT copy),
{doubling}
p AS (SELECT doc_id, pos, fd, fp, k FROM ({later}) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY k DESC) = 1),
c{steps} AS MATERIALIZED (SELECT *, 1 << k AS run FROM p),
{lifting}
w AS (SELECT doc_id, max(CASE WHEN fd = doc_id THEN least(run, pos - fp) ELSE run END) AS longest FROM c0 GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, pos + d AS pos FROM c0, (VALUES (0), (1)) v(d) WHERE d = 0 OR k > 0
      UNION ALL SELECT doc_id, pos FROM n WHERE copy AND (long OR EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND m.pos > 0))),
r AS (SELECT doc_id, count(*) AS len FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g) GROUP BY doc_id, run),
m AS (SELECT doc_id, sum(len)::BIGINT AS n_removed, count(*) AS n_runs FROM r GROUP BY doc_id),
k AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.pos) AS kept FROM n ANTI JOIN g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
SELECT s.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       CASE WHEN copy THEN coalesce(n_removed, 0) ELSE coalesce(longest, 0) END::BIGINT AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN w USING (doc_id)
"""
