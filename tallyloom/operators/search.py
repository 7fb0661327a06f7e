"""Ranked and linear text search over search documents (fact_key, kind, path, title, body)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import query_tokens
from tallyloom.functions.scratch import materialize
from tallyloom.operators.changes import in_scope

WEIGHTS = {"path": 2, "title": 4, "body": 1}
K1, B = 1.2, 0.75
# How much more a kind of document counts.
KIND_BOOSTS = {"chunk": 1.0, "file": 1.6, "project": 1.3, "dependency": 1.3, "script": 1.3, "config": 1.3, "task": 1.5, "route": 1.5, "rule": 1.5, "symbol": 1.5, "import": 1.3, "diagnostic": 1.3, "change": 1.2, "policy": 1.5}
_TOKEN = re.compile(r"[\w$@]+")


def _boost(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for k, v in KIND_BOOSTS.items():
        out = out.when(kind == k, F.lit(v))
    return out.otherwise(F.lit(1.0))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def gain(idf: Column, wtf: Column, dl: Column, mean: Column) -> Column:
    """What a term adds to the score; more for more weight and for shorter documents."""
    return idf * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * dl / mean))


def boosted(raw: Column, kind: Column, boost: str) -> Column:
    return raw * _boost(kind) if boost == "multiply" else raw / _boost(kind)


def terms_of(query: str) -> list[tuple[str, bool]]:
    """(term, whether it is a prefix): the last one is when the query ends in it."""
    found = [t.lower() for t in _TOKEN.findall(query)]
    open_end = bool(query) and bool(_TOKEN.fullmatch(query[-1]))
    return [(t, open_end and i == len(found) - 1) for i, t in enumerate(found)]


def build_postings(docs: DataFrame) -> DataFrame:
    """(term, fact_key, field, tf) for docs with a row a fact; `textindex` stores them for many searches.

    Texts are shuffled by key, which is less than their postings would be; the grouping needs no shuffle then.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), query_tokens(F.col(c)).alias("t")) for c in WEIGHTS])
    one = docs.repartition("fact_key").select("fact_key", F.explode(fields).alias("x"))
    terms = one.select("fact_key", "x.field", F.explode("x.t").alias("term"))
    return terms.groupBy("term", "fact_key", "field").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("fact_key", sum((F.size(query_tokens(F.coalesce(F.col(c), F.lit("")))) for c in WEIGHTS), F.lit(0)).cast("long").alias("dl"))


def _is(term: str, prefix: bool):
    return (lambda x: x.startswith(term)) if prefix else (lambda x: x == term)


def _scan_terms(docs: DataFrame, wanted: list[tuple[str, bool]]) -> tuple[DataFrame, DataFrame]:
    """(q, fact_key, wtf) and (fact_key, dl) from one scan that writes a few numbers a document."""
    toks = docs.select("fact_key", *[F.coalesce(query_tokens(F.col(c)), F.array().cast("array<string>")).alias(c) for c in WEIGHTS])
    count = lambda t, p: sum((w * F.size(F.filter(F.col(c), _is(t, p))) for c, w in WEIGHTS.items()), F.lit(0))
    wtf = F.array(*[count(t, p).cast("double") for t, p in wanted])
    rows = materialize(toks.select("fact_key", sum((F.size(c) for c in WEIGHTS), F.lit(0)).cast("long").alias("dl"), wtf.alias("w")))
    hits = rows.select("fact_key", F.posexplode("w").alias("q", "wtf")).filter("wtf > 0")
    return hits.select("q", "fact_key", "wtf"), rows.select("fact_key", "dl")


def _posted_terms(docs: DataFrame, wanted: list[tuple[str, bool]], post: DataFrame) -> tuple[DataFrame, DataFrame]:
    hits = None
    for n, (t, prefix) in enumerate(wanted):
        one = post.filter(F.col("term").startswith(t) if prefix else F.col("term") == t).withColumn("q", F.lit(n))
        hits = one if hits is None else hits.unionByName(one)
    weight = F.create_map(*[F.lit(x) for c, w in WEIGHTS.items() for x in (c, w)])
    return hits.groupBy("q", "fact_key").agg(F.sum(F.col("tf") * weight[F.col("field")]).cast("double").alias("wtf")), document_lengths(docs)


def page_of(out: DataFrame, order: list, offset: int, limit: int | None) -> DataFrame:
    """Rows offset to offset + limit in order; with a limit, `has_more` tells whether others follow."""
    if limit is None:
        return out.orderBy(*order)
    page = out.orderBy(*order).offset(offset).limit(limit + 1)  # a window over one page
    r = page.withColumn("__r", F.row_number().over(W.orderBy(*order))).withColumn("has_more", F.count("*").over(W.partitionBy()) > limit)
    return r.filter(F.col("__r") <= limit).drop("__r").orderBy(*order)


def search(docs: DataFrame, query: str, kinds: list[str] | None = None, prefixes: list[str] | None = None, mode: str = "all", limit: int | None = None, offset: int = 0, boost: str = "multiply", postings: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 over weighted term counts, times the kind's boost; ties by key. Statistics are those of all documents.

    With postings only those of the query's few terms are read; without, texts are tokenised once. A limit adds `has_more`.
    """
    wanted = terms_of(query)
    if not wanted:
        none = docs.limit(0).select("fact_key", "kind", "path", F.lit(0.0).alias("score"))
        return none if limit is None else none.withColumn("has_more", F.lit(False))
    by, lengths = _scan_terms(docs, wanted) if postings is None else _posted_terms(docs, wanted, postings)
    df = by.groupBy("q").agg(F.count("*").alias("df"))  # a row a term of the query
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    j = by.join(F.broadcast(df), "q").join(lengths, "fact_key").crossJoin(stats)
    part = gain(inverse_frequency(F.col("n"), F.col("df")), F.col("wtf"), F.col("dl"), F.col("mean"))
    scored = j.groupBy("fact_key").agg(F.sum(part).alias("raw"), F.count("*").alias("terms"))
    if mode == "all":
        scored = scored.filter(F.col("terms") == len(wanted))
    out = docs.select("fact_key", "kind", "path").join(scored, "fact_key").filter(in_scope(F.col("path"), prefixes or []))
    if kinds:
        out = out.filter(F.col("kind").isin(kinds))
    return page_of(out.select("fact_key", "kind", "path", boosted(F.col("raw"), F.col("kind"), boost).alias("score")), [F.desc("score"), F.col("fact_key")], offset, limit)


def _count(text: Column, needle: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)


def linear_search(docs: DataFrame, query: str, kinds: list[str] | None = None, prefixes: list[str] | None = None, mode: str = "all", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Substring counts over title, path and body: min(count, 8) times the boost; `all` needs every needle."""
    needles = [t for t, _ in terms_of(query)] or [query.lower()]
    counts = [sum((_count(F.lower(F.coalesce(F.col(c), F.lit(""))), n) for c in ("title", "path", "body")), F.lit(0.0)) for n in needles]
    total = sum(counts, F.lit(0.0))
    ok = total > 0
    if mode == "all":
        for c in counts:
            ok = ok & (c > 0)
    out = docs.filter(in_scope(F.col("path"), prefixes or []))
    if kinds:
        out = out.filter(F.col("kind").isin(kinds))
    out = out.filter(ok).select("fact_key", "kind", "path", (F.least(total, F.lit(8.0)) * _boost(F.col("kind"))).alias("score")).orderBy(F.desc("score"), "fact_key")
    return out if limit is None else out.offset(offset).limit(limit)


def search_symbols(symbols: DataFrame, query: str, workspace: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols of which name, path or kind has a token that starts with one of the query's terms; more such tokens first."""
    df = symbols if workspace is None else symbols.filter(F.col("workspace") == workspace)
    toks = F.concat(*[query_tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "path", "kind")])
    hit = F.lit(False)
    n = F.lit(0)
    for t, _ in terms_of(query):
        k = F.size(F.filter(F.col("__t"), _starts(t)))
        n, hit = n + k, hit | (k > 0)
    out = df.withColumn("__t", toks).filter(hit).withColumn("hits", n).drop("__t").orderBy(F.desc("hits"), "path", "byte_offset", "name")
    return out if limit is None else out.limit(limit)


def _starts(term: str):
    return lambda x: x.startswith(term)
