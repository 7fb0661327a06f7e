"""Postings, pages, exact quantiles and identity tokens against plain versions."""

import json
import re
import statistics
from collections import Counter
from math import ceil

from pyspark.sql import functions as F

from tallyloom.functions.identity import identity_tokens
from tallyloom.functions.quantiles import value_ranks, with_quantiles
from tallyloom.operators import records as R
from tallyloom.operators import resolution as N
from tallyloom.operators import search as S
from tallyloom.operators.textindex import TextIndex

DOCS = [(1, "chunk", "src/a.py", "Alpha", "beta beta $x @y beta"), (2, "file", "src/b", None, ""), (3, "file", "x", "alpha beta", None), (4, "chunk", "y", "t", "gamma alpha " * 50)]


def _docs(spark):
    return spark.createDataFrame(DOCS, "fact_key int, kind string, path string, title string, body string")


def test_postings_count_terms_of_each_field(spark):
    want = {(t, d[0], f, n) for d in DOCS for f, text in zip(("path", "title", "body"), d[2:]) for t, n in Counter(re.findall(r"[\w$@]+", (text or "").lower())).items()}
    assert {tuple(r) for r in S.build_postings(_docs(spark)).collect()} == want


def test_search_is_the_same_with_and_without_postings(spark):
    d = _docs(spark)
    for query in ("alpha beta", "alph", "beta ", "none"):
        for mode in ("all", "any"):
            got = [{(r.fact_key, round(r.score, 9)) for r in S.search(d, query, mode=mode, postings=p).collect()} for p in (None, S.build_postings(d))]
            assert got[0] == got[1]
    assert S.search(d, "").count() == 0


def test_stored_index_follows_change_sets(spark, tmp_path):
    words = ("alpha", "alphabet", "beta", "gamma", "the", "rare")

    def doc(k, turn):
        body = " ".join(words[(k * 7 + i * i + turn) % (5 + (k % 9 == 0))] for i in range(3 + k % 40))
        return (k, "chunk" if k % 2 else "file", f"src/{k % 4}", f"t{k % 3} {words[k % 3]}", body if k % 11 else None)

    schema, live = "fact_key int, kind string, path string, title string, body string", {}
    index = TextIndex(spark, f"file://{tmp_path}/index", spark.createDataFrame([], schema).schema["fact_key"].dataType, fan=3, chunk=16)
    sets = [(range(120), []), (range(0, 60, 5), [7, 8]), (range(200, 240), [1, 500]), ([], [0, 2, 3]), ([7, 300], []), (range(0, 240, 9), [4])]
    for version, (keys, deleted) in enumerate(sets):
        new = [doc(k, version) for k in keys]
        index.update(spark.createDataFrame(new, schema), version, spark.createDataFrame([(k,) for k in deleted], "fact_key int"))
        live = {k: v for k, v in live.items() if k not in deleted} | {d[0]: d for d in new}
    now = spark.createDataFrame(list(live.values()), schema)
    rows = lambda d: [(r.fact_key, r.kind, r.path, round(r.score, 9)) for r in d.collect()]
    assert sorted(rows(index.search("alpha beta ", mode="all"))) == sorted(rows(S.search(now, "alpha beta ", mode="all")))
    for query, mode, more in (("rare alph", "any", {}), ("t1 gamma ", "any", {"kinds": ["file"], "prefixes": ["src/2"]}), ("alpha beta ", "all", {"boost": "divide", "offset": 2})):
        assert rows(index.search(query, mode=mode, limit=3, **more)) == rows(S.search(now, query, mode=mode, limit=3, **more))
    index.update(spark.createDataFrame([doc(1, 0)], schema), 5)  # a version that is there already is left
    assert index.search("the ", mode="any").count() == S.search(now, "the ").count()
    assert len(index._manifest(5)[0]) < len(sets) and index.search("").count() == 0


def test_pages_tell_whether_more_follow(spark):
    d = spark.range(7).select(F.col("id").alias("fact_key"), F.lit("file").alias("kind"), F.lit("p").alias("path"), F.lit("t").alias("title"), F.lit("word").alias("body"))
    page = lambda offset: [(r.fact_key, r.has_more) for r in S.search(d, "word", limit=3, offset=offset).collect()]
    assert page(0) == [(0, True), (1, True), (2, True)]
    assert page(4) == [(4, False), (5, False), (6, False)] and page(6) == [(6, False)] and page(9) == []


def test_quantiles_are_exact(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 3}", float((i * 37) % 101)) for i in range(500)] + [("one", 4.0), ("none", None)] + [("g1", 7.0)] * 300
    df = spark.createDataFrame(rows, "g string, v double")
    groups = df.groupBy("g").count()
    got = {r.g: (r.count_, r.p95, r.mid) for r in with_quantiles(groups.withColumnRenamed("count", "count_"), df, ["g"], "v", {"p95": 0.95}, "mid").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = (sum(k == g for k, _ in rows), v[ceil(len(v) * 0.95) - 1] if v else None, statistics.median(v) if v else None)
    assert got == want
    ranks = value_ranks(df.filter("g = 'g1'"), [], "v").orderBy("v").collect()
    assert ranks[-1].upto == ranks[-1].total == df.filter("g = 'g1'").count()
    assert value_ranks(df.limit(0), ["g"], "v").count() == 0


def test_identity_strings_are_found_at_any_depth(spark):
    body = {"a": [{"Owner": " X ", "n": 1}, {"user_ID": "Y", "deep": {"path": ["P", "", 3, ["Q"]]}}], "note": "z", "source": None}
    rows = [("A/b", json.dumps(body)), (None, None), ("c", "no json"), ("d", '"path"')]
    df = spark.createDataFrame(rows, "path string, body string").select(identity_tokens(F.col("path"), F.col("body")).alias("t"))
    assert [r.t for r in df.collect()] == [["path:a/b", "value:p", "value:q", "value:x", "value:y"], [], ["path:c"], ["path:d"]]


def test_record_prefixes_end_at_whole_characters(spark):
    r = spark.createDataFrame([("s", "o", i, "x" * i + "é€😀" * 4) for i in range(8)], "scope string, origin string, path int, text string")
    got = {x.path: x.content for x in R.search_records(r, "é", ["s"], prefix_bytes=16).collect()}
    assert got == {i: ("x" * i + "é€😀" * 4).encode()[:16].decode(errors="ignore") for i in range(8)}


def test_references_see_what_is_declared_before_them(spark):
    d = spark.createDataFrame([("n", 1, 2, "add"), ("n", 1, 5, "remove"), ("n", 2, 4, "add"), (None, 3, 1, "add")], "name string, identity int, statement int, operation string")
    r = spark.createDataFrame([(s, n, s) for s in range(8) for n in ("n",)] + [(9, None, 9), (10, "m", 9)], "ref_id int, name string, statement int")
    got = {x.ref_id: x.identities for x in N.resolve_as_of(r, d).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [1], 4: [1], 5: [1, 2], 6: [2], 7: [2], 9: [], 10: []}
