"""The pipeline against a plain Python version of its stages."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
from tallyloom.llm import queries

from tests.llm.test_operators import brute_bench, brute_components, brute_rates


def plain(rows, items):
    """doc_id -> copies after all filters and the mix."""
    rows = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    comp = brute_components([r.text for r in rows], 5)
    rows = [r for i, r in enumerate(rows) if comp[i][1] == i]
    bad = brute_bench([r.text for r in rows], items)
    rows = [r for r, b in zip(rows, bad) if not b[4]]
    size = {r.doc_id: len(r.text.encode().split()) for r in rows}
    own = Counter()
    for r in rows:
        own[r.source] += size[r.doc_id]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(own))}
    full = set()
    while True:
        unit = (sum(own.values()) - sum(3 * own[s] for s in full)) / sum(weight[s] for s in own if s not in full)
        over = {s for s in own if s not in full and weight[s] * unit > 3 * own[s]}
        if not over:
            break
        full |= over
    targets = {s: 3 * own[s] if s in full else weight[s] * unit for s in own}
    rate = brute_rates({r.doc_id: (r.source, size[r.doc_id]) for r in rows}, targets)
    copies = {}
    for s in own:
        mine = {r.doc_id: round(rate[r.doc_id], 9) for r in rows if r.source == s and size[r.doc_id]}
        copies |= {d: int(w) for d, w in mine.items()}
        rest = round(targets[s]) - sum(int(w) * size[d] for d, w in mine.items())
        u = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) / 2**52 for d in mine}
        for d in sorted((d for d, w in mine.items() if w > int(w)), key=lambda d: u[d] / (mine[d] - int(mine[d]))):
            extra = max(0, min(size[d], rest))
            rest -= size[d]
            copies[d] += 1 if extra > 0 and 2 * extra >= size[d] else 0
    return {d: c for d, c in copies.items() if c}


def test_run_equals_the_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    want = plain(rows, items)
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == want
    text = {r.doc_id: r.text.encode() for r in rows if r.text is not None}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in got)
    load, places = Counter(), {}
    for r in got:
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(load) <= set(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(Counter({r.virtual_slot: 0 for r in got}) and [sum(x.size for x in got if x.virtual_slot == v) for v in {r.virtual_slot for r in got}])


def test_names_and_stages():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
