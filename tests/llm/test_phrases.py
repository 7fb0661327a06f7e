"""Phrase mining against plain Python, and the automata it uses."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import phrases
from tallyloom.llm.automaton import Automaton, sort_rows, union

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                f.update((lang or "und", *ws[i : i + m]) for i in range(len(ws) - m + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    inside = {(k[0], *k[i:j]) for k, a in cand.items() for i in range(1, len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) - 1 and a >= cand[(k[0], *k[i:j])]}
    out = {}
    for k, a in cand.items():
        if k not in inside:
            lang, ws = k[0], k[1:]
            score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *ws[:c])] * f[(lang, *ws[c:])]), c, f[(lang, *ws[:c])], f[(lang, *ws[c:])]) for c in range(1, len(ws)))
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_phrases_are_those_of_plain_python(spark, monkeypatch):
    """With few prefix ranges and with many."""
    rng = random.Random(7)
    texts = []
    for i in range(400):
        ws = [rng.choice(["The", "the", "of", "É", "é", "new york", "New York city", "a a", "x", "\x0bst.", "a\tb", ",", "\x1c", " nb"]) for _ in range(rng.randint(0, 40))]
        texts.append((" ".join(ws) if i % 17 else None, rng.choice(["en", "fr", None, "und"])))
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(texts)], SCHEMA).repartition(5)
    assert rows_of(phrases.collocations(df, least=4, top=25)) == brute(texts, 4, top=25)
    monkeypatch.setattr(phrases, "RANGE_WORDS", 100)
    assert rows_of(phrases.collocations(df, least=4, top=None)) == brute(texts, 4, top=10**6)


def test_odd_tables(spark):
    """A hot pair that holds most words, a very long piece, repeated rows and clashing names; an empty table."""
    texts = [("hot pair " * 20000, "en"), ("hot pair", "en"), ("hot pair", "en"), ("", "en"), (None, None), ("x", None)]
    df = spark.createDataFrame([(1, t, lang, None, None) for t, lang in texts], SCHEMA).withColumns({"word": F.lit(1), "g": F.lit(2), "n": F.lit(3), "part": F.lit(4), "label": F.lit(5), "words": F.lit("w")})
    assert rows_of(phrases.collocations(df)) == brute(texts, 100)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_shards_that_flush_often_unite_to_all_counts(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 200)
    rng = np.random.default_rng(5)
    arrays = [rng.integers(0, 9, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(20)]
    want = Counter(tuple(a[i : i + 3].view(np.int64).tolist()) for a in arrays for i in range(298) if a[i : i + 3].all())
    batches = [b for s in range(0, 20, 5) for b in phrases._shard(iter(arrays[s : s + 5]), 3, None, 3)]
    assert len(batches) > 4
    pairs = sorted((p, blob.as_py()) for b in batches for p, blob in zip(b.column("part").to_pylist(), b.column("automaton")))
    sent = pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([b for _, b in pairs])], ["part", "automaton"])
    got = {tuple(w): n for b in phrases._merge(2)([sent]) for w, n in zip(b.column("words").to_pylist(), b.column("a").to_pylist())}
    assert got == {k: n for k, n in want.items() if n > 1}


def test_automata():
    rng = np.random.default_rng(2)
    total, parts = Counter(), []
    for _ in range(5):
        rows = rng.integers(1, 4, (60, 4)).astype(np.uint64)
        for i, n in enumerate(rng.integers(1, 5, 60)):
            rows[i, n:] = 0
        counts = rng.integers(1, 9, 60)
        for r, c in zip(rows.tolist(), counts.tolist()):
            total[tuple(r)] += c
        rows, counts = sort_rows(rows, counts)
        half = len(rows) // 2
        whole, grown = Automaton(4).add(rows, counts), Automaton(4).add(rows[:half], counts[:half]).add(rows[half:], counts[half:])
        assert whole.dump() == grown.dump()
        parts.append(Automaton.load(whole.dump()))
    one = union(parts)
    rows, counts = one.rows()
    assert dict(zip(map(tuple, rows.tolist()), counts.tolist())) == dict(total)
    asked = np.array([[a, b, c, d] for a in range(1, 6) for b in range(5) for c in range(5) for d in range(5) if (b or not c) and (c or not d)], np.uint64)
    assert one.weigh(asked).tolist() == [total[tuple(r)] for r in asked.tolist()]
    assert not Automaton(4).weigh(asked).any()
