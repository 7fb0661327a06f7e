"""The toxicity operator: held-out accuracy, the label model on planted votes, odd tables."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng, n):
    """Documents of made-up words; the toxic ones hold words that no fixed list knows, two at least."""
    rows, labels = [], []
    for i in range(n):
        ws = [f"{rng.choice('bdfg')}{rng.choice('aeiou')}{rng.choice('klmn')}{rng.choice('aeiou')}" for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2 + len(ws) // 50):
                ws.insert(rng.randrange(len(ws)), rng.choice(["zorkat", "zorkel", "zorkun", "quibbit"]))
        rows.append((i, " ".join(ws), "en", "s", 1))
        if rng.random() < 0.7:
            labels.append((i, 0, int(bad)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(random.Random(4), 1200)
    docs, given = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, given).collect()}
    truth = {i: "zork" in t or "quibbit" in t for i, t, *_ in rows}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got) and len(got) == len(rows)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    # labels of held-out rows are never read: turned round, they change no score
    turned = given.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()}
    assert max(abs(again[i] - got[i].score) for i in got) < 1e-9


def test_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.95


def test_label_model_finds_accuracies_and_correlated_voters():
    """Votes drawn from known accuracies; one voter copies another. A fifth of the rows is labelled."""
    rng = np.random.default_rng(1)
    n, m = 20000, len(toxicity.VOTERS) + 1
    y = rng.random(n) < 0.3
    votes = np.full((n, m), toxicity.ABSTAIN, np.uint8)
    right = {0: 0.9, 1: 0.8, 2: 0.85, 3: 0.7}
    for j, p in right.items():
        ok = rng.random(n) < p
        votes[:, j] = np.where(ok == y, toxicity.TOXIC, toxicity.CLEAN)
    votes[:, 4] = np.where(rng.random(n) < 0.95, votes[:, 3], toxicity.ABSTAIN)

    votes[:, -1] = np.where(rng.random(n) < 0.2, np.where(y, toxicity.TOXIC, toxicity.CLEAN), toxicity.ABSTAIN)
    labelled = votes[:, -1] != toxicity.ABSTAIN
    q, parent = np.where(labelled, y, 0.0) + ~labelled * np.where((votes[:, :3] == toxicity.TOXIC).sum(1) > 1, 0.8, 0.2), None
    hot = np.eye(3)[votes].reshape(n, -1)
    for i in range(40):
        model = toxicity.LabelModel(np.stack([hot.T @ (hot * (1 - q)[:, None]), hot.T @ (hot * q[:, None])]), parent)
        parent = model.tree() if i == 15 else parent
        q = model.posterior(votes)
    told = model.accuracies()
    for j, p in right.items():
        assert abs(told[j][2] - p) < 0.03
    assert toxicity.VOTERS[3] == told[4][3] or toxicity.VOTERS[4] == told[3][3]
    assert abs(model.prior - 0.3) < 0.03 and np.mean((q > 0.5) == y) > 0.9


def test_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "you idiot " * 3, "en", "a", 1), (2, "you idiot " * 3, "en", "a", 1), (3, "x " * 200000, "en", "a", 1), (4, "퟿ \u0000 ünïcode", "xx", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"label": F.lit(1), "votes": F.lit("v"), "hits": F.lit(2), "held_out": F.lit("x"), "toxic": F.lit(1), "k": F.lit(3)})
    labels = spark.createDataFrame([(None, 1, 1), (2, None, None), (3, 0, 0), (3, 0, 1), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = toxicity.score(docs, given).collect()
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 2, 3, 4]
        assert all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r for r in got}
        assert by[2].score > by[1].score and len({r.score for r in got if r.doc_id == 2}) == 1
        assert by[None].held_out and by[None].score == by[1].score
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_entries_that_say_the_same_are_chosen_once():
    telling = [(-90.0, "zork**", 50.0), (-80.0, "zork*", 9.0), (-70.0, "zorka*", 30.0), (-60.0, "zorkat", 30.0), (-50.0, "quib*", 20.0), (-40.0, "quibbit", 20.0)]
    assert toxicity.choose(telling) == ["zork**", "quibbit"]
