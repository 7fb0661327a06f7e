"""The prefix trie of conversations against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import turntrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    members, ends, kids, leaves, saved = (defaultdict(k) for k in (list, list, int, int, int))
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        q = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        ends[q].append(c)
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += kids[k] == 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_trie_is_that_of_plain_python(spark, cells):
    """Blocks of one row, of a few and of all: what spans blocks is recombined."""
    rng = random.Random(cells)
    rows = []
    for c in range(150):
        n = rng.choice([0, 1, 2, 3, 9, 14, 1])
        text = rng.choice([lambda t: f"t{t}", lambda t: rng.choice(["x", "y", "éé", None]), lambda t: "same"])
        rows += [(c, t if t else rng.choice([0, None]), rng.choice(["u", None]), text(t)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(turntrie.trie(turntrie.rebuilt(turntrie.turns(df)), cells)) == brute(rows)


def test_a_conversation_of_a_third_of_all_and_a_very_long_one(spark):
    rows = [(c, t, "u", f"hot{t}") for c in range(0, 3000, 5) for t in range(3)]
    rows += [(c, t, "u", f"{c}-{t}") for c in range(1, 3000, 5) for t in range(2)]
    rows += [(7, t, "u", f"long{t}") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(turntrie.trie(turntrie.rebuilt(turntrie.turns(df)), 500)) == brute(rows)


def test_odd_rows(spark):
    """Nulls in each column, negative ids, repeated rows, ties, extra columns with names the operator uses; an empty table."""
    rows = [(None, 0, "u", "lost"), (0, None, None, None), (0, None, None, None), (0, 3, "u", ""), (1, 1, None, "a"), (1, 1, "b", "a"), (-7, 0, "u", "n"), (2, 0, "u", "x" * 100000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit(1), "size": F.lit(2), "h": F.lit(3), "key": F.lit("k"), "pid": F.lit(4), "__base": F.lit(0)})
    got = rows_of(turntrie.report(df))
    assert got == brute(rows)  # -7 is of the family of -5, which is absent
    root = next(r for r in got if r[1] == 0)
    assert root[0] == -7 and root[3] == 4
    assert turntrie.report(spark.createDataFrame([], SCHEMA)).collect() == []
