"""Stateful streams and the log-structured state table, over several micro-batches and restarts."""

import random

from pyspark.sql import functions as F

from tallyloom.operators.records import fold_claims, upsert_records
from tallyloom.plans.streams import in_slices
from tallyloom.streaming.statetable import StateTable, ingest_once, latest_log, upsert_log
from tallyloom.streaming.stateful import PROVIDER, claim_stream, start_stateful

STEPS = ("validated", "active", "superseded", "rejected", "tombstoned", "nonsense")


def test_claims_over_slices_equal_the_batch_fold(spark, tmp_path):
    """Each slice is a run of its own that starts from the checkpoint; some rows come twice."""
    rng = random.Random(3)
    rows = [(f"c{rng.randint(0, 11)}", i, rng.choice(STEPS)) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:200:7], "claim_id string, seq long, to_state string")
    schema = spark.createDataFrame([], "claim_id string, state string, refused long, last long").schema
    batches = []

    def start(s, top):
        def sink(b, n):
            batches.append(n)
            latest_log(StateTable(spark, f"{top}/claims", ["claim_id"], schema, "last"), "last")(b, n)

        return start_stateful(claim_stream(s), sink, f"{top}/state")

    top = in_slices(df, "seq", start, n=4)
    assert len(set(batches)) >= 4 and spark.conf.get(PROVIDER, None) is None or "RocksDB" not in spark.conf.get(PROVIDER)
    got = {tuple(r) for r in StateTable(spark, f"{top}/claims", ["claim_id"], schema, "last").read().select("claim_id", "state", "refused").collect()}
    assert got == {tuple(r) for r in fold_claims(spark.createDataFrame(rows, df.schema)).collect()}


def test_a_batch_writes_its_own_rows_and_runs_merge_by_level(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    schema = spark.createDataFrame([], "id long, seq long").schema
    table = StateTable(spark, path, ["id"], schema, "seq", split=500, fan=3)
    sink, want = latest_log(table, "seq"), {}
    rng = random.Random(1)
    for n in range(10):
        rows = [(i, n) for i in range(4000)] if n == 0 else [(rng.randint(0, 5000), n) for _ in range(50)]
        want |= dict(rows)
        for _ in range(1 + (n == 4)):  # a batch that runs again changes nothing
            sink(spark.createDataFrame(rows, schema), n)
        wrote = spark.read.parquet(f"{path}/data/{n:012d}-0").count()
        assert wrote == len(dict(rows))
        assert {r.id: r.seq for r in table.read().collect()} == want
        held = table.manifest(n)
        assert all(sum(r.level == level for r in held) < 3 for level in range(5))
    assert max(r.level for r in held) >= 2 and max(r.buckets for r in held) >= 8
    assert {r.id: r.seq for r in table.read(3).collect()} != want  # an older version is whole as well
    gone = table.vacuum(keep=2)
    assert gone and {r.id: r.seq for r in table.read().collect()} == want and table.versions() == [8, 9]
    live = {r.run for v in (8, 9) for r in table.manifest(v)}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == live


def test_a_reader_never_sees_half_a_batch(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, seq long").schema
    table = StateTable(spark, f"file://{tmp_path}/t", ["id"], schema, "seq")
    assert table.versions() == [] and table.read().collect() == []
    latest_log(table, "seq")(spark.createDataFrame([(1, 1), (2, 1)], schema), 0)
    table._write(spark.createDataFrame([(1, 2)], schema), "000000000001-0", 1, 0, 1)  # data of a batch that failed before its manifest
    assert {tuple(r) for r in table.read().collect()} == {(1, 1), (2, 1)}
    latest_log(table, "seq")(spark.createDataFrame([(2, 5), (2, 4)], schema), 1)
    assert {tuple(r) for r in table.read().collect()} == {(1, 1), (2, 5)}
    latest_log(table, "seq")(spark.createDataFrame([], schema), 2)
    assert table.versions() == [0, 1, 2] and table.read().count() == 2


def test_an_id_counts_once_for_ever(spark, tmp_path):
    path = f"file://{tmp_path}"
    ids = StateTable(spark, f"{path}/ids", ["id"], spark.createDataFrame([], "id string").schema, split=20, fan=3, bloom=True)
    out = []
    sink = ingest_once(ids, ["seq"], lambda b, n: out.append((n, [tuple(r) for r in b.collect()])))
    rng = random.Random(2)
    want, seen = [], set()
    for n in range(7):
        rows = [(rng.choice([f"u{rng.randint(0, 300)}", None if rng.random() < 0.1 else "hot"]), 100 * n + i) for i in range(60)]
        fresh = []
        for i, s in rows:
            if i is None or i not in seen:
                fresh.append((i, s))
                seen.add(i)
        want.append((n, fresh))
        sink(spark.createDataFrame(rows, "id string, seq long"), n)
    key = lambda x: (x[0] or "", x[1])
    assert [(n, sorted(r, key=key)) for n, r in out] == [(n, sorted(r, key=key)) for n, r in want]
    sink(spark.createDataFrame(rows, "id string, seq long"), 6)  # the last batch once more gives the same
    assert sorted(out[-1][1], key=key) == sorted(want[-1][1], key=key)
    assert {r.id for r in ids.read().collect()} == seen - {None}
    # the filters let no held id out, and few others in
    run = ids.manifest(6)[-1]
    held = {r.id for r in ids._run(run).collect()}
    asked = spark.createDataFrame([(f"u{i}",) for i in range(1000)], "id string")
    may = {r.id for r in ids._may_hold(asked, run).collect()}
    assert held - {"hot"} <= may and len(may - held) < 80


def test_upserts_by_lookup_equal_upserts_of_the_whole_store(spark, tmp_path):
    schema = "id string, kind string, origin_platform string, native_id string, workspace_key string, parent_id string, state string, sensitivity string, payload_hash string, expires_at_ms long, revision long, tombstoned_at_ms long"
    rng = random.Random(6)
    store = spark.createDataFrame([], schema)
    table = StateTable(spark, f"file://{tmp_path}/r", ["kind", "origin_platform", "native_id"], store.schema, fan=2)
    want = store.collect()
    for n in range(4):
        rows = [(f"{n}-{i}", "k", rng.choice(["p", None]), f"n{rng.randint(0, 20)}", rng.choice(["w", "w", "v"]), None, rng.choice("ab"), "low", "h", None, 1, None, i) for i in range(15)]
        batch = spark.createDataFrame(rows, schema + ", seq long")
        upsert_log(table)(batch, n)
        want = upsert_records(spark.createDataFrame(want, schema), batch).drop("outcome").collect()
    cols = store.columns
    assert sorted(map(str, table.read().select(*cols).collect())) == sorted(map(str, spark.createDataFrame(want, schema).select(*cols).collect()))
    assert table.read().agg(F.max("revision")).first()[0] > 1
