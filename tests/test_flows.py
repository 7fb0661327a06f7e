"""Sources, sinks, streams, and the entry module."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from tallyloom.sources import catalog as SC
from tallyloom.sources import sinks as SK
from tallyloom.sources import usage as SU
from tallyloom.sources.tree import list_tree
from tallyloom.streaming import jobs as ST

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_usage_exports_are_read_and_split(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"events": [{"id": "1"}, {"id": "2"}], "quotas": [{"metric": "t"}]}))
    (tmp_path / "b.jsonl").write_text('{"usage":{"input_tokens":1}}\n\n{"pid":7}\nnot json\n')
    (tmp_path / "node_modules" / "c.json").write_text('{"usage":{}}')
    parts = SU.split_records(SU.read_usage(spark, str(tmp_path)))
    assert {k: df.count() for k, df in parts.items()} == {"events": 3, "samples": 1, "quotas": 1}


def test_empty_buckets_give_no_rows(spark):
    df = spark.sql("SELECT array(struct(1L AS start_time, 2L AS end_time, cast(array() AS array<struct<model:string,project:string,key:string,input:long,cached:long,cache_write:long,output:long,requests:long>>) AS results)) AS data")
    assert SU.flatten_bucket_report(df, "messages").count() == 0


def test_files_are_captured_with_their_facts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes("x\r\né".encode())
    (tmp_path / "yarn.lock").write_text("x")
    r = SC.capture_files(spark, str(tmp_path)).collect()
    assert [(x.path, x.byte_count, x.lines, x.newline, x.language) for x in r] == [("src/a.py", 5, 2, "crlf", "python")]


def test_manifest_facts(spark):
    m = {"name": "web", "main": "x.js", "bin": {"w": "w.js"}, "scripts": {"test": "t", "dev": "d"}, "dependencies": {"a": "1"}, "devDependencies": {"b": "catalog:"}}
    f = SC.manifest_facts(spark.createDataFrame([("apps/web/package.json", json.dumps(m))], "path string, text string"))
    assert f["projects"].first().root == "apps/web"
    assert {(r.package_name, r.scope) for r in f["dependencies"].collect()} == {("a", "runtime"), ("b", "development")}
    assert {(r.kind, r.target) for r in f["entrypoints"].collect()} == {("package", "x.js"), ("test", "test"), ("script", "dev"), ("executable", "w.js")}


def test_generations_replace_only_their_own(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(f"r{i}", "t", f"p{i}", None, None) for i in range(n)], "row_key string, table_name string, path string, project_id string, policy_id string")
    path = f"file://{tmp_path}/g"
    SK.publish_generation(rows(3), "g1", path)
    SK.publish_generation(rows(5), "g2", path)
    SK.publish_generation(rows(2), "g2", path)
    assert [SK.read_generation(spark, path, g).count() for g in ("g1", "g2")] == [3, 2]


def _files(spark, tmp_path, rows, schema, parts=3):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_stream_of_backends_equals_the_batch(spark, tmp_path):
    schema = "seq long, backend string, operation string, ok boolean, error_type string, at timestamp"
    rows = spark.range(300).select(F.col("id").alias("seq"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")).alias("backend"), F.lit("tools/call").alias("operation"), (F.col("id") % 4 != 0).alias("ok"), F.lit("E").alias("error_type"), F.timestamp_seconds((F.col("id") * 7919) % 100000).alias("at")).collect()
    s = _files(spark, tmp_path, rows, schema)
    got = []
    q = ST.backend_stream(s, late="30 days", every="30 days").writeStream.outputMode("complete").foreachBatch(lambda b, n: got.append(b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ST.backend_stream(spark.createDataFrame(rows, schema), late="30 days", every="30 days").collect()
    assert sorted(map(str, got[-1])) == sorted(map(str, want)) and len(got) >= 3


def test_duplicate_ids_count_once(spark, tmp_path):
    from datetime import datetime

    rows = [(f"u{i % 5}", datetime(2026, 1, 1), i) for i in range(20)]
    s = _files(spark, tmp_path, rows, "id string, ts timestamp, v int")
    q = ST.ingest_usage(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def _feed(stream, sink, tmp_path):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()


def test_latest_by_id_over_batches(spark, tmp_path):
    out = f"file://{tmp_path}/latest"
    assert ST.read_state(spark, out) is None
    _feed(_files(spark, tmp_path, [(i % 7, i) for i in range(50)], "id int, seq int", parts=4), ST.latest_by_id("id", "seq", out, buckets=3), tmp_path)
    assert {(r.id, r.seq) for r in ST.read_state(spark, out).collect()} == {(i, max(x for x in range(50) if x % 7 == i)) for i in range(7)}


def test_a_batch_rewrites_only_its_buckets_and_can_run_again(spark, tmp_path):
    out = f"file://{tmp_path}/latest"
    sink = ST.latest_by_id("id", "seq", out, buckets=50)
    rows = lambda *r: spark.createDataFrame(list(r), "id int, seq int")
    sink(rows(*[(i, i) for i in range(200)]), 0)
    for _ in range(2):
        sink(rows((5, 1000), (6, 2)), 1)
    got = {r.id: r.seq for r in ST.read_state(spark, out).collect()}
    assert got == {i: i for i in range(200)} | {5: 1000}
    assert spark.read.parquet(out).filter("version_ = 1").select("bucket_").distinct().count() <= 2


def test_sessions_end_and_start_again(spark, tmp_path):
    rows = [("a", "register", 1, 10), ("a", "end", 2, 20), ("b", "register", 3, 30), ("c", "end", 4, 40), ("d", "register", 5, 50), ("d", "end", 6, 60), ("d", "register", 7, 70), ("e", "end", 8, 80), ("e", "register", 9, 90)]
    out = f"file://{tmp_path}/sessions"
    sink = ST.latest_by_id(["id", "action"], "seq", out)
    for n, r in enumerate(rows):
        sink(spark.createDataFrame([r], "id string, action string, seq long, at long"), n)
    got = {r.id: (r.started_at, r.ended_at, r.state) for r in ST.sessions_of(ST.read_state(spark, out)).collect()}
    assert got == {"a": (10, 20, "ended"), "b": (30, None, "active"), "d": (70, None, "active"), "e": (90, None, "active")}


def test_snapshots_show_the_newest_events_of_all_batches(spark, tmp_path):
    from tallyloom.plans.bindings import quotas, table, usage

    sf = "/root/testdata/sf0.001"
    u = usage(spark, sf, table(spark, sf, "events").filter("event_id < 400"))
    sink = ST.snapshot_sink(quotas(spark, sf), f"file://{tmp_path}/snap", keep=150, recent=20)
    for n in range(4):
        for _ in range(1 + (n == 2)):
            sink(u.filter((F.col("seq") >= 100 * n) & (F.col("seq") < 100 * n + 100)), n)
    read = lambda name, n: spark.read.parquet(f"file://{tmp_path}/snap/sequence={n}/{name}")
    assert {r.seq for r in read("recent", 3).collect()} == set(range(380, 400))
    assert [read("summary", n).agg(F.sum("requests")).first()[0] for n in (0, 3)] == [u.filter(c).agg(F.sum(F.coalesce(F.col("metadata")["request_count"].cast("int"), F.lit(1)))).first()[0] for c in ("seq < 100", "seq >= 250")]
    assert read("alerts", 3).filter("kind = 'failure'").count() == u.filter("seq >= 250 AND status = 'failed'").count()


def test_upsert_sink_over_batches(spark, tmp_path):
    schema = "id string, kind string, origin_platform string, native_id string, workspace_key string, parent_id string, state string, sensitivity string, payload_hash string, expires_at_ms long, revision long, tombstoned_at_ms long, seq long"
    rows = [(str(i), "k", "p", f"n{i % 3}", "w", None, "s", "low", "h", None, 1, None, i) for i in range(9)]
    s = _files(spark, tmp_path, rows, schema)
    out = f"file://{tmp_path}/store"
    _feed(s, ST.upsert_sink(out), tmp_path)
    assert sorted((r.native_id, r.revision) for r in ST.read_state(spark, out).collect()) == [("n0", 1), ("n1", 1), ("n2", 1)]


def test_reports_are_a_folder_a_section(spark, tmp_path):
    SK.write_report({"a": spark.range(3), "b": spark.range(5)}, f"file://{tmp_path}/r")
    SK.write_report({"a": spark.range(2)}, f"file://{tmp_path}/r")
    assert [spark.read.parquet(f"file://{tmp_path}/r/{n}").count() for n in "ab"] == [2, 5]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_llm_folder(tmp_path):
    for name in ("__spark_entry__.py", "tallyloom"):
        os.symlink(f"{REPO}/{name}", tmp_path / name) if name.endswith(".py") else None
    os.mkdir(tmp_path / "tallyloom")
    for name in os.listdir(f"{REPO}/tallyloom"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{REPO}/tallyloom/{name}", tmp_path / "tallyloom" / name)
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert q and not any(k.startswith(('op', 'pipeline')) for k in q); print('fine')"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip() == "fine", got.stderr[-500:]


def test_vendored_folders_are_never_entered(spark, tmp_path):
    root = tmp_path / "a.b+c [x]"
    for name, data in {"src/a.py": b"x = 1\r\n", "src/deep/er/b.md": b"t", "node_modules/m/c.js": b"y", "src/node_modules/d.js": b"y", "yarn.lock": b"z", "e.txt": b"", "f.bin": b"\x00"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "empty").mkdir()
    listed = {r.path: r.bytes for r in list_tree(spark, str(root)).collect()}
    assert listed == {"src/a.py": 7, "src/deep/er/b.md": 1, "yarn.lock": 1, "e.txt": 0, "f.bin": 1}
    assert {(r.path, r.newline) for r in SC.capture_files(spark, f"file://{root}").collect()} == {("src/a.py", "crlf"), ("src/deep/er/b.md", "none")}
    assert SC.capture_files(spark, str(root), own_only=False).count() == 7
    assert list_tree(spark, str(root / "empty")).count() == 0
