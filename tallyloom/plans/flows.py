"""Queries over sources, text helpers and streams, and their SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.functions.chunker import MAX_BYTES, MAX_LINES, chunk_files
from tallyloom.functions.redaction import redact_json, redact_text, sanitize_events
from tallyloom.functions.scratch import scratch_dir
from tallyloom.operators.changes import locate_offsets
from tallyloom.operators.telemetry import category_rollup, scan_totals
from tallyloom.plans.bindings import CALLS, PAGES, QUOTAS, USAGE, calls, files, pages, quotas, table, usage
from tallyloom.sources import catalog as SC
from tallyloom.sources import sinks as SK
from tallyloom.sources import usage as SU
from tallyloom.sources.tree import write_files
from tallyloom.streaming import jobs as ST

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Documents as files, and a line with its end, by the line ends of chunk_files.
_FILES = "SELECT concat_ws('/', source, lang, doc_id || '.md') AS path, text, sha256(text) AS digest FROM documents WHERE text IS NOT NULL"
_ENDS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"


def _cut(s: str) -> str:
    """SQL for the end of the piece of a long line that begins at byte `s`: a code point is not cut."""
    byte = lambda back: f"substr(h, 2 * ({s} + {MAX_BYTES} - {back}) + 1, 1) NOT IN ('8', '9', 'A', 'B')"
    return f"CASE WHEN {s} + {MAX_BYTES} >= n THEN n ELSE {s} + {MAX_BYTES} - CASE WHEN {byte(0)} THEN 0 WHEN {byte(1)} THEN 1 WHEN {byte(2)} THEN 2 ELSE 3 END END"


_CHUNKS = f"""f AS ({_FILES}),
ls AS (SELECT path, digest, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[^{_ENDS}]*(?:\\r\\n|[{_ENDS}])|[^{_ENDS}]+') END AS ls FROM f),
l AS (SELECT path, digest, i, hex(encode(ls[i])) AS h FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM ls)),
s AS MATERIALIZED (SELECT path, digest, i, h, len(h) // 2 AS n, (sum(len(h) // 2) OVER (PARTITION BY path ORDER BY i) - len(h) // 2)::BIGINT AS before FROM l),
c AS (SELECT path, digest, i, before, n, h, 0::BIGINT AS s, {_cut("0")} AS e FROM s WHERE n > {MAX_BYTES}
  UNION ALL SELECT path, digest, i, before, n, h, e, {_cut("e")} FROM c WHERE e < n),
short AS MATERIALIZED (SELECT path, digest, i, n, before FROM s),
g AS (SELECT path, digest, i, before, n, i AS first, CASE WHEN n > {MAX_BYTES} THEN 0 ELSE n END AS size, CASE WHEN n > {MAX_BYTES} THEN 0 ELSE 1 END AS held FROM short WHERE i = 1
  UNION ALL SELECT m.path, m.digest, m.i, m.before, m.n, CASE WHEN more THEN first ELSE m.i END, CASE WHEN long THEN 0 WHEN more THEN size + m.n ELSE m.n END, CASE WHEN long THEN 0 WHEN more THEN held + 1 ELSE 1 END
  FROM (SELECT g.first, g.size, g.held, m.*, m.n > {MAX_BYTES} AS long, m.n <= {MAX_BYTES} AND held > 0 AND held < {MAX_LINES} AND size + m.n <= {MAX_BYTES} AS more FROM g JOIN short m ON m.path = g.path AND m.i = g.i + 1) m),
r AS (SELECT path, digest, min(before) AS byte_start, max(before + n) AS byte_end, first AS start_line, max(i) AS end_line FROM g WHERE held > 0 GROUP BY path, digest, first
  UNION ALL SELECT path, digest, before + s, before + e, i, i FROM c)"""


@query(f"""
WITH RECURSIVE {_CHUNKS}
SELECT path, digest, byte_start::BIGINT AS byte_start, byte_end::BIGINT AS byte_end, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line,
  sha256(concat_ws(chr(0), 'w', path, digest, byte_start, byte_end)) AS chunk_id FROM r
""")
def u1_chunk_files(spark, sf_dir):
    return chunk_files(files(spark, sf_dir)).drop("text")


@query()
def f2_redact_text(spark, sf_dir):
    r = redact_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.count", F.sha2("r.value", 256).alias("value_sha256"))


@query("""SELECT event_id, '{"k":' || k || ',"password":"[REDACTED]","input_tokens":"' || user_id || '"}' AS value, 1 AS count FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events)""")
def f3_redact_json(spark, sf_dir):
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1)
    body = F.concat(F.lit('{"k":'), k, F.lit(',"password":"p'), k, F.lit('","input_tokens":"'), F.col("user_id").cast("string"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", redact_json(body).alias("r")).select("event_id", "r.value", "r.count")


@query("""SELECT event_id, event_type, CASE user_id % 3 WHEN 0 THEN '[REDACTED]' ELSE props END AS held, user_id::VARCHAR AS max_tokens FROM events""")
def p13_sanitize_events(spark, sf_dir):
    name = F.when(F.col("user_id") % 3 == 0, "api_key").when(F.col("user_id") % 3 == 1, "api_key_tokens").otherwise("note")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", name.alias("name"), F.create_map(name, F.col("props"), F.lit("max_tokens"), F.col("user_id").cast("string")).alias("metadata"))
    return sanitize_events(e, ["event_type"]).select("event_id", "event_type", F.col("metadata")[F.col("name")].alias("held"), F.col("metadata")["max_tokens"].alias("max_tokens"))


@query("""SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, 'markdown' AS language, 'documentation' AS kind FROM documents WHERE text IS NOT NULL AND text <> '' AND len(list_filter(string_split(text, chr(10)), lambda x: strlen(x) > 2000)) = 0 AND source <> 'vendor'""")
def p4_p5_eligible_files(spark, sf_dir):
    f = files(spark, sf_dir)
    ok = f.filter(P.eligible(F.col("path"), F.col("text").cast("binary"), max_line=2000))
    return ok.select("path", P.language_of(F.col("path")).alias("language"), P.chunk_kind(F.col("path")).alias("kind"))


@query(rf"""WITH {PAGES}, p AS (SELECT page_id, split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS a, split_part(path, '/', 3) AS b FROM paths), k AS (SELECT * FROM p WHERE host <> '' AND a <> '' AND b <> '')
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '2=' || a || ':required;3=' || b || ':optional-catch-all' WHEN 1 THEN '3=' || b || ':catch-all' ELSE '1=' || host || ':required' END AS segments,
CASE page_id % 3 WHEN 0 THEN '/' || host || '/' || a || '/' || b WHEN 1 THEN '/' || host || '/' || b ELSE '/' || b END AS target FROM k""")
def f10_dynamic_segments(spark, sf_dir):
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    p = pages(spark, sf_dir).select("page_id", part(1).alias("host"), part(2).alias("a"), part(3).alias("b")).filter("host <> '' AND a <> '' AND b <> ''")
    form = lambda *forms: F.when(F.col("page_id") % 3 == 0, F.format_string(forms[0], "host", "a", "b")).when(F.col("page_id") % 3 == 1, F.format_string(forms[1], "host", "a", "b")).otherwise(F.format_string(forms[2], "host", "a", "b"))
    route = form("/%s/[%s]/[[...%s]]", "/%s/%s/[...%s]", "/[%s]/%s/%s")
    seg = F.array_join(F.transform(P.dynamic_segments(route), lambda x: F.concat(x["position"].cast("string"), F.lit("="), x["name"], F.lit(":"), x["kind"])), ";")
    return p.select("page_id", seg.alias("segments"), P.interception(form("/%s/%s/(.)%s", "/%s/%s/(..)%s", "/%s/%s/(...)%s")).alias("target"))


@query(f"""
WITH RECURSIVE {_CHUNKS},
o AS (SELECT path, (octet_length(encode(text)) // 2)::BIGINT AS byte_offset, hex(encode(text)) AS h FROM f),
b AS (SELECT path, byte_offset, start_line, regexp_extract_all(substr(h, 2 * byte_start + 1, 2 * (byte_offset - byte_start)), '..') AS bs
  FROM o JOIN r USING (path) WHERE byte_offset >= byte_start AND byte_offset < greatest(byte_end, byte_start + 1))
SELECT path, byte_offset, (start_line + len(list_filter(bs, lambda x: x = '0A')))::INTEGER AS line, coalesce(nullif(list_position(list_reverse(bs), '0A'), 0), len(bs) + 1)::INTEGER AS "column" FROM b
""")
def j11_locate_offsets(spark, sf_dir):
    f = files(spark, sf_dir)
    off = f.select("path", F.floor(F.octet_length("text") / 2).cast("long").alias("byte_offset"))
    return locate_offsets(off, chunk_files(f)).select("path", "byte_offset", "line", "column")


# ---- sources ----


@query("""SELECT 'events' AS kind, sum(CASE WHEN turn % 3 = 2 THEN 0 WHEN role = 'user' THEN len(string_split(text, chr(10))) WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS n FROM conversations
UNION ALL SELECT 'samples', count(*) FILTER (turn % 3 <> 2 AND (role = 'user' OR role <> 'assistant')) FROM conversations UNION ALL SELECT 'quotas', sum(CASE WHEN turn % 3 = 2 THEN turn + 1 ELSE 0 END)::BIGINT FROM conversations""")
def s2_split_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    quotas_ = F.to_json(F.struct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn")), lambda i: F.struct(i.alias("limit"))).alias("quotas")))
    told = F.to_json(F.struct(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("toolName"))).alias("events"), F.array(F.struct(F.col("conv_id").alias("pid"))).alias("processes")))
    used = F.to_json(F.struct(F.struct(F.length("text").alias("input_tokens")).alias("usage")))
    body = F.when(F.col("turn") % 3 == 2, quotas_).when(F.col("role") == "user", told).when(F.col("role") == "assistant", used).otherwise(F.to_json(F.struct(F.col("conv_id").alias("pid"))))
    parts = SU.split_records(c.select(F.lit("f").alias("source"), F.parse_json(body).alias("record")))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no FROM events),
d AS (SELECT user_id, CASE WHEN bool_or(user_id % 2 = 0 AND event_type NOT IN ('view', 'click')) THEN 'turns' WHEN bool_or(user_id % 2 = 1 AND event_type <> 'view') THEN 'results' END AS dialect FROM l WHERE line_no <= 20 GROUP BY user_id)
SELECT user_id::VARCHAR AS file, line_no::BIGINT AS line_no, dialect, CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_type = 'click' THEN 'item.completed' ELSE 'turn.completed' END ELSE 'result' END AS type,
CASE WHEN user_id % 2 = 0 AND event_type <> 'click' THEN regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT END AS input_tokens, CASE WHEN user_id % 2 = 1 THEN value END AS cost_usd FROM l JOIN d USING (user_id) WHERE dialect IS NOT NULL AND event_type <> 'view'""")
def s3_import_transcripts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("line_no", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long"))
    kind = F.when(F.col("event_type") == "view", "noise").when(F.col("user_id") % 2 == 1, "result").when(F.col("event_type") == "click", "item.completed").otherwise("turn.completed")
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1)
    body = F.concat(F.lit('{"type":"'), kind, F.lit('","usage":{"input_tokens":'), k, F.lit(',"output_tokens":1},"total_cost_usd":'), F.col("value").cast("string"), F.lit("}"))
    lines = e.select(F.col("user_id").cast("string").alias("file"), "line_no", F.parse_json(body).alias("record"))
    return SU.import_transcripts(lines).select("file", "line_no", "dialect", "type", "input_tokens", "cost_usd")


@query("""SELECT 'categories' AS section, event_type AS name, count(*) AS calls FROM events GROUP BY event_type UNION ALL SELECT 'totals', 'all', count(*) FROM events""")
def s8_write_report(spark, sf_dir):
    path = f"{scratch_dir(spark)}/generations/{uuid.uuid4().hex}"
    u = usage(spark, sf_dir)
    SK.write_report({"categories": category_rollup(u), "totals": scan_totals(u)}, path)
    a = spark.read.parquet(f"{path}/categories").select(F.lit("categories").alias("section"), F.col("category").alias("name"), "calls")
    return a.unionByName(spark.read.parquet(f"{path}/totals").select(F.lit("totals").alias("section"), F.lit("all").alias("name"), "calls"))


@query("""SELECT doc_id, sha256(text || chr(10)) AS digest, strlen(text) + 1 AS byte_count, (length(text) - length(replace(text, chr(10), '')) + 2)::INTEGER AS lines FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 4""")
def s5_capture_files(spark, sf_dir):
    """Documents as a tree of files, a fifth of them below a vendored folder, captured again."""
    root = f"{scratch_dir(spark)}/trees/{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").filter("text is not null")
    place = F.when(F.col("doc_id") % 5 == 4, F.array(F.lit("node_modules"), F.lit("lib"))).otherwise(F.array(F.lit("src"), F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string"))))
    write_files(d.select(F.concat_ws("/", F.array_join(place, "/"), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.concat("text", F.lit("\n")).alias("text")), root)
    got = SC.capture_files(spark, root)
    return got.select(F.regexp_extract("path", "([0-9]+)[.]md$", 1).cast("long").alias("doc_id"), "digest", "byte_count", "lines")


@query("""SELECT 'm' || (o_custkey % 7) AS model_id, o_orderkey AS occurred_at, o_custkey AS input_tokens, o_custkey + 10 + 5 AS total_tokens FROM orders""")
def s4_flatten_bucket_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = F.struct(F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model"), F.lit("p").alias("project"), F.lit("k").alias("key"), F.col("o_custkey").alias("input"), F.lit(5).alias("cached"), F.lit(None).cast("int").alias("cache_write"), F.lit(10).alias("output"), F.lit(1).alias("requests"))
    report = o.select(F.array(F.struct(F.col("o_orderkey").alias("start_time"), (F.col("o_orderkey") + 1).alias("end_time"), F.array(r).alias("results")), F.struct(F.col("o_orderkey").alias("start_time"), F.col("o_orderkey").alias("end_time"), F.filter(F.array(r), lambda x: F.lit(False)).alias("results"))).alias("data"))
    return SU.flatten_bucket_report(report, "messages").select("model_id", "occurred_at", "input_tokens", "total_tokens")


@query("""SELECT 'a' || p_partkey AS artifact, 'lines' AS metric, p_size AS hits, 40 AS total FROM part WHERE p_size <= 40""")
def s6_import_coverage(spark, sf_dir):
    body = F.concat(F.lit('{"artifact":"a'), F.col("p_partkey").cast("string"), F.lit('","run":"r","records":[{"subject":"s","metric":"lines","hits":'), F.col("p_size").cast("string"), F.lit(',"total":40}]}'))
    return SC.import_coverage(table(spark, sf_dir, "part").select(body.alias("body"))).select("artifact", "metric", "hits", "total")


@query("""SELECT 'pkg' || p_partkey AS project_id, d.name AS package_name, d.scope FROM part, (VALUES ('left', 'runtime'), ('right', 'development')) d(name, scope) WHERE p_partkey % 2 = 0 OR d.scope = 'runtime'""")
def s7_manifest_facts(spark, sf_dir):
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('{"name":"pkg'), n, F.lit('","dependencies":{"left":"1"}'), F.when(F.col("p_partkey") % 2 == 0, ',"devDependencies":{"right":"2"}').otherwise(""), F.lit(',"scripts":{"test":"x"}}'))
    m = SC.manifest_facts(table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), n, F.lit("/package.json")).alias("path"), text.alias("text")))
    return m["dependencies"].select("project_id", "package_name", "scope")


@query("""SELECT 'symbol:' || p_brand || ':' || p_partkey AS fact_key, 'symbol' AS kind, p_type AS path, p_name AS title FROM part UNION ALL SELECT 'dependency:' || p_brand || ':' || p_name, 'dependency', p_brand, p_name FROM part""")
def f8_search_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sym = p.select(F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("signature"))
    dep = p.select(F.col("p_brand").alias("project_id"), F.col("p_name").alias("package_name"), F.lit("runtime").alias("scope"), F.lit("1").alias("specifier"))
    return SC.search_documents({"symbol": sym, "dependency": dep}).select("fact_key", "kind", "path", "title")


@query("""SELECT p_type AS table_name, count(*) AS n, count(DISTINCT p_partkey) AS keys FROM part GROUP BY 1""")
def s9_publish_generation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("row_key"), F.col("p_type").alias("table_name"), F.col("p_name").alias("path"), F.col("p_brand").alias("project_id"), F.lit(None).cast("string").alias("policy_id"))
    path = f"{scratch_dir(spark)}/generations/{uuid.uuid4().hex}"
    SK.publish_generation(rows, "g1", path)
    return SK.read_generation(spark, path, "g1").groupBy("table_name").agg(F.count("*").alias("n"), F.countDistinct("row_key").alias("keys"))


# ---- streams: the events table, read as a stream to its end ----


def _events(spark, sf_dir):
    """The events as a stream; the pattern lets the path be a file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def _run(df, mode: str):
    spark = df.sparkSession
    top = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{top}/out")).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{top}/out")


@query(f"WITH {USAGE} SELECT provider_id, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM usage GROUP BY 1")
def r1_ingest_usage(spark, sf_dir):
    s = usage(spark, sf_dir, _events(spark, sf_dir)).select("id", "ts", "provider_id", "total_tokens", "metadata")
    return _run(ST.ingest_usage(s), "append").groupBy("provider_id").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


@query("SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def r2_latest_by_id(spark, sf_dir):
    top = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    e = _events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    e.writeStream.foreachBatch(ST.latest_by_id("id", "seq", top)).option("checkpointLocation", f"{top}-state").trigger(availableNow=True).start().awaitTermination()
    return ST.read_state(spark, top)


_ACTION = "CASE WHEN event_type IN ('signup', 'purchase') THEN 'register' WHEN event_type = 'error' THEN 'end' END"


@query(f"""WITH e AS (SELECT user_id AS id, {_ACTION} AS action, event_id AS seq FROM events WHERE {_ACTION} IS NOT NULL),
s AS (SELECT id, max(seq) FILTER (action = 'register') AS r, max(seq) FILTER (action = 'end') AS x FROM e GROUP BY id)
SELECT id, r * 10 AS started_at, CASE WHEN x > r THEN x * 10 END AS ended_at, CASE WHEN x > r THEN 'ended' ELSE 'active' END AS state FROM s WHERE r IS NOT NULL""")
def r2_sessions(spark, sf_dir):
    top = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    e = _events(spark, sf_dir).select(F.col("user_id").alias("id"), F.expr(_ACTION).alias("action"), F.col("event_id").alias("seq"), (F.col("event_id") * 10).alias("at")).filter("action IS NOT NULL")
    e.writeStream.foreachBatch(ST.latest_by_id(["id", "action"], "seq", top)).option("checkpointLocation", f"{top}-state").trigger(availableNow=True).start().awaitTermination()
    return ST.sessions_of(ST.read_state(spark, top))


@query(f"""WITH {USAGE}, {QUOTAS}, n AS (SELECT * FROM usage ORDER BY seq DESC LIMIT 10000), late AS (SELECT * FROM n ORDER BY seq DESC LIMIT 200)
SELECT 'summary' AS section, provider_id AS subject, sum(total_tokens)::BIGINT AS tokens FROM (SELECT provider_id, total_tokens FROM n UNION ALL SELECT DISTINCT provider_id, 0 FROM quotas) GROUP BY provider_id
UNION ALL SELECT 'alerts', 'quota:' || id, NULL FROM quotas WHERE utilization_percent >= 80 UNION ALL SELECT 'alerts', 'context:' || id, NULL FROM late WHERE context_utilization_percent >= 80 UNION ALL SELECT 'alerts', 'failure:' || id, NULL FROM late WHERE status = 'failed'
UNION ALL (SELECT 'recent', id, total_tokens FROM n ORDER BY seq DESC LIMIT 100)""")
def r3_snapshot_job(spark, sf_dir):
    top = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    s = usage(spark, sf_dir, _events(spark, sf_dir))
    s.writeStream.foreachBatch(ST.snapshot_sink(quotas(spark, sf_dir), top, keep=10_000)).option("checkpointLocation", f"{top}-state").trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(f"{top}/buffer").agg(F.max("version_")).first()[0]
    read = lambda name: spark.read.parquet(f"{top}/sequence={newest}/{name}")
    out = read("summary").select(F.lit("summary").alias("section"), F.col("provider_id").alias("subject"), F.col("total_tokens").alias("tokens"))
    out = out.unionByName(read("alerts").select(F.lit("alerts").alias("section"), F.concat_ws(":", "kind", "subject").alias("subject"), F.lit(None).cast("long").alias("tokens")))
    return out.unionByName(read("recent").select(F.lit("recent").alias("section"), F.col("id").alias("subject"), F.col("total_tokens").alias("tokens")))


@query(f"""WITH {CALLS} SELECT backend, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, max("at") AS last_at FROM calls WHERE operation = 'tools/call' GROUP BY backend""")
def r4_backend_stream(spark, sf_dir):
    out = _run(ST.backend_stream(calls(spark, sf_dir, _events(spark, sf_dir)), late="400 days", every="1 day"), "complete")
    return out.groupBy("backend").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("last_at").cast("timestamp_ntz").alias("last_at"))


@query("SELECT event_type AS scope, max(event_id) AS watermark, count(*) FILTER (user_id % 2 = 0) AS persisted FROM events GROUP BY 1")
def r6_track_cursor(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = e.select(F.col("event_type").alias("scope"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("updated_at_ms"), F.lit(1).alias("generation"), (F.col("user_id") % 2 == 0).alias("durable"))
    return _run(ST.track_cursor(s), "complete").select("scope", "watermark", "persisted")


@query(f"WITH {USAGE} SELECT model_id, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens FROM usage GROUP BY 1")
def r3_snapshot_stream(spark, sf_dir):
    s = usage(spark, sf_dir, _events(spark, sf_dir)).groupBy("model_id").agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"))
    return _run(s, "complete")
