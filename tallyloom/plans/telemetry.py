"""Queries over usage telemetry, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.operators import telemetry as T
from tallyloom.plans.bindings import CALLS, PROCESSES, QUOTAS, USAGE, calls, processes, quotas, table, usage

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REGISTERED = "registered AS (SELECT 'b' || i AS backend FROM range(0, 9) t(i))"


def registered(spark):
    return spark.range(0, 9).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("backend"))


@query(f"""WITH {CALLS}, {REGISTERED},
own AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY duration_ms) AS r, count(*) OVER (PARTITION BY backend) AS n,
               row_number() OVER (PARTITION BY backend ORDER BY "at" DESC, seq DESC) AS newest FROM calls WHERE operation = 'tools/call'),
a AS (SELECT backend, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, max(duration_ms) FILTER (r = ceil(n * 0.5::DOUBLE)) AS p50_ms, max(duration_ms) FILTER (r = ceil(n * 0.95::DOUBLE)) AS p95_ms,
             max("at") AS last_at, max(CASE WHEN newest = 1 AND NOT ok THEN error_type END) AS last_error,
             max(CASE WHEN newest = 1 THEN CASE WHEN ok THEN 'ok' WHEN lower(error_type) LIKE '%auth%' THEN 'auth_error' ELSE 'error' END END) AS auth_state FROM own GROUP BY backend)
SELECT coalesce(a.backend, g.backend) AS backend, coalesce(calls, 0) AS calls, coalesce(errors, 0) AS errors, p50_ms, p95_ms, last_at, last_error, auth_state FROM a FULL JOIN registered g ON a.backend = g.backend""")
def a2_backend_summary(spark, sf_dir):
    return T.backend_summary(calls(spark, sf_dir), registered(spark))


@query(f"""WITH {USAGE}, {QUOTAS},
u AS (SELECT provider_id, arg_min(account_id, seq) AS account_id, sum(input_tokens)::BIGINT AS input_tokens, sum(cached_input_tokens)::BIGINT AS cached_input_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens, sum(total_tokens)::BIGINT AS total_tokens,
             sum(request_count)::BIGINT AS requests, count(*) FILTER (status = 'failed') AS failed, round(sum(estimated_cost_usd), 6) AS cost_usd, round(sum(credits_consumed), 6) AS credits, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(time_to_first_token_ms), 6) AS avg_time_to_first_token_ms, round(avg(tokens_per_second), 6) AS avg_tokens_per_second FROM usage GROUP BY provider_id),
q AS (SELECT provider_id, count(*) AS n_quotas, string_agg(id, ',' ORDER BY id) AS quota_ids FROM quotas GROUP BY provider_id)
SELECT coalesce(u.provider_id, q.provider_id) AS provider_id, account_id, coalesce(input_tokens, 0) AS input_tokens, coalesce(cached_input_tokens, 0) AS cached_input_tokens, coalesce(cache_write_tokens, 0) AS cache_write_tokens, coalesce(output_tokens, 0) AS output_tokens, coalesce(reasoning_tokens, 0) AS reasoning_tokens, coalesce(total_tokens, 0) AS total_tokens,
       coalesce(requests, 0) AS requests, coalesce(failed, 0) AS failed, cost_usd, credits, avg_latency_ms, avg_time_to_first_token_ms, avg_tokens_per_second, coalesce(n_quotas, 0)::INTEGER AS n_quotas, coalesce(quota_ids, '') AS quota_ids
FROM u FULL JOIN q ON u.provider_id = q.provider_id""")
def a1_provider_summary(spark, sf_dir):
    out = T.provider_summary(usage(spark, sf_dir), quotas(spark, sf_dir))
    flat = out.withColumns({"n_quotas": F.size("quotas"), "quota_ids": F.array_join(F.transform("quotas", lambda q: q["id"]), ",")}).drop("quotas")
    return flat.withColumns({c: F.round(c, 6) for c in ("cost_usd", "credits", "avg_latency_ms", "avg_time_to_first_token_ms", "avg_tokens_per_second")})


@query(f"""WITH {USAGE} SELECT model_id, count(*) AS requests, count(*) FILTER (status = 'failed') AS failures, sum(total_tokens)::BIGINT AS tokens, round(sum(estimated_cost_usd), 6) AS cost_usd, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(time_to_first_token_ms), 6) AS avg_time_to_first_token_ms, round(avg(tokens_per_second), 6) AS avg_tokens_per_second
FROM usage GROUP BY model_id""")
def a4_model_comparison(spark, sf_dir):
    out = T.model_comparison(usage(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("cost_usd", "avg_latency_ms", "avg_time_to_first_token_ms", "avg_tokens_per_second")})


_SUMS = "count(*) AS calls, sum(total_tokens)::BIGINT AS tokens, sum(input_tokens)::BIGINT AS input_tokens, sum(cached_input_tokens)::BIGINT AS cached_input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens, round(sum(latency_ms), 4) AS latency_ms, sum(output_bytes)::BIGINT AS output_bytes, count(*) FILTER (status = 'failed') AS failed_calls, count(*) FILTER (retry_count > 0) AS retried_calls, max(memory_bytes) AS peak_memory_bytes"


@query(f"WITH {USAGE} SELECT category, {_SUMS} FROM usage GROUP BY category")
def a5_category_rollup(spark, sf_dir):
    return T.category_rollup(usage(spark, sf_dir)).withColumn("latency_ms", F.round("latency_ms", 4))


@query(f"WITH {USAGE} SELECT {_SUMS} FROM usage")
def a6_scan_totals(spark, sf_dir):
    return T.scan_totals(usage(spark, sf_dir)).withColumn("latency_ms", F.round("latency_ms", 4))


@query(f"""WITH {CALLS}, t AS (SELECT backend, tool_name, count(*) AS n FROM calls GROUP BY ALL),
s AS (SELECT backend, string_agg(tool_name || '=' || n, ',' ORDER BY n DESC, tool_name) AS tools FROM t GROUP BY backend)
SELECT c.backend, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, round(sum(duration_ms), 4) AS total_ms, max(duration_ms) AS max_ms, round(sum(duration_ms) / count(*), 2) AS avg_ms, max("at") AS last_at, any_value(s.tools) AS tools
FROM calls c JOIN s ON c.backend = s.backend GROUP BY c.backend""")
def a7_backend_metrics(spark, sf_dir):
    out = T.backend_metrics(calls(spark, sf_dir))
    return out.withColumns({"tools": F.array_join(F.transform("tools", lambda t: F.concat(t["tool"], F.lit("="), t["count"].cast("string"))), ","), "total_ms": F.round("total_ms", 4), "avg_ms": F.round(F.col("total_ms") / F.col("calls"), 2)})


@query(f"""WITH {USAGE}, {QUOTAS} SELECT 'tool_tokens' AS result, 'experiment_id,variant' AS missing UNION ALL SELECT 'wasted_tokens', 'experiment_id,variant' UNION ALL SELECT 'cpu_memory', CASE WHEN (SELECT max(p_size) FROM part) > 0 THEN '' ELSE 'sample_interval_seconds' END UNION ALL SELECT 'capacity', 'resets_at' UNION ALL SELECT 'savings', 'experiment_id,variant'""")
def a8_missing_evidence(spark, sf_dir):
    e = usage(spark, sf_dir).select(F.col("id").alias("task_id"), F.lit(None).alias("experiment_id"), F.lit(None).alias("variant"), F.col("id").alias("tool_execution_id"))
    s = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("cumulative_cpu_seconds"), F.col("p_size").alias("sample_interval_seconds"))
    out = T.missing_evidence(e, s, quotas(spark, sf_dir))
    return out.select("result", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY tool_name ORDER BY duration_ms) AS r, count(*) OVER (PARTITION BY tool_name) AS n FROM calls)
SELECT tool_name, count(*) AS n, round(median(duration_ms), 3) AS median, round(max(duration_ms) FILTER (r = ceil(n * 0.95::DOUBLE)), 3) AS p95 FROM r GROUP BY tool_name""")
def a17_timing_summary(spark, sf_dir):
    return T.timing_summary(calls(spark, sf_dir), ["tool_name"], "duration_ms")


@query("""SELECT l_partkey AS pid, l_suppkey AS started_at_ms, max(l_extendedprice) - min(l_extendedprice) AS cpu_seconds, sum(l_quantity * l_linenumber) AS memory_byte_seconds, max(l_quantity) AS peak_memory_bytes FROM lineitem GROUP BY ALL""")
def a18_resource_integrals(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pid"), F.col("l_suppkey").alias("started_at_ms"), F.col("l_extendedprice").alias("cumulative_cpu_seconds"), F.col("l_quantity").alias("resident_memory_bytes"), F.col("l_linenumber").alias("sample_interval_seconds"))
    return T.resource_integrals(s)


@query("""WITH b AS (SELECT o_custkey, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS x, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS y FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
s AS (SELECT x - y AS saved FROM b WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT count(*) AS pairs, round(avg(saved), 4) AS mean_saved, round(median(saved), 4) AS median_saved, round(stddev_samp(saved), 4) AS spread FROM s""")
def a19_matched_savings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("intervention").alias("variant"), F.col("o_totalprice").alias("tokens"), (F.col("o_orderstatus") != "P").alias("success"))
    return T.matched_savings(o, ["task"], "tokens").withColumns({c: F.round(c, 4) for c in ("mean_saved", "median_saved", "spread")})


@query("""WITH a AS (SELECT avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS control_score, avg(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderstatus = 'P')::INT::DOUBLE END) AS control_fail_rate,
  avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS treatment_score, avg(CASE WHEN o_orderkey % 2 = 1 THEN (o_orderstatus = 'P')::INT::DOUBLE END) AS treatment_fail_rate,
  coalesce(bool_or(o_orderkey % 2 = 1 AND o_orderpriority = '1-URGENT'), false) AS oracle_pass FROM orders)
SELECT round(control_score, 4) AS control_score, round(control_fail_rate, 6) AS control_fail_rate, round(treatment_score, 4) AS treatment_score, round(treatment_fail_rate, 6) AS treatment_fail_rate, oracle_pass, treatment_score >= control_score AND treatment_fail_rate <= control_fail_rate AND oracle_pass AS passes FROM a""")
def a20_experiment_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "control").otherwise("treatment").alias("arm"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "P").alias("hard_fail"), (F.col("o_orderpriority") == "1-URGENT").alias("oracle"))
    out = T.experiment_gate(o)
    return out.withColumns({c: F.round(c, 4 if "score" in c else 6) for c in ("control_score", "control_fail_rate", "treatment_score", "treatment_fail_rate")})


@query(f"""WITH {USAGE}, p AS (SELECT sum(total_tokens) AS t, sum(request_count) AS r, avg(latency_ms) AS l FROM usage GROUP BY provider_id)
SELECT sum(t)::BIGINT AS tokens, sum(r)::BIGINT AS requests, round(avg(l), 6) AS avg_latency_ms FROM p""")
def a21_dashboard_totals(spark, sf_dir):
    return T.dashboard_totals(T.provider_summary(usage(spark, sf_dir), quotas(spark, sf_dir))).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query(f"""WITH {USAGE}, f AS (SELECT *, first_value(id) OVER w AS first_id, row_number() OVER w AS r FROM usage WINDOW w AS (PARTITION BY signature ORDER BY seq))
SELECT first_id, id AS later_id, category, total_tokens AS tokens_on_later FROM f WHERE r > 1""")
def w1_exact_repeats(spark, sf_dir):
    return T.exact_repeats(usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT id, category, status, retry_count, total_tokens FROM usage WHERE status = 'failed' OR retry_count > 0")
def w2_failed_or_retried(spark, sf_dir):
    return T.failed_or_retried(usage(spark, sf_dir))


@query(f"""WITH {USAGE}, {QUOTAS}, late AS (SELECT * FROM usage ORDER BY seq DESC LIMIT 200)
SELECT 'quota' AS kind, CASE WHEN utilization_percent >= 95 THEN 'critical' ELSE 'warning' END AS severity, id AS subject, utilization_percent AS value FROM quotas WHERE utilization_percent >= 80
UNION ALL SELECT 'context', CASE WHEN context_utilization_percent >= 95 THEN 'critical' ELSE 'warning' END, id, context_utilization_percent FROM late WHERE context_utilization_percent >= 80
UNION ALL SELECT 'failure', 'warning', id, NULL FROM late WHERE status = 'failed'""")
def w3_usage_alerts(spark, sf_dir):
    return T.usage_alerts(usage(spark, sf_dir), quotas(spark, sf_dir))


@query(f"WITH {USAGE}, r AS (SELECT seq, session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM usage) SELECT seq, session_id FROM r WHERE r <= 5")
def w4_retain_newest(spark, sf_dir):
    return T.retain_newest(usage(spark, sf_dir), 5, key="session_id").select("seq", "session_id")


@query("""SELECT target, seq, ok, CASE WHEN ok THEN 'ok' WHEN coalesce(max(ok::INT) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'degraded' ELSE 'down' END AS state,
  last_value(CASE WHEN ok THEN digest END IGNORE NULLS) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS digest,
  last_value(CASE WHEN ok THEN version END IGNORE NULLS) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version
FROM (SELECT user_id AS target, event_id AS seq, event_type NOT IN ('error', 'view', 'click') AS ok, md5(props) AS digest, 'v' || (event_id % 5) AS version FROM events)""")
def w6_health_history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.health_history(e.select(F.col("user_id").alias("target"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"), F.md5("props").alias("digest"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("version")))


@query(f"""WITH {USAGE} SELECT id, context_utilization_percent FROM usage WHERE context_utilization_percent >= 80""")
def p8_context_pressure(spark, sf_dir):
    return T.context_pressure(usage(spark, sf_dir)).select("id", "context_utilization_percent")


@query(f"""WITH {CALLS} SELECT seq, backend, tool_name, "at" FROM calls WHERE backend = 'b3' ORDER BY "at" DESC, seq DESC LIMIT 1000""")
def p9_recent_calls(spark, sf_dir):
    return T.recent_calls(calls(spark, sf_dir), "b3", 5000).select("seq", "backend", "tool_name", "at")


@query("""SELECT o_orderkey, CASE WHEN len(a) <= 1 THEN coalesce(a[1], '') ELSE a[1] || ' [+' || (len(a) - 1) || ' args]' END AS shown FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS a FROM orders)""")
def p10_redact_command(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.redact_command(F.split("o_orderpriority", "-")).alias("shown"))


@query(f"""WITH {USAGE} SELECT provider_id, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM usage WHERE provider_id = 'p1' AND session_id = 46 GROUP BY 1""")
def p14_scoped(spark, sf_dir):
    return T.for_provider(T.for_session(usage(spark, sf_dir), 46), "p1").groupBy("provider_id").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


@query("""SELECT id, input_tokens, output_tokens, reasoning_tokens, cached_input_tokens, total_tokens, model_id, status, category, latency_ms, session_id FROM (
SELECT event_id::VARCHAR AS id, k * 7 AS input_tokens, k * 3 AS output_tokens, k * 2 AS reasoning_tokens, k AS cached_input_tokens, CASE WHEN event_id % 5 = 0 THEN k * 11 ELSE k * 10 END AS total_tokens, 'm' || (user_id % 5) AS model_id,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CASE event_type WHEN 'click' THEN 'git' WHEN 'view' THEN 'file-read' WHEN 'purchase' THEN 'rg' WHEN 'signup' THEN 'tests' ELSE 'other-tool' END AS category, value AS latency_ms, user_id::VARCHAR AS session_id
FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events))""")
def p1_normalize_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("long"))
    usage_ = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct((F.col("k") * 7).alias("inputTokens"), (F.col("k") * 3).alias("outputTokens"), (F.col("k") * 2).alias("reasoningTokens"), F.col("k").alias("cachedInputTokens"))))
    usage_ = usage_.otherwise(F.to_json(F.struct((F.col("k") * 7).alias("prompt_tokens"), (F.col("k") * 3).alias("completion_tokens"), F.struct((F.col("k") * 2).alias("reasoning_tokens")).alias("output_tokens_details"), F.struct(F.col("k").alias("cached_tokens")).alias("prompt_tokens_details"))))
    command = F.when(F.col("event_type") == "click", "git status").when(F.col("event_type") == "view", "sed -n 1p x").when(F.col("event_type") == "purchase", "rg x").when(F.col("event_type") == "signup", "npm test").otherwise("none")
    rest = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.when(F.col("event_id") % 5 == 0, F.col("k") * 11).alias("totalTokens"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.when(F.col("event_type") == "error", "boom").alias("error"), F.lit("run").alias("tool_name"), F.struct(command.alias("command")).alias("input"), F.col("value").alias("latencyMs"), F.col("user_id").cast("string").alias("conversation_id")))
    record = F.parse_json(F.concat(F.lit('{"usage":'), usage_, F.lit(","), F.substring(rest, 2, 100000)))
    out = T.normalize_usage(e.select(record.alias("record"), F.lit("import").alias("source")))
    return out.select("id", "input_tokens", "output_tokens", "reasoning_tokens", "cached_input_tokens", "total_tokens", "model_id", "status", "category", "latency_ms", "session_id")


@query("""SELECT o_orderkey, latency::DOUBLE AS latency_ms, wait::DOUBLE AS time_to_first_token_ms, round(outp / greatest((latency - wait) / 1000.0::DOUBLE, 0.001::DOUBLE), 6) AS tokens_per_second, inp + outp + cached + wr AS total_tokens, used * 100.0::DOUBLE / 200000 AS context_utilization_percent, o_orderstatus = 'P' AS failed
FROM (SELECT *, o_orderkey % 900 + o_custkey % 50 AS latency, o_orderkey % 40 AS wait, o_custkey AS inp, o_orderkey % 77 AS outp, 5 AS cached, 3 AS wr, o_custkey * 10 AS used FROM orders)""")
def p2_request_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1000).cast("long").alias("started_at"), (1000 + F.col("o_orderkey") % 900 + F.col("o_custkey") % 50).alias("completed_at"), (1000 + F.col("o_orderkey") % 40).alias("first_token_at"), F.col("o_custkey").alias("input_tokens"), (F.col("o_orderkey") % 77).alias("output_tokens"), F.lit(5).cast("long").alias("cached_input_tokens"), F.lit(3).cast("long").alias("cache_write_tokens"), (F.col("o_custkey") * 10).alias("context_tokens_used"), F.lit(200000).alias("context_window_tokens"), F.when(F.col("o_orderstatus") == "P", "E").alias("error_code"))
    return T.request_metrics(o, "cache").select("o_orderkey", "latency_ms", "time_to_first_token_ms", F.round("tokens_per_second", 6).alias("tokens_per_second"), "total_tokens", "context_utilization_percent", "failed")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 42 ELSE o_custkey + 1 END AS occurred_at, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 7 + 2 ELSE 99 END AS total_tokens, o_custkey * 100.0::DOUBLE / 50000 AS context_utilization_percent FROM orders""")
def p3_ingest_defaults(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") + 1).alias("occurred_at"), F.col("o_custkey").alias("input_tokens"), F.lit(7).alias("output_tokens"), F.lit(2).alias("reasoning_tokens"), F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(99).cast("long").alias("total_tokens"), F.col("o_custkey").alias("context_tokens_used"), F.lit(50000).alias("context_window_tokens"), F.lit(None).cast("double").alias("context_utilization_percent"))
    return T.ingest_defaults(o, 42).select("o_orderkey", "occurred_at", "total_tokens", "context_utilization_percent")


@query("""SELECT c_custkey AS session_id, coalesce(p.n, 0) AS processes, coalesce(u.n, 0) AS events, coalesce(cpu, 0) AS cpu_percent, coalesce(mem, 0) AS memory_bytes, coalesce(tok, 0)::BIGINT AS tokens FROM customer c
LEFT JOIN (SELECT session_id, count(*) AS n, sum(cpu_percent) AS cpu, sum(resident_memory_bytes)::BIGINT AS mem FROM (SELECT p_partkey % 50 AS session_id, p_size * 2.0::DOUBLE AS cpu_percent, trunc(p_retailprice * 100)::BIGINT AS resident_memory_bytes FROM part) GROUP BY 1) p ON p.session_id = c_custkey
LEFT JOIN (SELECT user_id AS session_id, count(*) AS n, sum(regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT * 10) AS tok FROM events GROUP BY 1) u ON u.session_id = c_custkey""")
def j1_session_detail(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return T.session_detail(s, processes(spark, sf_dir), usage(spark, sf_dir))


@query("""SELECT tool_name, CASE WHEN tool_name = 'error' THEN 'local' ELSE CASE WHEN tool_name LIKE 'red\\_%' ESCAPE '\\' THEN 'red' WHEN tool_name LIKE 'small\\_ring\\_%' ESCAPE '\\' THEN 'ring' WHEN tool_name LIKE 'small\\_%' ESCAPE '\\' THEN 'small' ELSE 'local' END END AS attributed FROM (SELECT replace(p_name, ' ', '_') || '_' || p_type AS tool_name FROM part)""")
def j5_attribute_backend(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_type")).alias("tool_name"))
    b = spark.createDataFrame([("red", "red"), ("small", "small"), ("small_ring", "ring")], "namespace string, backend string")
    return T.attribute_backend(c, b, ["error"])


@query(f"""WITH {PROCESSES} (SELECT 'cpu_percent' AS by, pid, cpu_percent AS value FROM processes ORDER BY cpu_percent DESC, pid LIMIT 10) UNION ALL (SELECT 'resident_memory_bytes', pid, resident_memory_bytes::DOUBLE FROM processes ORDER BY resident_memory_bytes DESC, pid LIMIT 10)""")
def t5_resource_drain(spark, sf_dir):
    return T.resource_drain(processes(spark, sf_dir))


@query(f"WITH {USAGE} SELECT date_trunc('hour', ts) AS hour, model_id, provider_id, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens FROM usage GROUP BY ALL")
def r5_hourly_usage(spark, sf_dir):
    return T.hourly_usage(usage(spark, sf_dir), ["model_id", "provider_id"])


@query("""SELECT user_id, arg_min(event_id, event_id) AS first_event, arg_max(event_id, event_id) AS last_event FROM events GROUP BY 1""")
def x3_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"))
    return T.dedupe(e, "user_id").select("user_id", F.col("seq").alias("first_event")).join(T.dedupe(e, "user_id", keep="last").select("user_id", F.col("seq").alias("last_event")), "user_id")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name || ' ' || p_type, '(?i)(^|\\s)(git)(\\s|$)') THEN 'git' WHEN regexp_matches(p_name || ' ' || p_type, '(?i)bash|shell|terminal|exec|command_execution') THEN 'bash' ELSE 'other-tool' END AS category,
substr(sha256(p_partkey || ':' || p_name), 1, 24) AS id, CASE p_partkey % 3 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000000 ELSE p_size END::BIGINT AS size FROM part""")
def f1_f4_f5_part_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    unit = F.when(F.col("p_partkey") % 3 == 0, "k").when(F.col("p_partkey") % 3 == 1, "M").otherwise("")
    return p.select("p_partkey", C.classify_tool(F.col("p_name"), F.col("p_type")).alias("category"), C.stable_id(F.col("p_partkey"), F.col("p_name")).alias("id"), C.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("size"))


@query(f"""WITH {CALLS} SELECT seq, CASE WHEN ok THEN 'ok' WHEN lower(error_type) LIKE '%auth%' THEN 'auth_error' ELSE 'error' END AS auth_state FROM calls""")
def f13_auth_state(spark, sf_dir):
    return calls(spark, sf_dir).select("seq", C.auth_state(F.col("ok"), F.col("error_type")).alias("auth_state"))
