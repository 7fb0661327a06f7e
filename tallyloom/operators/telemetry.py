"""Usage telemetry: normalise, aggregate, compare, alert, attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import auth_state, classify_tool, stable_id
from tallyloom.functions.quantiles import with_quantiles

# ---- normalisation ----


def _first(raw: str, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*[F.expr(f"try_variant_get({raw}, '$.{p}', '{kind}')") for p in paths])


def _number(raw: str, *paths: str) -> Column:
    """The first field that is present; what is no number counts 0."""
    return F.coalesce(_first(raw, *paths).try_cast("double"), F.lit(0.0)).cast("long")


def normalize_usage(df: DataFrame, record: str = "record", source: str = "source") -> DataFrame:
    """Raw usage records (a VARIANT column) with any field spelling to one event schema. The total is input + output unless given."""
    u = ("usage", "response.usage", "message.usage")
    tok = lambda *names: _number(record, *[f"{p}.{n}" for p in u for n in names[:-1]], names[-1])
    inp = tok("inputTokens", "input_tokens", "prompt_tokens", "inputTokens")
    out = tok("outputTokens", "output_tokens", "completion_tokens", "outputTokens")
    cached = tok("cachedInputTokens", "cached_input_tokens", "input_cached_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens", "cachedInputTokens")
    write = tok("cacheWriteTokens", "cache_creation_input_tokens", "cacheWriteTokens")
    reason = tok("reasoningTokens", "reasoning_output_tokens", "output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens", "reasoningTokens")
    total = F.coalesce(_first(record, *[f"{p}.{n}" for p in u for n in ("totalTokens", "total_tokens")], "totalTokens").try_cast("double").cast("long"), inp + out)
    started = _number(record, "requestStartedAt", "performance.requestStartedAt", "startedAt", "timestamp", "occurredAt")
    latency = _first(record, "latencyMs", "performance.latencyMs").try_cast("double")
    ended = F.coalesce(_first(record, "completedAt", "performance.completedAt", "endedAt").try_cast("double").cast("long"), started + F.coalesce(latency, F.lit(0.0)).cast("long"))
    tool = _first(record, "toolName", "tool_name", "name")
    command = _first(record, "command", "input.command", "arguments.command")
    category = classify_tool(F.coalesce(tool, _first(record, "type", "kind")), F.coalesce(command, _first(record, "metadata.command")), _first(record, "toolCategory", "category"))
    body = F.to_json(F.struct(category.alias("category"), tool.alias("tool"), command.alias("command"), _first(record, "input", "arguments").alias("input")))
    text = F.coalesce(_first(record, "output", "result", "content", "toolOutput"), F.lit(""))
    status = F.coalesce(_first(record, "status", "performance.status"), F.when(_first(record, "error").isNotNull(), "failed").otherwise("completed"))
    return df.select(
        *[c for c in df.columns if c not in (record, source)],
        F.coalesce(_first(record, "id", "requestId", "request_id"), stable_id(F.col(source), started, body)).alias("id"),
        F.col(source).alias("source"),
        F.coalesce(_first(record, "providerId", "provider", "vendor"), F.lit("unknown")).alias("provider_id"),
        _first(record, "sessionId", "session_id", "conversationId", "conversation_id").alias("session_id"),
        _first(record, "taskId", "task_id").alias("task_id"),
        _first(record, "experimentId", "experiment_id").alias("experiment_id"),
        _first(record, "variant", "metadata.variant").alias("variant"),
        _first(record, "toolExecutionId", "tool_execution_id").alias("tool_execution_id"),
        F.coalesce(_first(record, "modelId", "model"), F.lit("unknown")).alias("model_id"),
        category.alias("category"), F.coalesce(tool, category).alias("tool_name"), F.substring(F.sha2(body, 256), 1, 20).alias("signature"),
        started.alias("started_at"), ended.alias("completed_at"), F.coalesce(latency, (ended - started).cast("double")).alias("latency_ms"), status.alias("status"),
        _number(record, "retryCount", "performance.retryCount").alias("retry_count"),
        inp.alias("input_tokens"), out.alias("output_tokens"), cached.alias("cached_input_tokens"), write.alias("cache_write_tokens"), reason.alias("reasoning_tokens"), total.alias("total_tokens"),
        _number(record, "residentMemoryBytes", "memoryBytes", "process.residentMemoryBytes").alias("memory_bytes"),
        F.octet_length(text).cast("long").alias("output_bytes"), F.coalesce(command, F.lit("")).alias("command"),
        _first(record, "estimatedCostUsd", "costUsd", "cost_usd").try_cast("double").alias("estimated_cost_usd"),
    )


def request_metrics(df: DataFrame, dialect: str = "plain") -> DataFrame:
    """Latency, time to first token, tokens a second, context use, failure; `cache` dialect adds cache reads and writes to the total."""
    latency = F.greatest(F.col("completed_at") - F.col("started_at"), F.lit(0)).cast("double")
    wait = F.greatest(F.col("first_token_at") - F.col("started_at"), F.lit(0)).cast("double")
    seconds = F.greatest((latency - F.coalesce(wait, F.lit(0.0))) / 1000, F.lit(0.001))
    total = F.col("input_tokens") + F.col("output_tokens")
    if dialect == "cache":
        total = total + F.coalesce("cached_input_tokens", F.lit(0)) + F.coalesce("cache_write_tokens", F.lit(0))
    use = F.when(F.col("context_window_tokens") > 0, F.col("context_tokens_used") * 100.0 / F.col("context_window_tokens"))
    return df.withColumns({"latency_ms": latency, "time_to_first_token_ms": wait, "tokens_per_second": F.col("output_tokens") / seconds, "total_tokens": total, "context_utilization_percent": use, "failed": F.col("error_code").isNotNull()})


def ingest_defaults(df: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Missing times are now; a total of 0 is input + output + reasoning; context use where a window is known."""
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    total = F.when(F.coalesce("total_tokens", F.lit(0)) == 0, F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")).otherwise(F.col("total_tokens"))
    use = F.coalesce("context_utilization_percent", F.when(F.col("context_window_tokens") > 0, F.col("context_tokens_used") * 100.0 / F.col("context_window_tokens")))
    return df.withColumns({"occurred_at": F.when(F.coalesce("occurred_at", F.lit(0)) == 0, now).otherwise(F.col("occurred_at")), "total_tokens": total, "context_utilization_percent": use})


def quota_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("utilization_percent", F.coalesce("utilization_percent", F.when(F.col("limit") > 0, F.col("used") * 100.0 / F.col("limit"))))


# ---- selections ----


def context_pressure(usage: DataFrame, min_percent: float = 80.0) -> DataFrame:
    use = F.coalesce("context_utilization_percent", F.lit(0.0))
    return usage.filter(use >= min_percent).orderBy(use.desc(), "seq")


def recent_calls(calls: DataFrame, backend: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first by event time; a page is at most 1,000 rows, which is the feature."""
    df = calls if backend is None else calls.filter(F.col("backend") == backend)
    return df.orderBy(F.desc("at"), F.desc("seq")).limit(min(limit, 1000))


def for_session(df: DataFrame, session_id=None) -> DataFrame:
    return df if session_id is None else df.filter(F.col("session_id") == session_id)


def for_provider(df: DataFrame, provider_id=None) -> DataFrame:
    return df if provider_id is None else df.filter(F.col("provider_id") == provider_id)


def dedupe(df: DataFrame, key: str, seq: str = "seq", keep: str = "first") -> DataFrame:
    """One row a key: the first to arrive (ingest) or the last (scan)."""
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(F.col(key).alias("__k")).agg(pick(F.struct(*df.columns), F.col(seq)).alias("__r")).select("__r.*")


def retain_newest(df: DataFrame, n: int, seq: str = "seq", key: str | None = None) -> DataFrame:
    """The n newest by arrival, or the n newest of each key."""
    if key is None:
        return df.orderBy(F.desc(seq)).limit(n)
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))).filter(F.col("__r") <= n).drop("__r")


# ---- aggregates ----


def provider_summary(usage: DataFrame, quotas: DataFrame) -> DataFrame:
    """A row a provider: token sums, failures, requests (from metadata, else one), averages over known values, quotas; providers with quotas only get zeros."""
    requests = F.coalesce(F.col("metadata")["request_count"].try_cast("long"), F.lit(1))
    sums = [F.sum(f"{k}_tokens").cast("long").alias(f"{k}_tokens") for k in ("input", "cached_input", "cache_write", "output", "reasoning", "total")]
    means = [F.avg(c).alias(f"avg_{c}") for c in ("latency_ms", "time_to_first_token_ms", "tokens_per_second")]
    left = usage.groupBy("provider_id").agg(F.min_by("account_id", "seq").alias("account_id"), *sums, F.sum(requests).alias("requests"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("estimated_cost_usd").alias("cost_usd"), F.sum("credits_consumed").alias("credits"), *means)
    right = quotas.groupBy("provider_id").agg(F.array_sort(F.collect_list(F.struct("id", "used", "limit", "utilization_percent"))).alias("quotas"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in [f"{k}_tokens" for k in ("input", "cached_input", "cache_write", "output", "reasoning", "total")] + ["requests", "failed"]}
    out = left.join(right, "provider_id", "full_outer").withColumns(zero)
    return out.withColumn("quotas", F.coalesce("quotas", F.array().cast(right.schema["quotas"].dataType)))


def dashboard_totals(summary: DataFrame) -> DataFrame:
    """Totals over provider summaries; the latency is the plain mean of the providers' means."""
    return summary.agg(F.sum("total_tokens").alias("tokens"), F.sum("requests").alias("requests"), F.avg("avg_latency_ms").alias("avg_latency_ms"))


def backend_summary(calls: DataFrame, registered: DataFrame) -> DataFrame:
    """Calls, errors, nearest-rank percentiles and the last event of each backend, silent ones with zeros."""
    own = calls.filter(F.col("operation") == "tools/call")
    order = F.struct("at", "seq")
    last = F.max_by(F.struct("at", "ok", "error_type"), order)
    agg = own.groupBy("backend").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), last.alias("last"))
    agg = with_quantiles(agg, own, ["backend"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    got = agg.select("backend", "calls", "errors", "p50_ms", "p95_ms", F.col("last.at").alias("last_at"), F.when(~F.col("last.ok"), F.col("last.error_type")).alias("last_error"), auth_state(F.col("last.ok"), F.col("last.error_type")).alias("auth_state"))
    silent = registered.select("backend").distinct().join(got, "backend", "left_anti")
    none = silent.select("backend", F.lit(0).cast("long").alias("calls"), F.lit(0).cast("long").alias("errors"), *[F.lit(None).cast(t).alias(c) for c, t in (("p50_ms", "double"), ("p95_ms", "double"), ("last_at", got.schema["last_at"].dataType), ("last_error", "string"), ("auth_state", "string"))])
    return got.unionByName(none).orderBy("backend")


def model_comparison(usage: DataFrame, provider_id: str | None = None) -> DataFrame:
    means = [F.avg(c).alias(f"avg_{c}") for c in ("latency_ms", "time_to_first_token_ms", "tokens_per_second")]
    out = for_provider(usage, provider_id).groupBy("model_id").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum("total_tokens").alias("tokens"), F.sum("estimated_cost_usd").alias("cost_usd"), *means)
    return out.orderBy(F.desc("tokens"), "model_id")


def _usage_sums() -> list[Column]:
    return [F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), *[F.sum(f"{k}_tokens").alias(f"{k}_tokens") for k in ("input", "cached_input", "output", "reasoning")], F.sum("latency_ms").alias("latency_ms"), F.sum("output_bytes").alias("output_bytes"), F.count_if(F.col("status") == "failed").alias("failed_calls"), F.count_if(F.col("retry_count") > 0).alias("retried_calls"), F.max("memory_bytes").alias("peak_memory_bytes")]


def category_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("category").agg(*_usage_sums()).orderBy(F.desc("tokens"), F.desc("calls"), "category")


def scan_totals(events: DataFrame) -> DataFrame:
    return events.agg(*_usage_sums())


def backend_metrics(calls: DataFrame) -> DataFrame:
    """Calls, errors, total, maximum and mean duration, last call and tools by count, a row a backend."""
    tools = calls.groupBy("backend", "tool_name").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("e"), F.sum("duration_ms").alias("t"), F.max("duration_ms").alias("m"), F.max("at").alias("at"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("tool_name").alias("tool"), "n")))
    out = tools.groupBy("backend").agg(F.sum("n").alias("calls"), F.sum("e").alias("errors"), F.sum("t").alias("total_ms"), F.max("m").alias("max_ms"), F.max("at").alias("last_at"), ranked.alias("r"))
    return out.select("backend", "calls", "errors", "total_ms", "max_ms", F.round(F.col("total_ms") / F.col("calls"), 3).alias("avg_ms"), "last_at", F.transform("r", lambda x: F.struct(x["tool"].alias("tool"), x["n"].alias("count"))).alias("tools"))


def missing_evidence(events: DataFrame, samples: DataFrame, quotas: DataFrame) -> DataFrame:
    """A row a result class with the fields that no record supplies."""
    any_ = lambda df, *cs: df.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in cs])
    e = any_(events, *[(c, F.col(c).isNotNull()) for c in ("task_id", "experiment_id", "variant", "tool_execution_id")])
    s = any_(samples, ("cumulative_cpu_seconds", F.col("cumulative_cpu_seconds") > 0), ("sample_interval_seconds", F.col("sample_interval_seconds") > 0))
    q = any_(quotas, ("resets_at", F.col("resets_at").isNotNull()), ("metric", F.col("metric").isNotNull()))
    one = e.crossJoin(s).crossJoin(q)  # three single rows
    need = {"tool_tokens": ("task_id", "experiment_id", "variant", "tool_execution_id"), "wasted_tokens": ("task_id", "experiment_id", "variant"), "cpu_memory": ("tool_execution_id", "cumulative_cpu_seconds", "sample_interval_seconds"), "capacity": ("resets_at", "metric"), "savings": ("task_id", "experiment_id", "variant")}
    rows = F.array(*[F.struct(F.lit(k).alias("result"), F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in cs])).alias("missing")) for k, cs in need.items()])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def timing_summary(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, median of the middle two and nearest-rank 95th percentile, to 3 decimals."""
    n = samples.groupBy(*group).agg(F.count(value).alias("n"))
    out = with_quantiles(n, samples, group, value, {"p95": 0.95}, "median")
    return out.select(*group, "n", F.round("median", 3).alias("median"), F.round("p95", 3).alias("p95"))


def resource_integrals(samples: DataFrame) -> DataFrame:
    """CPU seconds, memory byte-seconds and peak memory of each process; a pid with another start is another process."""
    out = samples.groupBy("pid", "started_at_ms").agg((F.max("cumulative_cpu_seconds") - F.min("cumulative_cpu_seconds")).alias("cpu_seconds"), F.sum(F.col("resident_memory_bytes") * F.col("sample_interval_seconds")).alias("memory_byte_seconds"), F.max("resident_memory_bytes").alias("peak_memory_bytes"))
    return out


def matched_savings(runs: DataFrame, keys: list[str], value: str, base: str = "baseline", changed: str = "intervention") -> DataFrame:
    """Per key the mean baseline less the mean intervention of successful runs, then count, median and spread over keys."""
    by = runs.filter("success").groupBy(*keys).agg(*[F.avg(F.when(F.col("variant") == v, F.col(value))).alias(v) for v in (base, changed)])
    saved = by.filter(F.col(base).isNotNull() & F.col(changed).isNotNull()).select((F.col(base) - F.col(changed)).alias("saved"))
    one = saved.agg(F.count("*").alias("pairs"), F.avg("saved").alias("mean_saved"), F.stddev_samp("saved").alias("spread"))
    return with_quantiles(one, saved, [], "saved", median="median_saved").select("pairs", "mean_saved", "median_saved", "spread")


def experiment_gate(runs: DataFrame) -> DataFrame:
    """Mean score and hard-fail rate of both arms; it passes when the treatment is no worse on either and an oracle passed."""
    a = runs.agg(*[f(F.when(F.col("arm") == arm, c)).alias(f"{arm}_{n}") for arm in ("control", "treatment") for n, f, c in (("score", F.avg, F.col("score")), ("fail_rate", F.avg, F.col("hard_fail").cast("double")))], F.coalesce(F.bool_or((F.col("arm") == "treatment") & F.col("oracle")), F.lit(False)).alias("oracle_pass"))
    return a.withColumn("passes", (F.col("treatment_score") >= F.col("control_score")) & (F.col("treatment_fail_rate") <= F.col("control_fail_rate")) & F.col("oracle_pass"))


# ---- repeats, alerts, history ----


def exact_repeats(events: DataFrame) -> DataFrame:
    """Each later event with the first of its signature: an aggregate and a join, so a frequent signature is split."""
    first = events.groupBy("signature").agg(F.min_by("id", "seq").alias("first_id"), F.min("seq").alias("first_seq"))
    return events.join(first, "signature").filter(F.col("seq") > F.col("first_seq")).select("first_id", F.col("id").alias("later_id"), "category", F.col("total_tokens").alias("tokens_on_later"))


def failed_or_retried(events: DataFrame) -> DataFrame:
    return events.filter((F.col("status") == "failed") | (F.col("retry_count") > 0)).select("id", "category", "status", "retry_count", "total_tokens")


def observations(events: DataFrame) -> DataFrame:
    """Repeats and failures as one table."""
    a = exact_repeats(events).select(F.lit("exact-repeat").alias("type"), "category", F.array("first_id", "later_id").alias("event_ids"), F.col("tokens_on_later").alias("tokens"))
    b = failed_or_retried(events).select(F.lit("failed-or-retried").alias("type"), "category", F.array("id").alias("event_ids"), F.col("total_tokens").alias("tokens"))
    return a.unionByName(b)


def usage_alerts(usage: DataFrame, quotas: DataFrame, newest: int = 200, warn: float = 80.0, critical: float = 95.0) -> DataFrame:
    """Quota, context-pressure and failure alerts; events only among the newest."""
    level = lambda c: F.when(c >= critical, "critical").otherwise("warning")
    q = quotas.filter(F.col("utilization_percent") >= warn).select(F.lit("quota").alias("kind"), level(F.col("utilization_percent")).alias("severity"), F.col("id").alias("subject"), F.col("utilization_percent").alias("value"))
    late = retain_newest(usage, newest)
    use = F.col("context_utilization_percent")
    c = late.filter(use >= warn).select(F.lit("context").alias("kind"), level(use).alias("severity"), F.col("id").alias("subject"), use.alias("value"))
    f = late.filter(F.col("status") == "failed").select(F.lit("failure").alias("kind"), F.lit("warning").alias("severity"), F.col("id").alias("subject"), F.lit(None).cast("double").alias("value"))
    return q.unionByName(c).unionByName(f)


def health_history(probes: DataFrame) -> DataFrame:
    """ok, degraded (failed, once ok) or down; digest and version carry on from the last good probe."""
    past = W.partitionBy("target").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("target").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    state = F.when(F.col("ok"), "ok").when(F.coalesce(F.max("ok").over(past), F.lit(False)), "degraded").otherwise("down")
    carry = lambda c: F.last(F.when(F.col("ok"), F.col(c)), ignorenulls=True).over(upto)
    return probes.select("target", "seq", "ok", state.alias("state"), carry("digest").alias("digest"), carry("version").alias("version"))


# ---- joins ----


def session_detail(sessions: DataFrame, processes: DataFrame, usage: DataFrame) -> DataFrame:
    """Each session with totals of its processes and usage, summed before they are joined."""
    p = processes.groupBy("session_id").agg(F.count("*").alias("processes"), F.sum("cpu_percent").alias("cpu_percent"), F.sum("resident_memory_bytes").alias("memory_bytes"))
    u = usage.groupBy("session_id").agg(F.count("*").alias("events"), F.sum("total_tokens").alias("tokens"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("processes", "memory_bytes", "events", "tokens")} | {"cpu_percent": F.coalesce("cpu_percent", F.lit(0.0))}
    return sessions.join(p, "session_id", "left").join(u, "session_id", "left").withColumns(zero)


def attribute_backend(calls: DataFrame, backends: DataFrame, local: list[str]) -> DataFrame:
    """The backend of a tool name: known local names first, then the longest namespace followed by `_`, else local.

    A name's namespaces are its prefixes before each `_`, so this is an equi-join, not a prefix test of every pair.
    """
    names = calls.select("tool_name").distinct()
    parts = F.split("tool_name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    tried = names.select("tool_name", F.explode(F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))).alias("namespace"))
    best = tried.join(backends.select("namespace", F.col("backend").alias("b")), "namespace").groupBy("tool_name").agg(F.max_by("b", F.length("namespace")).alias("b"))
    out = calls.join(best, "tool_name", "left")
    return out.select(*calls.columns, F.when(F.col("tool_name").isin(local), "local").otherwise(F.coalesce("b", F.lit("local"))).alias("attributed"))


def resource_drain(processes: DataFrame, session_id=None, top: int = 10) -> DataFrame:
    """The top processes by CPU and by memory (a top-k report)."""
    own = for_session(processes, session_id)
    pick = lambda by: own.orderBy(F.desc(by), "pid").limit(top).select(F.lit(by).alias("by"), "pid", F.col(by).cast("double").alias("value"))
    return pick("cpu_percent").unionByName(pick("resident_memory_bytes"))


def hourly_usage(events: DataFrame, dims: list[str], ts: str = "ts") -> DataFrame:
    """Token sums in hours by the given dimensions; works on tables and streams."""
    return events.groupBy(F.window(ts, "1 hour").alias("w"), *dims).agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens")).select(F.col("w.start").alias("hour"), *dims, "requests", "tokens")
