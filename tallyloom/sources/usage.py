"""Usage exports, transcripts and bucket reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import stable_id
from tallyloom.functions.paths import VENDORED


def read_usage(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, record VARIANT): a row a line of .jsonl and .ndjson, a row a file of .json, below the paths and outside vendored folders."""

    def read(glob: str, whole: bool) -> DataFrame:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", whole).text(paths)
        return df.select(F.col("_metadata.file_path").alias("source"), F.col("value"))

    lines = read("*.{jsonl,ndjson}", False).filter(F.trim("value") != "")
    every = lines.unionByName(read("*.json", True))
    own = ~F.arrays_overlap(F.split("source", "/"), F.array(*[F.lit(v) for v in VENDORED]))
    return every.filter(own).select("source", F.try_parse_json("value").alias("record")).filter(F.col("record").isNotNull())


def _has(*names: str):
    out = F.lit(False)
    for n in names:
        out = out | F.expr(f"try_variant_get(record, '$.{n}') IS NOT NULL")
    return out


def split_records(df: DataFrame) -> dict[str, DataFrame]:
    """Events, process samples and quotas: from the arrays of a document, or a bare object classed by its fields in that order."""
    listed = {"events": ("events", "usageEvents"), "samples": ("processSamples", "processes"), "quotas": ("quotas",)}
    usage, sample, quota = _has("usage", "inputTokens", "toolName", "tool_name", "response.usage", "message.usage"), _has("pid", "cpuPercent", "residentMemoryBytes"), _has("metric", "utilizationPercent", "limit")
    arrays = _has(*[n for ns in listed.values() for n in ns])
    kind = F.when(arrays, F.lit(None).cast("string")).when(usage, "events").when(sample, "samples").when(quota, "quotas")
    out = {}
    for name, fields in listed.items():
        bare = df.filter(kind == name).select("source", "record")
        for f in fields:
            items = df.select("source", F.expr(f"try_variant_get(record, '$.{f}', 'array<variant>')").alias("a"))
            bare = bare.unionByName(items.select("source", F.explode("a").alias("record")))
        out[name] = bare
    return out


def import_transcripts(df: DataFrame, sniff: int = 20) -> DataFrame:
    """Lines of transcripts (file, line_no, record VARIANT) as usage rows, by the dialect that a file's first records show.

    In dialect `turns`, turn totals carry the tokens and item events none; in dialect `results`, result records
    carry cost and latency. Other record types are left out.
    """
    kind = F.expr("try_variant_get(record, '$.type', 'string')")
    head = df.filter(F.col("line_no") <= sniff).groupBy("file").agg(F.bool_or(kind.startswith("turn.") | kind.startswith("thread.")).alias("t"), F.bool_or(kind.isin("result", "assistant")).alias("r"))
    dialect = head.select("file", F.when(F.col("t"), "turns").when(F.col("r"), "results").alias("dialect")).filter(F.col("dialect").isNotNull())
    j = df.join(dialect, "file").withColumn("type", kind)
    turn = (F.col("dialect") == "turns") & (F.col("type").isin("turn.completed", "turn.failed") | F.col("type").startswith("item."))
    result = (F.col("dialect") == "results") & F.col("type").isin("result", "assistant")
    get = lambda p, t="long": F.expr(f"try_variant_get(record, '$.{p}', '{t}')")
    tokens = F.col("type").isin("turn.completed", "turn.failed", "assistant")
    usage = lambda n: F.when(tokens, F.coalesce(get(f"usage.{n}"), get(f"message.usage.{n}"), F.lit(0)))
    return j.filter(turn | result).select("file", "line_no", "dialect", "type", usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), F.when(F.col("type") == "result", get("total_cost_usd", "double")).alias("cost_usd"), F.when(F.col("type") == "result", get("duration_ms", "double")).alias("latency_ms"))


def flatten_bucket_report(df: DataFrame, dialect: str) -> DataFrame:
    """A row a (bucket, result) of a provider's report, with a stable id; buckets without results give no rows.

    `completions`: input and output; `messages`: input, cached reads, cache writes and output all count in the total.
    """
    b = df.select(F.explode("data").alias("b")).select("b.start_time", "b.end_time", F.explode("b.results").alias("r"))
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long")
    total = zero("input") + zero("output")
    if dialect == "messages":
        total = total + zero("cached") + zero("cache_write")
    dims = [F.col(f"r.{c}") for c in ("model", "project", "key")]
    return b.select(stable_id(F.lit(dialect), F.col("start_time"), *dims, sep="|").alias("id"), F.col("start_time").alias("occurred_at"), *[d.alias(n) for d, n in zip(dims, ("model_id", "project", "key"))], zero("input").alias("input_tokens"), zero("cached").alias("cached_input_tokens"), zero("output").alias("output_tokens"), zero("requests").alias("requests"), total.alias("total_tokens"))
