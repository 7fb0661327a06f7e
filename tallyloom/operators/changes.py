"""Snapshots and change sets, pages, caps, budgets, fingerprints, chains."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import stable_id


def in_scope(path: Column, prefixes: list[str]) -> Column:
    """Equal to one of the prefixes or below it at a `/`; no prefixes: everything."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p + "/")
    return out


def diff_snapshots(old: DataFrame, new: DataFrame, generation: str) -> DataFrame:
    """path, operation, previous and current digest, change id."""
    a, b = old.select("path", F.col("digest").alias("previous")), new.select("path", F.col("digest").alias("current"))
    j = a.join(b, "path", "full_outer").filter(~F.col("previous").eqNullSafe(F.col("current")))
    op = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "deleted").otherwise("changed")
    return j.select("path", op.alias("operation"), "previous", "current", stable_id(F.lit(generation), F.col("path"), op, F.col("previous"), F.col("current")).alias("change_id"))


def apply_changes(old_facts: DataFrame, new_facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts of unchanged paths stay, those of changed and added paths are new, those of deleted ones go."""
    touched = changes.select("path", "operation")
    kept = old_facts.join(touched, "path", "left_anti")
    fresh = new_facts.join(touched.filter(F.col("operation") != "deleted").select("path"), "path", "left_semi")
    return kept.unionByName(fresh)


def fingerprint_digits(n: int, rows: int) -> int:
    """Digits of the first level's prefixes for n lines: 2, 4, and so on."""
    digits = 2
    while 16**digits * rows < n:
        digits += 2
    return digits


def fingerprint(files: DataFrame, group: list[str] | None = None, rows: int = 10_000) -> DataFrame:
    """A digest of the set of (path, digest), whatever the order.

    Lines are digested by prefixes of the path's MD5, so many that each holds about `rows` lines; the digests then by
    prefixes shorter by two, so that none but the last lists holds more than 256 of them.
    """
    keys = group or []
    digits = fingerprint_digits(files.count(), rows)
    level = files.select(*keys, F.md5("path").alias("k"), F.concat_ws("\x00", "path", "digest").alias("x"))
    for d in range(digits, -1, -2):
        level = level.groupBy(*keys, F.substring("k", 1, d).alias("k")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("x"))
    return level.select(*keys, F.col("x").alias("fingerprint"))


def coverage(rows: DataFrame, keys: list[str], reasons: int = 5) -> DataFrame:
    """Counts of candidates and resolved rows, a status by priority, and a bounded list of reasons with a summary entry."""
    a = rows.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if("resolved").alias("resolved"), F.bool_or("changed").alias("c"), F.bool_or("truncated").alias("t"), F.bool_or("unsupported").alias("u"), F.array_sort(F.collect_set("reason")).alias("r"))
    status = F.when(F.col("c"), "changed").when(F.col("t"), "truncated").when(F.col("u"), "unsupported").when(F.col("resolved") < F.col("candidates"), "partial").otherwise("complete")
    more = F.size("r") - reasons
    listed = F.when(more > 0, F.concat(F.slice("r", 1, reasons), F.array(F.concat(F.lit("and "), more.cast("string"), F.lit(" more"))))).otherwise(F.col("r"))
    return a.select(*keys, "candidates", "resolved", status.alias("status"), listed.alias("reasons"))


def cap_rows(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """At most n rows a group, in order, with whether the group had more (the cap is the feature)."""
    w = W.partitionBy(group)
    return df.withColumn("__r", F.row_number().over(w.orderBy(*order))).filter(F.col("__r") <= n + 1).withColumn("truncated", F.max("__r").over(w) > n).filter(F.col("__r") <= n).drop("__r")


def keyset_page(df: DataFrame, key: str, after=None, limit: int = 100) -> DataFrame:
    """The next page by key, with has_more; rows with a tombstone are hidden."""
    live = df.filter(F.col("tombstoned_at_ms").isNull()) if "tombstoned_at_ms" in df.columns else df
    page = (live if after is None else live.filter(F.col(key) > after)).orderBy(key).limit(limit + 1)
    n = F.count("*").over(W.partitionBy())
    return page.withColumn("has_more", n > limit).withColumn("__r", F.row_number().over(W.partitionBy().orderBy(key))).filter(F.col("__r") <= limit).drop("__r")


def query_facts(df: DataFrame, kinds: list[str] | None = None, tables: list[str] | None = None, prefixes: list[str] | None = None, policies: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Conjunctive filters in the order of row_key; with a limit, one page and has_more."""
    for c, v in (("kind", kinds), ("table_name", tables), ("policy_id", policies)):
        if v:
            df = df.filter(F.col(c).isin(v))
    df = df.filter(in_scope(F.col("path"), prefixes or [])).orderBy("row_key")
    if limit is None:
        return df.withColumn("has_more", F.lit(False))
    page = df.offset(offset).limit(limit + 1)
    w = W.partitionBy()
    return page.withColumns({"has_more": F.count("*").over(w) > limit, "__r": F.row_number().over(w.orderBy("row_key"))}).filter(F.col("__r") <= limit).drop("__r")


def domain_counts(entries: DataFrame, domains: DataFrame) -> DataFrame:
    n = entries.groupBy("domain").agg(F.count("*").alias("n"))
    return domains.join(n, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))


def languages(files: DataFrame) -> DataFrame:
    return files.select("language").filter(F.col("language").isNotNull()).distinct().orderBy("language")


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def integrity(children: DataFrame, parents: DataFrame, ref: str, key: str) -> DataFrame:
    """Rows, references that point nowhere, and whether there are none."""
    lost = children.filter(F.col(ref).isNotNull()).join(parents.select(F.col(key).alias(ref)).distinct(), ref, "left_anti").agg(F.count("*").alias("dangling"))
    return children.agg(F.count("*").alias("rows")).crossJoin(lost).withColumn("sound", F.col("dangling") == 0)


def verify_chain(log: DataFrame, event_hash: Column | None = None) -> DataFrame:
    """Rows of a hash chain that don't hold: previous hash, payload hash or event hash.

    The prior row comes by a join on sequence - 1 (sequences are dense), not by one window over the whole log.
    """
    if event_hash is None:
        event_hash = F.sha2(F.concat_ws("|", F.coalesce("previous_event_hash", F.lit("")), "payload_hash", "sequence"), 256)
    prior = log.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("prior_hash"))
    first = log.agg(F.min("sequence").alias("first"))
    j = log.withColumn("expected", event_hash).join(prior, "sequence", "left").crossJoin(first)
    link = F.when(F.col("sequence") == F.col("first"), F.col("previous_event_hash").isNull()).otherwise(F.coalesce(F.col("previous_event_hash") == F.col("prior_hash"), F.lit(False)))
    out = j.select("sequence", link.alias("link_ok"), (F.col("payload_hash") == F.sha2("payload", 256)).alias("payload_ok"), (F.col("event_hash") == F.col("expected")).alias("event_ok"))
    return out.filter(~(F.col("link_ok") & F.col("payload_ok") & F.col("event_ok")))


def next_ordinal(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """max + 1 over live turns of each session, 0 for a session without any."""
    live = turns.filter(F.col("tombstoned_at_ms").isNull()) if "tombstoned_at_ms" in turns.columns else turns
    m = live.groupBy("session_id").agg(F.max("ordinal").alias("m"))
    return sessions.join(m, "session_id", "left").select("session_id", (F.coalesce("m", F.lit(-1)) + 1).cast("long").alias("next_ordinal"))


def fit_budget(items: DataFrame, max_bytes: int, max_tokens: int, overhead: int = 0, packet: str = "packet") -> DataFrame:
    """The longest prefix of each packet, by (section_rank, rank), within bytes and tokens; a packet's first item always stays."""
    w = W.partitionBy(packet).orderBy("section_rank", "rank")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    size = F.sum("bytes").over(upto) + overhead
    out = items.withColumns({"__b": size, "__n": F.row_number().over(w)})
    return out.filter((F.col("__n") == 1) | ((F.col("__b") <= max_bytes) & (F.ceil(F.col("__b") / 4) <= max_tokens))).drop("__b", "__n")


def select_facts(rows: DataFrame, limit: int, group: str = "query") -> DataFrame:
    """The best of each section first, in the sections' order, then the rest by rank, up to the limit."""
    first = F.row_number().over(W.partitionBy(group, "section").orderBy("rank")) == 1
    order = F.row_number().over(W.partitionBy(group).orderBy(F.when(F.col("first"), 0).otherwise(1), F.when(F.col("first"), F.col("section_rank")), "rank"))
    return rows.withColumn("first", first).withColumn("position", order).filter(F.col("position") <= limit)


def select_by_seed(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows with one of the seed keys, and the rows of the projects of dependency and relation seeds; each once."""
    hit = rows.select("row_key", "project_id", F.explode("seed_keys").alias("seed")).join(seeds.select("seed", "kind"), "seed")
    own = hit.select("row_key")
    projects = hit.filter(F.col("kind").isin("dependency", "relation")).select("project_id").distinct()
    more = rows.join(projects, "project_id", "left_semi").select("row_key")
    return rows.join(own.unionByName(more).distinct(), "row_key", "left_semi")


def locate_offsets(offsets: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk that holds a byte offset, with 1-based line and column of the offset."""
    c = chunks.select(F.col("path").alias("p2"), "chunk_id", "byte_start", "byte_end", "start_line", "text")
    j = offsets.join(c, (offsets["path"] == c["p2"]) & (F.col("byte_offset") >= F.col("byte_start")) & (F.col("byte_offset") < F.greatest(F.col("byte_end"), F.col("byte_start") + 1)))
    before = F.decode(F.substring(F.encode("text", "UTF-8"), F.lit(1), (F.col("byte_offset") - F.col("byte_start")).cast("int")), "ISO-8859-1")
    lines = F.length(before) - F.length(F.translate(before, "\n", ""))
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    best = j.select("path", "byte_offset", "chunk_id", (F.col("start_line") + lines).alias("line"), column.alias("column"), "byte_start")
    return best.groupBy("path", "byte_offset").agg(F.min_by(F.struct("chunk_id", "line", "column"), "byte_start").alias("x")).select("path", "byte_offset", "x.*")


def snapshot_match(artifacts: DataFrame, snapshot: dict[str, str]) -> DataFrame:
    """True when each id an artifact declares is the snapshot's, false when one differs, null when it declares none."""
    ids = list(snapshot)
    differs, declares = F.lit(False), F.lit(False)
    for c in ids:
        differs = differs | F.coalesce(F.col(c) != snapshot[c], F.lit(False))
        declares = declares | F.col(c).isNotNull()
    return artifacts.withColumn("matches", F.when(declares, ~differs))


#: Symbols in one automaton; a larger table is cut by hash, with a pass over the texts for each part.
AUTOMATON = 200_000


def _finder(symbols: list[str]):
    """Runs one automaton of all symbols over each text once."""

    def find(batches):
        machine = ahocorasick.Automaton()
        for s in symbols:
            machine.add_word(s, s)
        machine.make_automaton()
        for batch in batches:
            paths, names, lines = [], [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                first: dict[str, int] = {}
                for end, s in machine.iter(text):
                    first.setdefault(s, end - len(s) + 1)
                at = line = 0
                for s, start in sorted(first.items(), key=lambda x: x[1]):
                    line += text.count("\n", at, start)
                    at = start
                    paths.append(path)
                    names.append(s)
                    lines.append(line + 1)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(lines, pa.int32())], ["path", "symbol", "line"])

    return find


def text_consumers(files: DataFrame, symbols: DataFrame, sources: DataFrame, max_bytes: int | None = None, symbols_most: int | None = None, most: int | None = None, part: int = AUTOMATON) -> DataFrame:
    """Other files that hold a symbol of three letters or more, with the symbol's first line. The caps are off unless given.

    All symbols are found in one pass over each text; at most about `part` of them are in memory at a time.
    """
    small = (files if max_bytes is None else files.filter(F.octet_length("text") <= max_bytes)).filter(F.col("text").isNotNull()).join(sources.select("path"), "path", "left_anti")
    names = symbols.filter(F.length("symbol") >= 3).select("symbol").distinct()
    names = names if symbols_most is None else names.orderBy("symbol").limit(symbols_most)
    n = names.count()
    parts = -(-n // part) or 1
    found = None
    for k in range(parts):
        own = names if parts == 1 else names.filter(F.pmod(F.xxhash64("symbol"), F.lit(parts)) == k)
        got = small.select("path", "text").mapInArrow(_finder(sorted(r[0] for r in own.collect())), "path string, symbol string, line int")
        found = got if found is None else found.unionByName(got)
    return found if most is None else found.orderBy("path", "symbol").limit(most)


def token_star_edges(rows: DataFrame) -> DataFrame:
    """Members of each shared token as a star from the smallest; n - 1 edges for n members."""
    t = rows.select("row_key", F.explode(F.array_distinct("tokens")).alias("token"))
    low = t.groupBy("token").agg(F.min("row_key").alias("anchor"))
    return t.join(low, "token").filter("row_key <> anchor").select("anchor", "row_key").distinct()


def relation_tokens(*fields: Column) -> Column:
    """Folded identity fields without nulls and repeats."""
    return F.array_distinct(F.array_compact(F.array(*[F.lower(f) for f in fields])))


def detect(files: DataFrame, dependencies: DataFrame, rules: DataFrame) -> DataFrame:
    """Suggestions of which a listed file or dependency is present, in catalog order."""
    by_file = rules.select("rule_no", "suggestion", F.explode("files").alias("path")).join(files.select("path"), "path", "left_semi")
    by_dep = rules.select("rule_no", "suggestion", F.explode("dependencies").alias("name")).join(dependencies.select("name"), "name", "left_semi")
    return by_file.select("rule_no", "suggestion").unionByName(by_dep.select("rule_no", "suggestion")).distinct().orderBy("rule_no")


def governance_edges(*parts: DataFrame, limit: int | None = None) -> DataFrame:
    """The union of edge tables, one row an id, in order; with a limit, omitted = how many didn't fit."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cols = [c for c in out.columns if c != "id"]
    one = out.groupBy("id").agg(F.min(F.struct(*cols)).alias("x")).select("id", "x.*").orderBy("id")
    if limit is None:
        return one.withColumn("omitted", F.lit(0).cast("long"))
    total = one.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))
    return one.limit(limit).crossJoin(total)
