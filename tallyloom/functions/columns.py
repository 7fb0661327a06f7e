"""Column functions shared by the operators: ids, digests, tokens, sizes, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered patterns that class a tool by its name and command; the first that matches wins.
TOOL_CLASSES = (
    ("compaction", r"(?i)compact|compaction"),
    ("web-search", r"(?i)web.?search|search_query|image_query"),
    ("mcp", r"(?i)(^|[\s._-])mcp([\s._-]|$)|model.?context.?protocol"),
    ("rg", r"(?i)(^|\s|/)(rg|ripgrep)(\s|$)"),
    ("tests", r"(?i)pytest|vitest|jest|playwright|cargo test|pnpm test|npm test|yarn test"),
    ("git", r"(?i)(^|\s)git(\s|$)"),
    ("file-read", r"(?i)read_file|fetch_file|cat\s|sed\s+-n|head\s|tail\s"),
    ("file-write", r"(?i)write_file|apply_patch|update_file|create_file"),
    ("bash", r"(?i)bash|shell|terminal|exec|command_execution"),
)


def classify_tool(tool: Column, command: Column, explicit: Column | None = None) -> Column:
    """An explicit category wins, then the first matching class, then other-tool, or model without a tool."""
    name, cmd = F.coalesce(tool, F.lit("")), F.coalesce(command, F.lit(""))
    text = F.concat(name, F.lit(" "), cmd)
    out = F.when(F.lit(False), F.lit(""))
    for label, pattern in TOOL_CLASSES:
        out = out.when(text.rlike(pattern), F.lit(label))
    found = out.otherwise(F.when(name != "", F.lit("other-tool")).otherwise(F.lit("model")))
    return found if explicit is None else F.coalesce(explicit, found)


def stable_id(*parts: Column, length: int = 24, sep: str = ":") -> Column:
    """The first `length` hex digits of the SHA-256 of the parts, joined; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def parse_size(text: Column) -> Column:
    """`200k`, `1.5M`, `2g` or a plain number as a long; null for other text."""
    n = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmg]?)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmg]?)\s*$", 2))
    scale = F.when(unit == "k", 1_000.0).when(unit == "m", 1_000_000.0).when(unit == "g", 1_000_000_000.0).otherwise(1.0)
    return F.when(n != "", F.round(n.cast("double") * scale).cast("long"))


def auth_state(ok: Column, error_type: Column) -> Column:
    """ok, auth_error when the error's type speaks of auth, else error."""
    return F.when(ok, "ok").when(F.lower(F.coalesce(error_type, F.lit(""))).contains("auth"), "auth_error").otherwise("error")


def redact_command(command: Column) -> Column:
    """An argument array as its program and the number of hidden arguments."""
    n = F.size(command)
    return F.when(n <= 0, F.lit("")).when(n == 1, F.element_at(command, 1)).otherwise(F.concat(F.element_at(command, 1), F.lit(" [+"), (n - 1).cast("string"), F.lit(" args]")))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up, one at least."""
    return F.greatest(F.ceil(F.octet_length(text) / 4), F.lit(1)).cast("long")


def clamp(text: Column, characters: int) -> Column:
    return F.substring(text, 1, characters)


def utf8_prefix(text: Column, size: int) -> Column:
    """The longest prefix of at most `size` bytes that ends at a code point."""
    raw = F.substring(text.cast("binary"), 1, size)
    # a cut code point leaves 1 to 3 bytes of it: the longest valid prefix is one of four
    tries = [F.try_validate_utf8(F.substring(text.cast("binary"), 1, size - k)) for k in range(1, 4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(F.try_validate_utf8(raw), *tries))


def normalize_identity(text: Column) -> Column:
    """Folded case, `_` and `-` as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "_-", "  "), r"\s+", " "))


def normalize_package(name: Column) -> Column:
    """Folded case without `-`, `_` and `.`."""
    return F.regexp_replace(F.lower(name), "[-_.]", "")


def query_tokens(text: Column) -> Column:
    """Runs of letters, digits, `_`, `$` and `@`, folded."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_$@]+)"), 1)


def match_terms(text: Column, mode: str = "all") -> Column:
    """struct<terms array<struct<term, prefix>>, mode>: the last term is a prefix when the text ends in a token."""
    toks = query_tokens(text)
    open_end = text.rlike(r"[\p{L}\p{N}_$@]$")
    plain = F.transform(toks, lambda t: F.struct(t.alias("term"), F.lit(False).alias("prefix")))
    # only the last term is touched, so that the tokens aren't counted anew for each of them
    last = F.array(F.struct(F.element_at(toks, -1).alias("term"), F.lit(True).alias("prefix")))
    terms = F.when(open_end & (F.size(toks) > 0), F.concat(F.slice(plain, 1, F.greatest(F.size(toks) - 1, F.lit(0))), last)).otherwise(plain)
    return F.struct(terms.alias("terms"), F.lit(mode).alias("mode"))


#: Words that say nothing about an objective.
STOP_WORDS = ("and", "are", "but", "for", "from", "has", "have", "how", "into", "its", "not", "our", "that", "the", "their", "them", "then", "there", "this", "use", "was", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your")


def context_terms(text: Column, most: int = 24, extra: str = "_", stop: tuple = STOP_WORDS) -> Column:
    """The first distinct terms of three letters or more without stop words; `extra`: characters allowed besides letters and digits."""
    toks = F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}{extra}]+")
    kept = F.filter(toks, lambda t: F.length(t) >= 3)
    return F.slice(F.array_distinct(F.array_except(kept, F.array(*[F.lit(s) for s in stop]))), 1, most)


def excerpt(text: Column, query: Column, context: int = 2, most: int = 400) -> Column:
    """The first line that holds the query, with lines around it, capped in characters; null without a hit."""
    lines = F.split(text, "\n")
    hits = F.transform(lines, lambda x: F.contains(x, query))
    at = F.array_position(hits, True)
    first = F.greatest(at - context, F.lit(1))
    part = F.slice(lines, first.cast("int"), (at + context - first + 1).cast("int"))
    return F.when(at > 0, F.substring(F.array_join(part, "\n"), 1, most))


def evidence_id(evidence: Column) -> Column:
    """Digest of a struct's canonical JSON; list its fields by name."""
    return F.sha2(F.to_json(evidence), 256)


def derive_confidence(source: Column, derived: Column) -> Column:
    return F.least(source, derived)


def relation_state(outcome: Column) -> Column:
    """struct<status, confidence> by outcome; other outcomes are candidates."""
    status = F.when(outcome == "resolved", "resolved").when(outcome == "partial", "partial").otherwise("candidate")
    score = F.when(outcome == "resolved", 1.0).when(outcome == "partial", 0.75).otherwise(0.5)
    return F.struct(status.alias("status"), score.alias("confidence"))
