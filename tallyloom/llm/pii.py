"""Personal data by candidate gradient boosting.

1. Generators run over every whole text and propose spans: the four base kinds by their patterns, whether
   their checks hold or not, and wider forms (spelled-out or bracketed email addresses, IPs with bracketed
   dots, card numbers with other separators, phone numbers without a plus, and secrets: assigned or free-standing
   keys). Proposals may overlap.
2. Each proposal gets features of its format (digits, separators, groups, Luhn's sum, entropy) and of its context
   (neighbouring characters, words that speak for or against it, currency signs). Whether the base check holds is no
   feature.
3. Weak labels: a proposal in a context that speaks against it (an order number, a version, a price, a part of a longer
   name), or of a form that can't be its kind, is labelled 0 even where its base check holds; one of right form is
   labelled 1 if it is a base match or if a word speaks for it. Wider forms that can't be their kind are examples only. Right forms of the wider generators without such a
   word have no label: the trees decide. Each base match that passes adds a corrupted twin labelled 0.
   Boosted trees are fitted on at most TRAIN labelled proposals (a documented bound: the first in hash order of each kind
   and label, half of them and TRAIN / (2 * kinds) at most).
4. All labelled proposals outside the fit are scored and counted by kind and score in BINS steps. Isotonic regression
   of these counts calibrates scores to probabilities; a kind's threshold is the lowest score whose
   probability is PRECISION. A kind that has no such proposals takes the threshold of all kinds together.
Base spans that pass their checks always stand; the trees add proposals above the threshold that do not
overlap them, the better one first where they overlap each other, and reject the others.

Defined cases: a null or empty text has no spans. Rows that agree in doc_id and text get the same result each.
A text may be of any length: every pattern is linear (possessive or bounded). Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, sliced

KINDS = ("email", "ip", "card", "phone")
#: With the kind that has no base pattern; its spans are reported apart.
ALL_KINDS = (*KINDS, "secret")
TRAIN = 5000
PRECISION = 0.95
BINS = 10_000
TREES, DEPTH = 20, 4

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WIDE = (
    ("email", re.compile(r"(?i)(?<![\w.+-])[\w.+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\})\s?[a-z0-9-]{1,63}(?:(?:\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\sdot\s|\.)[a-z0-9-]{2,63}){1,4}")),
    ("email", re.compile(r"(?i)(?<![\w.+-])[\w.+-]{1,64}(?:\sat\s|@)[a-z0-9-]{1,63}(?:(?:\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\sdot\s)[a-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[({]?(?:\.|dot)[\])}]?\s?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[\x20._/-]{1,2}[0-9]{6}[\x20._/-]{1,2}[0-9]{5}(?![0-9])")),
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d|auth|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?([a-z0-9/+_.=-]{8,}+)")),
    ("secret", re.compile(r"(?<![\w/+.=:-])([A-Za-z0-9_-]{20,}+)(?![/.:@])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
)
# Words that speak for a kind, and contexts that speak against any.
_CUES = {"email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "address", "ping"), "card": ("card", "visa", "credit", "master", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile", "cell"), "secret": ("token", "secret", "key", "passw", "auth", "credential")}
_AGAINST = re.compile(r"(?i)\b(?:version|ver|release|isbn|issn|doi|order|invoice|serial|ref|part|page|chapter|section|row|item|id|no|nr|sku|build|article|case|commit|hash|checksum|sha1|sha256|md5)\b[\s.:#=]{0,3}$|\bv$")
_MONEY = re.compile(r"[$€£¥%]")
FEATURES = (*ALL_KINDS, "length", "digits", "digit_share", "separators", "kinds_of_separator", "luhn", "most_in_group", "groups", "longest_group", "starts_plus", "letters", "same_digit", "entropy", "letter_before", "letter_after", "digit_before", "digit_after", "joined_before", "joined_after", "cue", "against", "money", "first_digit", "dots", "at_sign", "words")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """The base check of a span that has its kind's base pattern."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d) if kind == "card" else 10 <= len(d) <= 15


def _emails(text: str):
    """Leftmost matches: the part before each @ is all of its run, or what the last match left of it."""
    at, done = text.find("@"), 0
    while at >= 0:
        run = text[done:at]
        start = done + len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_matches(text: str):
    """(kind, start, end, passes): matches of the base patterns."""
    if not _ANY.search(text):
        return
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e, True
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end(), valid(kind, m[0])


def _normal(kind: str, s: str) -> str:
    if kind == "email":
        s = re.sub(r"(?i)\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?", ".", re.sub(r"(?i)\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?", "@", s, count=1))
        return re.sub(r"\s", "", s)
    return re.sub(r"\s?[\[({]?(?:\.|dot)[\])}]?\s?", ".", s) if kind == "ip" else s


def well_formed(kind: str, s: str) -> bool:
    """Whether a span, written plainly, has its kind's form."""
    n = _normal(kind, s)
    if kind == "email":
        return next(((a, b) == (0, len(n)) for a, b in _emails(n)), False)
    if kind == "ip":
        return bool(_IP.fullmatch(n)) and valid(kind, n)
    if kind == "secret":
        return len(s) >= 16 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _entropy(s) > 2.5
    return valid(kind, n)


def _entropy(s: str) -> float:
    """Bits a character, of the first 400."""
    n = Counter(s[:400])
    total = sum(n.values())
    return -sum(k / total * math.log2(k / total) for k in n.values())


def features(kind: str, s: str, before: str, after: str) -> list[float]:
    d = _digits(s)
    sep = [c for c in s if not c.isalnum()]
    groups = re.findall("[0-9]+", s)
    most = max((int(g[:6]) for g in groups), default=0)
    near = (before + " " + after).lower()
    b, a = before[-1:], after[:1]
    same = max(Counter(d).values()) / len(d) if d else 0.0
    return [*(float(kind == k) for k in ALL_KINDS), min(len(s), 400), len(d), len(d) / len(s), len(sep), len(set(sep)), luhn(d), min(most, 99999), len(groups), max(map(len, groups), default=0), s[0] == "+", sum(c.isalpha() for c in s), same, _entropy(s), b.isalpha(), a.isalpha(), b.isdigit(), a.isdigit(), b in "_-./#=", a in "_-/#=", any(c in near for c in _CUES[kind]), bool(_AGAINST.search(before)), bool(_MONEY.search(before[-2:] + after[:2])), float(d[:1] or -1), s.count("."), s.count("@"), len(s.split())]


def against(kind: str, before: str, after: str) -> bool:
    """Whether the context speaks against a span of this kind."""
    b, a = before[-1:], after[:1]
    glued = kind != "email" and (b.isalnum() or a.isalnum() or b == "_" or a == "_")
    return glued or bool(_AGAINST.search(before)) or bool(_MONEY.search(before[-2:] + after[:2]))


def weak_label(kind: str, s: str, before: str, after: str, base: bool) -> int | None:
    if against(kind, before, after) or not well_formed(kind, s):
        return 0
    near = (before + " " + after).lower()
    return 1 if base or any(c in near for c in _CUES[kind]) else None


def _twin(kind: str, s: str) -> str:
    """A span like s that has not its kind's form."""
    if kind == "email":
        return s.partition("@")[0] + "@" + s.partition("@")[2].replace(".", "")
    if kind == "ip":
        return str(300 + len(s)) + s[s.index(".") :]
    if kind == "card":
        return s[:-1] + str((int(s[-1]) + 1) % 10)
    return s[: max(3, len(s) // 2)]


def candidates(text: str):
    """(kind, start, end, base, label, features): label None where the trees decide; examples that are no proposals have start -1."""
    seen = set()
    around = lambda s, e: (text[max(0, s - 40) : s], text[e : e + 20])
    for kind, s, e, ok in base_matches(text):
        seen.add((kind, s, e))
        span, (before, after) = text[s:e], around(s, e)
        digits = len(_digits(span))
        if not ok and (kind == "card" and digits < 12 or kind == "phone" and digits < 7):
            continue
        yield kind, s, e, ok, weak_label(kind, span, before, after, True), features(kind, span, before, after)
        if ok:
            yield kind, -1, -1, False, 0, features(kind, _twin(kind, span), before, after)
    low = text.lower()
    some_digit = bool(_ANY.search(text))
    for kind, pattern in _WIDE:
        if not (some_digit if kind != "email" else "dot" in low or "at)" in low or "at]" in low or "at}" in low):
            continue
        for m in pattern.finditer(text):
            s, e = m.span(pattern.groups)  # of a secret, what is assigned
            if (kind, s, e) not in seen and (kind != "secret" or any(c.isdigit() for c in text[s:e])):
                seen.add((kind, s, e))
                span, (before, after) = text[s:e], around(s, e)
                # what has not its kind's form is an example to learn from, no proposal
                place = (s, e) if well_formed(kind, span) else (-1, -1)
                yield kind, *place, False, weak_label(kind, span, before, after, False), features(kind, span, before, after)


def _extract(batches):
    for batch in sliced(batches):
        ids, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
        rows = [(d, h, *c) for d, h, t in zip(ids, hashes, batch.column("text").to_pylist()) if t for c in candidates(t)]
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.float64()))
        names = ("doc_id", "th", "kind", "start", "end", "base", "label", "f")
        data = [list(c) for c in cols]
        data[7] = [[float(x) for x in f] for f in data[7]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, kinds)], list(names))


def propose(docs: DataFrame) -> DataFrame:
    """All proposals of all texts; th = xxhash64(text)."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_extract, "doc_id long, th long, kind string, start int, end int, base boolean, label int, f array<double>")


def _split(found: DataFrame, train: int) -> tuple[DataFrame, DataFrame]:
    """(rows to fit, rows outside the fit) of the labelled proposals: of each kind and label the first of its distinct
    hashes fit, half of them and train // 8 at most."""
    most, group = max(1, train // (2 * len(ALL_KINDS))), ["kind", "label"]
    rows = found.filter("label is not null").withColumn("h", F.xxhash64("doc_id", "th", "kind", "start", "end", "label", "f"))
    own = {(r.kind, r.label): r.n for r in rows.groupBy(*group).agg(F.countDistinct("h").alias("n")).collect()}
    if not own:
        return rows, rows
    of = lambda values: F.create_map(*[F.lit(x) for (k, y), v in values.items() for x in (f"{k} {y}", v)])[F.concat_ws(" ", *group)]
    few = {k: min(most, (n + 1) // 2) for k, n in own.items()}
    # hashes are even over 64 bits: few of a large group's rows lie below the bound, and twice those wanted do
    low = of({k: min(2**63 - 1, 2 * few[k] * 2**64 // n - 2**63) for k, n in own.items()})
    low = rows.filter(F.col("h") <= low).dropDuplicates([*group, "h"]).withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("h")))
    sample = materialize(low.filter(F.col("r") <= of(few)).drop("r"))
    last = {(r.kind, r.label): r.h for r in sample.groupBy(*group).agg(F.max("h").alias("h")).collect()}
    return sample, rows.filter(F.col("h") > F.coalesce(of(last), F.lit(-(2**63))))


def _bin():
    return F.floor(vector_to_array("probability")[1] * BINS).cast("int")


def calibrated(bins: list[tuple[int, int, int]]) -> list[tuple[int, float]]:
    """(bin, probability) by isotonic regression: neighbouring bins are pooled until the share of right ones rises. bins: (bin, rows, right ones)."""
    pools: list[list] = []
    for b, n, right in sorted(bins):
        pools.append([b, n, right])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, right = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += right
    return [(b, right / n) for b, n, right in pools]


def _least(bins: list[tuple[int, int, int]]) -> int | None:
    """The lowest bin whose calibrated probability is PRECISION."""
    return next((b for b, p in calibrated(bins) if p >= PRECISION), None)


def fit(found: DataFrame, train: int = TRAIN):
    """(model, least bin by kind), or (None, {}) where nothing can be learned. found: materialized proposals."""
    sample, outside = _split(found, train)
    if sample.select("label").distinct().count() < 2:
        return None, {}
    as_rows = lambda df: df.select("kind", F.col("label").cast("double").alias("label"), array_to_vector("f").alias("features"))
    rows = as_rows(sample).coalesce(1).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(rows)
    rows.unpersist()
    bins = model.transform(as_rows(outside)).groupBy("kind", _bin().alias("b")).agg(F.count("*").alias("n"), F.sum("label").alias("right")).collect()  # BINS + 1 a kind at most
    limits = {}
    for kind in ALL_KINDS:
        own = [(r.b, r.n, r.right) for r in bins if r.kind == kind]
        least = _least(own or [(r.b, r.n, r.right) for r in bins])
        if least is not None:
            limits[kind] = least
    return model, limits


def find(docs: DataFrame, train: int = TRAIN) -> DataFrame:
    """(doc_id, th, spans array<struct<start, k, end, base>>) for the documents that hold any; k is the kind's number."""
    found = materialize(propose(docs))
    model, limits = fit(found, train)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(ALL_KINDS) for x in (k, i)])
    span = F.struct("start", number[F.col("kind")].alias("k"), "end")
    base = found.filter("base").select("doc_id", "th", span.alias("x"), F.lit(2.0).alias("p"))
    every = base
    if model is not None and limits:
        least = F.create_map(*[F.lit(x) for k, p in limits.items() for x in (k, p)])
        wide = found.filter("not base and start >= 0").select("doc_id", "th", "kind", span.alias("x"), array_to_vector("f").alias("features"))
        wide = model.transform(wide).withColumn("p", vector_to_array("probability")[1])
        every = base.unionByName(wide.filter(_bin() >= least[F.col("kind")]).select("doc_id", "th", "x", "p"))
    by = every.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.when(F.col("p") == 2.0, F.col("x")))).alias("base"), F.sort_array(F.collect_set(F.when(F.col("p") < 2.0, F.struct("p", "x"))), asc=False).alias("wide"))
    clash = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    added = F.aggregate("wide", F.filter("base", lambda b: F.lit(False)), lambda got, w: F.when(F.exists(F.concat(got, F.col("base")), lambda o: clash(o, w["x"])), got).otherwise(F.concat(got, F.array(w["x"]))))
    return by.select("doc_id", "th", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _text(spans):
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, train: int = TRAIN) -> DataFrame:
    """One row per document: doc_id, the four base counts, base_sha256, spans (of the four kinds), secrets, n_spans (of both)."""
    got = find(docs, train).withColumnsRenamed({"doc_id": "__d", "th": "__t"})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__h"))
    out = keyed.join(got, keyed["doc_id"].eqNullSafe(got["__d"]) & (keyed["__h"] == got["__t"]), "left")
    count = lambda k: F.greatest(F.size(F.filter("base", lambda s: s["k"] == k)), F.lit(0)).cast("long")
    text = lambda spans: F.coalesce(_text(spans), F.lit(""))
    own, secrets = F.filter("spans", lambda s: s["k"] < len(KINDS)), F.filter("spans", lambda s: s["k"] >= len(KINDS))
    return out.select("doc_id", *[F.coalesce(count(i), F.lit(0).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(own).alias("spans"), text(secrets).alias("secrets"), F.coalesce(F.greatest(F.size("spans"), F.lit(0)), F.lit(0)).cast("long").alias("n_spans"))


def redact(docs: DataFrame, train: int = TRAIN) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets."""
    got = find(docs, train).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spans")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    out = keyed.join(got, keyed["doc_id"].eqNullSafe(got["__d"]) & (keyed["__h"] == got["__t"]), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in ALL_KINDS])
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
    body = F.aggregate(F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,k:int,end:int>>)")), start, lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["s"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.get(names, x["k"])).alias("s"), x["end"].alias("at"))), lambda a: F.concat(a["s"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return out.select("doc_id", F.when(F.col("text").isNotNull(), body).alias("text"))
