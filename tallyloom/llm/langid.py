"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits; for each bit a binary n-gram classifier (naive Bayes log odds
of hashed byte trigrams, languages with bit 1 against those with bit 0) predicts the bit of a text.
Decoding picks the codeword with the least exponential loss, each bit weighted by how well it separated the
training texts; when the two best losses lie close together, the text is flagged as ambiguous.

The classifiers learn from at most SAMPLE documents of each language (a documented bound: the first ones in the
order of a hash of doc_id and text), each read whole. Prediction reads whole texts, in pieces of about 1 MB.

Defined cases: a null text, or one without a letter (number signs such as ½ are none), is `und` with score 0. Without any labelled text all
are `und`; with one language all others are that one, with score 1. lang, source and doc_id are no inputs
of a prediction. Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import chunks, materialize, sliced

SAMPLE = 1500
BUCKETS = 1 << 15
FOLDS, HELD_OUT = 3, 1
#: Two codewords whose probabilities differ by less are an ambiguous decoding.
AMBIGUOUS = 0.05
#: Letters, and the number signs (as ½) that the pattern can't tell from them.
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text or ""))


def held_out():
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(FOLDS)) == HELD_OUT


def codewords(n: int) -> np.ndarray:
    """(n, bits) of 0 and 1: the exhaustive code up to five languages, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 0 and any(c)]
        return np.array(cols, np.int8).T
    rng, best, far = np.random.default_rng(17), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        if (code.sum(0) % n == 0).any():
            continue
        d = (code[:, None] != code[None]).sum(2)
        d[np.arange(n), np.arange(n)] = bits
        if d.min() > far:
            best, far = code, d.min()
    return best


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of ` text ` for each text, one after another, and each text's first index."""
    joined = b"".join(b" " + t + b"  " for t in texts)
    b = np.frombuffer(joined, np.uint8).astype(np.uint32)
    h = (b[:-2] * _A) ^ (b[1:-1] * _B) ^ (b[2:] * _C)
    h ^= h >> np.uint32(15)
    starts = np.concatenate([[0], np.cumsum([len(t) + 3 for t in texts])[:-1]])
    return (h & np.uint32(BUCKETS - 1)).astype(np.int32), starts


def _fold(text: str) -> bytes:
    return text.lower().encode()


def _count(batches):
    """Trigram counts by language over one task's documents."""
    got: dict[str, np.ndarray] = {}
    for batch in sliced(batches):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang, text in zip(langs, texts):
            if has_letter(text):
                h, _ = _grams([_fold(text)])
                got[lang] = got.get(lang, 0) + np.bincount(h, minlength=BUCKETS)
    for lang, n in got.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])


class Model:
    """Languages, codewords, a weight table (grams, bits) and the bits' weights: a few MB for any corpus."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        if not langs:
            return
        c = self.code.T.astype(np.float64)  # (bits, langs)
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # languages weigh alike
        scale = counts.sum(1).max()
        one, zero = c @ share * scale + 0.5, (1 - c) @ share * scale + 0.5
        odds = np.log(one / one.sum(1, keepdims=True)) - np.log(zero / zero.sum(1, keepdims=True))
        self.table = odds.T.astype(np.float32).copy()
        # how far the mean log odds of a language's own text lie on the right side, for each bit
        margin = (share @ odds.T) * (2 * self.code - 1)
        self.bit_weight = np.maximum(margin.mean(0), 1e-6) / max(margin.mean(0).sum(), 1e-6)
        self.scale = 1.0 / np.maximum(margin.min(0), 1e-3)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, bits): mean log odds a trigram, in units of the weakest language's own margin."""
        h, starts = _grams(texts)
        sizes = np.array([len(t) for t in texts]) + 3.0
        out = np.empty((len(texts), self.table.shape[1]))
        for k in range(out.shape[1]):
            out[:, k] = np.add.reduceat(self.table[:, k][h], starts, dtype=np.float64) / sizes
        return out * self.scale

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability, and whether the second best is close."""
        sign = 2.0 * self.code - 1
        loss = (np.exp(-np.clip(bits[:, None, :] * sign[None], -20, 20)) * self.bit_weight).sum(2)
        x = -4 * np.log(loss)
        p = np.exp(x - x.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        close = (top[:, -1] - top[:, -2] < AMBIGUOUS) if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p.max(1), close


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # the choice is made on ids alone; the texts of the chosen then come by a broadcast of their ids
    keys = materialize(known.select("lang", F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h")).distinct().withColumn("r", F.xxhash64("__d", "__h")))
    sizes = keys.groupBy("lang").agg(F.count("*").alias("n"))
    # hashes are even over 64 bits: of a large language, twice the wanted rows lie below the bound, and only these are ranked
    low = keys.join(F.broadcast(sizes), "lang").filter(F.col("r") / 2.0**64 + 0.5 <= F.lit(2.0 * sample) / F.col("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("r", "__d", "__h"))
    ids = materialize(low.withColumn("k", rank).filter(F.col("k") <= sample).select("__d", "__h").distinct())
    chosen = known.join(F.broadcast(ids), known["doc_id"].eqNullSafe(ids["__d"]) & (F.xxhash64(known["text"]) == ids["__h"]), "left_semi")
    counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most BUCKETS rows a language
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        own = got.filter(pa.compute.equal(got.column("lang"), lang))
        counts[i, own.column("gram").to_numpy()] = own.column("n").to_numpy()
    return Model(langs, counts)


def _predictor(model: Model, keep: list[str]):
    def predict(batches):
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            n = len(texts)
            lang, score, close = [["und"] * n, np.zeros(n), np.zeros(n, bool)]
            at = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
            folded = [_fold(texts[i]) for i in at]
            for s, e in chunks(folded):
                best, p, c = model.decode(model.bits(folded[s:e]))
                for i, b, x, y in zip(at[s:e], best, p, c):
                    lang[i], score[i], close[i] = model.langs[b], x, y
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(lang, pa.string()), pa.array(score), pa.array(close)], [*keep, "lang_pred", "score", "ambiguous"])

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predictor(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, train(docs, sample))


def _keeper(model: Model):
    def keep(batches):
        names = None
        score = _predictor(model, [])
        for batch in sliced(batches):
            names = names or batch.schema.names
            got = next(score(iter([batch.select(["text"])])))
            ok = pa.compute.not_equal(got.column("lang_pred"), "und")
            yield batch.filter(ok)

    return keep


def drop_unidentified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that have a language: those without text or without any letter go. All columns kept."""
    return docs.mapInArrow(_keeper(train(docs, sample)), docs.schema)
