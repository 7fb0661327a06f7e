"""Collocations: phrases of 2 to 5 words whose parts meet far more often than by chance, by language.

1. Words are counted by task and summed by Spark. A word's label is a 64-bit hash of language and word, so that phrases of different
   languages never meet.
2. Lengths 2 to 5 in turn. A phrase can only be frequent if its first and its last words are, so each task looks at runs of words
   whose shorter phrases are frequent by a bitmap of fixed size: a false hit costs work and changes nothing. A task
   counts its phrases and builds weighted acyclic automata from them in order, one a range of prefixes (the pair of the first two
   words, by its hash); the automata of a range are united, their weights summed, and rare phrases dropped.
3. Parts: the parts of all cuts, each once, are sorted by prefix range and composed with the automaton of all counts of
   that range, which gives their counts; these go back to the phrases by equi-joins.
4. Scores are integral divisions of decimals of 38 digits; the first `top` of each language are taken after a limit in each task.

From the third word on, tasks read runs of words (8 bytes a word) that hold a frequent pair at least, not the texts.

Defined cases: null texts are empty, a null lang is `und`; repeated rows count as often as they stand; extra columns are ignored;
an empty table gives an empty result. Words and phrases are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.automaton import Automaton, sort_rows, union
from tallyloom.llm.common import materialize, sliced

LEAST, LONGEST, TOP = 100, 5, 2000
#: Entries that a task or a range holds before it passes them on or sums them; bytes of text that are split into words at a time.
HELD, TEXT = 1 << 20, 1 << 22
#: Bits of the bitmap of frequent phrases: 16 a phrase, 16 MB at most.
MOST_BITS = 1 << 27
#: Words of the corpus a prefix range, and the most ranges.
RANGE_WORDS, MOST_RANGES = 500_000, 1 << 18

#: Separators of pieces become `.`, which then stands between words as a break; tabs become spaces.
_SPLIT = bytes.maketrans(b".,;:!?\n\v\f\r\t", b".......... ")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(texts: list[str]):
    """Lists of words of many texts, with b"." for breaks, of about TEXT bytes each; pieces stay whole."""
    data = b".".join(t.encode() for t in texts).lower().translate(_SPLIT)
    at = 0
    while at < len(data):
        end = data.find(b".", at + TEXT)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end + 1


def _by_language(batches):
    """(language, its texts) of some rows at a time."""
    for batch in sliced(batches):
        own: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            own.setdefault(lang, []).append(text)
        yield from own.items()


def label(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, seed=xxhash.xxh32_intdigest(lang)) or 1


def _count_words(batches):
    """(lang, word, label, n); the row without a word has the number of all words."""
    held: dict[str, Counter] = {}

    def flush():
        for lang, own in held.items():
            own.pop(b".", None)
            names = [*own, None]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.array([label(lang, w) for w in own] + [0], np.uint64).view(np.int64)), pa.array([*own.values(), sum(own.values())], pa.int64())], ["lang", "word", "label", "n"])
        held.clear()

    for lang, texts in _by_language(batches):
        own = held.setdefault(lang, Counter())
        for ws in pieces(texts):
            own.update(ws)
        if sum(map(len, held.values())) > HELD // 4:
            yield from flush()
    yield from flush()


class Bitmap:
    """A set of hashes with false hits, of a size that doesn't follow the input beyond MOST_BITS."""

    def __init__(self, hashes: DataFrame):
        n = hashes.count()
        size = 1 << 15
        while size < min(16 * n, MOST_BITS):
            size *= 2
        self.mask = np.uint64(size - 1)
        bit = F.col("g").bitwiseAND(F.lit(size - 1)) + 1
        got = hashes.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
        self.bits = np.zeros(size // 8, np.uint8)
        for r in got:
            self.bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
        self.raw = self.bits.tobytes()

    def __contains__(self, one: int) -> bool:
        at = one & int(self.mask)
        return bool(self.raw[at >> 3] >> (at & 7) & 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Labels(dict):
    """Labels of a language's words; 0 for those that are not frequent."""

    def __init__(self, lang: str, frequent: Bitmap):
        super().__init__({b".": 0})
        self.lang, self.frequent = lang, frequent

    def __missing__(self, word: bytes) -> int:
        x = label(self.lang, word)
        self[word] = x = x if x in self.frequent else 0
        return x


def _label_rows(batches, frequent: Bitmap):
    """Arrays of labels, with 0 for breaks and rare words."""
    known: dict[str, _Labels] = {}
    for lang, texts in _by_language(batches):
        own = known.setdefault(lang, _Labels(lang, frequent))
        for ws in pieces(texts):
            yield np.append(np.fromiter(map(own.__getitem__, ws), np.uint64, len(ws)), np.uint64(0))
        if len(own) > HELD // 4:
            del known[lang]


def chain(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its first words and its last word."""
    x = (first ^ (first >> np.uint64(29))) * _A + word
    return (x ^ (x >> np.uint64(32))) * _B


def windows(labels: np.ndarray, length: int, shorter: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of phrases of `length` frequent words whose first and last length - 1 words are frequent phrases, as far as known."""
    g, ok = labels, labels != 0
    for d in range(1, length - 1):
        g, ok = chain(g[:-1], labels[d:]), ok[:-1] & (labels[d:] != 0)
    if shorter is not None:
        ok = ok & shorter.has(g)
    at = np.flatnonzero(ok[:-1] & ok[1:])
    return at, chain(g[at], labels[at + length - 1])


def as_rows(words: np.ndarray) -> np.ndarray:
    """Automaton rows of phrases (padded with 0): the prefix pair's hash (or a lone word), the first two words, the others."""
    pair = np.where(words[:, 1] != 0, chain(words[:, 0], words[:, 1]), words[:, 0])
    pair[pair == 0] = 1
    return np.column_stack([pair, words])


def with_pairs(machine: Automaton) -> Automaton:
    """An automaton of phrases of two words or more, sent without the hashes of its prefix pairs."""
    first, second = machine.labels[1], machine.labels[2]
    pair = chain(first, second[np.searchsorted(machine.parents[2], np.arange(len(first)))])
    pair[pair == 0] = 1
    machine.labels[0] = pair[np.searchsorted(machine.parents[1], np.arange(len(machine.parents[0])))]
    return machine


def prefix_range(rows: np.ndarray, bits: int) -> np.ndarray:
    return (rows[:, 0] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(rows), np.int32)


def _shard(arrays, length: int, shorter: Bitmap | None, bits: int):
    """One task's phrases as automata, one a prefix range: (part, automaton)."""
    hashes, words, counts, held = [], [], [], 0

    def fold():
        nonlocal hashes, words, counts, held
        u, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = np.zeros(len(u), np.int64)
        np.add.at(n, back, np.concatenate(counts))
        hashes, words, counts, held = [u], [np.concatenate(words)[first]], [n], len(u)

    def flush():
        rows, n = sort_rows(as_rows(words[0]), counts[0])
        part = prefix_range(rows, bits)
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        got = [(int(part[s]), Automaton(rows.shape[1]).add(rows[s:e], n[s:e]).dump(first=False)) for s, e in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], ["part", "automaton"])

    for labels in arrays:
        at, g = windows(labels, length, shorter)
        if not len(at):
            continue
        u, first, n = np.unique(g, return_index=True, return_counts=True)
        hashes.append(u)
        words.append(labels[at[first][:, None] + np.arange(length)])
        counts.append(n)
        held += len(u)
        if held > HELD:
            fold()
            if 4 * held > 3 * HELD:
                yield from flush()
                hashes, words, counts, held = [], [], [], 0
    if hashes:
        fold()
        yield from flush()


def _from_texts(frequent: Bitmap, bits: int):
    return lambda batches: _shard(_label_rows(batches, frequent), 2, None, bits)


def _from_runs(length: int, shorter: Bitmap, bits: int):
    def shard(batches):
        rows = (np.frombuffer(r, np.uint64) for batch in sliced(batches) for r in batch.column("run").to_pylist())
        return _shard(rows, length, shorter, bits)

    return shard


def _runs(frequent: Bitmap, pairs: Bitmap):
    """Runs of words in which each three may be frequent, one after another with a break between, as bytes."""

    def keep(batches):
        for labels in _label_rows(batches, frequent):
            at, _ = windows(labels, 3, pairs)
            stay = np.zeros(len(labels) + 1, bool)
            for d in range(3):
                stay[at + d] = True
            # the words that stay, and one break after each run; neighbours of a run that don't stay would be one
            ends = np.append(stay, False)[1:] < stay
            ids = np.insert(labels[stay[:-1]], np.cumsum(stay[:-1])[ends[: len(labels)]], np.uint64(0)) if len(at) else labels[:0]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["run"])

    return keep


def _merge(least: int):
    """Unites the automata of each prefix range, which come one after another, and keeps rows with a weight of `least`."""

    def merge(batches):
        part, held, size = None, [], 0

        def done():
            rows, n = union(held).rows()
            rows, n = rows[n >= least], n[n >= least]
            g = rows[:, 1].copy()
            for d in range(2, rows.shape[1]):
                g = chain(g, rows[:, d])
            words = pa.FixedSizeListArray.from_arrays(pa.array(rows[:, 1:].ravel().view(np.int64)), rows.shape[1] - 1).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([words, pa.array(g.view(np.int64)), pa.array(n)], ["words", "g", "a"])

        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("automaton")):
                if p != part and held:
                    yield done()
                    held, size = [], 0
                part = p
                held.append(with_pairs(Automaton.load(blob.as_py())))
                size += len(held[-1].labels[-1])
                if size > HELD // 2 and len(held) > 8:
                    held = [union(held)]
                    size = len(held[0].labels[-1])
        if held:
            yield done()

    return merge


PHRASES = "words array<long>, g long, a long"


def _padded(column, width: int) -> np.ndarray:
    """Lists of labels as rows of `width`, 0 where a list is shorter."""
    at = column.offsets.to_numpy()
    lens = np.diff(at)
    out = np.zeros((len(lens), width), np.uint64)
    out[np.arange(width) < lens[:, None]] = column.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
    return out


def _compose(longest: int):
    """Weights of the parts asked for (kind 1) from the automaton of their range's phrases (kind 0), which come before them."""

    def compose(batches):
        part, rows, counts, machine = None, [], [], None
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            own = as_rows(_padded(batch.column("words"), longest))
            cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(parts)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if parts[s] != part:
                    part, rows, counts, machine = parts[s], [], [], None
                if kinds[s] == 0:
                    rows.append(own[s:e])
                    counts.append(batch.column("a").to_numpy()[s:e])
                    continue
                if machine is None:
                    machine = Automaton(longest + 1)
                    if rows:
                        machine.add(*sort_rows(np.concatenate(rows), np.concatenate(counts)))
                yield pa.RecordBatch.from_arrays([batch.column("g")[s:e], pa.array(machine.weigh(own[s:e]))], ["g", "f"])

    return compose


def _part_of(words, longest: int, bits: int):
    """The prefix range of phrases, as a column."""

    def number(batches):
        for batch in batches:
            rows = as_rows(_padded(batch.column("words"), longest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prefix_range(rows, bits))], [*batch.schema.names, "part"])

    return words.mapInArrow(number, f"{PHRASES}, kind int, part int")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases (all, if None)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, label long, n long").groupBy("lang", "word", "label").agg(F.sum("n").alias("n"))
    counted = materialize(counted.filter(F.col("word").isNull() | (F.col("n") >= least)))
    totals = counted.filter(F.col("word").isNull()).select("lang", "n")
    vocabulary = counted.filter(F.col("word").isNotNull()).select("lang", "word", F.col("label").alias("g"), F.col("n").alias("a"))
    size = totals.agg(F.sum("n")).first()[0] or 0
    bits = 5
    while RANGE_WORDS << bits < size and 1 << bits < MOST_RANGES:
        bits += 1
    frequent = Bitmap(vocabulary.select("g"))
    levels = [vocabulary.select(F.array("g").alias("words"), "g", "a")]

    def united(shards: DataFrame) -> DataFrame:
        ranged = shards.repartition("part").sortWithinPartitions("part")
        return materialize(ranged.mapInArrow(_merge(least), PHRASES))

    pairs = united(texts.mapInArrow(_from_texts(frequent, bits), "part int, automaton binary"))
    levels.append(pairs)
    if longest > 2:
        shorter = Bitmap(pairs.select("g"))
        runs = materialize(texts.mapInArrow(_runs(frequent, shorter), "run binary"))
        for length in range(3, longest + 1):
            own = united(runs.mapInArrow(_from_runs(length, shorter, bits), "part int, automaton binary"))
            levels.append(own)
            shorter = Bitmap(own.select("g"))
    phrases = levels[0]
    for own in levels[1:]:
        phrases = phrases.unionByName(own)
    found = phrases.filter(F.size("words") > 1)

    # each cut's parts, asked for once each
    k, m = F.col("k"), F.size("words")
    cut = found.select("g", "words", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    left, right = F.slice("words", F.lit(1), k), F.slice("words", k + 1, m - k)
    sides = cut.select("g", "a", "k", m.alias("m"), F.lit(0).alias("side"), left.alias("words")).unionByName(cut.select("g", "a", "k", m.alias("m"), F.lit(1).alias("side"), right.alias("words")))
    sides = materialize(sides.withColumn("part_g", F.xxhash64("words")))
    asked = sides.groupBy("part_g").agg(F.first("words").alias("words")).select("words", F.col("part_g").alias("g"), F.lit(0).cast("long").alias("a"), F.lit(1).alias("kind"))
    known = _part_of(phrases.select("words", "g", "a", F.lit(0).alias("kind")).unionByName(asked), longest, bits)
    weights = known.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_compose(longest), "g long, f long")
    answered = materialize(sides.join(weights.select(F.col("g").alias("part_g"), "f"), "part_g").select("g", "a", "k", "m", "side", "part_g", "f"))

    # a phrase inside a longer one of the same count is inside one that is longer by a word
    inside = answered.filter((F.col("m") > 2) & (F.col("f") == F.col("a")) & (((F.col("side") == 0) & (k == F.col("m") - 1)) | ((F.col("side") == 1) & (k == 1)))).select("part_g").distinct()
    both = answered.groupBy("g", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    kept = found.withColumn("part_g", F.xxhash64("words")).join(inside, "part_g", "left_anti").select("g", "words", "a")

    # words, and with them the language; then the lowest score of all cuts
    spelled = kept.select("g", "a", F.posexplode("words").alias("at", "w")).join(vocabulary.select(F.col("g").alias("w"), "lang", "word"), "w")
    text = spelled.groupBy("g", "a", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = text.join(totals, "lang").join(both, "g").withColumn("num", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("den", wide("l") * wide("r"))
    lowest = scored.withColumn("score", F.expr("num div den")).groupBy("g", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    out = lowest.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = out.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    return f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM ws GROUP BY lang),
gram AS (
  SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM ws, (SELECT unnest(range(1, {longest + 1})) AS m) WHERE len(w) >= m))
  GROUP BY lang, m, phrase HAVING count(*) >= {least}),
cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM gram WHERE m > 1),
longer AS (
  SELECT DISTINCT lang, sub, a FROM (
    SELECT lang, a, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) AS sub FROM cand WHERE m > 2)),
kept AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.sub = c.phrase AND x.a >= c.a)),
cut AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n, (1000 * c.a * t.n) // (l.a * r.a) AS score
  FROM cut c JOIN total t USING (lang)
  JOIN gram l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN gram r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low) WHERE rank <= {top}
"""
