"""Language-model scores by logistic context mixing of bit predictors.

Text is read as tokens: words (A-Z folded) and one end a text. Every token becomes bits:
* a heavy token, one of a share of 1 / HEAVY of all training tokens or more, is a code word of a Huffman code over the
  heavy tokens and one escape; all other tokens, the light ones, are the escape. Each bit has a prediction in each of
  four contexts that run across the text: none, the last heavy token, the heavy token before that, and the last two
  tokens of any kind. Each context, with the code's bits so far, is hashed into a table of counters.
* after an escape a light token is either repeated from the light training tokens, by its share of them, or spelled
  bit by bit, each word's bytes and a space, in the contexts of its last one, two, three bytes and its whole prefix; the first
  decision's probability is the share of light tokens that occurred once. Both ways are added up, so that all
  probabilities sum to one at most. Spelling depends on the word alone, so it is done once for all its occurrences.
For each bit the predictions are stretched and summed with weights that a gate selects by how often the longer contexts
were seen; the weights are learned by a step after each part of the training rows, and a last table, learned on the way, corrects
the mixed probability.

How the corpus is read:
1. Every text's tokens are counted, in each task first, then by token: a row for each distinct token with its
   count in the training texts (0 where only other texts hold it). Heavy tokens, HEAVY at most, get their codes.
2. Counters are summed over all training texts (code bits) and over all distinct training tokens (spelling is for new
   words, so each counts once); a task sends them packed, SPAN slots a row. A table has 2 ^ bits slots a context, where bits follows the number of distinct
   tokens between MIN_BITS and MAX_BITS (a documented memory bound: 16 MB a table). The mixers learn from every bit of
   the same rows, once, with its own occurrence left out of the counters: the rows are dealt by hash to parts that grow to
   three quarters of them all (PARTS), tasks sum gradients, Hessians and the correcting table's cells over a part at the
   weights that the parts before gave, and the driver gets these sums alone (SUMS numbers) and makes a Newton step over all
   parts so far.
3. Each distinct light token gets its log-probability after an escape.
4. Texts sum their code bits in one pass, and ask for counts and log-probabilities of light tokens by hash bucket, packed
   a chunk of texts and bucket; only sums by text come back. No light token has more than its share, so no bucket is hot.
Tokens are matched by 64-bit hashes.

Defined cases: a null text is an empty one: its only token is the end. Without training texts the base
score is over no counts (N = V = 0) and the model is uniform over the bits of spelling. Repeated rows are scored each.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import chunks, materialize, sliced
from tallyloom.llm.neardup import _mix, word_hashes

FOLDS, HELD_OUT = 7, 2
END = b"\n"
MIN_BITS, MAX_BITS = 12, 18
ORDERS = 4
GATES, BINS = 8 * 4, 33
#: Where the parts end from which the mixers learn in turn, in sixteenths of all training rows.
PARTS = (1, 4, 16)
#: Sums of a part: by gate a gradient and a Hessian, by cell of the correcting table ones, bits and predictions.
SUMS = GATES * ORDERS * (1 + ORDERS) + 3 * GATES * BINS
HEAVY = 200_000
#: Bits that are worked on at a time, and bytes that are spelled: many, so that a context's part of a table stays in a core's cache.
BLOCK = 1 << 18
#: Slots of a row in which a task sends its counters, and events of a context that it gathers before it counts them.
SPAN, EVENTS = 4096, 1 << 20
#: Tokens of a bucket, about; buckets grow with the corpus.
BUCKET_TOKENS = 4_000_000
_U = np.uint64
_rng = np.random.default_rng(404)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_ORDER = _rng.integers(1, 2**63, ORDERS, dtype=np.uint64)
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_M, _N = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Masks that keep the first bytes of eight, and the length from which a word's bytes are hashed by the generic way.
_KEEP, LONG = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 64
_LN10 = float(np.log(10))


def _fold(text: str | None) -> bytes:
    return (text or "").encode().lower()


def held_out():
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(FOLDS)) == HELD_OUT


# ---- tokens ----


def _count(batches):
    """(token, n): n counts training texts only; given out whenever 300,000 distinct tokens have gathered."""
    parts, waiting = [], 0

    def merged():
        rows = pa.concat_tables(parts).group_by("token").aggregate([("n", "sum")])
        return pa.table([rows.column("token"), rows.column("n_sum")], ["token", "n"]).combine_chunks()

    for batch in sliced(batches, 2048):
        for held in (True, False):
            texts = batch.column("text").filter(pc.equal(batch.column("held"), held))
            counts = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(texts))).value_counts()
            token, n = counts.field(0).cast(pa.binary()), counts.field(1)
            if held:
                n = pa.array(np.zeros(len(n), np.int64))
            parts.append(pa.table([token, n], ["token", "n"]).filter(pc.not_equal(token, b"")))
            if len(texts) and not held:
                parts.append(pa.table([pa.array([END], pa.binary()), pa.array([len(texts)], pa.int64())], ["token", "n"]))
            waiting += len(counts) + 1
        if waiting > 600_000:
            parts = [merged()]
            waiting = len(parts[0])
            if waiting > 300_000:
                yield from parts[0].to_batches()
                parts, waiting = [], 0
    if parts:
        yield from merged().to_batches()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, n), materialized: each distinct token of all texts with its count in the training texts."""
    rows = docs.select(held_out().alias("held"), "text").mapInArrow(_count, "token binary, n long")
    return materialize(rows.groupBy("token").agg(F.sum("n").alias("n")))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and each text's number of words; words are read eight bytes at a time."""
    joined = b" ".join([b"", *texts, b" " * 16])
    joined = joined[: len(joined) // 8 * 8]
    b, eight = np.frombuffer(joined, np.uint8), np.frombuffer(joined, np.uint64)
    gap = (b - np.uint8(9) < np.uint8(5)) | (b == np.uint8(32))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    size = last - first

    def window(at):
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (np.take(eight, word) >> shift) | ((np.take(eight, word + 1) << _U(1)) << (_U(63) - shift))

    h = _mix((window(first) & np.take(_KEEP, np.minimum(size, 8))) + size.astype(np.uint64) * _P)
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG:
        h[more] = _mix(h[more] * _Q + (window(first[more] + k) & np.take(_KEEP, np.minimum(size[more] - k, 8))))
        k += 8
        more = more[size[more] > k]
    if len(more):
        h[more] = word_hashes([joined[x:y] for x, y in zip(first[more].tolist(), last[more].tolist())])[0]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h.view(np.int64), np.diff(np.searchsorted(first, ends, side="right"), prepend=0)


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    """The hashes that the same tokens have in a text; the end, which is no word, has its own."""
    out = np.zeros(len(tokens), np.int64)
    at = [i for i, t in enumerate(tokens) if t != END]
    out[at] = _words([tokens[i] for i in at])[0]
    return out


# ---- bits ----


def table_bits(distinct: int, heavy: int = 0) -> int:
    """Slots a context, as a power of two: one for two distinct tokens or so, and four for each heavy one."""
    return max(MIN_BITS, min(MAX_BITS, max(distinct.bit_length() - 1, heavy.bit_length() + 2)))


def _contexts(ctx: np.ndarray) -> np.ndarray:
    """(ORDERS, events) 32-bit numbers of the contexts; those of each order are apart."""
    return (((ctx + _ORDER[:, None]) * _P) >> _U(32)).astype(np.uint32)


def _slots(ctx: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """(ORDERS, events): each context with its node, hashed into its part of the table."""
    h = ctx ^ (node.astype(np.uint32) * _M)
    h ^= h >> np.uint32(15)
    h *= _N
    h >>= np.uint32(32 - bits)
    h += (np.arange(ORDERS, dtype=np.uint32) << np.uint32(bits))[:, None]
    return h.astype(np.int64)


class Spelling:
    """The bits of a list of spelled tokens."""

    def __init__(self, tokens: list[bytes]):
        coded = [t if t == END else t + b" " for t in tokens]
        sizes = np.array([len(t) for t in coded])
        b = np.frombuffer(b"".join(coded), np.uint8)
        self.owner = np.repeat(np.arange(len(tokens)), sizes)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(b)) - starts[self.owner]
        ctx = np.zeros((ORDERS, len(b)), np.uint64)
        x = b.astype(np.uint64) + _U(1)
        last = np.zeros(len(b), np.uint64)
        for k in range(3):
            shifted = np.zeros(len(b), np.uint64)
            shifted[k + 1 :] = x[: -(k + 1)] if len(b) > k + 1 else x[:0]
            shifted[place <= k] = 0
            last = last * _U(257) + shifted
            ctx[k] = last
        power = np.cumprod(np.concatenate([[_U(1)], np.full(int(sizes.max()), _P)]), dtype=np.uint64)
        val = _BYTE[b] * power[place]
        run = np.cumsum(val) - val
        ctx[3] = run - run[starts][self.owner]
        self.ctx, self.b, self.who = _contexts(ctx), b, self.owner

    def bits(self, bits: int):
        """(slots, bit, which bytes) for each of the bytes' eight bits, the highest first."""
        for i in range(8):
            node = (_U(1) << _U(i)) | (self.b >> np.uint8(8 - i) if i else np.zeros_like(self.b)).astype(np.uint64)
            yield _slots(self.ctx, node, bits), (self.b >> np.uint8(7 - i)) & np.uint8(1), slice(None)


def huffman(counts: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol; one symbol alone has no bits."""
    heap = [(max(n, 1), i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    up, n = {}, len(counts)
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a], up[b] = (n, 0), (n, 1)
        heapq.heappush(heap, (x + y, n))
        n += 1
    codes: dict[int, tuple[int, int]] = {}
    for i in range(n - 1, -1, -1):
        if i not in up:
            codes[i] = (0, 0)
        else:
            parent, bit = up[i]
            code, size = codes[parent]
            codes[i] = (code << 1 | bit, size + 1)
    return [codes[i] for i in range(len(counts))]


class Codes:
    """The heavy tokens' hashes, sorted, with their code words; the last code word is the escape's."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, light: int):
        order = np.argsort(hashes)
        self.keys, self.n = hashes[order], counts[order]
        got = huffman([*self.n.tolist(), light + 1])
        self.code = np.array([c for c, _ in got], np.int64)
        self.size = np.array([n for _, n in got], np.int64)
        # where the keys begin that share their first bits, and how many do at most
        self.shift = 64 - (len(self.keys).bit_length() + 3)
        n = np.bincount(self._head(self.keys), minlength=1 << (64 - self.shift))
        self.first, self.most = (np.cumsum(n) - n).astype(np.int32), int(n.max())

    def _head(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift) + (1 << (63 - self.shift))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's symbol; that of the escape for light tokens."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.take(self.first, self._head(h)).astype(np.int64)
        for _ in range(self.most):
            at += np.take(self.keys, at, mode="clip") < h
        return np.where(np.take(self.keys, at, mode="clip") == h, at, len(self.keys))


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all tokens in order, each text's end (hash 0) included."""
    h, n = _words(texts)
    who = np.repeat(np.arange(len(texts)), n + 1)
    out, ends = np.zeros(len(who), np.int64), np.cumsum(n + 1) - 1
    word = np.ones(len(who), bool)
    word[ends] = False
    out[word] = h
    return out, who


class Running:
    """The code bits of texts, in contexts that run across their tokens."""

    def __init__(self, texts: list[bytes], codes: Codes):
        self.h, self.owner = sequence(texts)
        self.symbol = codes.find(self.h)
        n = len(self.h)
        at, starts = np.arange(n), np.flatnonzero(np.diff(self.owner, prepend=-1))
        start = np.take(starts, self.owner)  # of each token's text
        last = np.empty_like(at)
        last[:1] = -1
        np.maximum.accumulate(np.where(self.symbol < len(codes.keys), at, -1)[:-1], out=last[1:])
        before = np.take(last, last, mode="clip")  # the first token has no last one, and so none before
        x = self.h.view(np.uint64) + _U(1)
        pick = lambda i: np.where(i >= start, np.take(x, i, mode="clip"), _U(0))
        one, two = np.zeros_like(x), np.zeros_like(x)
        one[1:], two[2:] = x[:-1], x[:-2]
        one[starts] = two[starts] = 0
        two[np.minimum(starts + 1, n - 1)] = 0
        # by falling code length, so that the tokens with a j-th bit are the first ones
        size = np.take(codes.size.astype(np.uint8), self.symbol)
        by = np.argsort(~size, kind="stable")
        symbol = np.take(self.symbol, by)
        ctx = _contexts(np.stack([np.zeros(n, np.uint64), pick(last), pick(before) * _P, (one * _P + two) * _Q]))
        self.ctx = np.stack([np.take(x, by) for x in ctx])
        self.size, self.who = np.take(size, by).astype(np.uint32), np.take(self.owner, by)
        self.path = np.take(((1 << codes.size) | codes.code).astype(np.uint32), symbol)  # a code word behind a 1

    def bits(self, bits: int):
        """(slots, bit, which tokens) of all first bits, then of all second bits, and so on, BLOCK at a time."""
        for j in range(int(self.size.max(initial=0))):
            n = int(np.count_nonzero(self.size > j))
            for s in range(0, n, BLOCK):
                e = min(s + BLOCK, n)
                path = self.path[s:e] >> (self.size[s:e] - np.uint32(j + 1))  # with its j-th bit last
                yield _slots(self.ctx[:, s:e], path >> np.uint32(1), bits), (path & np.uint32(1)).astype(np.uint8), slice(s, e)


def _spellings(batch, _codes):
    tokens = batch.column("token").to_pylist()
    for s, e in chunks(tokens, BLOCK):
        yield Spelling(tokens[s:e])


def _runnings(batch, codes):
    for part in sliced([batch]):
        texts = [_fold(t) for t in part.column("text").to_pylist()]
        for s, e in chunks(texts):
            yield Running(texts[s:e], codes)


def _counters(pieces, codes, bits: int):
    def count(batches):
        """(span, n) over one task's rows: of SPAN slots the zeros and ones by slot."""
        table = np.zeros((ORDERS, 2 << bits), np.int64)
        events, waiting = [], 0

        def flush():
            for k in range(ORDERS):
                table[k] += np.bincount(np.concatenate([x[k] for x in events]), minlength=2 << bits)
            events.clear()

        for batch in batches:
            for piece in pieces(batch, codes):
                for slots, bit, _ in piece.bits(bits):
                    at = (slots << 1) + bit
                    at &= (2 << bits) - 1
                    events.append(at.astype(np.int32))
                    waiting += len(bit)
                    if waiting >= EVENTS:
                        flush()
                        waiting = 0
        if events:
            flush()
        rows = table.reshape(-1, 2 * SPAN)
        at = np.flatnonzero(rows.any(axis=1))
        for s in range(0, len(at), 64):
            yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 64].astype(np.int32)), pa.array([rows[i].tobytes() for i in at[s : s + 64]], pa.binary())], ["span", "n"])

    return count


def _add_spans(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(2 * SPAN, np.int64)
    for x in rows["n"]:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"span": rows["span"].iloc[:1], "n": [total.tobytes()]})


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


def _squash(x: np.ndarray) -> np.ndarray:
    y = np.clip(x, -20, 20)
    np.exp(np.negative(y, out=y), out=y)
    y += 1
    return np.reciprocal(y, out=y)


def _inputs(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The stretched predictions. The last bits of those of the longest context and of the one before are how often that was
    seen, in 8 and in 4 levels, so that one look-up brings both."""
    x = _stretch(n0, n1).astype(np.float32)
    word, seen = x.view(np.uint32).reshape(ORDERS, -1), np.log2(n0 + n1 + 1).astype(np.uint32).reshape(ORDERS, -1)
    word[2:] &= ~np.uint32(7)
    word[3] |= np.minimum(seen[3], np.uint32(7))
    word[2] |= np.minimum(seen[2] // np.uint32(4), np.uint32(3))
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    word = x.view(np.uint32)
    return (((word[3] & np.uint32(7)) << np.uint32(2)) | (word[2] & np.uint32(3))).astype(np.uint8)


def _bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 2), -16, 16).astype(np.int64) + 16


class LeftOut:
    """The counters' inputs with one occurrence of a bit left out, of a 0 and of a 1 by slot in turn."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray):
        self.x = _inputs(np.stack([np.maximum(n0 - 1, 0), n0], 1).ravel(), np.stack([n1, np.maximum(n1 - 1, 0)], 1).ravel())


def _sums(piece, left: LeftOut, weights: np.ndarray, bits: int) -> np.ndarray:
    """The piece's SUMS at these weights; bits are sorted by gate, so that a gate's sums are a product of matrices."""
    both, cells, near = np.zeros((GATES, ORDERS + 1, ORDERS)), np.zeros(2 * GATES * BINS), np.zeros(GATES * BINS)
    weights = weights.astype(np.float32)
    for slots, bit, _ in piece.bits(bits):
        slots += slots
        slots += bit
        x = np.take(left.x, slots, mode="clip")
        g = _gate(x)
        n = np.bincount(g, minlength=GATES)
        by = np.argsort(g, kind="stable")
        x, y = np.take(np.ascontiguousarray(x.T), by, axis=0), np.take(bit, by)
        gates = [(k, slice(e - n[k], e)) for k, e in enumerate(np.cumsum(n).tolist()) if n[k]]
        z = np.empty(len(y), np.float32)
        for k, s in gates:
            np.matmul(x[s], weights[k], out=z[s])
        p = _squash(z)
        cell = _bin(z)
        cell += np.repeat(np.arange(GATES) * BINS, n)
        near += np.bincount(cell, p, GATES * BINS)
        cell += cell
        cell += y
        cells += np.bincount(cell, minlength=2 * GATES * BINS)
        # of each bit its inputs times the curvature, and its error; sums are in double precision
        row = np.empty((ORDERS + 1, len(y)))
        row[ORDERS] = y - p
        p *= 1 - p
        for k in range(ORDERS):
            row[k] = x[:, k] * p
        x = x.astype(float)
        for k, s in gates:
            both[k] += row[:, s] @ x[s]
    zeros, ones = cells[::2], cells[1::2]
    return np.concatenate([both[:, ORDERS].ravel(), both[:, :ORDERS].ravel(), ones, zeros + ones, near])


class Mixer:
    """Counters, gated weights and the correcting table."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, bits: int):
        self.size = bits
        self.x = _inputs(n0, n1)
        self.weights = np.full((GATES, ORDERS), 1.0 / ORDERS)
        self.table = np.tile(_squash((np.arange(BINS) - 16) / 2.0), (GATES, 1))
        # all parts so far: Hessians, Hessians by weights plus gradients, cells; a gate that no bit comes to keeps its weights
        self.bend = np.tile(np.eye(ORDERS), (GATES, 1, 1))
        self.pull, self.cells = self.weights.copy(), np.zeros((3, GATES * BINS))

    def step(self, sums: np.ndarray) -> None:
        """A Newton step over this part, whose sums are at the present weights, and all before."""
        step, bend, cells = np.split(sums, [GATES * ORDERS, GATES * ORDERS * (1 + ORDERS)])
        bend = bend.reshape(GATES, ORDERS, ORDERS)
        self.pull += (bend @ self.weights[:, :, None])[:, :, 0] + step.reshape(GATES, ORDERS)
        self.bend += bend
        self.cells += cells.reshape(3, -1)
        # rounded, so that the order in which tasks are summed does not show
        self.weights = np.round(np.linalg.solve(self.bend, self.pull[:, :, None])[:, :, 0], 9)
        prior = 4.0
        one, all_, near = self.cells
        plain = np.tile(_squash((np.arange(BINS) - 16) / 2.0), GATES)
        mean = np.where(all_ > 0, near / np.maximum(all_, 1e-9), plain)
        self.table = np.round((one + prior * mean) / (all_ + prior), 9).reshape(GATES, BINS)

    def learn(self, pieces, n0: np.ndarray, n1: np.ndarray) -> None:
        """One step over pieces that are at hand; n0 and n1 are the counters."""
        left = LeftOut(n0, n1)
        self.step(sum((_sums(piece, left, self.weights, self.size) for piece in pieces), np.zeros(SUMS)))

    def log10(self, piece, n: int) -> np.ndarray:
        """log10 probability of the bits of each of the piece's n owners."""
        likely = np.ones(len(piece.who))  # 27 bits of 2 ** -20 at most
        weights, table = self.weights.astype(np.float32), self.table.astype(np.float32).ravel()
        low, high = np.float32(2.0**-20), np.float32(1 - 2.0**-20)
        for slots, bit, at in piece.bits(self.size):
            x = np.take(self.x, slots, mode="clip")
            g = _gate(x).astype(np.int64)
            w = np.take(weights, g, axis=0)
            z = w[:, 0] * x[0]
            for k in range(1, ORDERS):
                z += w[:, k] * x[k]
            g *= BINS
            g += _bin(z)
            p = _squash(z)
            p += np.take(table, g, mode="clip")
            p *= np.float32(0.5)
            p = np.clip(p, low, high, out=p)
            likely[at] *= 1 - np.abs(bit - p)
        return np.bincount(piece.who, np.log(likely), n) / _LN10

    def spelled(self, tokens: list[bytes]) -> np.ndarray:
        out = np.zeros(len(tokens))
        for s, e in chunks(tokens, BLOCK):
            out[s:e] = self.log10(Spelling(tokens[s:e]), e - s)
        return out


def _summed(rows: DataFrame, pieces, codes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters over all rows: ORDERS << bits of them at most reach the driver."""
    sums = rows.mapInArrow(_counters(pieces, codes, bits), "span int, n binary").groupBy("span").applyInPandas(_add_spans, "span int, n binary").toArrow()
    n = np.zeros(((ORDERS << bits) // SPAN, SPAN, 2))
    for span, x in zip(sums.column("span").to_pylist(), sums.column("n").to_pylist()):
        n[span] = np.frombuffer(x, np.int64).reshape(SPAN, 2)
    return n[:, :, 0].ravel(), n[:, :, 1].ravel()


def _part_sums(pieces, codes, left, weights: np.ndarray, bits: int):
    def sums(batches):
        """(at, v): one task's SUMS."""
        total = np.zeros(SUMS)
        for batch in batches:
            for piece in pieces(batch, codes):
                total += _sums(piece, left.value, weights, bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    return sums


def _train(rows: DataFrame, column: str, key, pieces, codes, bits: int) -> Mixer:
    """Counters and mixer of all rows; key deals them to the parts."""
    n0, n1 = _summed(rows.select(column), pieces, codes, bits)
    mixer = Mixer(n0, n1, bits)
    left = rows.sparkSession.sparkContext.broadcast(LeftOut(n0, n1))
    del n0, n1
    lot = F.pmod(key, F.lit(PARTS[-1]))
    for start, end in zip((0, *PARTS), PARTS):
        part = rows.filter((lot >= start) & (lot < end)).select(column)
        got = part.mapInArrow(_part_sums(pieces, codes, left, mixer.weights, bits), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        sums = np.zeros(SUMS)
        sums[got.column("at").to_numpy()] = got.column("v").to_numpy()
        mixer.step(sums)
    left.destroy()
    return mixer


def train_spelling(vocab: DataFrame, bits: int) -> Mixer:
    """From all distinct training tokens, each once."""
    return _train(vocab.filter("n > 0"), "token", F.xxhash64("token"), _spellings, None, bits)


def train_running(docs: DataFrame, codes: Codes, bits: int) -> Mixer:
    """From all training texts."""
    return _train(docs.filter(~held_out()), "text", F.xxhash64("doc_id", "text"), _runnings, codes, bits)


def light_log10(mixer: Mixer, tokens: list[bytes], n: np.ndarray, total: int, new: float) -> np.ndarray:
    """log10 of (1 - new) * share of the light training tokens + new * spelled."""
    spelled = mixer.spelled(tokens) + np.log10(new)
    share = (1 - new) * n / max(total, 1)
    return np.where(share > 0, np.log10(np.maximum(share, 1e-300) + 10.0 ** np.maximum(spelled, -290)), spelled)


def _rated(mixer: Mixer, buckets: int, total: int, new: float):
    def rate(batches):
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            h = token_hashes(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.mod(h, buckets).astype(np.int32)), pa.array(h), batch.column("n"), pa.array(light_log10(mixer, tokens, batch.column("n").to_numpy(), total, new))], ["bucket", "h", "n", "lp"])

    return rate


# ---- texts ----


def _ask(codes: Codes, mixer: Mixer, buckets: int):
    """For each chunk of texts one row of what is known (bucket of the chunk) and one for each bucket it asks."""

    def ask(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        known, lg = np.append(codes.n > 0, False).astype(float), np.append(np.log10(codes.n + 1.0), 0.0)
        for batch in sliced(batches):
            texts = [_fold(t) for t in batch.column("text").to_pylist()]
            ids, held = batch.column("doc_id"), batch.column("held")
            for s, e in chunks(texts):
                chunk, n = (part << 32) + k, e - s
                k += 1
                run = Running(texts[s:e], codes)
                heavy = run.symbol < len(codes.keys)
                own = [np.bincount(run.owner, v[run.symbol], n) for v in (known, lg)] + [mixer.log10(run, n)]
                tokens = np.bincount(run.owner, minlength=n).astype(np.int64)
                size = np.array([sum(map(len, x.split())) for x in texts[s:e]], np.int64) + tokens
                rows = [(chunk % buckets, chunk, True, ids.slice(s, n).to_pylist(), held.slice(s, n).to_pylist(), tokens.tolist(), size.tolist(), b"", b"", b"", *[v.tolist() for v in own])]
                h, doc = run.h[~heavy], run.owner[~heavy]
                b = np.mod(h, buckets)
                order = np.lexsort((h, doc, b))
                b, h, doc = b[order], h[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
                tf = np.diff(np.concatenate([new, [len(h)]])).astype(np.int32)
                b, h, doc = b[new], h[new], doc[new].astype(np.int32)
                cut = np.flatnonzero(np.diff(b)) + 1
                for x, y in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(b)]]).tolist()):
                    if x < y:
                        rows.append((int(b[x]), chunk, False, None, None, None, None, h[x:y].tobytes(), doc[x:y].tobytes(), tf[x:y].tobytes(), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ASK_TYPES)], _ASK_NAMES)

    return ask


_D, _L = pa.list_(pa.float64()), pa.list_(pa.int64())
_ASK_TYPES = (pa.int32(), pa.int64(), pa.bool_(), _L, pa.list_(pa.bool_()), _L, _L, pa.binary(), pa.binary(), pa.binary(), _D, _D, _D)
_ASK_NAMES = ["bucket", "chunk", "own", "ids", "held", "tokens", "size", "h", "doc", "tf", "known", "lg", "lp"]
_ASK = "bucket int, chunk long, own boolean, ids array<long>, held array<boolean>, tokens array<long>, size array<long>, h binary, doc binary, tf binary, known array<double>, lg array<double>, lp array<double>"
_REPLY = "chunk long, own boolean, ids array<long>, held array<boolean>, tokens array<long>, size array<long>, doc binary, known array<double>, lg array<double>, lp array<double>"
_REPLY_NAMES = ["chunk", "own", "ids", "held", "tokens", "size", "doc", "known", "lg", "lp"]


def _answer(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """One bucket: each chunk's questions become sums by text."""
    out = asked[asked["own"]][_REPLY_NAMES].to_dict("records")
    order = np.argsort(words["h"].to_numpy())
    keys, n, lp = (words[c].to_numpy()[order] for c in ("h", "n", "lp"))
    lg, known = np.log10(n + 1.0), (n > 0).astype(float)
    for r in asked[~asked["own"]].itertuples():
        h, doc, tf = np.frombuffer(r.h, np.int64), np.frombuffer(r.doc, np.int32), np.frombuffer(r.tf, np.int32)
        at = np.searchsorted(keys, h)
        docs, inv = np.unique(doc, return_inverse=True)
        sums = [np.bincount(inv, tf * v[at]) for v in (known, lg, lp)]
        out.append(dict(zip(_REPLY_NAMES, (r.chunk, False, None, None, None, None, docs.tobytes(), *sums))))
    return pd.DataFrame(out, columns=_REPLY_NAMES)


def _gather(floor: float, train_tokens: int):
    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["own"]].iloc[0]
        sums = [np.array(own[c], float) for c in ("known", "lg", "lp")]
        for r in rows[~rows["own"]].itertuples():
            doc = np.frombuffer(r.doc, np.int32)
            for total, part in zip(sums, (r.known, r.lg, r.lp)):
                total[doc] += part
        tokens, size = np.array(own["tokens"], np.int64), np.array(own["size"], np.int64)
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in own["ids"]], "Int64"), "held_out": own["held"], "n_tokens": tokens, "n_known": np.rint(sums[0]).astype(np.int64), "train_tokens": train_tokens, "base_score": sums[1] - tokens * floor, "score": sums[2], "bits_per_byte": -sums[2] * np.log2(10) / size})

    return gather


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    vocab = vocabulary(docs)
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    is_heavy = (F.col("n") * HEAVY >= total) & (F.col("n") > 0)
    heavy = [(bytes(r.token), r.n) for r in vocab.filter(is_heavy).collect()]  # HEAVY rows at most, as shares sum to one
    light = materialize(vocab.filter(~is_heavy))
    rest, once = light.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    new = min(max(once, 1) / rest, 0.5) if rest else 1.0
    codes = Codes(token_hashes([t for t, _ in heavy]), np.array([n for _, n in heavy], np.int64), rest)
    bits = table_bits(distinct, len(codes.keys))
    spelling, running = train_spelling(vocab, bits), train_running(docs, codes, bits)
    buckets = max(8, -(-total // BUCKET_TOKENS))
    rated = light.mapInArrow(_rated(spelling, buckets, rest, new), "bucket int, h long, n long, lp double")
    if not len(codes.keys) or 0 not in codes.keys:  # an end that no training text has is light
        ends = vocab.sparkSession.createDataFrame([(END, 0)], "token binary, n long").join(light.filter(F.col("token") == F.lit(END)), "token", "left_anti")
        rated = rated.unionByName(ends.mapInArrow(_rated(spelling, buckets, rest, new), "bucket int, h long, n long, lp double"))
    asked = docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(_ask(codes, running, buckets), _ASK)
    replies = asked.groupBy("bucket").cogroup(rated.groupBy("bucket")).applyInPandas(_answer, _REPLY)
    floor = float(np.log10(total + distinct + 1.0))
    return replies.groupBy("chunk").applyInPandas(_gather(floor, total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
