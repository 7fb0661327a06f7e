"""Removal of repeated byte strings: every byte covered by a SPAN-byte string that also starts elsewhere.

1. Dealing: the least hash of the GRAM-byte strings within each SHORT-byte window is its anchor, so equal windows
   have equal anchors, and so have equal SPAN-byte windows, which begin with equal SHORT-byte ones. The texts' bytes
   around anchors that occur more than once in the corpus are dealt out by anchor; all others hold no repeat.
2. Suffix array: each task parses its pieces into chunks between content-defined marks (the least hash of the 8-byte
   strings of each STEP-byte window), so that pieces are sequences of chunk numbers, and sorts all their suffixes by the
   grouping construction of `gsaca` (Lyndon-prefix groups in descending order, previous-smaller pointers). Common
   prefixes of neighbours give the intervals of suffixes that share k chunks, for each k.
3. A window from s has its first mark p and its last certain mark q within STEP + 7 bytes of its ends, both set by its
   own bytes alone. So two windows are equal if and only if their suffixes at p lie in one interval of the k chunks
   between p and q, and the bytes before p and after q agree. Windows that agree so are neighbours after one
   sort; each pair is confirmed on its bytes.

Equal texts are collapsed first: they are covered whole, and one of them stands for all in the search.
Anchors whose pieces hold more than BLOCK bytes are dealt out in blocks; a window not settled within its block is
compared with the other blocks' windows by a shuffled count, so no task holds a group of unbounded size.

The same search finds the strings of SHORT bytes (a passage of 50 words or so) that start elsewhere in another text or
in the same one. They aren't removed; `n_shared` counts the bytes they cover, whole copies of a text aside.

Defined cases: a null text is empty; texts of less than SPAN bytes lose nothing; runs of a text may overlap
themselves; rows that agree in doc_id and text are two equal texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import chunks, join_keys, materialize, sliced
from tallyloom.llm.gsaca import suffix_array

SPAN, SHORT, GRAM = 400, 250, 64
#: Bytes of a mark's window; the 8-byte string of its last place reaches 7 bytes further.
STEP = 96
#: Bytes of one anchor's pieces in a task, about.
BLOCK = 1 << 20
#: Window starts of a piece; longer runs of one anchor (periodic texts) are several pieces.
RUN = 1 << 15
_U = np.uint64
_BYTE = np.random.default_rng(303).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_A, _B = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)
_POW = 0x5851F42D4C957F2D
_HIGH, _LOW = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * _A + y
    h ^= h >> _U(32)
    h *= _B
    h ^= h >> _U(29)
    return h


def string_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each position: powers of two by doubling, joined from the largest down."""
    level, m, parts = _BYTE[b], 1, []
    out, done = None, 0
    while m <= size:
        if size & m:
            parts.append((m, level))
        if 2 * m > size:
            break
        level = _join(level[:-m], level[m:]) if len(level) > m else level[:0]
        m *= 2
    n = len(b) - size + 1
    for m, level in reversed(parts):
        piece = level[done : done + n]
        out = piece.copy() if out is None else _join(out, piece)
        done += m
    return out


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w, from the running minima of blocks of w."""
    n = len(h)
    x = np.concatenate([h, np.full((-n) % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def least_places(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least hash (by its high half, the leftmost of equals) in each window of w."""
    return (window_minima((h & _HIGH) | np.arange(len(h), dtype=np.uint64), w) & _LOW).astype(np.int64)


# ---- dealing by anchor ----


def anchors(texts: list[bytes]):
    """(text number, anchor, lo, hi, again) as arrays: the SHORT-byte windows of a text that start in [lo, hi) have this
    anchor; again: at more than one place, so that two of them may be equal."""
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    h = string_hashes(np.frombuffer(b"".join(texts), np.uint8), GRAM)
    place = least_places(h, SHORT - GRAM + 1)
    who = np.repeat(np.arange(len(texts)), size)[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + SHORT <= end[who])  # no window crosses texts
    who, place = who[at], place[at]
    fp = h[place]
    new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (who[1:] != who[:-1])]) if len(at) else np.empty(0, bool)
    start = np.flatnonzero(new)
    if len(at) > RUN and np.diff(start, append=len(at)).max() > RUN:
        size_of = np.diff(start, append=len(at))
        start = np.concatenate([np.arange(s, s + n, RUN) for s, n in zip(start.tolist(), size_of.tolist())])
    moved = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
    last = np.concatenate([start[1:], [len(at)]]) - 1
    first = (end - size)[who[start]]
    return who[start], fp[start].view(np.int64), (at[start] - first).astype(np.int32), (at[last] + 1 - first).astype(np.int32), moved[last] > moved[start]


def _anchor_rows(batches):
    for batch in sliced(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        for s, e in chunks(texts):
            if sum(map(len, texts[s:e])) < SHORT:
                continue
            who, *cols = anchors(texts[s:e])
            part = batch.slice(s, e - s).select(["doc_id", "cls"]).take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, cols)], ["doc_id", "cls", "fp", "lo", "hi", "again"])


def _pieces(batches):
    def out(rows):
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["fp", "block", "cut", "cls", "lo", "starts", "seg"])

    for batch in sliced(batches):
        rows = []
        for c, t, own in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), batch.column("own").to_pylist()):
            b = t.encode()
            for r in own:
                rows.append((r["fp"], r["block"], r["cut"], c, r["lo"], r["hi"] - r["lo"], b[r["lo"] : r["hi"] + SPAN - 1]))
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


# ---- one task's search ----


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; places near the end are short of some."""
    x = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << _U(8 * step))
    return x


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` bytes from each a and b agree."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a), 65536):
        x, y, ok = a[s : s + 65536], b[s : s + 65536], np.ones(min(65536, len(a) - s), bool)
        for o in (*range(0, size - 8, 8), size - 8):
            ok &= words[x + o] == words[y + o]
        out[s : s + 65536] = ok
    return out


class Pieces:
    """Distinct pieces of text with the suffix array of their chunk sequences."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces])
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = _words(self.data)
        h = (self.words ^ (self.words >> _U(31))) * _A
        self.mark = least_places(h ^ (h >> _U(29)), STEP)  # of the window from each place
        reach = STEP + 7
        sure = np.concatenate([np.arange(f, f + n - reach + 1) for f, n in zip(self.first.tolist(), self.size.tolist())])
        marks = np.unique(self.mark[sure])
        self.number = np.zeros(len(self.data), np.int64)  # of the mark at a place
        self.number[marks] = np.arange(len(marks))
        owner = np.searchsorted(self.first, marks, side="right")
        raw, known, seq = self.data.tobytes(), {}, []
        places, who = marks.tolist(), owner.tolist()
        for i in range(len(places) - 1):
            seq.append(known.setdefault(raw[places[i] : places[i + 1]], len(known) + 1) if who[i] == who[i + 1] else 0)
        seq.append(0)  # 0 ends a piece
        self.seq = np.array(seq)
        self.order = np.array(suffix_array(seq), np.int64)
        self.rank = np.empty(len(seq), np.int64)
        self.rank[self.order] = np.arange(len(seq))
        # sums of byte values times powers, for hashes of any stretch
        value = _BYTE[self.data]
        n = len(self.data) + 1
        power = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(_POW))]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(pow(_POW, -1, 2**64)))]), dtype=np.uint64)
        self.sums, self.back = np.concatenate([[_U(0)], np.cumsum(value * power[:-1])]), back

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes in [a, b)."""
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def common(self, most: int) -> np.ndarray:
        """How many chunks, up to `most`, each suffix in the array's order shares with the one before."""
        out = np.zeros(len(self.order), np.int64)
        now = np.arange(1, len(self.order))
        for k in range(most):
            a, b = self.order[now] + k, self.order[now - 1] + k
            fits = np.maximum(a, b) < len(self.seq)
            now = now[fits][self.seq[a[fits]] == self.seq[b[fits]]]
            if not len(now):
                break
            out[now] = k + 1
        return out

    def repeated(self, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, same, twice) of the windows of `size` bytes from `start`: an order in which equal windows are
        neighbours, whether each neighbour is equal to the one before, and whether a window has an equal."""
        p, q = self.mark[start], self.mark[start + size - STEP - 7]
        k = self.number[q] - self.number[p]
        shared = self.common(int(k.max(initial=0)))
        rank, interval = self.rank[self.number[p]], np.zeros(len(start), np.int64)
        by = np.argsort(k, kind="stable")
        edge = np.flatnonzero(np.diff(k[by], prepend=-1))
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(by)]):
            left = np.maximum.accumulate(np.where(shared < k[by[s]], np.arange(len(shared)), 0))  # each interval's first suffix
            interval[by[s:e]] = left[rank[by[s:e]]]
        ends = _join(self.stretch(start, p), self.stretch(q, start + size))
        key = _join(_join(ends, (interval * 512 + k).astype(np.uint64)), ((p - start) * 512 + (q - p)).astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = np.flatnonzero(same)
        same[hit] = _equal(self.words, start[order[hit]], start[order[hit + 1]], size)
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return order, same, twice


def _repeats(rows: list[tuple]):
    """(cls, start, end, size, fp, hash, settled) of one task's complete groups.

    rows: (fp, block, cut, cls, lo, starts, seg). Runs of window starts have fp None; for groups cut into blocks, one
    row for each distinct window follows, for the comparison between blocks.
    """
    by: dict[bytes, dict] = {}
    for r in rows:
        by.setdefault(r[6], {})[r[3], r[4]] = r
    many = [[*own.values()] for own in by.values()]
    held = Pieces(list(by))
    starts = np.array([max(r[5] for r in own) for own in many])
    copied = np.array([len(own) > 1 for own in many])
    for size in (SHORT, SPAN):
        n = np.clip(held.size - size + 1, 0, starts)
        piece = np.repeat(np.arange(len(many)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not len(pos):
            continue
        start = held.first[piece] + pos
        order, same, twice = held.repeated(start, size)
        twice |= copied[piece]
        run = np.flatnonzero(twice & np.concatenate([[True], ~twice[:-1] | (piece[1:] != piece[:-1])]))
        stop = np.flatnonzero(twice & np.concatenate([~twice[1:] | (piece[1:] != piece[:-1]), [True]]))
        for s, e in zip(run.tolist(), stop.tolist()):
            for r in many[piece[s]]:
                yield r[3], r[4] + int(pos[s]), r[4] + int(pos[e]) + 1, size, None, None, True
        lead = order[np.concatenate([[True], ~same])]
        lead = lead[np.array([any(r[2] for r in own) for own in many])[piece[lead]]]
        if len(lead):
            whole = string_hashes(held.data, size)
            for i in lead.tolist():
                r = many[piece[i]][0]
                yield r[3], r[4] + int(pos[i]), r[4] + int(pos[i]) + 1, size, r[0], int(whole[start[i]].view(np.int64)), bool(twice[i])


def _search(batches):
    """Rows sorted by (fp, block): whole groups are taken together, about 1 MB of pieces at a time."""
    held: list[tuple] = []
    size = 0

    def flush(rows):
        found = list(_repeats(rows))
        cols = list(zip(*found)) if found else [()] * 7
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["cls", "s", "e", "size", "fp", "h", "settled"])

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in ("fp", "block", "cut", "cls", "lo", "starts", "seg")]
        for row in zip(*cols):
            if size >= 1_000_000 and held[-1][:2] != row[:2]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield flush(held)


# ---- the job ----


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("cls"), "text")


def repeated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cls, whole, runs array<struct<s, e, size>>): per distinct text (cls = its MD5) the starts [s, e) of repeated windows
    of SHORT and of SPAN bytes; whole: equal texts exist."""
    rows = _keyed(docs).filter(F.octet_length("text") >= SHORT)
    classes = materialize(rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = rows.mapInArrow(_anchor_rows, "doc_id long, cls binary, fp long, lo int, hi int, again boolean")
    copies = classes.filter("n > 1").select("cls", "rep")
    spare = materialize(rows.select("doc_id", "cls").join(copies, "cls").filter(~F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "cls"))
    found = materialize(join_keys(found, spare, ["doc_id", "cls"], "left_anti").drop("doc_id"))
    shared = found.groupBy("fp").agg(F.count("*").alias("m"), F.max("again").alias("again"), F.sum(F.col("hi") - F.col("lo") + SPAN).alias("bytes")).filter("m > 1 or again").select("fp", "bytes")
    blocks = F.ceil(F.col("bytes") / block).cast("int")
    wanted = found.join(shared, "fp").select("cls", F.struct("fp", F.pmod(F.xxhash64("cls", "lo"), blocks).cast("int").alias("block"), (blocks > 1).alias("cut"), "lo", "hi").alias("x"))
    own = materialize(wanted.groupBy("cls").agg(F.collect_list("x").alias("own")))
    one = join_keys(rows, spare, ["doc_id", "cls"], "left_anti").select("cls", "text")
    pieces = one.join(own, "cls").select("cls", "text", "own").mapInArrow(_pieces, "fp long, block int, cut boolean, cls binary, lo int, starts int, seg binary")
    dealt = pieces.repartition("fp", "block").sortWithinPartitions("fp", "block")
    runs = materialize(dealt.mapInArrow(_search, "cls binary, s int, e int, size int, fp long, h long, settled boolean"))
    open_ = runs.filter("fp is not null")
    twice = open_.groupBy("fp", "size", "h").agg(F.count("*").alias("n")).filter("n > 1").select("fp", "size", "h")
    late = open_.filter("not settled").join(twice, ["fp", "size", "h"]).select("cls", "s", "e", "size")
    runs = runs.filter("fp is null").select("cls", "s", "e", "size").unionByName(late)
    by = runs.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("s", "e", "size"))).alias("runs"))
    whole = classes.filter("n > 1").select("cls", F.lit(True).alias("whole"))
    return whole.join(by, "cls", "full_outer").select("cls", F.coalesce("whole", F.lit(False)).alias("whole"), "runs")


def _spans(runs, size: int) -> list[list[int]]:
    """The stretches of bytes that the windows of `size` bytes cover."""
    out: list[list[int]] = []
    for r in runs or ():
        if r["size"] == size:
            s, e = r["s"], r["e"] - 1 + size
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
    return out


def _cut(batches):
    for batch in sliced(batches):
        cols: list[list] = [[] for _ in range(5)]
        for t, whole, runs in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), batch.column("runs").to_pylist()):
            b = (t or "").encode()
            spans = [[0, len(b)]] if whole and len(b) >= SPAN else _spans(runs, SPAN)
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(b[at:s])
                at = e
            kept.update(b[at:])
            shared = sum(e - s for s, e in _spans(runs, SHORT))
            for col, x in zip(cols, (len(b), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), shared)):
                col.append(x)
        n, gone, count, digest, shared = cols
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n, gone, count)], pa.array(digest, pa.string()), pa.array(shared, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])


def report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared."""
    found = materialize(repeated(docs, block))
    return _keyed(docs).join(found, "cls", "left").select("doc_id", "text", "whole", "runs").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")
