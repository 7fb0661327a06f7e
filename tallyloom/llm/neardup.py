"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts hashes words and shingles and keeps, a document: a key of its word sequence, the
   size of its shingle set, BANDS band hashes of ROWS minima each, and B low bits of all minima packed.
2. Documents of one word sequence are one class (smallest doc_id); only classes go on.
3. Classes that share a band are candidates. Within a bucket the packed bits are compared by bit counts,
   corrected for chance collisions, and every class proposes its most similar partner. Proposals are
   confirmed on full shingle sets and confirmed links joined to components; buckets of one component are done.
   In the others the classes outside the main component are compared, on full
   sets and inside the task, with every class of another component that could reach the threshold; only links
   are given out. So rows follow the number of classes, while no candidate pair between two components
   stays unchecked.
   Buckets of more than BLOCK classes are cut into blocks, and so are their asking classes: a task's group is
   one block of asking classes against one block of the bucket's.

With 36 bands of 5 minima, a pair at similarity 0.8 shares no band with probability 6e-7; the estimate's
cut lies 4.5 standard deviations below the threshold.

Shingles have SHINGLE words or as many as the caller says.

Defined cases: without words (or text) the set is empty, links with nothing, and the document is kept. With
fewer words than a shingle has, the whole sequence is the set's only one. Rows without doc_id have a null component and are kept. Rows that agree
in doc_id are one node. Ties go to the smallest doc_id. Extra columns are kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import chunks, join_keys, materialize, sliced
from tallyloom.llm.components import components

BANDS, ROWS, B = 36, 5, 2
HASHES = BANDS * ROWS
#: Words of a shingle, unless the caller says otherwise.
SHINGLE, PER_CENT = 5, 80
BLOCK = 1500
#: Partners that a class proposes in each of the first rounds; the last round settles all that is left.
PROPOSALS = (1,)
_U = np.uint64
_BYTE = np.random.default_rng(101).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_POW, _MIX1, _MIX2, _ONE = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x5851F42D4C957F2D)
_rng = np.random.default_rng(202)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and each word's text number."""
    joined = b" ".join(texts) + b" "
    b = np.frombuffer(joined, np.uint8)
    gap = _SPACE[b]
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    size = last - first
    at = np.flatnonzero(~gap)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(size.max()), _POW)]), dtype=np.uint64)
    h = np.add.reduceat(_BYTE[b[at]] * power[place], np.cumsum(size) - size)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _mix(h + size.astype(np.uint64) * _ONE), np.searchsorted(ends, first, side="right")


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words (of fewer words: of the whole sequence)."""
    h, doc = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    end = np.cumsum(n)
    # by[k]: hashes of k + 1 words from each place
    by = [_mix(h ^ _MIX2)]
    for k in range(1, width):
        by.append(_mix(by[-1][:-1] * _POW + (h[k:] ^ _ONE)) if len(by[-1]) > 1 else by[-1][:0])
    out = []
    for i in range(len(texts)):
        s, k = end[i] - n[i], min(int(n[i]), width)
        out.append(np.unique(by[k - 1][s : end[i] - k + 1]) if k else h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(HASHES, sets) minima of 32-bit hashes; the sets are not empty."""
    x = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((HASHES, len(sets)), np.uint32)
    t = np.empty_like(x)
    for k in range(HASHES):
        np.bitwise_xor(x, _XOR[k], out=t)
        np.multiply(t, _MUL[k], out=t)
        np.minimum.reduceat(t, starts, out=out[k])
    return out


def bands_of(minima: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit hashes of each band's minima and number."""
    m = minima.reshape(BANDS, ROWS, -1).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[:, None] * _ONE
    for r in range(ROWS):
        h = _mix(h * _POW + m[:, r])
    return h.T.view(np.int64)


def packed(minima: np.ndarray) -> np.ndarray:
    """(sets, words) 64-bit words of B bits of each minimum."""
    low = ((minima >> np.uint32(9)) & np.uint32(2**B - 1)).astype(np.uint64)
    per = 64 // B
    pad = (-HASHES) % per
    low = np.concatenate([low, np.zeros((pad, low.shape[1]), np.uint64)])
    shift = (np.arange(per, dtype=np.uint64) * _U(B))[None, :, None]
    return np.bitwise_or.reduce(low.reshape(-1, per, low.shape[1]) << shift, axis=1).T


_LOW = _U(sum(1 << (B * i) for i in range(64 // B)))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures (broadcasting), corrected for chance collisions of B bits."""
    x = a ^ b
    x = (x | (x >> _U(1))) & _LOW
    equal = 1 - np.bitwise_count(x).sum(-1) / HASHES
    return (equal - 2.0**-B) / (1 - 2.0**-B)


def cut(threshold: float) -> float:
    """The threshold less 4.5 standard deviations of the estimate."""
    p = threshold + (1 - threshold) * 2.0**-B
    return threshold - 4.5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-B)


def _fold(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _describe(width: int):
    def describe(batches):
        for batch in sliced(batches):
            ids, texts = batch.column("doc_id"), [_fold(t) for t in batch.column("text").to_pylist()]
            for s, e in chunks(texts):
                part = texts[s:e]
                keys = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in part]
                sets = shingle_sets(part, width)
                n = np.array([len(x) for x in sets], np.int64)
                at = np.flatnonzero(n)
                bands: list = [[]] * len(part)
                sig: list = [None] * len(part)
                if len(at):
                    m = signatures([sets[i] for i in at])
                    for i, x, y in zip(at.tolist(), bands_of(m), packed(m)):
                        bands[i], sig[i] = x, y.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), pa.array(keys, pa.binary()), pa.array(n), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "key", "n", "bands", "sig"])

    return describe


def _sets(width: int):
    def sets(batches):
        for batch in sliced(batches):
            texts = [_fold(t) for t in batch.column("text").to_pylist()]
            for s, e in chunks(texts):
                got = shingle_sets(texts[s:e], width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), pa.array([x.tobytes() for x in got], pa.binary())], ["cid", "hashes"])

    return sets


def _confirm(per_cent: int):
    def confirm(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(p), len(q)) * 100 < per_cent * max(len(p), len(q)):
                    ok.append(False)
                    continue
                z = np.sort(np.concatenate([p, q]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                ok.append(100 * both >= per_cent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return confirm


def _grouped(work, out_names: list[str]):
    """Run `work` on whole (band, block) groups of rows sorted by them, 20,000 rows or so at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < 20_000 and sum(b.nbytes for b in held) < 32 << 20:
                continue
            rows = pa.Table.from_batches(held)
            # the last group may go on in the next batch
            band, blk = rows.column("band").to_numpy(), rows.column("block").to_numpy()
            own = np.flatnonzero((band != band[-1]) | (blk != blk[-1]))
            n = int(own[-1]) + 1 if len(own) else 0
            if n:
                yield flush(rows.slice(0, n))
            held = rows.slice(n).to_batches()
            size = len(rows) - n
        if size:
            yield flush(pa.Table.from_batches(held))

    def flush(rows: pa.Table):
        band, blk, cid, comp, asks = (rows.column(k).to_numpy() for k in ("band", "block", "cid", "comp", "asks"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(len(cid), -1)
        edge = np.flatnonzero((band[1:] != band[:-1]) | (blk[1:] != blk[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(cid)]])
        out = list(work(rows, starts, ends, cid, comp, asks, sig))
        a, b = (np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], out_names)

    return run


def _propose(most: int, least: float):
    """The `most` best partners outside its own component of every asking class of a bucket's block."""

    def work(rows, starts, ends, cid, comp, asks, sig):
        two = ends - starts == 2  # most buckets: all at once
        p = starts[two]
        p = p[(comp[p] != comp[p + 1]) & (similarity(sig[p], sig[p + 1]) >= least)]
        yield cid[p], cid[p + 1]
        for s, e in zip(starts[~two].tolist(), ends[~two].tolist()):
            m, who = e - s, np.flatnonzero(asks[s:e]) + s
            step = max(1, 200_000 // m)  # 48 bytes a pair, three times
            for k in range(0, len(who) if m > 1 else 0, step):
                own = who[k : k + step]
                est = similarity(sig[own, None], sig[None, s:e])
                est[(comp[own, None] == comp[None, s:e]) | (est < least)] = -1
                top = np.argpartition(-est, most - 1, axis=1)[:, :most] if most < m else np.tile(np.arange(m), (len(own), 1))
                ok = np.take_along_axis(est, top, 1) >= 0
                yield cid[np.repeat(own, ok.sum(1))], cid[s + top[ok]]

    return _grouped(work, ["a", "b"])


def _settle(per_cent: int, least: float):
    """Links of every asking class to the block's members of other components, on full sets; one link a component."""

    def work(rows, starts, ends, cid, comp, asks, sig):
        raw, member = rows.column("hashes").to_pylist(), rows.column("member").to_numpy()
        for s, e in zip(starts.tolist(), ends.tolist()):
            who = np.flatnonzero(asks[s:e])
            if e - s < 2 or not len(who):
                continue
            size = np.array([len(x) // 8 for x in raw[s:e]])
            at = np.cumsum(size) - size
            _, ids = np.unique(np.frombuffer(b"".join(raw[s:e]), np.uint64), return_inverse=True)
            mine = np.zeros(int(ids.max()) + 1, bool)
            for i in who.tolist():
                ok = member[s:e] & (comp[s:e] != comp[s + i]) & (100 * np.minimum(size, size[i]) >= per_cent * np.maximum(size, size[i]))
                ok &= similarity(sig[s + i], sig[s:e]) >= least
                if not ok.any():
                    continue
                own = ids[at[i] : at[i] + size[i]]
                mine[own] = True
                both = np.add.reduceat(mine[ids], at, dtype=np.int64)
                mine[own] = False
                found = np.flatnonzero(ok & (100 * both >= per_cent * (size + size[i] - both)))
                _, one = np.unique(comp[s:e][found], return_index=True)
                yield np.full(len(one), cid[s + i]), cid[s + found[one]]

    return _grouped(work, ["a", "b"])


def link_classes(described: DataFrame, docs: DataFrame, per_cent: int = PER_CENT, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) over class ids (smallest doc_id) from the pass's rows."""
    least = cut(per_cent / 100)
    classes = materialize(described.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).select("cid", "bands", "sig"))
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = banded.join(shared, "band")
    members = materialize(members.join(classes.select("cid", "sig"), "cid"))
    wanted = materialize(members.select("cid").distinct())
    texts = join_keys(docs.select("doc_id", "text"), wanted.select(F.col("cid").alias("doc_id")), ["doc_id"], "left_semi")
    sets = materialize(texts.mapInArrow(_sets(shingle), "cid long, hashes binary"))
    a, b = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("hashes").alias("sb"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cid", "band"), blocks).cast("int")
    rows = members.select("band", own.alias("block"), "cid", F.col("cid").alias("comp"), F.lit(True).alias("asks"), "sig")
    comps = None
    for k in [*PROPOSALS, None]:
        if comps is not None:
            rows = _unsettled(members, comps, blocks, own)
        rows = rows if k else rows.join(sets, "cid")
        rows = rows.repartition("band", "block").sortWithinPartitions("band", "block")
        if k:
            pairs = rows.mapInArrow(_propose(k, least), "a long, b long").distinct()
            found = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(per_cent), "a long, b long, linked boolean").filter("linked").select("a", "b")
        else:
            found = rows.mapInArrow(_settle(per_cent, least), "a long, b long")
        found = materialize(found.distinct())
        if comps is not None and not found.limit(1).count():
            continue
        # links known before are stars already
        links = found if comps is None else found.unionByName(comps.select(F.col("node").alias("a"), F.col("root").alias("b")))
        comps = materialize(components(links, "a", "b"))
    return comps


def _unsettled(members: DataFrame, comps: DataFrame, blocks, own) -> DataFrame:
    """The buckets that hold more than one component. Classes outside a bucket's main component ask.

    Askers are dealt to blocks of their own. A group is a block of the bucket's classes (member) with a block of its
    askers (asks), and every asker meets every class in exactly one group.
    """
    rows = members.join(comps, members["cid"] == comps["node"], "left").select(members["*"], F.coalesce("root", "cid").alias("comp"))
    askers = F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("ask_blocks")
    mixed = rows.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), askers).filter("comps > 1").select("band", "main", "ask_blocks")
    rows = rows.join(mixed, "band").withColumns({"asks": F.col("comp") != F.col("main"), "own": own, "blocks": blocks, "ask": F.pmod(F.xxhash64("band", "cid", F.lit("ask")), "ask_blocks").cast("int")})
    place = lambda i, j, asks, member: F.struct((i * F.col("ask_blocks") + j).alias("block"), asks.alias("asks"), member.alias("member"))
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: place(i, F.col("ask"), F.lit(True), i == F.col("own")))
    asked = F.transform(F.sequence(F.lit(0), F.col("ask_blocks") - 1), lambda j: place(F.col("own"), j, F.lit(False), F.lit(True)))
    # an asker is a member of its own block beside the other blocks of askers, too
    other = F.filter(asked, lambda x: x["block"] != F.col("own") * F.col("ask_blocks") + F.col("ask"))
    rows = rows.select("band", "cid", "comp", "sig", F.explode(F.when(F.col("asks"), F.concat(asking, other)).otherwise(asked)).alias("at"))
    return rows.select("band", "at.block", "cid", "comp", "at.asks", "at.member", "sig")


def cluster(docs: DataFrame, per_cent: int = PER_CENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; sets are shingles of `shingle` words."""
    described = materialize(docs.select("doc_id", "text").mapInArrow(_describe(shingle), "doc_id long, key binary, n long, bands array<long>, sig binary"))
    comps = link_classes(described, docs, per_cent, shingle)
    rows = described.select("doc_id", "key", "n")
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("cid"))
    roots = classes.join(comps, classes["cid"] == comps["node"], "left").select("key", F.coalesce("root", "cid").alias("root"))
    out = rows.join(roots, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.least("root", "doc_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, per_cent: int = PER_CENT, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, the one of the smallest doc_id; rows without doc_id stay. All columns kept.

    Of rows that share a doc_id the one of the least hash of all columns stays.
    """
    gone = materialize(cluster(docs, per_cent, shingle).filter(~F.col("kept")).select("doc_id"))
    out = join_keys(docs, gone.distinct(), ["doc_id"], "left_anti")
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", digest.alias("h"))
    again = materialize(known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("h")).filter("n > 1").select("doc_id", "h"))
    if not again.limit(1).count():
        return out
    # a row travels as one struct, so that no column of the caller meets one of these
    packed = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", digest.alias("h"))
    first = join_keys(packed, again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id"]).select("row.*")
    return join_keys(out, again.select("doc_id"), ["doc_id"], "left_anti").unionByName(first)
