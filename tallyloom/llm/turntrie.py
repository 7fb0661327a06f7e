"""Prefix trie of conversations: which first turns are shared, by how many, and what sharing them saves.

1. `rebuilt` turns each conversation into arrays of turn ids (64-bit hashes of role and text) and of the bytes of each text;
   texts themselves never leave their scan.
2. Conversations are range-partitioned by (turn ids, conv_id), so that a prefix lies in neighbouring rows and a conversation with
   many copies is cut by conv_id. Each block of rows is a range shard: a padded matrix of turn ids, put in order by numpy's
   lexsort. A column's change mask, OR-ed with those before, marks where the nodes of that depth start; reduceat adds up every
   depth, from the deepest to the root. A block holds CELLS cells at most (or one conversation).
3. Nodes inside a block are final. Those on the path of its first or last row may go on in its neighbours: they are sent as
   parts under a key of their prefix and recombined by DataFrame operations. In the order of their first rows (preorder) a
   subtree is an interval, so what boundary nodes add to each other is a difference of running sums, kept by partition
   with offsets; no path is walked and no group is held.

The ids of conversations that end in a boundary node are hashed in order as a stream of pieces, a piece a block.

Defined cases: rows without conv_id belong to no conversation; a null role or text is empty; turns of one number are in the order of
role and then of the turn's hash; rows that agree in all columns are turns of their own; extra columns are ignored. An
empty table has no node, not even the root. Turns are told apart by 64-bit hashes. A conversation's ids (16 bytes a turn) are
one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import BROADCAST_KEYS, materialize

#: Cells of a block's matrix: 16 MB of ids.
CELLS = 1 << 21
PAD = -(1 << 63)
NOTHING = hashlib.sha256(b"").hexdigest()
#: How conversations share their beginnings: c takes the first crc32(c) % HEADS turns of c - c % FAMILY.
FAMILY, HEADS = 5, 9

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: a final node; 1: a part of a boundary node; 2: ids that end in a boundary node. pkey: the key of a parent on the boundary.
SHARD = f"kind int, {NODE}, key binary, pkey binary, pid int, seq int, srow int, erow int, size long, ends binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = {name: _TYPES[kind] for name, kind in (f.split() for f in SHARD.split(", "))}


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): each conversation's turn ids in order and the UTF-8 bytes of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lean = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.greatest(F.xxhash64(role, text), F.lit(PAD + 1)).alias("id"), F.octet_length(text).cast("long").alias("size"))
    # a struct's fields are compared in their order, nulls first
    own = lean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id", "size"))).alias("t"))
    return own.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(own: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Each conversation with the first h turns of the head of its family before its own turns after the first h."""
    head = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__base"), F.slice("ids", 1, heads - 1).alias("__i"), F.slice("sizes", 1, heads - 1).alias("__s"))
    j = own.withColumn("__base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).join(head, "__base", "left")
    none = F.array().cast("array<bigint>")
    both = lambda first, rest: F.concat(F.slice(F.coalesce(first, none), F.lit(1), F.col("h")), F.slice(rest, F.col("h") + 1, F.greatest(F.size(rest), F.lit(1))))
    return j.select("conv_id", both(F.col("__i"), F.col("ids")).alias("ids"), both(F.col("__s"), F.col("sizes")).alias("sizes"))


def _decimal(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _path_keys(ids: np.ndarray) -> list[bytes]:
    """A key for each prefix of a row, from the empty one."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for at in range(len(ids)):
        h.update(ids[at : at + 1].tobytes())
        out.append(h.copy().digest())
    return out


def _blocks(lens: np.ndarray, cells: int):
    """(start, end) of runs of rows whose padded matrix has at most `cells` cells, or of one row."""
    start, wide = 0, 1
    for i, n in enumerate(lens.tolist()):
        wide = max(wide, n)
        if i > start and wide * (i + 1 - start) > cells:
            yield start, i
            start, wide = i, max(1, n)
    if start < len(lens):
        yield start, len(lens)


class _Rows:
    """Columns of SHARD as they are gathered; those not given are null."""

    def __init__(self):
        self.parts: list[tuple[int, dict]] = []

    def add(self, n: int, **columns):
        self.parts.append((n, columns))

    def batch(self) -> pa.RecordBatch:
        made = lambda c, n, t: c.cast(t) if isinstance(c, pa.Array) else pa.nulls(n, t) if c is None else pa.array(c, t)
        arrays = [pa.concat_arrays([made(cols.get(name), n, t) for n, cols in self.parts]) for name, t in _FIELDS.items()]
        return pa.RecordBatch.from_arrays(arrays, list(_FIELDS))


def _shard(conv: np.ndarray, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, size_starts: np.ndarray, lens: np.ndarray, pid: int, seq: int) -> pa.RecordBatch:
    """The nodes of one block of conversations: row i has lens[i] turns from ids[starts[i]] and sizes[size_starts[i]] on."""
    n, wide = len(conv), int(lens.max())
    m, b = np.full((n, wide), PAD, np.int64), np.zeros((n, wide), np.int64)
    inside = np.arange(wide) < lens[:, None]
    m[inside], b[inside] = ids[(starts[:, None] + np.arange(wide))[inside]], sizes[(size_starts[:, None] + np.arange(wide))[inside]]
    order = np.lexsort((conv, *m.T[::-1]))
    m, b, conv, lens = m[order], b[order], conv[order], lens[order]
    # by depth: the rows at which nodes start, and those at which they end
    changed = np.zeros(n, bool)
    changed[0] = True
    levels = [(np.array([0]), np.array([n]))]
    for d in range(wide):
        changed[1:] |= m[1:, d] != m[:-1, d]
        s = np.flatnonzero(changed)
        e = np.append(s[1:], n)
        real = lens[s] > d
        levels.append((s[real], e[real]))

    def over(ufunc, values, end, s, e):
        """ufunc over values[s:e] of each node; rows between nodes belong to none."""
        cuts = np.column_stack([s, e]).ravel()
        return ufunc.reduceat(np.append(values, end), cuts)[::2]

    first, last = _path_keys(m[0, : lens[0]]), _path_keys(m[-1, : lens[-1]])
    out, most = _Rows(), np.iinfo(np.int64).max
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)  # what final nodes add, at their first rows
    below_s = final_s = np.zeros(0, np.int64)  # starts of the nodes one level down, and of the final ones
    least = over(np.minimum, conv, most, *levels[wide])
    for d in range(wide, -1, -1):
        s, e = levels[d]
        edge = (s == 0) | (e == n)
        total, final = e - s, np.flatnonzero(~edge)
        children = np.searchsorted(below_s, e) - np.searchsorted(below_s, s)
        own_bytes = b[s, d - 1] if d else np.zeros(1, np.int64)
        leaves[s[final]] += children[final] == 0
        saved[s[final]] += ((total - 1) * own_bytes)[final]
        n_leaves, n_saved = over(np.add, leaves, 0, s, e), over(np.add, saved, 0, s, e)
        stop = over(np.add, (lens == d).astype(np.int64), 0, s, e)  # those who end here sort before those who go on
        keys, up_least, up_edge = [None] * len(s), np.zeros(len(s), np.int64), np.zeros(len(s), bool)
        if d:
            up_s, up_e = levels[d - 1]
            up, own_least = np.searchsorted(up_s, s, "right") - 1, over(np.minimum, conv, most, up_s, up_e)
            up_least, up_edge = own_least[up], ((up_s == 0) | (up_e == n))[up]
            keys = [(first if zero else last)[d - 1] if on else None for zero, on in zip((up_s[up] == 0).tolist(), up_edge.tolist())]
        if len(final):
            sha = [hashlib.sha256(_decimal(conv[i : i + c])).hexdigest() if c else NOTHING for i, c in zip(s[final].tolist(), stop[final].tolist())]
            out.add(len(final), kind=np.zeros(len(final), np.int32), conv_id=least[final], depth=np.full(len(final), d), parent_conv_id=pa.array(up_least[final], mask=up_edge[final]), n_convs=total[final], n_children=children[final], n_leaves=n_leaves[final], saved_tokens=n_saved[final], ends_sha256=sha, pkey=[keys[i] for i in final.tolist()])
        for i in np.flatnonzero(edge).tolist():
            place = {"key": [(first if s[i] == 0 else last)[d]], "pid": [pid], "seq": [seq]}
            inner = int(np.searchsorted(final_s, e[i]) - np.searchsorted(final_s, s[i]))
            out.add(1, kind=[1], conv_id=least[i : i + 1], depth=[d], n_convs=total[i : i + 1], n_children=[inner], n_leaves=n_leaves[i : i + 1], saved_tokens=n_saved[i : i + 1], pkey=[keys[i]], srow=[int(s[i])], erow=[int(e[i]) - 1], size=own_bytes[i : i + 1], **place)
            if stop[i]:
                out.add(1, kind=[2], ends=[_decimal(conv[s[i] : s[i] + stop[i]])], **place)
        below_s, final_s = s, s[final]
        least = own_least if d else None
    return out.batch()


def _sharder(cells: int):
    def shard(batches):
        seq = 0
        for batch in batches:
            ids, sizes = batch.column("ids"), batch.column("sizes")
            at, size_at = ids.offsets.to_numpy(), sizes.offsets.to_numpy()
            flat, flat_sizes = ids.values.to_numpy(), sizes.values.to_numpy()
            conv, pid, lens = batch.column("conv_id").to_numpy(), batch.column("pid").to_numpy(), np.diff(at).astype(np.int64)
            for s, e in _blocks(lens, cells):
                yield _shard(conv[s:e], flat, flat_sizes, at[s:e], size_at[s:e], lens[s:e], int(pid[s]), seq)
                seq += 1

    return shard


def _hash_pieces(batches):
    """SHA-256 of each key's pieces, which come in order; a piece is in memory at a time."""
    key, h, done = None, None, ([], [])
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends")):
            if k != key:
                if h is not None:
                    done[0].append(key)
                    done[1].append(h.hexdigest())
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.as_buffer())
    if h is not None:
        done[0].append(key)
        done[1].append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["key", "sha"])


def _running(rows: DataFrame, values: list[str]) -> DataFrame:
    """`rows` with the sum of each value over all rows up to it in the order (pid, seq, row, depth), as `<value>_cum`."""
    parts = rows.groupBy("pid").agg(*[F.sum(v).alias(v) for v in values])  # a row a partition
    offsets = parts.select("pid", *[(F.sum(v).over(W.orderBy("pid")) - F.col(v)).alias(f"{v}_off") for v in values])
    inside = W.partitionBy("pid").orderBy("seq", "row", "depth").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(v).over(inside).alias(f"{v}_in") for v in values])
    return summed.join(F.broadcast(offsets), "pid").select(*rows.columns, *[(F.col(f"{v}_in") + F.col(f"{v}_off")).alias(f"{v}_cum") for v in values])


def _recombine(shards: DataFrame) -> DataFrame:
    """The boundary nodes from their parts: (key, conv_id, depth, pkey, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    parts = shards.filter("kind = 1")
    place = F.struct("pid", "seq")
    whole = materialize(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("pkey").alias("pkey"), F.first("size").alias("size"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min(F.struct("pid", "seq", "srow")).alias("lo"), F.max(F.struct(place.alias("p"), F.col("erow"))).alias("hi")))
    kids = whole.filter(F.col("pkey").isNotNull()).groupBy(F.col("pkey").alias("key")).agg(F.count("*").alias("more"))
    nodes = materialize(whole.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    # what each adds to its subtree, in preorder, and the ends of all subtrees as rows of no weight
    adds = [F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("save")]
    enter = nodes.select("key", F.lit(True).alias("enter"), "lo.pid", "lo.seq", F.col("lo.srow").alias("row"), "depth", *adds)
    leave = nodes.select("key", F.lit(False).alias("enter"), "hi.p.pid", "hi.p.seq", F.col("hi.erow").alias("row"), F.lit(1 << 62).alias("depth"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("save"))
    cum = _running(materialize(enter.unionByName(leave)), ["leaf", "save"])
    # up to the end of the subtree, less what came before the node itself
    own = lambda v: F.sum(F.when(F.col("enter"), F.col(v) - F.col(f"{v}_cum")).otherwise(F.col(f"{v}_cum")))
    sums = cum.groupBy("key").agg(own("leaf").alias("leaf"), own("save").alias("save"))
    pieces = shards.filter("kind = 2").select("key", "pid", "seq", "ends").repartition("key").sortWithinPartitions("key", "pid", "seq")
    ends = pieces.select("key", "ends").mapInArrow(_hash_pieces, "key binary, sha string")
    out = nodes.join(sums, "key").join(ends, "key", "left")
    return out.select("key", "conv_id", "depth", "pkey", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("save")).alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))


def trie(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Every node of the prefix trie of (conv_id, ids, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    dealt = materialize(convs).repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id").withColumn("pid", F.spark_partition_id())
    shards = materialize(dealt.mapInArrow(_sharder(cells), SHARD))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    edge = materialize(_recombine(shards))
    up = edge.select(F.col("key").alias("pkey"), F.col("conv_id").alias("up"))
    if up.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        up = F.broadcast(up)
    both = shards.filter("kind = 0").select(*names, "pkey").unionByName(edge.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names, "pkey"))
    return both.join(up, "pkey", "left").withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id")).select(*names)


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(materialize(turns(conversations))))


def oracle_sql() -> str:
    return """
WITH RECURSIVE o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT 0::UBIGINT AS i, 0::UBIGINT AS v, 0 AS s UNION ALL SELECT CASE WHEN s = 8 THEN i + 1 ELSE i END, CASE WHEN s = 8 THEN i + 1 WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, CASE WHEN s = 8 THEN 0 ELSE s + 1 END FROM bits WHERE i < 256),
crct AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE s = 8),
ids AS (SELECT DISTINCT conv_id FROM o),
crc AS (
  SELECT conv_id, 4294967295::UBIGINT AS v, CAST(conv_id AS VARCHAR) AS left_over FROM ids
  UNION ALL
  SELECT conv_id, xor(v // 256, (SELECT t FROM crct)[1 + (xor(v % 256, ascii(left_over[1])::UBIGINT))::BIGINT]), left_over[2:] FROM crc WHERE left_over <> ''),
h AS (SELECT conv_id, (xor(v, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM crc WHERE left_over = ''),
parts AS (
  SELECT h.conv_id, o.k, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 WHERE o.k <= h.h
  UNION ALL
  SELECT h.conv_id, 1000000 + o.k, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id WHERE o.k > h.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, sha256(concat(length(role), ':', role, text)) AS t, strlen(text) AS b FROM parts),
pre AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS key, NULL::VARCHAR AS up, 0::BIGINT AS b FROM ids
  UNION ALL
  SELECT r.conv_id, r.d, sha256(p.key || r.t), p.key, r.b FROM pre p JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1),
deep AS (SELECT conv_id, max(d) AS top FROM pre GROUP BY conv_id),
node AS (SELECT d, key, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS c, count(*) AS n FROM pre GROUP BY d, key),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
ends AS (SELECT pre.d, pre.key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM pre JOIN deep USING (conv_id) WHERE pre.d = deep.top GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, key)),
below AS (
  SELECT a.d, a.key, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n - 1) * f.b) AS saved
  FROM (SELECT DISTINCT p.d, p.key, q.d AS d2, q.key AS key2 FROM pre p JOIN pre q ON p.conv_id = q.conv_id AND q.d >= p.d) a
  JOIN full_node f ON f.d = a.d2 AND f.key = a.key2 GROUP BY 1, 2)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_node f JOIN below USING (d, key) LEFT JOIN ends USING (d, key) LEFT JOIN node u ON u.d = f.d - 1 AND u.key = f.up
"""
