"""What the operators of this folder share: scratch tables, size-checked joins, text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scratch import materialize, scratch_dir

#: A key table of at most this many rows (16 bytes a row and the hash table) may be broadcast.
BROADCAST_KEYS = 400_000

#: ASCII capitals and their small letters; only these are folded, `É` stays `É`.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of one byte a character take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def join_keys(big: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join against a key table: broadcast when it has at most BROADCAST_KEYS rows, else by shuffle.

    Keys are compared null-safely. `keys` should be materialized, as it is counted first.
    """
    small = keys.select(*[F.col(c).alias(f"__k_{c}") for c in on])
    if small.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        small = F.broadcast(small)
    cond = [big[c].eqNullSafe(small[f"__k_{c}"]) for c in on]
    return big.join(small, cond, how)


def sliced(batches, rows: int = 512):
    """The batches in slices of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def chunks(texts: list, limit: int = 1 << 20):
    """(start, end) ranges of a list of byte strings of about `limit` bytes each, so that numpy work stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


__all__ = ["BROADCAST_KEYS", "ascii_lower", "chunks", "join_keys", "materialize", "scratch_dir", "sliced", "table"]
