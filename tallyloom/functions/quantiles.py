"""Exact quantiles by group. No task holds a group: values are counted, ordered by range, and ranked with offsets by part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.scratch import materialize


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, upto, total): how many values of the group are no greater, and how many it has. Nulls don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    # written, so that a part keeps its rows if a task is run again
    dealt = materialize(counts.repartitionByRange(*keys, value).withColumn("__p", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "__p").agg(F.sum("__n").alias("__m"))  # no more rows than groups and parts together
    before = F.sum("__m").over(W.partitionBy(*keys).orderBy("__p")) - F.col("__m")
    offsets = parts.select(*keys, "__p", before.alias("__before"), F.sum("__m").over(W.partitionBy(*keys)).alias("total"))
    inside = dealt.withColumn("__upto", F.sum("__n").over(W.partitionBy(*keys, "__p").orderBy(value)))
    j = inside.join(offsets, _same(inside, offsets, keys) & (inside["__p"] == offsets["__p"]))
    return j.select(*[inside[k] for k in keys], inside[value], (F.col("__before") + F.col("__upto")).alias("upto"), "total")


def with_quantiles(groups: DataFrame, df: DataFrame, keys: list[str], value: str, nearest: dict[str, float] | None = None, median: str | None = None) -> DataFrame:
    """`groups` (a row a group of df) with nearest-rank quantiles (the element at ceil(n * q), from 1) and a median of the middle two."""
    ranks = value_ranks(df, keys, value)
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    out = {name: at(F.ceil(F.col("total") * F.lit(q))) for name, q in (nearest or {}).items()}
    if median:
        out[median] = at(F.floor((F.col("total") + 1) / 2)) * 0.5 + at(F.floor(F.col("total") / 2) + 1) * 0.5
    q = ranks.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])
    return groups.join(q, _same(groups, q, keys), "left").select(*[groups[c] for c in groups.columns], *[q[n] for n in out])
