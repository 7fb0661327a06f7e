"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), returns a DataFrame that is written as Parquet and reread for the
next, and works on all that its predecessor kept. All but the last return the columns of documents.
Their defined cases (nulls, empty texts, ties, repeated rows) are those of the operators they call.
"""

from __future__ import annotations

import uuid

from tallyloom.llm import decontaminate, langid, mixing, neardup, sharding
from tallyloom.llm.common import scratch_dir, table


def identify_language(spark, docs, sf_dir):
    """Documents without text or without any letter go."""
    return langid.drop_unidentified(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents with 5 % or more of their words in benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def assign_shards(spark, docs, sf_dir):
    """One row for each record with its shard and its place there."""
    return sharding.place(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("mix_sources", mix_sources), ("shard", assign_shards)]

#: Language ID and near-dedup have no SQL form; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = f"{scratch_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
