"""Reports and generations as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(sections: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder a section."""
    for name, df in sections.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def publish_generation(rows: DataFrame, generation: str, path: str) -> None:
    """Write a generation's rows, partitioned by generation and table, with their seed keys; other generations stay."""
    keys = F.array_distinct(F.array_compact(F.array(F.col("path"), F.col("project_id"), F.col("policy_id"))))
    out = rows.withColumns({"generation": F.lit(generation), "seed_keys": keys}).sortWithinPartitions("table_name", "row_key")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "table_name").parquet(path)


def read_generation(spark: SparkSession, path: str, generation: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("generation") == generation)
