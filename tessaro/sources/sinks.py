"""Sinks that can be run again: partitions replaced, rows upserted, references deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of ``by`` that ``df`` has and leave the others; writing twice changes nothing."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``old`` with the rows of ``new`` put in their place by key; of several new rows the one with the largest ``order`` counts."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).withColumn("_order", F.lit(None)).unionByName(new.withColumn("_new", F.lit(1)).withColumn("_order", order))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", "_order")).alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*old.columns)


def cascade_deleted(tables: dict[str, DataFrame], references: dict[str, str], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that refer to a deleted id; ``gone`` has one column, ``references`` names the column of each table."""
    key = gone.columns[0]
    return {name: df.join(gone.select(F.col(key).alias(references[name])), references[name], "left_anti").select(*df.columns) for name, df in tables.items()}
