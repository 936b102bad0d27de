"""Ordered scans over groups of any size.

A window function sorts each group inside one task, which fails when one group holds a third of
all rows. Here the rows are range-sorted over all groups together, so that a large group spreads
over many partitions; what a partition must know of the rows before it is carried over in one
small summary for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: The column with the number of a row's range partition.
PARTITION = "_partition"


def range_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` sorted over all its partitions by ``keys`` and ``order``, with ``PARTITION`` added.

    The result is checkpointed: range bounds come from a sample, so two evaluations might
    otherwise cut the rows in different places.
    """
    by = [*keys, *order]
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(spread.withColumn(PARTITION, F.spark_partition_id()))


def carried(summaries: DataFrame, keys: Sequence[str], combine: dict[str, Column]) -> DataFrame:
    """What each partition inherits from the earlier partitions of its first group.

    ``summaries`` has one row for each group and partition in which the group occurs. ``combine``
    gives an aggregate over the earlier summaries for each column of the result. A group runs on
    into a partition only as that partition's first group, so the result has at most one row for
    each partition: that bounds the size of a broadcast of it.
    """
    before = Window.partitionBy(*keys).orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    found = summaries.select(PARTITION, *(c.over(before).alias(name) for name, c in combine.items()))
    return found.where(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in combine)))


def with_carried(df: DataFrame, inherited: DataFrame) -> DataFrame:
    """``df`` with the columns of ``carried`` on every row of the partition.

    They hold for the partition's first group only. The join is broadcast (one row for each
    partition) and keeps the order of ``df``.
    """
    return df.join(F.broadcast(inherited), PARTITION, "left")


def _with_earlier(rows: DataFrame, parts: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with aggregates over the earlier partitions of their group; ``parts`` has one row for each group and partition.

    A group goes on into a partition only as its first one, so at most one row for each partition is broadcast.
    """
    earlier = Window.partitionBy(*keys).orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    inherited = parts.select(F.col(PARTITION).alias("_p"), *(F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)), *(c.over(earlier).alias(name) for name, c in values.items()))
    inherited = inherited.where(reduce(lambda a, b: a | b, (F.col(name).isNotNull() for name in values)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)), F.col(PARTITION) == F.col("_p"))
    return rows.join(F.broadcast(inherited), same, "left").drop("_p", *(f"_c{i}" for i in range(len(keys))))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` with ``_previous``, a struct of ``values`` of the row before in its group (null for the first), for groups of any size.

    ``order`` must tell the rows of a group apart. Null keys form groups of their own.
    """
    rows = range_sorted(df, keys, order)
    last = rows.groupBy(PARTITION, *keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_l"))
    before = F.lag(F.struct(*values)).over(Window.partitionBy(PARTITION, *keys).orderBy(*order))
    return _with_earlier(rows, last, keys, {"_carry": F.last("_l")}).withColumn("_previous", F.coalesce(before, "_carry")).drop("_carry", PARTITION)


def with_running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``values`` over its group up to and with each row, for groups of any size; ``order`` as above."""
    rows = range_sorted(df.withColumns(values), keys, order)
    within = Window.partitionBy(PARTITION, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(PARTITION, *keys).agg(*(F.sum(name).alias(name) for name in values))
    seeded = _with_earlier(rows, parts, keys, {f"_before_{name}": F.sum(name) for name in values})
    return seeded.withColumns({name: F.sum(name).over(within) + F.coalesce(f"_before_{name}", F.lit(0)) for name in values}).drop(*(f"_before_{name}" for name in values), PARTITION)
