"""Interval operators: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .segments import PARTITION, carried, range_sorted, with_carried

_NONE = np.iinfo(np.int64).min


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of periods, and gaps, of the sorted rows of one partition.

    A row has its group's hash, start, end and what the partition inherits for its first group. A
    piece that continues a period of an earlier partition has no start.
    """
    group, reach, label, fresh = None, _NONE, None, True
    for rows in batches:
        if not rows.num_rows:
            continue
        g, s, e = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_group", "_start", "_end"))
        first = np.r_[g[0] != group, g[1:] != g[:-1]]
        if fresh and (carry := rows.column("_carry")[0].as_py()) is not None:
            reach, first[0] = carry, False
        fresh = False
        before = np.empty(len(g), np.int64)
        edges = np.flatnonzero(np.r_[True, first[1:], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            run = np.maximum.accumulate(np.r_[_NONE if first[a] else reach, e[a:b]])
            before[a:b], reach = run[:-1], run[-1]
        opens = s > before
        cuts = np.flatnonzero(np.r_[True, opens[1:]])
        labels = [int(s[a]) if opens[a] else label for a in cuts]
        holes = np.flatnonzero(opens & (before != _NONE))
        named = [c for c in rows.schema.names if c not in ("_group", "_start", "_end", "_carry")]
        for kind, at, starts, ends in (("period", cuts, labels, np.maximum.reduceat(e, cuts)), ("gap", holes, before[holes], s[holes])):
            columns = [rows.column(c).take(pa.array(at)) for c in named]
            columns += [pa.array([kind] * len(at), pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*named, "_kind", "_start", "_end"])
        group, label = g[-1], labels[-1]


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Maximal continuous periods of each group of intervals, and the gaps between them.

    ``start`` and ``end`` are whole numbers. Touching intervals are continuous; a gap lies between
    one period of a group and the next. The result has the columns ``keys``, kind (``period`` or
    ``gap``), ``start`` and ``end``.

    Rows with a null time, or an end that isn't later than the start, don't count. Null keys form
    groups of their own. Repeated rows and ties change nothing; an empty table gives an empty
    result; other columns of ``df`` are ignored, whatever their names.

    Method: the intervals are range-sorted over all groups, so that a group may span partitions.
    Each partition's largest end is prefix-combined over the earlier partitions of its first
    group, and a second scan of each partition, starting from that end, labels the islands. A
    piece of a period that began in an earlier partition gets its label from there in the same
    way. No group is ever gathered in one task.
    """
    named = [f"_key{i}" for i in range(len(keys))]
    valid = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end")).where(F.col("_end") > F.col("_start"))
    # Intervals with the same start are one, so that ties can't pile up in one range partition.
    longest = valid.groupBy(*named, "_start").agg(F.max("_end").alias("_end"))
    rows = range_sorted(longest, named, ["_start"])
    reach = rows.groupBy(PARTITION, *named).agg(F.max("_end").alias("_reach"))
    seeded = with_carried(rows, carried(reach, named, {"_carry": F.max("_reach")}))
    # Equal keys are neighbours, so a hash of them tells one group from the next within a partition.
    hashed = seeded.withColumn("_group", F.xxhash64(*named, *(F.col(n).isNull() for n in named)) if named else F.lit(0).cast("long"))
    fields = [f for f in seeded.schema.fields if f.name in (*named, PARTITION)]
    schema = T.StructType([*fields, T.StructField("_kind", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType())])
    found = cut(hashed.mapInArrow(_scan, schema))
    pieces = found.where("_kind = 'period'")
    opened = pieces.groupBy(PARTITION, *named).agg(F.max("_start").alias("_opened"))
    labelled = with_carried(pieces, carried(opened, named, {"_began": F.max("_opened")})).withColumn("_start", F.coalesce("_start", "_began"))
    periods = labelled.groupBy(*named, "_kind", "_start").agg(F.max("_end").alias("_end"))
    both = periods.unionByName(found.where("_kind = 'gap'").drop(PARTITION))
    return both.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), F.col("_kind").alias("kind"), F.col("_start").alias(start), F.col("_end").alias(end))
