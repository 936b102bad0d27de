"""Sequence operators: as-of and interval joins, windows cut from spans, ranks by first appearance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import PARTITION, carried, range_sorted, with_carried, with_running_sums
from .skew import salted_join


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, known, fresh = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("_group").to_numpy()
        if fresh and (carry := batch.column("_carry")[0].as_py()) is not None:
            group, known = g[0], carry
        fresh = False
        given = np.asarray(batch.column("_right").is_valid())
        right = batch.column("_right").fill_null(0).to_numpy()
        place = np.arange(len(g))
        # the last row with a right id and the first row of the group, at or before each row
        last = np.maximum.accumulate(np.where(given, place, -1))
        first = np.maximum.accumulate(np.where(np.r_[g[0] != group, g[1:] != g[:-1]], place, -1))
        own = last >= np.maximum(first, 0)
        found = np.where(own, right[np.maximum(last, 0)], 0 if known is None else known)
        none = ~own & ((first >= 0) | (known is None))
        kept = batch.drop_columns(["_right", "_carry", "_group"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int64(), mask=none)], [*kept.schema.names, "_match"])
        group, known = g[-1], None if none[-1] else int(found[-1])


def asof_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_on: str, right_id: str, right_on: str) -> DataFrame:
    """For each left row the id of the last right row of its group at or before it: ``left_id``, ``right_id``.

    Times are whole numbers, ids are whole numbers; of right rows at the same time the largest id
    counts. Rows with a null time are left out on the right and match nothing on the left; null
    keys form a group. Both sides are range-sorted together and each partition starts from the
    last right row before it, so a group of any size is spread over the cluster.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]
    lefts = left.select(*key, F.col(left_on).cast("long").alias("_at"), F.lit(1).alias("_side"), F.col(left_id).cast("long").alias("_id"), F.lit(None).cast("long").alias("_right"))
    rights = right.where(F.col(right_on).isNotNull()).select(*key, F.col(right_on).cast("long").alias("_at"), F.lit(0).alias("_side"), F.col(right_id).cast("long").alias("_id"), F.col(right_id).cast("long").alias("_right"))
    rows = range_sorted(lefts.where("_at IS NOT NULL").unionByName(rights), named, ["_at", "_side", "_id"])
    last = rows.groupBy(PARTITION, *named).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_at", "_id"))).alias("_last"))
    seeded = with_carried(rows, carried(last, named, {"_carry": F.last("_last", ignorenulls=True)}))
    hashed = seeded.withColumn("_group", F.xxhash64(*named, *(F.col(n).isNull() for n in named)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hashed.schema.fields if f.name not in ("_right", "_carry", "_group")) + ", _match bigint"
    filled = hashed.mapInArrow(_fill, schema).where("_side = 1").select(F.col("_id").alias(left_id), F.col("_match").alias(right_id))
    untimed = lefts.where("_at IS NULL").select(F.col("_id").alias(left_id), F.lit(None).cast("long").alias(right_id))
    return filled.unionByName(untimed)


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, start: str, end: str, bin_width: int) -> DataFrame:
    """The pairs of intervals of a group that overlap (they share more than an end): ``left_id``, ``right_id``.

    Times are whole numbers; both sides have ``start`` and ``end``. Intervals are joined through
    the bins of ``bin_width`` that they touch, so a large group is spread by time; a pair is kept
    in the bin where the later of the two starts. Null or empty intervals overlap nothing.
    """

    def binned(df: DataFrame, name: str, side: str) -> DataFrame:
        rows = df.where(F.col(end) > F.col(start)).select(*keys, F.col(name).alias(f"{side}_id"), F.col(start).alias(f"{side}_s"), F.col(end).alias(f"{side}_e"))
        first, last = F.floor(F.col(f"{side}_s") / bin_width), F.floor((F.col(f"{side}_e") - 1) / bin_width)
        return rows.withColumn("_bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))

    pairs = binned(left, left_id, "l").join(binned(right, right_id, "r"), [*keys, "_bin"])
    later = F.floor(F.greatest("l_s", "r_s") / bin_width)
    met = pairs.where((F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e")) & (later == F.col("_bin")))
    return met.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id))


def overlap_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, start: str, end: str) -> DataFrame:
    """How many right intervals of its group each left one overlaps (shares more than an end with): ``left_id``, n; none gives no row.

    Nothing is paired: those that overlap are those that start before the left one ends, less those
    that end before it starts, and both are running counts along one sweep of each group.
    ``left_id`` tells the left rows apart; null or empty intervals overlap nothing.
    """
    lefts = left.where(F.col(end) > F.col(start)).select(*keys, F.col(left_id).alias("_id"), F.explode(F.array(F.struct(F.col(end).alias("at"), F.lit(1).alias("s")), F.struct(F.col(start).alias("at"), F.lit(1).alias("s")))).alias("_x"), F.col(end).alias("_end"))
    lefts = lefts.select(*keys, "_id", F.col("_x.at").alias("_at"), F.lit(1).alias("_side"), (F.col("_x.at") == F.col("_end")).alias("_last"))
    # ends first, then what asks, then starts
    points = right.where(F.col(end) > F.col(start)).select(*keys, F.posexplode(F.array(end, start)).alias("_i", "_at"))
    points = points.groupBy(*keys, "_at", (F.col("_i") * 2).alias("_side")).agg(F.count("*").alias("_m"))
    both = lefts.withColumn("_m", F.lit(0).cast("long")).unionByName(points.withColumns({"_id": F.lit(None).cast(left.schema[left_id].dataType), "_last": F.lit(None).cast("boolean")}))
    counts = {"_starts": F.when(F.col("_side") == 2, F.col("_m")).otherwise(0), "_ends": F.when(F.col("_side") == 0, F.col("_m")).otherwise(0)}
    swept = with_running_sums(both, keys, ["_at", "_side", "_id", "_last"], counts).where("_side = 1")
    met = F.max(F.when(F.col("_last"), F.col("_starts"))) - F.max(F.when(~F.col("_last"), F.col("_ends")))
    return swept.groupBy("_id").agg(met.alias("n")).where("n > 0").select(F.col("_id").alias(left_id), "n")


def covering(points: DataFrame, spans: DataFrame, keys: Sequence[str], point_id: str, at: str, span_id: str, start: str, end: str) -> DataFrame:
    """How many spans of its group cover each point (start at or before it, end after it), and which one if it is one: ``point_id``, n, ``span_id``.

    One sweep: opened spans add one and their id, closed ones take both away, so where one is open
    the sum of ids is its id. Points that no span covers give no row; ids are whole numbers.
    """
    edges = spans.where(F.col(end) > F.col(start)).select(*keys, F.col(span_id).cast("long").alias("_s"), F.posexplode(F.array(end, start)).alias("_i", "_at"))
    signed = F.when(F.col("_i") == 1, F.lit(1)).otherwise(F.lit(-1))
    edges = edges.groupBy(*keys, "_at").agg(F.sum(signed).alias("_open"), F.sum(signed * F.col("_s")).alias("_ids")).withColumns({"_side": F.lit(0), "_id": F.lit(None).cast("long")})
    asked = points.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(0).cast("long").alias("_open"), F.lit(0).cast("long").alias("_ids"), F.lit(1).alias("_side"), F.col(point_id).cast("long").alias("_id"))
    swept = with_running_sums(edges.unionByName(asked), keys, ["_at", "_side", "_id"], {"_n": F.col("_open"), "_sum": F.col("_ids")})
    return swept.where("_side = 1 AND _n > 0").select(F.col("_id").alias(point_id), F.col("_n").alias("n"), F.when(F.col("_n") == 1, F.col("_sum")).alias(span_id))


def sliding_windows(df: DataFrame, keep: Sequence[str], start: str, end: str, width: int, step: int) -> DataFrame:
    """Windows of ``width`` every ``step`` along each span; the last one ends with the span. Times are whole numbers.

    A span not longer than ``width`` is one window; empty and null spans give none.
    """
    rows = df.where(F.col(end) > F.col(start))
    count = F.greatest(F.ceil((F.col(end) - F.col(start) - width) / step), F.lit(0)).cast("int")
    windows = rows.select(*keep, start, end, F.posexplode(F.sequence(F.lit(0), count)).alias("window_no", "_k"))
    begin = F.col(start) + F.col("_k") * step
    return windows.select(*keep, "window_no", begin.cast("long").alias("window_start"), F.least(begin + width, F.col(end)).cast("long").alias("window_end"))


def first_appearance_rank(df: DataFrame, keys: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """Each distinct label of a group with its number by first appearance, from 1; null labels get none.

    The rows are reduced to one for each label before they are ranked.
    """
    from pyspark.sql import Window

    seen = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.min(F.struct(*order)).alias("_first"))
    return seen.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", label))).drop("_first")


def named_rows(rows: DataFrame, names: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the names of a small side; the large side's hot keys are salted."""
    return salted_join(rows, names, on)
