"""Quality metrics as aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_or_null(value: Column, places: int = 4) -> Column:
    """The mean of the values that aren't null, rounded; null when there are none."""
    return F.round(F.avg(value), places)


def percentile(value: Column, share: float) -> Column:
    """The interpolated percentile of the values that aren't null."""
    return F.percentile(value, F.lit(share))


def recall_at_k(found: Column, wanted: Column, k: int) -> Column:
    """The share of wanted ids among the first ``k`` found; null without wanted ids."""
    hits = F.size(F.array_intersect(F.array_distinct(wanted), F.slice(found, 1, k)))
    return F.when(F.size(wanted) > 0, hits / F.size(F.array_distinct(wanted)))


def reciprocal_rank(found: Column, wanted: Column, k: int) -> Column:
    """One over the rank of the first wanted id among the first ``k`` found, 0 if none; null without wanted ids."""
    first = F.array_position(F.transform(F.slice(found, 1, k), lambda x: F.array_contains(wanted, x)), F.lit(True))
    return F.when(F.size(wanted) > 0, F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0)))


def agreement(df: DataFrame, keys: list[str], one: Column, other: Column) -> DataFrame:
    """n, agreement and Cohen's kappa of two boolean verdicts by group; rows with a null verdict don't count.

    kappa is null where chance alone agrees always.
    """
    rows = df.where(one.isNotNull() & other.isNotNull()).select(*keys, one.cast("int").alias("_a"), other.cast("int").alias("_b"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("_po"), F.avg("_a").alias("_pa"), F.avg("_b").alias("_pb"))
    chance = F.col("_pa") * F.col("_pb") + (1 - F.col("_pa")) * (1 - F.col("_pb"))
    kappa = F.when(F.abs(1 - chance) > 1e-12, F.round((F.col("_po") - chance) / (1 - chance), 4))
    return sums.select(*keys, "n", F.round("_po", 4).alias("agreement"), kappa.alias("kappa"))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Word errors between two arrays of words: the edit distance, by folding one row of the table after another."""
    start = F.transform(F.sequence(F.lit(0), F.size(hypothesis)), lambda i: i)

    def step(row: Column, word: Column) -> Column:
        first = F.array(F.element_at(row, 1) + 1)
        cells = F.arrays_zip(F.slice(row, 1, F.size(hypothesis)).alias("d"), F.slice(row, 2, F.size(hypothesis)).alias("u"), hypothesis.alias("h"))
        return F.aggregate(cells, first, lambda acc, c: F.concat(acc, F.array(F.least(F.element_at(acc, -1) + 1, c["u"] + 1, c["d"] + F.when(c["h"] == word, 0).otherwise(1)))))

    return F.element_at(F.aggregate(reference, start, step), -1)


def at_place(chunk: Column, ref: Column) -> Column:
    """Whether a chunk of the same source covers a reference: its page, else its stretch of time (ends count), else the whole source.

    Both are structs with page_start, page_end, start_s and end_s. A chunk without the kind of
    place that the reference names doesn't cover it.
    """
    last = F.when(F.coalesce(chunk["page_end"], F.lit(0)) == 0, chunk["page_start"]).otherwise(chunk["page_end"])
    paged = (chunk["page_start"] <= ref["page_start"]) & (ref["page_start"] <= last)
    timed = (chunk["start_s"] <= F.coalesce(ref["end_s"], ref["start_s"])) & (ref["start_s"] <= F.coalesce(chunk["end_s"], chunk["start_s"]))
    return F.coalesce(F.when(ref["page_start"].isNotNull(), paged).when(ref["start_s"].isNotNull(), timed).otherwise(True), F.lit(False))


def value_matches(expected: Column, got: Column, form: Callable[[Column], Column]) -> Column:
    """Equal in the given form; what is expected to be missing must be null or blank."""
    return F.when(expected.isNull(), got.isNull() | (F.trim(got) == "")).otherwise(F.coalesce(form(expected) == form(got), F.lit(False)))


def compare_runs(before: DataFrame, after: DataFrame, metric: str, value: str, margin: float = 0.02) -> DataFrame:
    """Every metric of either run with its change; a regression is a loss of ``margin`` or more."""
    joined = before.select(metric, F.col(value).alias("before")).join(after.select(metric, F.col(value).alias("after")), metric, "full")
    delta = F.round(F.col("after") - F.col("before"), 4)
    return joined.select(metric, "before", "after", delta.alias("delta"), F.coalesce(delta <= -margin, F.lit(False)).alias("regression"))
