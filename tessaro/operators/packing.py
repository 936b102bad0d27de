"""Packing pieces in order into parts of a bounded size; each works within one row, so it needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(pieces: Column, limit: int, separator: str = " ") -> Column:
    """Pieces joined by ``separator`` for as long as the part stays within ``limit`` characters; a longer piece is a part of its own.

    The part that is being filled is kept beside the finished ones, so that these are copied once
    for each part and not for each piece.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        fits = F.char_length(state["open"]) + len(separator) + F.char_length(piece) <= limit
        joined = F.when(state["open"].isNull(), piece).when(fits, F.concat(state["open"], F.lit(separator), piece)).otherwise(piece)
        done = F.when(state["open"].isNull() | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), joined.alias("open"))

    return F.aggregate(pieces, start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def fitting(costs: Column, budget: int) -> Column:
    """The positions, from 1, of the pieces that fit in the budget in their order: one that doesn't is skipped, later smaller ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"))

    def add(state: Column, cost: Column) -> Column:
        fits = state["used"] + cost <= budget
        at = state["at"] + 1
        return F.struct((state["used"] + F.when(fits, cost).otherwise(0)).alias("used"), F.when(fits, F.concat(state["kept"], F.array(at))).otherwise(state["kept"]).alias("kept"), at.alias("at"))

    return F.aggregate(costs, start, add)["kept"]
