"""Joins against keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_SALT = "_salt"


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", buckets: int = 16) -> DataFrame:
    """Join a large side with hot keys to a small side with one row for each key.

    Every row of ``right`` is repeated for each of ``buckets`` salts, every row of ``left`` draws
    one from its own content, so a key with a third of all rows is spread over ``buckets`` tasks.
    ``how`` is ``left``, ``inner`` or ``left_semi``; null keys match nothing.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError("only left, inner and semi joins can repeat the right side")
    salted = left.withColumn(_SALT, F.pmod(F.xxhash64(*left.columns), F.lit(buckets)).cast("int"))
    copies = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)


def sized_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", most_bytes: int = 16 << 20) -> DataFrame:
    """Join a large side to a side with one row for each key that is mostly small.

    ``right`` is materialised and measured: up to ``most_bytes`` (as text) it is broadcast and
    ``left`` isn't shuffled; beyond that the keys are salted. The result is the same.
    """
    side = cut(right)
    size = side.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*side.columns)))), F.lit(0))).first()[0]
    return left.join(F.broadcast(side), [*on], how) if size <= most_bytes else salted_join(left, side, on, how)
