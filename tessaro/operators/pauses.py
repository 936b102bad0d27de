"""Speech split at its longest pauses."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import with_previous, with_running_sums


def split_at_longest(starts: list[int], ends: list[int], most: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, overlaps the one before) of spans in order, split at the longest pause, again and again, until each part lasts ``most`` at most.

    Of equal pauses the first counts. A single longer span is cut into windows that overlap.
    """
    out, open_parts = [], [(0, len(starts))]
    while open_parts:
        a, b = open_parts.pop()
        if ends[b - 1] - starts[a] <= most:
            out.append((starts[a], ends[b - 1], False))
        elif b - a == 1:
            at = starts[a]
            while True:
                out.append((at, min(at + most, ends[a]), at > starts[a]))
                if at + most >= ends[a]:
                    break
                at += most - overlap
        else:
            k = max(range(a + 1, b), key=lambda i: (starts[i] - ends[i - 1], -i))
            open_parts += [(k, b), (a, k)]
    return out


def pause_chunks(spans: DataFrame, keys: Sequence[str], start: str, end: str, most: int, overlap: int) -> DataFrame:
    """Parts of at most ``most`` of the spans of each group, split at the longest pauses: ``keys``, ``start``, ``end``, overlaps.

    The spans of a group must not overlap (``periods_and_gaps`` merges them); times are whole
    numbers. A pause longer than ``most`` always splits, so the spans are first cut there by an
    ordered scan over all groups; what comes together in a task is speech without such a pause.
    """
    seen = with_previous(spans.select(*keys, start, end), keys, [start], [end])
    far = F.coalesce(F.col(start) - F.col(f"_previous.{end}") > most, F.lit(True))
    islands = with_running_sums(seen.withColumn("_new", far.cast("int")).drop("_previous"), keys, [start], {"_island": F.col("_new")}).drop("_new")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(start)
        parts = split_at_longest(rows[start].tolist(), rows[end].tolist(), most, overlap)
        made = pd.DataFrame({k: [rows[k].iloc[0]] * len(parts) for k in keys})
        return made.assign(**{start: [p[0] for p in parts], end: [p[1] for p in parts], "overlaps": [p[2] for p in parts]})

    kept = ", ".join(f"`{k}` {spans.schema[k].dataType.simpleString()}" for k in keys)
    return islands.groupBy(*keys, "_island").applyInPandas(split, f"{kept}, `{start}` bigint, `{end}` bigint, overlaps boolean")
