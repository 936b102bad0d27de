"""Oversized items into pieces under a limit, cut at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary levels from the weakest to the strongest.
LEVELS = ("none", "word", "sentence", "line", "paragraph")
_SPACE = re.compile(r"\s+")
_ENDED = re.compile(r"[.!?…][\"'”’»)\]]*\Z")


def boundaries(text: str) -> list[tuple[int, int, int]]:
    """(start, end, level) of each white space run of ``text``; level counts in ``LEVELS``."""
    found = []
    for m in _SPACE.finditer(text):
        lines = m.group().count("\n")
        if not lines and "\r" in m.group():
            lines = m.group().count("\r")
        level = 4 if lines > 1 else 3 if lines else 2 if _ENDED.search(text, max(0, m.start() - 4), m.start()) else 1
        found.append((m.start(), m.end(), level))
    return found


def bisected(text: str, limit: int, overlap: int, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], int]:
    """(position, level) of each cut, by recursive bisection, and the weakest level that ``limit`` forced.

    A part longer than ``limit`` less ``overlap`` is cut at the strongest boundary in it, of equal
    ones the nearest to its midpoint; without any, at the midpoint itself. White space at the ends
    of a part doesn't count for ``limit``. A cut within a part over ``limit`` is forced, and its
    level is the strongest left: so the weakest forced level is the coarsest at which no part
    exceeds ``limit``.
    """
    ends = [np.array([e for _, e, level in found if level == k], int) for k in range(len(LEVELS))]
    out, weakest, open_parts = [], len(LEVELS) - 1, [(0, len(text))]
    while open_parts:
        a, b = open_parts.pop()
        if b - a <= limit - overlap:
            continue
        middle = (a + b) // 2
        cut, level = middle, 0
        for k in range(len(LEVELS) - 1, 0, -1):
            i = np.searchsorted(ends[k], middle)
            near = [int(x) for x in ends[k][max(i - 1, 0) : i + 1] if a < x < b]
            if near:
                cut, level = min(near, key=lambda x: (abs(x - middle), x)), k
                break
        if len(text[a:b].strip()) > limit:
            weakest = min(weakest, level)
        out.append((cut, level))
        open_parts += [(a, cut), (cut, b)]
    return sorted(out), weakest


def _overlap(text: str, start: int, cut: int, size: int) -> int:
    """Where the repeated end of the piece before ``cut`` begins: at most ``size`` characters back, at the head of a word if there is one."""
    low = max(start, cut - size)
    if low > start and not text[low - 1].isspace():
        m = _SPACE.search(text, low, cut)
        if m and m.end() < cut:
            return m.end()
    return low


def _pieces(limit: int, overlap: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, numbers, whole, strengths, bodies = [], [], [], [], [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                found = boundaries(text)
                made, weakest = bisected(text, limit, overlap, found)
                edges = [0, *(c for c, _ in made), len(text)]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    begin = a if i == 0 else _overlap(text, edges[i - 1], a, overlap)
                    rows.append(k)
                    texts.append(text[begin:b])
                    bodies.append(a - begin)
                    numbers.append(i + 1)
                    whole.append(LEVELS[weakest])
                    strengths.append(LEVELS[made[i - 1][1]] if i else None)
            kept = batch.drop_columns(["_text"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(bodies, pa.int32()), pa.array(strengths, pa.string()), pa.array(whole, pa.string())], [*kept.schema.names, "piece_no", "piece", "repeated", "cut", "boundary"])

    return split


def split_oversized(df: DataFrame, text: str, keep: list[str], limit: int = 2000, overlap: int = 200) -> DataFrame:
    """The pieces of each text of more than ``limit`` characters.

    Result: the columns ``keep``, piece_no (from 1), piece (at most ``limit`` characters),
    repeated (how many of its first characters repeat the end of the piece before, up to
    ``overlap``), cut (the level of the boundary before the piece, null for the first; ``none``:
    amid a word) and boundary (the coarsest level of the whole text at which no part exceeds
    ``limit``). Pieces without what they repeat make up the text exactly.

    Texts up to the limit, null ones included, give no rows; an empty table gives an empty result;
    repeated rows are split each for itself; of ``df`` only ``text`` and ``keep`` are read.

    Method: recursive bisection at the strongest boundary, of equal ones the nearest to the
    midpoint, until each part fits in the limit less the overlap; then the overlaps are attached.
    The same cuts give ``boundary``: it is the weakest that a part over the limit needed. One text is one row here
    as in the input, so the work is spread by rows, without a shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    added = {"piece_no", "piece", "repeated", "cut", "boundary"} & set(keep)
    if added:
        raise ValueError(f"rename the columns {sorted(added)} first")
    rows = df.select(*keep, F.col(text).alias("_text")).where(F.char_length("_text") > limit)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(_pieces(limit, overlap), f"{kept}, piece_no int, piece string, repeated int, cut string, boundary string")
