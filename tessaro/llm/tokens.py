"""Encoding texts with a public tokenizer, long ones in parallel parts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: The tokenizer's file; never part of this repository.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"

Encoded = tuple[list[int], list[tuple[int, int]]]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


_SPACE = re.compile(r"(?<=\S)\s")


def part_ends(text: str, size: int) -> list[int]:
    """Where each part of at most ``size`` characters ends: before white space in its last quarter if there is any, else in the midst of what stands there."""
    out, at = [], 0
    while len(text) - at > size:
        places = [m.start() for m in _SPACE.finditer(text, at + size - max(size // 4, 1), at + size)]
        at = places[-1] if places and places[-1] > at else at + size
        out.append(at)
    return [*out, len(text)]


def encode_part(t, text: str) -> Encoded:
    e = t.encode(text, add_special_tokens=False)
    return e.ids, e.offsets


def join(t, text: str, left: Encoded, right: Encoded, at: int, first: int = 32) -> Encoded:
    """The encoding of ``text`` from the encodings of its halves ``text[:at]`` and ``text[at:]``, whose offsets count within ``text``.

    A window around the join is encoded again and grows until it holds one token of the left half
    and one of the right half in their places. Byte pairs merge by neighbours alone: a sequence in
    which every two neighbours stand as they are encoded together is the encoding. So tokens up to
    the agreed left one, those of the window, and those from the agreed right one fit together.
    """
    size = first
    while True:
        low, high = max(0, at - size), min(len(text), at + size)
        ids, spans = encode_part(t, text[low:high])
        spans = [(a + low, b + low) for a, b in spans]
        place = {(s, e, i): k for k, ((s, e), i) in enumerate(zip(spans, ids, strict=True)) if e - s > 0}
        i = j = None
        if low > 0:
            k = len(left[0]) - 1
            while k >= 0 and left[1][k][0] > low:
                hit = place.get((*left[1][k], left[0][k]))
                if hit is not None and left[1][k][1] <= at - size // 4:
                    i = (k, hit)
                    break
                k -= 1
        else:
            i = (-1, -1)
        if high < len(text):
            for k, (span, token) in enumerate(zip(right[1], right[0], strict=True)):
                if span[1] >= high:
                    break
                hit = place.get((*span, token))
                if hit is not None and span[0] >= at + size // 4:
                    j = (k, hit)
                    break
        else:
            j = (len(right[0]), len(ids))
        if i is not None and j is not None and i[1] < j[1]:
            return [*left[0][: i[0] + 1], *ids[i[1] + 1 : j[1]], *right[0][j[0] :]], [*left[1][: i[0] + 1], *spans[i[1] + 1 : j[1]], *right[1][j[0] :]]
        size *= 2


def _lists(lists: list, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((x for one in lists for x in one), kind.to_pandas_dtype(), int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts = [x or "" for x in rows.column("_text").to_pylist()]
                found = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*rows.drop_columns(["_text"]).columns, _lists(found, pa.int32())], [*rows.drop_columns(["_text"]).schema.names, "ids"])

    return encode


def _cut(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("_text").to_pylist()):
                ends = part_ends(text, size)
                starts = [0, *ends[:-1]]
                key = batch.drop_columns(["_text"]).take(pa.array([k] * len(ends)))
                columns = [*key.columns, pa.array(range(len(ends)), pa.int32()), pa.array([text[a:e] for a, e in zip(starts, ends, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*key.schema.names, "_no", "_part"])

    return cut


def _encode_parts(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found = [(e.ids, e.offsets) for e in t.encode_batch(rows.column("_part").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *_encoded(found)], [*rows.schema.names, "_ids", "_from", "_to"])

    return encode


def _encoded(found: list[Encoded]) -> list[pa.Array]:
    return [_lists([i for i, _ in found], pa.int32()), _lists([[a for a, _ in o] for _, o in found], pa.int32()), _lists([[b for _, b in o] for _, o in found], pa.int32())]


def _join_pairs(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts, found = [], []
            # a pair is one row: at most the left and the right half of one text
            for halves in batch.column("_halves").to_pylist():
                ordered = sorted(halves, key=lambda h: h["_no"])
                made = [(h["_part"], (h["_ids"], list(zip(h["_from"], h["_to"], strict=True)))) for h in ordered]
                text, one = made[0]
                if len(made) == 2:
                    at = len(text)
                    text, (ids, spans) = text + made[1][0], made[1][1]
                    one = join(t, text, one, (ids, [(a + at, b + at) for a, b in spans]), at)
                texts.append(text)
                found.append(one)
            key = batch.drop_columns(["_halves"])
            yield pa.RecordBatch.from_arrays([*key.columns, pa.array(texts, pa.string()), *_encoded(found)], [*key.schema.names, "_part", "_ids", "_from", "_to"])

    return run


def encode_texts(df: DataFrame, key: str, text: str, path: str = BYTE_BPE, part: int = 4096) -> DataFrame:
    """``key`` and the ids (array<int>) of each text, without special tokens.

    An empty or null text gives an empty list; every other text is encoded as it is, blank ones
    included; a special token's name is ordinary text. Every row gives one row, repeated rows and
    null keys too; an empty table gives an empty result; other columns are ignored.

    Method: tree concatenation. Texts are cut into parts of at most ``part`` characters, which are
    spread over the cluster and encoded in parallel; then neighbours are joined in pairs, all pairs
    of a level in parallel, until each text is one. At each join a window around it is encoded
    again and grows until both sides agree. A text that is one part is a tree of one leaf: it is
    encoded where it stands, without a shuffle. The longest text is measured first; it gives the
    number of levels.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    leaf = rows.where(~F.coalesce(F.char_length("_text") > part, F.lit(False))).mapInArrow(_encode(path), f"_key {kind}, ids array<int>")
    # repeated rows and null keys must stay apart when parts come together again
    numbered = rows.where(F.char_length("_text") > part).withColumn("_row", F.monotonically_increasing_id())
    pieces = cut(numbered.mapInArrow(_cut(part), f"_key {kind}, _row bigint, _no int, _part string"))
    most = pieces.agg(F.coalesce(F.max("_no") + 1, F.lit(0))).first()[0]
    if not most:
        return leaf.select(F.col("_key").alias(key), "ids")
    encoded = "_part string, _ids array<int>, _from array<int>, _to array<int>"
    tree = pieces.repartition("_row", "_no").mapInArrow(_encode_parts(path), f"_key {kind}, _row bigint, _no int, {encoded}")
    for _ in range(max(most - 1, 1).bit_length()):
        halves = F.struct("_no", "_part", "_ids", "_from", "_to")
        pairs = tree.groupBy("_key", "_row", F.shiftright("_no", 1).alias("_pair")).agg(F.collect_list(halves).alias("_halves"))
        tree = pairs.withColumnRenamed("_pair", "_no").mapInArrow(_join_pairs(path), f"_key {kind}, _row bigint, _no int, {encoded}")
    return leaf.unionByName(tree.select("_key", F.col("_ids").alias("ids"))).select(F.col("_key").alias(key), "ids")
