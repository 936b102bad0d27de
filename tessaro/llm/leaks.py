"""Evaluation texts that occur inside training texts."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters or digits after canonical composition, in lower case."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


class WuManber:
    """Search for all runs of exactly ``run`` words of some texts at once.

    The words of all items stand once in one array of numbers; words that no item holds are 0. A
    block is two successive words, hashed to ``2 ** bits`` places. ``shift`` says, for a block at
    the end of the window, how far the window may move without missing a run; blocks that no run
    holds move it by ``run - 1``. Where it says 0, the bucket of the block's hash holds the places
    of the runs that end so, and these are compared directly.
    """

    def __init__(self, items: list[tuple[int, str]], run: int):
        if run < 2:
            raise ValueError("a run has at least two words")
        self.run, self.ids = run, {}
        number: list[np.ndarray] = []
        kept: list[int] = []
        for item, text in items:
            w = np.fromiter((self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)), np.int32)
            if len(w) >= run:
                number.append(w)
                kept.append(item)
        lengths = np.array([len(w) for w in number], np.int64)
        said = np.concatenate(number) if number else np.empty(0, np.int32)
        self.items, self.starts = np.array(kept, np.int64), np.cumsum(np.r_[0, lengths])[:-1]
        place = np.arange(len(said)) - np.repeat(self.starts, lengths)
        self.bits = max(8, int(len(said)).bit_length())
        wide = said.astype(np.int64)
        hashed = self._hash(np.r_[0, wide[:-1]] if len(wide) else wide, wide)
        self.shift = np.full(1 << self.bits, min(run - 1, 255), np.uint8)
        inner = place > 0
        np.minimum.at(self.shift, hashed[inner], np.minimum(run - 1 - np.minimum(place[inner], run - 1), 255).astype(np.uint8))
        ends = np.flatnonzero(place >= run - 1)
        order = np.argsort(hashed[ends], kind="stable")
        self.ends = ends[order].astype(np.int32)
        self.heads = np.searchsorted(hashed[ends][order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.said = said.tobytes()

    def _hash(self, a, b):
        return (a * 40_503 + b * 10_007) & ((1 << self.bits) - 1)

    def size(self) -> int:
        """The bytes of all tables, the vocabulary included."""
        arrays = self.items, self.starts, self.shift, self.ends, self.heads
        return sum(x.nbytes for x in arrays) + len(self.said) + sys.getsizeof(self.ids) + sum(sys.getsizeof(w) + 28 for w in self.ids)

    def find(self, text: str) -> set[int]:
        """The items of which ``text`` holds a run."""
        w = [self.ids.get(x, 0) for x in words(text)]
        found: set[int] = set()
        if len(w) < self.run or not len(self.ends):
            return found
        run, mask, shift, at = self.run, (1 << self.bits) - 1, self.shift, self.run - 1
        mine = np.array(w, np.int32).tobytes()
        while at < len(w):
            if not w[at]:  # no run holds this word
                at += run
                continue
            h = (w[at - 1] * 40_503 + w[at] * 10_007) & mask
            step = int(shift[h])
            if step == 0:
                own = mine[4 * (at - run + 1) : 4 * (at + 1)]
                for e in self.ends[self.heads[h] : self.heads[h + 1]].tolist():
                    if self.said[4 * (e - run + 1) : 4 * (e + 1)] == own:
                        found.add(int(self.items[np.searchsorted(self.starts, e, "right") - 1]))
                step = 1
            at += step
        return found


def _search(finder: Broadcast):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = finder.value
        for batch in batches:
            rows, items = [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                hits = sorted(tables.find(text))
                rows += [k] * len(hits)
                items += hits
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("_doc").take(pa.array(np.array(rows, np.int64))), pa.array(items, pa.int64())], ["_doc", "_item"])

    return search


def leaked(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12, block_words: int = 2_000_000) -> DataFrame:
    """The distinct pairs (``doc``, ``item``) of a document and an evaluation item that share a run of ``run`` words or more.

    Words are runs of letters or digits after canonical composition, in lower case. Null, empty
    and shorter texts share nothing; rows with a null id are reported under null for documents and
    left out for items; repeated rows count once; an empty table gives an empty result; other
    columns are ignored. Whole texts are searched, of any length.

    Method: Wu-Manber search for all runs of the items at once. The items are the stated query
    set: their words are counted, and they are searched in as many blocks as keep each one within
    ``block_words`` (a single item above it makes a block of its own). The tables of a block take
    below 30 bytes a word and the vocabulary of its distinct words, which is what is broadcast,
    once for each Python worker. The documents are read once for each block and never shuffled but
    for the distinct pairs.
    """
    wanted = items.select(F.col(item).cast("long").alias("_item"), F.col(item_text).alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL")
    size = wanted.agg(F.coalesce(F.sum(F.regexp_count("_text", F.lit(r"[\p{L}\p{N}]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_words))
    kind = documents.schema[doc].dataType.simpleString()
    texts = documents.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    found = None
    for k in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == k).collect()
        finder = documents.sparkSession.sparkContext.broadcast(WuManber([(r["_item"], r["_text"]) for r in own], run))
        hits = texts.mapInArrow(_search(finder), f"_doc {kind}, _item bigint")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct().select(F.col("_doc").alias(doc), F.col("_item").alias(item))
