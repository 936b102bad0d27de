"""Per-document text statistics, and the kind of text they point to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .quality_holdout import HOLDOUT

KINDS = ("list", "table", "junk")
#: The share of a document's lines above which it is a list or a table.
MOST = 2 / 3

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINES = re.compile(r"\r\n|[\n\r\v\f\x85  ]")
_ENDED = re.compile(r"[.!?…:;][\"'”’»)\]]*\s*\Z")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|\Z)")
_BULLET = re.compile(r"\s*(?:[-*+•·–—‣◦▪●○→☐☑☒✓✔✗]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\[[ xX✓]?\])\s+\S")
_FIELD = re.compile(r"\s*[^\W\d_][\w .\-/()]{0,30}?\s?[:=]\s+(\S.*)")
_RULE = re.compile(r"\s*[-+|=:_\s─━│┼╪]{3,}\Z")
_TAG = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_UNREADABLE = re.compile(r"[ÃÂ�\x00-\x08\x0e-\x1f\x7f-\x9f-]|(?<=[^\W\d_])[€¢£¥¤]|[¢€¥¤](?=[^\W\d_])")
#: The characters that ``_UNREADABLE`` needs; a text without them is spared the search.
_SUSPECT = frozenset("ÃÂ�€¢£¥¤" + "".join(map(chr, [*range(9), *range(0x0E, 0x20), *range(0x7F, 0xA0), *range(0xE000, 0xF900)])))
_HARSH = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", re.I)
_MIXED = re.compile(r"[a-z][A-Z]|[A-Za-z]\d[A-Za-z]|\d[a-z]")

FEATURES = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "unreadable_ratio", "single_letters", "harsh_words",
    "mixed_tokens", "top_word", "distinct_words", "top_sentence", "words_per_sentence", "mean_line_length", "marked_lines", "field_lines", "bare_lines", "list_lines", "table_lines", "led_lines", "short_lines",
)
#: What the classifiers see: how the words and characters of a text are, not whether its lines are rows or items. That is left to the exact check.
LEARNED = (
    "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "unreadable_ratio", "single_letters", "harsh_words", "mixed_tokens", "top_word", "distinct_words",
    "top_sentence", "words_per_sentence", "mean_line_length", "led_lines", "short_lines",
)


def is_table_line(line: str) -> bool:
    """A row or rule of a table: ruled, piped, tabbed, delimited, tagged or set in columns."""
    bare = line.strip()
    if _TAG.match(bare) or (len(bare) > 2 and _RULE.match(line) and any(c in "-=|_─━│" for c in bare)):
        return True
    if bare.count("|") >= 2 or "\t" in bare or (bare.count("&") >= 2 and bare.endswith("\\\\")):
        return len(re.findall(r"\w", bare)) * 3 >= len(bare.replace(" ", ""))
    for mark in ";,":
        cells = bare.split(mark)
        if len(cells) > 2 and all(len(c.split()) <= 4 for c in cells) and (mark == ";" or bare.count(", ") * 2 < bare.count(",")):
            return True
    cells = re.split(r" {2,}", bare)
    return len(cells) > 2 and sum(any(ch.isdigit() for ch in c) for c in cells) * 3 >= len(cells)


def is_field_line(line: str) -> bool:
    """A field and its value, which is no sentence."""
    m = _FIELD.match(line)
    return bool(m) and len(m[1]) <= 60 and len(m[1].split()) <= 7 and not re.search(r"[.!?]\s*\Z", m[1])


def _bare(block: list[str], common: set[str]) -> int:
    """How many lines of a block are items without a mark: short lines without sentences."""
    if len(block) < 2 or any(_SENTENCE.search(x) for x in block):
        return 0
    words = [w for x in block for w in _WORD.findall(x.lower())]
    if not words or sum(map(len, words)) < 3 * len(words) or sum(w in common for w in words) > 0.32 * len(words):
        return 0
    return sum(len(x.strip()) <= 70 and len(x.split()) <= 9 and max(map(len, x.split())) <= 24 for x in block)


def statistics(text: str, common: dict[str, set[str]], everywhere: set[str] | None = None) -> list[float]:
    """The values of ``FEATURES`` for a text with a visible character; ``everywhere`` are the words of all languages of ``common``.

    Characters, words and tokens are counted once and judged by their distinct values.
    """
    if everywhere is None:
        everywhere = set().union(*common.values())
    lines = [x for x in _LINES.split(text) if x.strip()]
    words = Counter(_WORD.findall(text.lower()))
    characters, tokens = Counter(text), Counter(text.split())
    visible = sum(m for c, m in characters.items() if not c.isspace())
    n_words, n_tokens = words.total(), max(1, tokens.total())
    n, w, k = max(1, visible), max(1, n_words), max(1, len(lines))
    table = [is_table_line(x) for x in lines]
    marked = [not t and bool(_BULLET.match(x)) for x, t in zip(lines, table, strict=True)]
    field = [not t and not m and is_field_line(x) for x, t, m in zip(lines, table, marked, strict=True)]
    bare, block = 0, []
    for x, taken in [*((x, t or m or f) for x, t, m, f in zip(lines, table, marked, field, strict=True)), ("", True)]:
        if taken:
            bare += _bare(block, everywhere)
            block = []
        else:
            block.append(x)
    sentences = Counter(y for s in re.split(r"(?<=[.!?…])\s+|[\r\n]+", text) if " " in (y := s.strip().lower()))
    top_sentence = max(sentences.values()) / sentences.total() if sentences.total() > 4 else 0.0
    said = {x: m for x, m in words.items() if x in everywhere}
    ended = [bool(_ENDED.search(x)) for x in lines]
    firsts = [x.lstrip()[0] for x in lines]
    return [
        len(text), n_words, len(lines), sum(len(x) * m for x, m in words.items()) / w, sum(m for c, m in characters.items() if not c.isalnum() and not c.isspace()) / n, sum(ended) / k,
        max([sum(m for x, m in said.items() if x in own) / w for own in common.values()], default=0.0), sum(m for c, m in characters.items() if c.isdigit()) / n,
        (0 if _SUSPECT.isdisjoint(characters) else len(_UNREADABLE.findall(text))) / n, sum(m for x, m in tokens.items() if len(x) == 1) / n_tokens,
        sum(m for x, m in words.items() if len(x) > 4 and _HARSH.search(x)) / w, sum(m for x, m in tokens.items() if len(x) > 12 and _MIXED.search(x)) / n_tokens, max(words.values(), default=0) / w, len(words) / w,
        top_sentence, n_words / max(1, len(_SENTENCE.findall(text))), sum(map(len, lines)) / k, sum(marked) / k, sum(field) / k, bare / k, (sum(marked) + sum(field) + bare) / k, sum(table) / k,
        sum(not c.isalpha() for c in firsts) / k, sum(not e and x.count(" ") < 9 for x, e in zip(lines, ended, strict=True)) / k,
    ]


def _described(common: dict[str, set[str]]):
    everywhere = set().union(*common.values())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x, common, everywhere) for x in batch.column("_text").to_pylist()]
            values = np.array(rows, float).reshape(-1, len(FEATURES))
            key = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*key.columns, *(pa.array(values[:, i]) for i in range(len(FEATURES)))], [*key.schema.names, *FEATURES])

    return describe


def text_statistics(df: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """``key`` and the statistics ``FEATURES`` of each text with a visible character.

    Null, empty and blank texts give no row. Repeated rows give one row each, null keys too; an
    empty table gives an empty result; other columns are ignored. ``common_words`` (lang, word,
    word_rank) is the fixed list of frequent words of each language, some hundreds of rows; all of
    them are sent to the executors, whatever their rank. The share of common words is that of the
    language with the largest.
    """
    kept = common_words.where(F.col("word").isNotNull() & F.col("lang").isNotNull())
    common = {r["lang"]: set(r["words"]) for r in kept.groupBy("lang").agg(F.collect_set(F.lower("word")).alias("words")).collect()}
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\s\x{00a0}\x{200b}-\x{200f}\x{2060}\x{feff}\x{2000}-\x{200a}\x{202f}\x{3000}\x{00ad}\x{0000}-\x{001f}]"))
    made = rows.mapInArrow(_described(common), f"_key {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{f} double" for f in FEATURES))
    return made.withColumnRenamed("_key", key)


def weak_label():
    """A kind in cases that leave no doubt, else null.

    prose: many common words and no lines of another kind. list, table: six in seven lines of five
    or more. junk: far more unreadable characters, strays or repetition than any prose has, or no
    common word among many, or hardly one. Everything between is left to the classifiers.
    """
    c = F.col
    plain = (c("list_lines") <= 0.2) & (c("table_lines") <= 0.2)
    noise = (c("unreadable_ratio") > 0.15) | ((c("symbol_ratio") > 0.6) & (c("n_words") == 0)) | (c("single_letters") > 0.7) | (c("mixed_tokens") > 0.5) | ((c("mean_word_length") < 1.6) & (c("n_words") >= 30))
    loop = (c("top_sentence") > 0.8) | ((c("top_word") > 0.8) & (c("n_words") >= 20))
    loose = (c("common_words") < 0.06) & (c("n_words") >= 30) & (c("words_per_sentence") > 25)
    flowing = (c("common_words") >= 0.28) & (c("n_words") >= 15) & (c("mean_word_length") > 3) & (c("top_sentence") <= 0.35) & (c("unreadable_ratio") < 0.005) & (c("symbol_ratio") < 0.15) & (c("single_letters") < 0.15)
    structured = (c("n_lines") >= 5) & (c("unreadable_ratio") < 0.005)
    return F.when(structured & (c("table_lines") >= 0.85), "table").when(structured & (c("list_lines") >= 0.85), "list").when(plain & (noise | loop | loose), "junk").when(plain & flowing, "prose")


def _platt(scores: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out scores, with smoothed targets."""
    yes, no = truth.sum(), len(truth) - truth.sum()
    target = np.where(truth, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * scores + b)))
        g = np.array([((p - target) * scores).sum() + 1e-3 * (a - 1), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * scores * scores).sum() + 1e-3, (v * scores).sum()], [(v * scores).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _calibrated(margins: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    return _platt(margins, truth) if 0 < truth.sum() < len(truth) else (2.0, 0.0)


def kinds_of_text(df: DataFrame, key: str, text: str, common_words: DataFrame, sample: int = 3000, trees: int = 16, depth: int = 4, step: float = 0.3) -> DataFrame:
    """``key``, the probability of each of ``KINDS``, weak (its weak label or null) and kind for each text with a visible character; kind is ``prose`` or one of ``KINDS``.

    One boosted classifier for each kind is trained on at most ``sample`` weakly labelled rows of
    each kind (those with the smallest hashes of their statistics) and its scores are calibrated on
    the hand-checked texts of ``quality_holdout``. The kind is the most probable one of at least
    one half. A list or a table must also pass the exact check that more than two thirds of its
    lines are such lines. Where a kind has no weak label among the rows, or all labels are of one
    kind, there is nothing to learn and its weak label stands. Rows as in ``text_statistics``.
    """
    stats = cut(text_statistics(df, key, text, common_words).withColumn("_weak", weak_label()))
    spark = df.sparkSession
    # One pass: the rows with the smallest hashes of each kind, by Spark's group limit before the exchange.
    order = Window.partitionBy("_weak").orderBy(F.xxhash64(*FEATURES), *FEATURES[:4])
    vectors = VectorAssembler(inputCols=list(LEARNED), outputCol="features")
    chosen = stats.where("_weak IS NOT NULL").select(*FEATURES, "_weak", F.row_number().over(order).alias("_n")).where(F.col("_n") <= sample)
    chosen = cut(vectors.transform(chosen).select("features", "_weak").coalesce(4))
    counts = {r["_weak"]: r["count"] for r in chosen.groupBy("_weak").count().collect()}
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HOLDOUT)], "i int, t string")
    held = cut(vectors.transform(text_statistics(texts, "i", "t", common_words)).select("i", "features").coalesce(1))
    scored = vectors.transform(stats)
    for kind in KINDS:
        if not 0 < counts.get(kind, 0) < sum(counts.values()):
            scored = scored.withColumn(f"p_{kind}", F.when(F.col("_weak") == kind, 1.0).otherwise(0.0))
            continue
        labelled = chosen.select("features", (F.col("_weak") == kind).cast("double").alias("label"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=7, predictionCol="_y").setRawPredictionCol("_raw").setProbabilityCol("_p").fit(labelled)
        margins = {r["i"]: r["m"] for r in model.transform(held).select("i", vector_to_array("_raw")[1].alias("m")).collect()}
        a, b = _calibrated(np.array([margins[i] for i in range(len(HOLDOUT))]), np.array([k == kind for k, _ in HOLDOUT]))
        scored = model.transform(scored).withColumn(f"p_{kind}", 1 / (1 + F.exp(-(a * vector_to_array("_raw")[1] + b)))).drop("_raw", "_p", "_y")
    # The exact check: a list or a table that hasn't the lines is none.
    held_lines = {"list": F.col("list_lines") > MOST, "table": F.col("table_lines") > MOST, "junk": F.lit(True)}
    ranks = F.array_sort(F.array(*(F.struct((-F.col(f"p_{k}")).alias("p"), F.lit(k).alias("kind")) for k in KINDS)))
    likely = F.filter(ranks, lambda x: (x["p"] <= -0.5) & F.coalesce(*(F.when(x["kind"] == k, held_lines[k]) for k in KINDS)))
    kind = F.coalesce(F.try_element_at(likely, F.lit(1))["kind"], F.lit("prose"))
    return scored.select(key, *(f"p_{k}" for k in KINDS), F.col("_weak").alias("weak"), kind.alias("kind"))
