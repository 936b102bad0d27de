"""Text of scanned pages: page furniture, broken words, misread characters and torn sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.segments import PARTITION, carried, range_sorted, with_carried
from ..operators.skew import sized_join
from ..session import cut

# What a scan reads for what was printed.
CONFUSIONS = (
    ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("5", "s"), ("5", "S"), ("6", "b"), ("6", "B"), ("8", "B"), ("9", "g"),
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("ri", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"),
    ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("l", "I"), ("I", "l"), ("O", "D"), ("D", "O"), ("li", "h"), ("h", "li"), ("nn", "m"), ("in", "m"), ("o", "a"), ("a", "o"), ("u", "v"), ("v", "u"),
)
#: Pairs that also make other words of words; they need much better evidence.
WEAK = {("o", "a"), ("a", "o"), ("l", "i"), ("i", "l"), ("u", "v"), ("v", "u"), ("nn", "m"), ("in", "m"), ("h", "li"), ("li", "h")}
_CHEAP = {pair: 0.6 if pair in WEAK else 0.3 for pair in CONFUSIONS}
# Marks that stand for a hyphen at the end of a line.
HYPHENS = "-‐­¬￾"
# Ligatures and the letters they stand for.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
_DIGITS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5", "B": "8", "b": "6"})

_SEPARATOR = re.compile(r"\s*(?:-{2,}\s*page\s*-{2,}|<!--\s*page[ _-]?break\s*-->|\[page[ _-]?break\]|={3,}\s*page\s*={3,})\s*\Z", re.I)
_NUMBER = re.compile(r"[\s\-–—\[\]()|·*]*(?:(?:page|seite|página|pagina|pág\.|p\.|s\.)\s*)?(?:[\dOlISB]{1,4}|[ivxlc]{1,6})(?:\s*(?:/|of|von|de|sur)\s*[\dOlISB]{1,4})?[\s\-–—\[\]()|·*]*\Z", re.I)
#: A page word and what was read for its number, which may have no digit left.
_PAGE = re.compile(r"[\s\-–—\[\]()|·*]*(?i:page|seite|página|pagina|pág\.|p\.|s\.)\s*[\dOlISB]{1,4}(?:\s*(?:/|of|von|de|sur)\s*[\dOlISB]{1,4})?[\s\-–—\[\]()|·*]*\Z")
_TERMINAL = re.compile(r"[.!?:;…][\"'”’»)\]]*\s*\Z")
_BROKEN = re.compile(r"([^\W\d_][^\W_]*)[" + re.escape(HYPHENS) + r"]\s*\Z")
_EDGES = "\"'“”„«»‘’()[]{}<>*_#|.,:;!?…—–¿¡"
_CLOSERS = "\"'”’»)]"
_CODE = re.compile(r"[A-Z]{2,4}-?[\dOlISB]+(?:-[\dOlISB]+)*(?:-[A-Z]\d)?\Z")
_NUMERIC = re.compile(r"[€$£]?[\dOlISB]+(?:[.,:/\-][\dOlISB]+)*%?\Z")


#: Lines that are paragraphs of their own: headings, rows of tables, items of lists.
_ALONE = re.compile(r"\s*(?:#|\||[-*+•–]\s|\d{1,3}[.)]\s)")


def is_number_line(line: str) -> bool:
    """A line that only gives the page."""
    bare = line.strip()
    return bool(bare) and bool(_NUMBER.match(bare)) and (any(c.isdigit() for c in bare) or bool(_PAGE.match(bare)) or bool(re.fullmatch(r"[\W_]*[ivxlc]+[\W_]*", bare)))


def furniture_key(line: str) -> str:
    """A line in lower case with its digits masked, so that running headers agree from page to page."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", re.sub(r"\s{2,}\W*[\dOlISB]{1,4}\W*\Z|\A\W*[\dOlISB]{1,4}\s{2,}", "", line.strip().lower()))).strip()


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _key_of(text: Column) -> Column:
    """``furniture_key`` of a column."""
    bare = F.regexp_replace(F.lower(_trimmed(text)), r"(?U)\s{2,}\W*[\dOlISB]{1,4}\W*$|^\W*[\dOlISB]{1,4}\s{2,}", "")
    return _trimmed(F.regexp_replace(F.regexp_replace(bare, r"(?U)\d+", "#"), r"(?U)\s+", " "))


def _could_be_header(text: Column) -> Column:
    """``could_be_header`` of a column."""
    bare = _trimmed(text)
    size = F.char_length(bare)
    ended = bare.rlike(r"[.!?:;…][\"'”’»)\]]*$") | bare.endswith(",") | bare.rlike("[^\\W\\d_][" + HYPHENS.replace("-", "\\-") + "]$") | bare.rlike(r"(?U)^[#|\-*•>]|^\p{Ll}")
    return (size > 2) & (size <= 70) & bare.rlike(r"\p{L}") & ~ended


def could_be_header(line: str) -> bool:
    bare = line.strip()
    return 2 < len(bare) <= 70 and bare[0] not in "#|-*•>" and not _TERMINAL.search(bare) and not bare.endswith(",") and any(c.isalpha() for c in bare) and not (bare[0].islower() or _BROKEN.search(bare))


def document_lines(text: str) -> list[dict]:
    """The lines of a whole document with their page, and which of them stand at a page's edge.

    Pages end at form feeds, at separator lines, or, where there are none, around the lines that
    only give a page. Where a document has none of these, a line that recurs in it is taken as
    standing at an edge.
    """
    raw = text.split("\n")
    lines = [{"line_no": i + 1, "text": x.replace("\f", ""), "blank": not x.replace("\f", "").strip(), "number": False, "edge": False, "page": 0} for i, x in enumerate(raw)]
    marked = any("\f" in x or _SEPARATOR.match(x) for x in raw)
    page = 0
    for x, line in zip(raw, lines, strict=True):
        if _SEPARATOR.match(x):
            page += 1
            line["blank"] = True
        elif "\f" in x:
            before, _, after = x.partition("\f")
            if before.strip() and not after.strip():
                line["page"] = page
                page += x.count("\f")
                continue
            page += x.count("\f")
        line["page"] = page
    written = [x for x in lines if not x["blank"]]
    if marked:
        pages: dict[int, list[dict]] = {}
        for x in written:
            pages.setdefault(x["page"], []).append(x)
        for rows in pages.values():
            for side in (rows, rows[::-1]):
                seen = 0
                for x in side[:3]:
                    if not x["number"] and is_number_line(x["text"]):
                        x["number"] = True
                    elif seen == 0 and not x["number"]:
                        x["edge"], seen = True, 1
                    else:
                        break
    else:
        keys = Counter(furniture_key(x["text"]) for x in written if could_be_header(x["text"]))
        page = 0
        numbered = [i for i, x in enumerate(written) if is_number_line(x["text"])]
        for i in numbered:
            written[i]["number"] = True
            for j in (i - 1, i + 1):
                if 0 <= j < len(written) and not written[j]["number"]:
                    written[j]["edge"] = True
        for x in written:
            repeated = could_be_header(x["text"]) and keys[furniture_key(x["text"])] > 1
            x["edge"] = x["edge"] or repeated
            if x["number"] or repeated:
                page += 1
            x["page"] = page
    return lines


_LINE = pa.schema([("source_id", pa.int64()), ("item_no", pa.int32()), ("line_no", pa.int32()), ("page", pa.int32()), ("text", pa.string()), ("number", pa.bool_()), ("edge", pa.bool_()), ("alone", pa.bool_()), ("heading", pa.bool_()), ("label", pa.string())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, text in zip(batch.column("source_id").to_pylist(), batch.column("markdown").to_pylist(), strict=True):
            rows = [
                {"source_id": source, "item_no": 0, "line_no": x["line_no"], "page": x["page"], "text": x["text"], "number": x["number"], "edge": x["edge"], "alone": False, "heading": x["text"].lstrip().startswith("#"), "label": None}
                for x in document_lines(text) if not x["blank"]
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _LINE)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for source, item, label, page, text in zip(*(batch.column(c).to_pylist() for c in ("source_id", "item_no", "label", "page_no", "text")), strict=True):
            lines = text.split("\n")
            alone = sum(bool(x.strip()) for x in lines) == 1
            for i, x in enumerate(lines):
                if x.strip():
                    rows.append({"source_id": source, "item_no": item, "line_no": i + 1, "page": page, "text": x, "number": alone and is_number_line(x), "edge": False, "alone": alone, "heading": alone and label == "section_header", "label": label})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _LINE)


_LINE_DDL = "source_id bigint, item_no int, line_no int, page int, text string, number boolean, edge boolean, alone boolean, heading boolean, label string"


def page_lines(document_results: DataFrame, document_texts: DataFrame) -> DataFrame:
    """Every line that isn't blank, with its page; lines of items stand at an edge if the item is one line and the first or last of its page."""
    whole = document_results.where("markdown IS NOT NULL").select("source_id", "markdown").mapInArrow(_documents, _LINE_DDL)
    items = document_texts.where("text IS NOT NULL").select("source_id", "item_no", "label", F.col("page_no").cast("int").alias("page_no"), "text").mapInArrow(_items, _LINE_DDL)
    items = cut(items)
    at = F.struct("item_no", "line_no")
    edges = items.where(~F.col("number")).groupBy("source_id", "page").agg(F.min(at).alias("top"), F.max(at).alias("bottom"))
    edges = edges.select("source_id", F.explode(F.array_distinct(F.array("top", "bottom"))).alias("x")).select("source_id", F.col("x.item_no").alias("item_no"), F.col("x.line_no").alias("line_no"), F.lit(True).alias("_edge"))
    items = items.join(edges, ["source_id", "item_no", "line_no"], "left")
    items = items.withColumn("edge", F.coalesce("_edge", F.lit(False)) & F.col("alone")).drop("_edge")
    return whole.unionByName(items)


def _nearly(once: DataFrame, again: DataFrame) -> DataFrame:
    """The keys of ``once`` (source_id, _key) that a key of ``again`` (source_id, _other) equals but for a sixth of the letters.

    A key cut in one piece more than it may have misread letters keeps one of them whole, so keys
    meet by their pieces and all pairs are found without comparing every line with every other.
    """
    most = F.floor(F.length("_key") / 6).cast("int")
    cuts = once.where(F.length("_key") >= 6).withColumn("_most", most)
    at = lambda i: F.floor(i * F.length("_key") / (F.col("_most") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("_most")), lambda i: F.substring(F.col("_key"), at(i) + 1, at(i + 1) - at(i)))
    asked = cuts.select("source_id", "_key", "_most", F.explode(F.array_distinct(pieces)).alias("_piece"))
    # Pieces have three to six letters, whatever the length of the key.
    runs = F.flatten(F.transform(F.sequence(F.lit(3), F.lit(6)), lambda n: F.transform(F.sequence(F.lit(1), F.length("_other")), lambda i: F.substring(F.col("_other"), i, n))))
    held = again.select("source_id", "_other", F.explode(F.array_distinct(runs)).alias("_piece"))
    met = asked.join(held, ["source_id", "_piece"]).where(F.abs(F.length("_key") - F.length("_other")) <= F.col("_most"))
    return met.select("source_id", "_key", "_most", "_other").distinct().where(F.levenshtein("_key", "_other") <= F.col("_most")).select("source_id", "_key").distinct()


def with_furniture(lines: DataFrame) -> DataFrame:
    """``lines`` with header: whether a line is a running header.

    A line at an edge is one if it recurs at edges of its source or nearly so (a misread letter),
    if edges of several sources have it, if it is the source's title, if an item of one line is
    labelled so, or if it is much shorter than the lines of its source and yet ends no sentence.
    """
    edges = lines.where(F.col("edge") & ~F.col("number") & ~F.col("heading") & _could_be_header(F.col("text"))).withColumn("_key", _key_of(F.col("text")))
    edges = cut(edges.select("source_id", "item_no", "line_no", "_key", "label", F.char_length(F.trim("text")).alias("_long")))
    own = edges.groupBy("source_id", "_key").agg(F.count("*").alias("_own"))
    everywhere = own.groupBy("_key").agg(F.count("*").alias("_sources"))
    once, again = own.where("_own = 1").select("source_id", "_key"), own.where("_own > 1").select("source_id", F.col("_key").alias("_other"))
    misread = cut(_nearly(once, again).withColumn("_near", F.lit(True)))
    shape = lines.where(~F.col("number")).groupBy("source_id").agg(F.max(F.when(~F.col("heading"), F.char_length("text"))).alias("_width"), F.min_by(F.col("text"), F.when(F.col("heading"), F.struct("item_no", "line_no"))).alias("_title"))
    counted = sized_join(sized_join(sized_join(edges.join(own, ["source_id", "_key"]), everywhere, ["_key"]), misread, ["source_id", "_key"]), shape, ["source_id"])
    near = (F.col("_own") > 1) | F.coalesce("_near", F.lit(False))
    titled = F.levenshtein(F.regexp_replace(F.lower(F.trim(F.regexp_replace("_title", "^#+", ""))), r"\d+", "#"), F.col("_key")) <= F.length("_key") / 8
    running = near | (F.col("_sources") > 2) | titled | F.col("label").isin("page_header", "page_footer") | F.col("_key").rlike(r" [|–] ") | (F.col("_long") <= 0.6 * F.col("_width"))
    headers = counted.where(running).select("source_id", "item_no", "line_no", F.lit(True).alias("header"))
    return sized_join(lines, headers.distinct(), ["source_id", "item_no", "line_no"]).withColumn("header", F.coalesce("header", F.lit(False)))


def tokens(line: str) -> list[str]:
    """The words and numbers of a line without the punctuation around them; what ends a sentence is kept as a mark before the next word."""
    out = []
    for raw in line.split():
        word = raw.strip(_EDGES)
        if word:
            out.append(word)
        if not word or raw.rstrip(_CLOSERS).endswith((".", "!", "?", ":")):
            out.append("\u0002")
    return out


def number_repair(word: str) -> str | None:
    """A number with its misread digits put right, or null."""
    digits = sum(c.isdigit() for c in word)
    if digits >= 2 and any(c in "OlISB" for c in word):
        if _NUMERIC.match(word):
            return word.translate(_DIGITS).strip("€$£%")
        m = re.fullmatch(r"([A-Z]{2,4}-)([\dOlISB-]+?)(-[A-Z]\d)?", word)
        if m and any(c in "OlISB" for c in m[2]):
            return m[1] + m[2].translate(_DIGITS) + (m[3] or "")
    return None


@F.pandas_udf(T.StringType())
def _numbers(words: pd.Series) -> pd.Series:
    return pd.Series([number_repair(w) for w in words], dtype=object)


_OUT = pa.schema([("source_id", pa.int64()), ("item_no", pa.int32()), ("line_no", pa.int32()), ("torn", pa.bool_()), ("b_item", pa.int32()), ("b_line", pa.int32()), ("head", pa.string()), ("tail", pa.string()), ("rest", pa.string()), ("cut", pa.int32()), ("p_item", pa.int32()), ("p_line", pa.int32()), (PARTITION, pa.int32()), ("words", pa.list_(pa.string()))])
_OUT_DDL = f"source_id bigint, item_no int, line_no int, torn boolean, b_item int, b_line int, head string, tail string, rest string, cut int, p_item int, p_line int, {PARTITION} int, words array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text lines in order: what each continues from the line before, its words, and where its paragraph begins.

    The beginning is null for lines of a paragraph that began in an earlier partition.
    """
    last, fresh, began = None, True, (None, None)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if fresh:
                fresh, last = False, row["_last"] and dict(row["_last"], source_id=row["source_id"])
            line = row["text"].strip()
            before = last if last and last["source_id"] == row["source_id"] else None
            broken = _BROKEN.search(before["text"].strip()) if before and not before["heading"] else None
            first = re.match(r"[\"'“„«(]*([^\W\d_][^\W_]*(?:[’'-][^\W_]+)*)(\S*)\s*", line) if broken and not row["heading"] else None
            made = {"source_id": row["source_id"], "item_no": row["item_no"], "line_no": row["line_no"], "torn": False, "b_item": None, "b_line": None, "head": None, "tail": None, "rest": None, "cut": 0, PARTITION: row[PARTITION]}
            if first:
                start = re.search(r"[^\W\d_](?:[^\W_]|[’'-](?=\w))*\Z", before["text"].strip()[:-1])
                made |= {"b_item": before["item_no"], "b_line": before["line_no"], "head": start.group() if start else broken[1], "tail": first[1], "rest": first[2], "cut": first.end()}
            if before and before["page"] != row["page"] and not before["heading"] and not row["heading"] and not line.startswith(("|", "#")) and not before["text"].lstrip().startswith("|"):
                open_end = not _TERMINAL.search(before["text"])
                made["torn"] = bool(first) or (open_end and (line[:1].islower() or len(before["text"].strip()) >= 35))
            flows = before and not (row["heading"] or before["heading"] or _ALONE.match(line) or _ALONE.match(before["text"]))
            beside = before and before["item_no"] == row["item_no"] and before["line_no"] + 1 == row["line_no"] and before["page"] == row["page"]
            if not (made["torn"] or first or (flows and beside)):
                began = row["item_no"], row["line_no"]
            made |= {"p_item": began[0], "p_line": began[1]}
            words = tokens(line)
            if first and words:
                words = words[1:]
            if _BROKEN.search(line) and words:
                words = words[:-1]
            out.append(made | {"words": words})
            last = row
        if out:
            yield pa.RecordBatch.from_pylist(out, _OUT)


def edit_cost(read: str, true: str, most: float = 2.0) -> float:
    """Weighted edit distance from what was read to what may have been printed; confusion pairs are cheap."""
    if abs(len(read) - len(true)) > most:
        return most + 1
    n, m = len(read), len(true)
    best = [[most + 1] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = best[i][j]
            if here > most:
                continue
            if i < n and j < m:
                step = 0.0 if read[i] == true[j] else 1.0
                best[i + 1][j + 1] = min(best[i + 1][j + 1], here + step)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], here + 1)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], here + 1)
            for a in (1, 2):
                for b in (1, 2):
                    cost = _CHEAP.get((read[i : i + a], true[j : j + b])) if i + a <= n and j + b <= m else None
                    if cost is not None:
                        best[i + a][j + b] = min(best[i + a][j + b], here + cost)
    return best[n][m]


@F.pandas_udf(T.DoubleType())
def _costs(read: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([edit_cost(a, b) for a, b in zip(read, true, strict=True)], dtype=float)


def deletes(word: str) -> list[str]:
    """A word with up to two of its letters left out, fewer in short words."""
    found = {word}
    level = {word}
    for _ in range(2 if len(word) > 4 else 1):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w)) if len(w) > 2}
        found |= level
    return sorted(found)


def replaced(word: str) -> list[str]:
    """What a word may have been before one or two confusions; ``edit_cost`` tells which are cheap enough."""
    found: set[str] = set()
    level = {word}
    for _ in range(2):
        level = {w[:i] + b + w[i + len(a) :] for w in level for a, b in CONFUSIONS for i in range(len(w)) if w.startswith(a, i)}
        found |= level
    return sorted(found - {word})


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            lists = [replaced(w) for w in rows.column("word").to_pylist()]
            index = pa.array([k for k, x in enumerate(lists) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(index) for c in rows.columns), pa.array([d for x in lists for d in x], pa.string())], [*rows.schema.names, "d"])


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            lists = [deletes(w) for w in rows.column("word").to_pylist()]
            index = pa.array([k for k, x in enumerate(lists) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(index) for c in rows.columns), pa.array([d for x in lists for d in x], pa.string())], [*rows.schema.names, "d"])


def repairs(lexicon: DataFrame, common: int = 5, ratio: float = 10.0) -> DataFrame:
    """For each word that a frequent one explains: word, candidate, cost, n (the candidate's frequency).

    ``lexicon`` (word, n) has distinct words. A symmetric-delete index over the frequent words
    gives the candidates, together with the words that one or two confusions make of each word:
    a pair of letters read for one leaves short words no key in common. The weighted edit distance
    keeps those that confusion pairs explain and that are ``ratio`` times as frequent as the word.
    """
    plain = lexicon.where(F.col("word").rlike(r"^[\p{L}\d'’-]{2,40}$") & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"^[A-Z]{2,4}-?\d"))
    shown = plain.mapInArrow(_deleted, "word string, n bigint, d string")
    index = shown.where((F.col("n") >= common) & ~F.col("word").rlike(r"\d")).select("d", F.col("word").alias("candidate"), F.col("n").alias("m"))
    asked = shown.select("d", "word", "n")
    mixed = F.col("word").rlike(r"\d")
    # No count is asked for here: what is restored depends on the ratio alone, not on the size of the corpus.
    known = plain.where(~F.col("word").rlike(r"\d")).select(F.col("word").alias("d"), F.col("word").alias("candidate"), F.col("n").alias("m"))
    direct = sized_join(plain.mapInArrow(_replaced, "word string, n bigint, d string"), known, ["d"], "inner").select("d", "word", "n", "candidate", "m")
    # What is left of short words is the same for many of them: such keys are spread over several tasks.
    short, salts = F.length("d") < 4, 8
    asked = asked.withColumn("_salt", F.when(short, F.pmod(F.xxhash64("word"), F.lit(salts))).otherwise(0).cast("int"))
    index = index.withColumn("_salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    pairs = asked.join(index, ["d", "_salt"]).select("d", "word", "n", "candidate", "m").unionByName(direct).where((F.col("word") != F.col("candidate")) & (F.col("m") >= F.when(mixed, 1.5).otherwise(ratio) * F.col("n")))
    pairs = pairs.select("word", "n", "candidate", "m").distinct()
    costed = pairs.withColumn("cost", _costs("word", "candidate"))
    clear = (F.col("cost") <= 0.3) | ((F.col("cost") <= 0.6) & (F.col("m") >= F.when(mixed, 3.0).otherwise(50.0) * F.col("n")) & (F.length("word") > 3))
    return costed.where(clear).select("word", "candidate", "cost", F.col("m").alias("n"))


def scan_noise(document_results: DataFrame, document_texts: DataFrame) -> DataFrame:
    """The noise of scanned pages: source_id, item_no, line_no, kind, repaired.

    item_no is 0 for a whole document. kind: ``header``, ``page_number``, ``hyphen`` (the line on
    which a broken word begins; repaired is the word), ``char`` (a word or number misread;
    repaired is what it must read) and ``join`` (the first text line of a page that goes on with a
    sentence of the page before). Null and blank texts give no rows, repeated rows count once, an
    empty table gives no rows; other columns are ignored. Rows with a null source are one source.

    Method: furniture is told by what recurs at the edges of pages; text lines are read in order
    over all sources at once, range-sorted, so that no source is gathered in a task. A
    symmetric-delete index over the corpus's frequent words generates the candidates for every
    word, weighted edit distance with confusion pairs keeps those a scan explains, and the
    frequencies of the pairs of words around it pick the repair.
    """
    return noise_of(*scanned_lines(document_results, document_texts))


def scanned_lines(document_results: DataFrame, document_texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines with their furniture, and the text lines as they were read in order."""
    lines = with_furniture(cut(page_lines(document_results, document_texts)))
    body = lines.where(~F.col("number") & ~F.col("header")).select("source_id", "item_no", "line_no", "page", "text", "heading").dropDuplicates(["source_id", "item_no", "line_no"])
    ordered = range_sorted(body, ["source_id"], ["item_no", "line_no"])
    tail = ordered.groupBy(PARTITION, "source_id").agg(F.max_by(F.struct("item_no", "line_no", "page", "text", "heading"), F.struct("item_no", "line_no")).alias("_l"))
    seeded = with_carried(ordered, carried(tail, ["source_id"], {"_last": F.last("_l")}))
    return lines, cut(seeded.mapInArrow(_read, _OUT_DDL))


def noise_of(lines: DataFrame, read: DataFrame, whole_words: bool = False) -> DataFrame:
    """``scan_noise`` of the frames of ``scanned_lines``; with ``whole_words`` also word, as it was read."""
    at = ["source_id", "item_no", "line_no"]
    none = F.lit(None).cast("string").alias("word")
    furniture = lines.where(F.col("number") | F.col("header")).select(*at, F.when(F.col("number"), "page_number").otherwise("header").alias("kind"), F.lit("").alias("repaired"), none)
    joins = read.where("torn").select(*at, F.lit("join").alias("kind"), F.lit("").alias("repaired"), none)

    said = read.select(F.explode("words").alias("word")).where("word <> '\u0002'")
    lexicon = cut(said.groupBy("word").agg(F.count("*").alias("n")))
    fixes = cut(repairs(lexicon))

    broken = read.where("head IS NOT NULL").select("source_id", F.col("b_item").alias("item_no"), F.col("b_line").alias("line_no"), F.concat("head", "tail").alias("whole"), F.concat_ws("-", "head", "tail").alias("dashed"))
    broken = cut(broken)
    for form in ("whole", "dashed"):
        known = lexicon.select(F.col("word").alias(form), F.col("n").alias(f"_{form}")).join(broken.select(form).distinct(), form, "left_semi")
        broken = sized_join(broken, known, [form])
    best = fixes.groupBy("word").agg(F.min_by("candidate", F.struct("cost", (-F.col("n")).alias("m"))).alias("fixed"))
    broken = broken.withColumn("word", F.when(F.coalesce("_dashed", F.lit(0)) > F.coalesce("_whole", F.lit(0)), F.col("dashed")).otherwise(F.col("whole")))
    hyphens = sized_join(broken, best, ["word"]).select(*at, F.lit("hyphen").alias("kind"), F.coalesce("fixed", "word").alias("repaired"), none)

    placed = read.select(*at, "words", F.posexplode("words").alias("i", "word")).where("word <> '\u0002'")
    near = lambda k: F.coalesce(F.get("words", F.col("i") + k), F.lit("\u0003"))
    placed = placed.select(*at, "word", near(-1).alias("before"), near(1).alias("after"))
    numbers = placed.where(F.col("word").rlike(r"\d.*[OlISB]|[OlISB].*\d")).withColumn("repaired", _numbers("word")).where("repaired IS NOT NULL").select(*at, F.lit("char").alias("kind"), "repaired", "word")
    ligatures = placed.where(F.col("word").rlike("[ﬀ-ﬆ]")).select(*at, F.lit("char").alias("kind"), _unligated(F.col("word")).alias("repaired"), "word")

    suspects = sized_join(placed, fixes.groupBy("word").agg(F.collect_list(F.struct("candidate", "cost", "n")).alias("options")), ["word"], "inner")
    suspects = cut(suspects.select(*at, "word", "before", "after", F.inline("options")))
    for other in ("before", "after"):
        pair = placed.select(other, F.col("word").alias("candidate"))
        wanted = sized_join(pair, suspects.select(other, "candidate").distinct(), [other, "candidate"], "left_semi")
        suspects = sized_join(suspects, wanted.groupBy(other, "candidate").agg(F.count("*").alias(f"_{other}")), [other, "candidate"])
    context = F.log1p(F.coalesce("_before", F.lit(0))) + F.log1p(F.coalesce("_after", F.lit(0)))
    score = context + 0.3 * F.log("n") - 6 * F.col("cost")
    chosen = suspects.groupBy(*at, "word", "before", "after").agg(F.max_by("candidate", F.struct(score, "candidate")).alias("repaired"))
    chars = chosen.select(*at, F.lit("char").alias("kind"), "repaired", "word")
    every = furniture.unionByName(joins).unionByName(hyphens).unionByName(chars).unionByName(numbers).unionByName(ligatures)
    return (every if whole_words else every.drop("word")).distinct()


_LINE_TEXT = "source_id bigint, item_no int, line_no int, p_item int, p_line int, text string"


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line without what belongs to the line before, its words put right and its broken last word whole."""
    for batch in batches:
        texts = []
        for row in batch.select(["text", "cut", "fixes", "whole", "rest"]).to_pylist():
            line = row["text"].strip()[row["cut"] :]
            if row["whole"] is not None:
                line = re.sub(r"[^\W\d_](?:[^\W_]|[’'-](?=\w))*[" + re.escape(HYPHENS) + r"]\Z", "", line) + row["whole"] + (row["rest"] or "")
            for fix in row["fixes"] or ():
                line = re.sub(rf"(?<!\w){re.escape(fix['word'])}(?!\w)", lambda _, to=fix["repaired"]: to, line)
            texts.append(line.strip())
        named = ["source_id", "item_no", "line_no", "p_item", "p_line"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), pa.array(texts, pa.string())], [*named, "text"])


def repaired_paragraphs(document_results: DataFrame, document_texts: DataFrame) -> DataFrame:
    """The text of scanned pages as it was written: source_id, item_no, paragraph_no (from 1 within its item), text.

    Headers and page numbers are left out, broken words are made whole, misread words put right,
    and lines flow into paragraphs, also over the end of a page or an item. A blank line, a
    heading, a row of a table and an item of a list end a paragraph. A paragraph stands under the
    item in which it begins. Rows as in ``scan_noise``; blank texts give no paragraph.
    """
    lines, read = scanned_lines(document_results, document_texts)
    noise = cut(noise_of(lines, read, True))
    at = ["source_id", "item_no", "line_no"]
    fixes = noise.where("kind = 'char' AND word IS NOT NULL").groupBy(*at).agg(F.array_sort(F.collect_set(F.struct("word", "repaired"))).alias("fixes"))
    broken = read.where("head IS NOT NULL").select("source_id", F.col("b_item").alias("item_no"), F.col("b_line").alias("line_no"), "rest").dropDuplicates(at)
    wholes = noise.where("kind = 'hyphen'").groupBy(*at).agg(F.max("repaired").alias("whole")).join(broken, at)
    opened = read.where("p_line IS NOT NULL").groupBy(PARTITION, "source_id").agg(F.max(F.struct("p_item", "p_line")).alias("_o"))
    placed = with_carried(read.select(*at, "cut", "p_item", "p_line", PARTITION), carried(opened, ["source_id"], {"_began": F.last("_o", ignorenulls=True)}))
    placed = placed.select(*at, "cut", F.coalesce("p_item", "_began.p_item").alias("p_item"), F.coalesce("p_line", "_began.p_line").alias("p_line"))
    texts = lines.where(~F.col("number") & ~F.col("header")).select(*at, "text").dropDuplicates(at)
    full = sized_join(sized_join(placed.join(texts, at), fixes, at), wholes, at)
    flowing = full.select(*at, "cut", "p_item", "p_line", "text", "fixes", "whole", "rest").mapInArrow(_rewritten, _LINE_TEXT).where("text <> ''")
    parts = flowing.groupBy("source_id", "p_item", "p_line").agg(F.array_join(F.array_sort(F.collect_list(F.struct("item_no", "line_no", "text")))["text"], " ").alias("text"))
    # The paragraphs of one item: no more than one text holds.
    number = F.row_number().over(Window.partitionBy("source_id", "p_item").orderBy("p_line"))
    return parts.select("source_id", F.col("p_item").alias("item_no"), number.alias("paragraph_no"), "text")


def _unligated(word: Column) -> Column:
    for mark, letters in LIGATURES:
        word = F.replace(word, F.lit(mark), F.lit(letters))
    return word
