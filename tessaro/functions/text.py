"""Text functions as columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of what may belong to one term: letters, digits and the marks inside identifiers.
RUN = r"([\p{L}\p{N}_./-]+)"
#: The decline phrase.
DECLINE = "not found in your documents"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, _lit(RUN), F.lit(1))


def search_terms(text: Column) -> Column:
    """The terms of ``search_text``, an array: identifiers whole, other runs split at their marks."""

    def bare(run: Column) -> Column:
        whole = F.regexp_replace(run, r"^[-_./]+|[-_./]+$", "")
        return F.when(run.rlike("[0-9]"), whole).otherwise(F.trim(F.regexp_replace(run, "[-_./]+", " ")))

    return F.filter(F.split(F.array_join(F.transform(runs(text), bare), " "), " "), lambda x: x != "")


def search_text(text: Column) -> Column:
    """The text as it is indexed for search."""
    return F.array_join(search_terms(text), " ")


def query_terms(text: Column, stop: list[str]) -> Column:
    """Distinct terms of a query in lower case, in their first order, without stop words unless nothing else is left."""
    terms = F.array_distinct(F.transform(search_terms(text), F.lower))
    kept = F.filter(terms, lambda x: ~x.isin(stop))
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def identifiers(text: Column) -> Column:
    """Distinct terms of three or more characters that hold a digit and something else, with alphanumeric edges."""
    bare = F.transform(runs(text), lambda r: F.regexp_replace(r, r"^[-_./]+|[-_./]+$", ""))
    return F.array_distinct(F.filter(bare, lambda x: (F.char_length(x) >= 3) & x.rlike("[0-9]") & x.rlike(r"[\p{L}_./-]")))


def citations(text: Column, sources: Column | None = None) -> Column:
    """The source numbers that an answer cites: ``[2]``, ``[1, 3]``, ``[2-4]``, in order, once each; with ``sources`` only those up to that number."""
    marks = F.regexp_extract_all(text, _lit(r"\[([0-9]+(?:\s*[,/–-]\s*[0-9]+)*)\]"), F.lit(1))

    def numbers(mark: Column) -> Column:
        parts = F.transform(F.split(mark, r"\s*[,/]\s*"), lambda p: F.split(p, r"\s*[–-]\s*"))
        ends = F.transform(parts, lambda p: F.struct(p[0].cast("int").alias("a"), F.element_at(p, -1).cast("int").alias("b")))
        return F.flatten(F.transform(F.filter(ends, lambda e: e["a"] <= e["b"]), lambda e: F.sequence(e["a"], e["b"])))

    found = F.array_distinct(F.flatten(F.transform(marks, numbers)))
    return found if sources is None else F.filter(found, lambda n: n.between(1, sources))


def declines(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains(DECLINE), F.lit(False))


def token_count(text: Column) -> Column:
    """The approximate number of model tokens: a third of the characters, plus one."""
    return (F.floor(F.char_length(text) / 3.0) + 1).cast("long")


# The suffixes that a light stem goes without, in this order, and the final letters that stay double.
SUFFIXES = ("ments", "ment", "ings", "ing", "ed", "es", "s")
STAYS_DOUBLE = "aeiouls"


def stem(word: Column) -> Column:
    """A light stem: the first suffix off after which three letters stay, then a final e off and a double letter halved where more than three are left."""
    whole = word
    for suffix in reversed(SUFFIXES):
        fits = word.endswith(suffix) & (F.char_length(word) >= len(suffix) + 3)
        whole = F.when(fits, F.substring(word, F.lit(1), F.char_length(word) - len(suffix))).otherwise(whole)
    bare = F.when(F.char_length(whole) > 3, F.regexp_replace(whole, "e$", "")).otherwise(whole)
    return F.when(F.char_length(bare) > 3, F.regexp_replace(bare, rf"([^{STAYS_DOUBLE}])\1$", "$1")).otherwise(bare)


def stem_sql(word: str) -> str:
    """``stem`` in SQL."""
    cut = f"CASE {' '.join(f"WHEN ends_with({word}, '{x}') AND length({word}) >= {len(x) + 3} THEN left({word}, -{len(x)})" for x in SUFFIXES)} ELSE {word} END"
    bare = f"(CASE WHEN length({cut}) > 3 AND ends_with({cut}, 'e') THEN left({cut}, -1) ELSE {cut} END)"
    return f"CASE WHEN length({bare}) > 3 AND right({bare}, 1) = substr({bare}, -2, 1) AND NOT contains('{STAYS_DOUBLE}', right({bare}, 1)) THEN left({bare}, -1) ELSE {bare} END"


def iso_dates(text: Column) -> Column:
    """Valid dates written year first, distinct and in order of occurrence."""
    found = F.regexp_extract_all(text, _lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull()))


def amount(text: Column) -> Column:
    """A written amount as a number: of two kinds of separator the later is the decimal one; one kind alone groups if every group has three digits."""
    digits = F.regexp_replace(text, r"[^0-9.,-]", "")
    last_dot, last_comma = F.instr(F.reverse(digits), "."), F.instr(F.reverse(digits), ",")
    both = (last_dot > 0) & (last_comma > 0)
    decimal_comma = both & (last_comma < last_dot)
    grouped = digits.rlike(r"^-?[0-9]{1,3}(?:[.,][0-9]{3})+$") & ~both
    plain = (
        F.when(decimal_comma, F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", "."))
        .when(both, F.regexp_replace(digits, ",", ""))
        .when(grouped, F.regexp_replace(digits, "[.,]", ""))
        .otherwise(F.regexp_replace(digits, ",", "."))
    )
    return F.when(digits.rlike("[0-9]"), plain.try_cast("double"))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB in steps of 1024."""
    kb, mb, gb = 1024, 1024**2, 1024**3

    def step(unit: int, name: str) -> Column:
        return F.concat(F.round(size / unit).cast("long").cast("string"), F.lit(f" {name}"))

    return F.when(size < kb, F.concat(size.cast("string"), F.lit(" B"))).when(size < mb, step(kb, "KB")).when(size < gb, step(mb, "MB")).otherwise(step(gb, "GB"))


def clock(seconds: Column) -> Column:
    """Seconds as ``m:ss`` or ``h:mm:ss``."""
    whole = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    colon = F.lit(":")
    return F.when(hours > 0, F.concat(hours.cast("string"), colon, two(minutes), colon, two(rest))).otherwise(F.concat(minutes.cast("string"), colon, two(rest)))


def citation_label(name: Column, page_start: Column, page_end: Column, start_s: Column) -> Column:
    """How a chunk is cited: its file with the time, or else the page or pages."""
    last = F.when(F.coalesce(page_end, F.lit(0)) == 0, page_start).otherwise(page_end)
    pages = F.when(last > page_start, F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("–"), last.cast("string"))).otherwise(F.concat(F.lit("p. "), page_start.cast("string")))
    return F.concat_ws(" · ", name, F.when(start_s.isNotNull(), clock(start_s)).otherwise(pages))
