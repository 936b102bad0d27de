"""Texts in one form, so that two that say the same in different formats are equal."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English months and their short forms.
MONTHS = (
    ("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"),
    ("september", "sept", "sep"), ("october", "oct"), ("november", "nov"), ("december", "dec"),
)
# Dashes and quotes that stand for the plain ones.
DASHES = "‐‑‒–—―−"
QUOTES = "‘’“”"
_MONTH = "|".join(sorted((name for names in MONTHS for name in names), key=len, reverse=True))
_WORD = r"\p{L}\p{N}_"


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def iso_dates_in(text: Column) -> Column:
    """A lower-case text with its dates written year first: month names either way round, month/day/year, short ISO dates."""
    for number, names in enumerate(MONTHS, 1):
        text = F.regexp_replace(text, rf"\b(?:{'|'.join(names)})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", f"$2-{number:02d}-$1")
    for number, names in enumerate(MONTHS, 1):
        text = F.regexp_replace(text, rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:{'|'.join(names)})\.?,?\s+(\d{{4}})\b", f"$2-{number:02d}-$1")
    return text


def canonical(text: Column) -> Column:
    """Lower case, compatible characters, ISO dates, plain numbers, and no punctuation but what belongs to numbers and codes.

    ``$4,980.00`` and ``4980``, ``October 14, 2026`` and ``2026-10-14`` come out alike.
    """
    t = F.lower(F.translate(_compatible(text), DASHES + QUOTES, "-" * len(DASHES) + "''\"\""))
    t = F.regexp_replace(t, r"(?<=\d) +- +(?=\d)", "-")
    t = F.when(t.rlike(rf"\b(?:{_MONTH})\b"), iso_dates_in(t)).otherwise(t)
    t = F.regexp_replace(t, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", "$3-$1-$2")
    t = F.regexp_replace(t, r"\b(\d{4})-(\d)-(\d{1,2})\b", "$1-0$2-$3")
    t = F.regexp_replace(t, r"\b(\d{4})-(\d{2})-(\d)\b", "$1-$2-0$3")
    t = F.regexp_replace(t, "[$€£¥]", " ")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", "")
    t = F.regexp_replace(t, r"(?<=\d)\.0+(?!\d)", "")
    t = F.regexp_replace(t, r"(?<!\d)[.:]|[.:](?!\d)", " ")
    t = F.regexp_replace(t, rf"[^{_WORD}\s.:%/@#+-]", " ")
    t = F.regexp_replace(t, rf"(?<![{_WORD}])-|-(?![{_WORD}])", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def contains_words(haystack: Column, needle: Column) -> Column:
    """Whether a canonical text holds a canonical needle at word boundaries; an empty needle is in none."""
    pattern = F.concat(F.lit(rf"(?<![{_WORD}])\Q"), needle, F.lit(rf"\E(?![{_WORD}])"))
    return F.coalesce((needle != "") & F.contains(haystack, needle) & F.regexp_like(haystack, pattern), F.lit(False))


def iso_date(text: Column) -> Column:
    """A written date as an ISO date, or null: year first, day and month where only one order is possible, or with an English month name.

    ``14/09/2026`` and ``09/14/2026`` are told by the number above 12; ``03/04/2026`` may be two days and is none.
    """
    t = F.lower(F.trim(text))
    numeric = r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})$"
    a, b, c = (F.regexp_extract(t, numeric, i) for i in (1, 2, 3))
    one, two = a.try_cast("int"), b.try_cast("int")
    named, spelt = rf"^(\d{{1,2}})[\s-]+({_MONTH})\.?[\s-]+(\d{{4}})$", rf"^({_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$"
    first = F.greatest(F.regexp_extract(t, named, 1), F.regexp_extract(t, spelt, 2))
    name = F.greatest(F.regexp_extract(t, named, 2), F.regexp_extract(t, spelt, 1))
    month = F.coalesce(*(F.when(name.isin(*names), F.lit(number)) for number, names in enumerate(MONTHS, 1)))
    year = F.greatest(F.regexp_extract(t, named, 3), F.regexp_extract(t, spelt, 3))

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.date_format(F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")

    ends = (F.length(c) == 4) & (F.length(a) <= 2)
    return (
        F.when(F.length(a) == 4, day(a, b, c))
        .when(ends & (one > 12) & (two <= 12), day(c, b, a))
        .when(ends & (one <= 12) & ((two > 12) | (one == two)), day(c, a, b))
        .when(month.isNotNull(), day(year, month, first))
    )


def canonical_sql(text: str) -> str:
    """The same as ``canonical`` in SQL without look-around: what must stay is put out of the way, each step twice as matches overlap."""

    def sub(inner: str, pattern: str, by: str, times: int = 1) -> str:
        for _ in range(times):
            inner = f"regexp_replace({inner}, '{pattern}', '{by}', 'g')"
        return inner

    quotes = QUOTES.replace("'", "''")
    t = f"lower(translate(nfc_normalize(translate({text}, chr(160) || chr(8239) || chr(8201) || chr(8203), '   ' || chr(8203))), '{DASHES}{quotes}', '{'-' * len(DASHES)}''''\"\"'))"
    t = sub(t, r"(\d) +- +(\d)", r"\1-\2", 2)
    for number, names in enumerate(MONTHS, 1):
        t = sub(t, rf"\b(?:{'|'.join(names)})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", rf"\2-{number:02d}-\1")
    for number, names in enumerate(MONTHS, 1):
        t = sub(t, rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:{'|'.join(names)})\.?,?\s+(\d{{4}})\b", rf"\2-{number:02d}-\1")
    t = sub(t, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\3-\1-\2")
    t = sub(t, r"\b(\d{4})-(\d)-(\d{1,2})\b", r"\1-0\2-\3")
    t = sub(t, r"\b(\d{4})-(\d{2})-(\d)\b", r"\1-\2-0\3")
    t = sub(t, "[$€£¥]", " ")
    t = sub(t, r"(\d),(\d{3})(\D|$)", r"\1\2\3", 3)
    t = sub(t, r"(\d)\.0+(\D|$)", r"\1\2", 2)
    t = sub(sub(t, r"(\d)\.(\d)", "\\1\x01\\2", 2), r"(\d):(\d)", "\\1\x02\\2", 2)
    t = f"translate(translate({t}, '.:', '  '), chr(1) || chr(2), '.:')"
    t = sub(t, rf"[^{_WORD}\s.:%/@#+-]", " ")
    t = sub(t, rf"([{_WORD}])-([{_WORD}])", "\\1\x03\\2", 2)
    t = f"translate(translate({t}, '-', ' '), chr(3), '-')"
    return f"trim({sub(t, r'\s+', ' ')})"
