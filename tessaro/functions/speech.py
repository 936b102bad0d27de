"""What was said, as words that can be compared: contractions written out, numbers as digits, word errors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Contractions and what they stand for.
CONTRACTIONS = {
    "let's": "let us", "it's": "it is", "that's": "that is", "what's": "what is", "there's": "there is", "i'm": "i am", "we're": "we are", "you're": "you are", "they're": "they are",
    "i'll": "i will", "we'll": "we will", "you'll": "you will", "they'll": "they will", "i've": "i have", "we've": "we have", "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "can't": "cannot", "won't": "will not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "shouldn't": "should not",
}
# English number words.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_VALUE = {w: i for i, w in enumerate(SMALL)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
_LARGE = {"thousand": 1_000, "million": 1_000_000}
_ALONE = re.compile(r"[^\w\s'.]|(?<!\d)\.|\.(?!\d)|_")


class _Number:
    """A number as it is spoken, word by word."""

    def __init__(self) -> None:
        self.done, self.open, self.last = 0, 0, None

    def takes(self, word: str) -> bool:
        """Whether the word goes on with this number: ``twenty five`` does, ``five twenty`` is two."""
        if word in _VALUE:
            value = _VALUE[word]
            if self.last is None or self.last in ("hundred", *_LARGE):
                return True
            return self.last in TENS and 1 <= value <= 9
        return self.last is not None and (word in _LARGE and self.last not in _LARGE or word == "hundred" and self.last not in ("hundred", *_LARGE, *TENS))

    def add(self, word: str) -> None:
        if word in _VALUE:
            self.open += _VALUE[word]
        elif word == "hundred":
            self.open *= 100
        else:
            self.done, self.open = self.done + self.open * _LARGE[word], 0
        self.last = word


def digits_of(words: list[str]) -> list[str]:
    """Runs of number words as digits: ``one hundred and five`` is ``105``, ``twenty twenty six`` is ``20 26``."""
    out, number = [], _Number()
    for i, word in enumerate(words):
        joins = word == "and" and number.last in ("hundred", *_LARGE) and i + 1 < len(words) and words[i + 1] in _VALUE
        if joins or number.takes(word):
            if not joins:
                number.add(word)
            continue
        if number.last is not None:
            out.append(str(number.done + number.open))
            number = _Number()
        if number.takes(word):
            number.add(word)
        else:
            out.append(word)
    return out if number.last is None else [*out, str(number.done + number.open)]


def spoken(text: str) -> list[str]:
    """The words of a text as they are said: lower case, dollars and percent as words, contractions written out, numbers as digits."""
    text = re.sub(r"\$\s?(\d[\d,]*(?:\.\d+)?)", r"\1 dollars", text)
    text = re.sub(r"(?<=\d),(?=\d)", "", text.lower().replace("’", "'").replace("%", " percent"))
    words = [w for x in _ALONE.sub(" ", text).split() for w in CONTRACTIONS.get(x, x.replace("'", "")).split()]
    return digits_of(words)


def errors(reference: list[str], said: list[str]) -> int:
    """The least number of words to replace, leave out or put in, by one row of the table at a time."""
    known: dict[str, int] = {}
    a, b = (np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in (reference, said))
    row, place = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, word in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != word))
        # what is put in costs one more than the least to the left
        row = np.minimum.accumulate(np.r_[i, step] - place) + place
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def word_error_rate(reference: pd.Series, said: pd.Series) -> pd.Series:
    """Word errors by word of the reference; an empty reference gives 0 for nothing said and 1 else; a null text is empty."""

    def rate(one: str | None, other: str | None) -> float:
        a, b = spoken(one or ""), spoken(other or "")
        return errors(a, b) / len(a) if a else float(bool(b))

    return pd.Series([rate(x, y) for x, y in zip(reference, said, strict=True)], dtype=float)
