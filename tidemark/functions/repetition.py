"""Folding of repeated word patterns and clean-up of recognised text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Least repeats of one word and of longer patterns, the longest pattern, and what counts as a word.
LEAST_ONE, LEAST_MORE, LONGEST = 5, 3, 32
_WORD = re.compile(r"\w+(?:[-'’]\w+)*")
_MARKS = regex.compile(r"\p{P}*")


@lru_cache(maxsize=1 << 16)
def _name(word: str) -> str:
    return unicodedata.normalize("NFKC", word).casefold()


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for words alike in NFKC and case-folded, and the place where it ends."""
    found = [(m.group(), m.end()) for m in _WORD.finditer(text)]
    ids, names = pd.factorize(np.array([_name(w) for w, _ in found], object))
    real = (names != "")[ids] if len(names) else np.zeros(0, bool)
    return ids[real], np.array([b for _, b in found], np.int64)[real]


def _periods(ids: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words from which a pattern of n words comes `least` times or more in a row, and how often."""
    differ = np.flatnonzero(ids[:-n] != ids[n:])
    ends = np.append(differ, ids.size - n)
    starts = np.concatenate([[0], differ + 1])
    long = ends - starts >= (least - 1) * n  # runs of words that equal the word n further on
    starts, ends = starts[long], ends[long]
    if not starts.size:
        return starts, starts
    at = np.concatenate([np.arange(a, b - (least - 1) * n + 1) for a, b in zip(starts, ends)])
    return at, (np.repeat(ends, ends - starts - (least - 1) * n + 1) - at) // n + 1


def fold_once(text: str) -> str:
    ids, ends = _words(text)
    # the shortest pattern at each word that repeats often enough, and its number of words in all repeats
    size, reach = np.zeros(ids.size, np.int64), np.zeros(ids.size, np.int64)
    for n in range(min(LONGEST, ids.size // LEAST_MORE), 0, -1):
        at, times = _periods(ids, n, LEAST_ONE if n == 1 else LEAST_MORE)
        size[at], reach[at] = n, times * n
    # characters of repeats after the first go, from the leftmost repeat on; the marks after a word go or stay with it
    change, done = np.zeros(len(text) + 1, np.int64), 0
    for i in np.flatnonzero(size).tolist():
        if i >= done:
            done = i + int(reach[i])
            for k, step in ((i + size[i] - 1, 1), (done - 1, -1)):
                change[_MARKS.match(text, int(ends[k])).end()] += step
    return "".join(compress(text, np.cumsum(change[:-1]) == 0)) if done else text


def fold(text: str | None) -> str | None:
    """Patterns of words that repeat in a row, folded to their first occurrence until nothing changes."""
    while text and (shorter := fold_once(text)) != text:
        text = shorter
    return text


@F.pandas_udf(StringType())
def fold_repeats(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


#: What clean-up replaces, in order. The second pattern is Hiragana and Katakana, CJK, Hangul, CJK symbols and full-width forms.
CLEAN = (
    (r"(?i)^\s*input transcript corrected\s*:\s*", ""),
    ("[぀-ヿ㐀-鿿가-힯　-〿＀-￯]", ""),
    (r"\s+", " "),
    (r"\s+([,.;:!?])", "$1"),
    (r"(^|[,;:])\s*,", "$1"),
    (r",\s*,", ","),
    ("^[ ,]+|[ ,]+$", ""),
)


def clean_segment(text: Column) -> Column:
    """Recognised text without its correction prefix and CJK characters, blanks and commas put right."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in CLEAN:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)
