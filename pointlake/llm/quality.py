"""Quality rules by suffix-array repetition.

Each document's words get a suffix array with the longest common prefixes of its neighbours; the
intervals of that array whose common prefix is long are the document's maximal repeated substrings.
Their spans are united: a document fails when the share of words covered by repeats of
``least_words`` or more exceeds ``max_share``, or when its longest repeat exceeds ``max_longest``.
The base rules (too few words, too many words in repeated 5-word windows) come first; the windows are
read off the same array.  Many documents share one array per batch (word codes are made distinct
per document), so nothing is shuffled and memory depends on the batch, or on one document if that is
longer.

Defined results: a NULL or empty text has no words and zero counts, and fails the base rule on
length; ids, repeated rows and other columns play no part in a row's result and are passed on; a
column that has the name of an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm import suffixes
from pointlake.llm.common import SPACES, map_column

SYMBOLS = "#*$%&|<>"
WINDOW = 5
KEEP = 64  # words whose ranks are kept; longer common prefixes are found from the finished array
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    worded = [x for x in lines if x.strip(SPACES)]
    return len(worded) - len(set(worded))


def repetition(counts: np.ndarray, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated windows, words covered by repeats of ``least`` words or more,
    and the length of the longest repeat (0 below the window's length)."""
    n, docs = len(codes), len(counts)
    if not n:
        return (np.zeros(docs, np.int64),) * 3
    owner = np.repeat(np.arange(docs), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    codes = owner * (int(codes.max()) + 1) + codes
    order, levels = suffixes.suffix_array(codes, ends, keep=KEEP)
    at, lcp = suffixes.neighbour_lcp(order, ends, levels, min(WINDOW, least))
    lcp = suffixes.lengthen(lcp, order[at], order[at + 1], codes, ends, sum(k for k, _ in levels))
    start, length = np.concatenate([order[at], order[at + 1]]), np.concatenate([lcp, lcp])
    at = length >= WINDOW
    windows = suffixes.covered(n, start[at], np.full(int(at.sum()), WINDOW))
    at = length >= least
    spans = suffixes.covered(n, start[at], length[at])
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, owner[start], length)
    return np.bincount(owner[windows], minlength=docs), np.bincount(owner[spans], minlength=docs), longest


def measure(texts: list[str | None], least: int) -> dict[str, np.ndarray]:
    """The measures of each text."""
    words = [(t or "").encode().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    codes = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64)
    window, covered, longest = repetition(counts, codes, least)
    rows = [(len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), duplicate_lines(t)) if t else (0, 0, 0) for t in texts]
    chars, symbols, lines = np.array(rows, np.int64).reshape(-1, 3).T
    return dict(zip(MEASURES, (counts, chars, symbols, lines, window, covered, longest), strict=True))


def quality_measures(df: DataFrame, text: str = "text", least_words: int = 10, keep: bool = True) -> DataFrame:
    """Add the measures (longs) to every row; ``keep=False`` leaves the text out."""
    def start():
        def apply(texts: list[str | None]) -> list[pa.Array]:
            found = measure(texts, least_words)
            return [pa.array(found[m], pa.int64()) for m in MEASURES]
        return apply

    return map_column(df, text, [(m, T.LongType()) for m in MEASURES], start, keep)


def judge(df: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, max_share: float = 0.3, max_longest: int = 100) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows with measures."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    sound = (F.col("n_covered") <= max_share * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & sound)
