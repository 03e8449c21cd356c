"""Quality rules on repetition, by a suffix array over the words of each text.

The suffixes of all texts of a batch are sorted together by prefix doubling; only suffixes that
still tie are sorted again. Neighbours' longest common prefixes give, for each word, the longest
repeated substring that starts there: the longest common prefix interval around it. The union of
these spans is what maximal repeats cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capspark.llm.session import bound_batches
from capspark.llm.shingles import word_hashes

LEAST_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30  # percent of words in repeated windows
LEAST_REPEAT = 16
MAX_COVERED = 20  # percent of words in maximal repeats of LEAST_REPEAT words or more
LONGEST = 100  # words of a single repeat
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_RUN = 1 << 19


def longest_repeats(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """words: hashes of several texts one after the other, each from one of starts. For each
    position the length of the longest run of words from there that its text has elsewhere too."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    text = np.repeat(np.arange(len(starts), dtype=np.uint64), sizes)
    end = np.repeat(starts + sizes, sizes)
    key = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + text * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    count = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(count[rank] > 1)
    levels, k = [rank.astype(np.int32)], 1
    while len(tied):
        second = tied + k
        inside = second < end[tied]
        after = np.where(inside, rank[np.minimum(second, n - 1)], -1)
        both = rank[tied] * (n + 1) + after + 1
        o = np.argsort(both)
        pos, both = tied[o], both[o]
        old = rank[pos]
        i = np.arange(len(pos))
        sub = np.maximum.accumulate(np.where(np.concatenate(([True], both[1:] != both[:-1])), i, 0))
        top = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), i, 0))
        rank[pos] = old + sub - top
        levels.append(rank.astype(np.int32))
        k *= 2
        last = np.concatenate((sub[1:] != sub[:-1], [True]))
        alone = last & (sub == i)
        tied = np.sort(pos[~alone])
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    pair = np.flatnonzero(levels[0][array[:-1]] == levels[0][array[1:]])
    a, b = array[pair], array[pair + 1]
    a0 = a.copy()
    for m in range(len(levels) - 1, -1, -1):
        ok = (a < end[a0]) & (b < end[a0])
        same = ok & (levels[m][np.minimum(a, n - 1)] == levels[m][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << m
        a, b = a + step, b + step
    common = np.zeros(n + 1, np.int64)
    common[pair + 1] = a - a0
    out = np.empty(n, np.int64)
    out[array] = np.maximum(common[:-1], common[1:])
    return out


def spans(repeats: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of the repeats of at least `least` words."""
    at = np.flatnonzero(repeats >= least)
    if not len(at):
        return at, at
    ends = np.maximum.accumulate(at + repeats[at])
    first = np.concatenate(([True], at[1:] > ends[:-1]))
    return at[first], ends[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(at) - 1]))]


def _counts(text: str) -> tuple[int, int, int]:
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def measurer(window: int = WINDOW, least_repeat: int = LEAST_REPEAT):
    """text -> word, symbol, line and repetition counts, and the spans of the maximal repeats."""

    def measure(texts: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        run: list[np.ndarray] = []

        def flush() -> None:
            sizes = [len(h) for h in run]
            starts = np.cumsum([0, *sizes])[:-1]
            all_repeats = longest_repeats(np.concatenate(run) if run else np.zeros(0, np.uint64), np.array([s for s, k in zip(starts, sizes, strict=True) if k], np.int64))
            for s, k in zip(starts, sizes, strict=True):
                own = all_repeats[s : s + k]
                longest = int(own.max()) if k else 0
                w = spans(own, window) if longest >= window else ((), ())
                a, b = spans(own, least_repeat) if longest >= least_repeat else ((), ())
                rows.append((k, int(np.sum(w[1])) - int(np.sum(w[0])), int(np.sum(b)) - int(np.sum(a)), longest, list(a), list(b)))
            run.clear()

        values, total = texts.to_pylist(), 0
        for t in values:
            h = word_hashes(t, lower=False)
            if run and total + len(h) > _RUN:
                flush()
                total = 0
            run.append(h)
            total += len(h)
        flush()
        counts = [_counts(t or "") for t in values]
        n, repeated, covered, longest, a, b = zip(*rows, strict=True) if rows else ((),) * 6
        chars, symbols, lines = zip(*counts, strict=True) if counts else ((),) * 3
        longs = [pa.array(list(map(int, x)), pa.int64()) for x in (n, chars, symbols, lines, repeated, covered, longest)]
        at = [pa.array([list(map(int, y)) for y in x], pa.list_(pa.int64())) for x in (a, b)]
        return pa.StructArray.from_arrays([*longs, *at], names=_NAMES)

    return F.arrow_udf(measure, _TYPE).asNondeterministic()


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "span_starts", "span_ends"]
_TYPE = ", ".join(f"{x} long" for x in _NAMES[:7]) + ", span_starts array<long>, span_ends array<long>"


def verdict(n: Column, repeated: Column, covered: Column, longest: Column) -> tuple[Column, Column]:
    """(base_failed, kept)."""
    base = (n < LEAST_WORDS) | (100 * repeated > MAX_REPEATED * n)
    return base, ~base & (100 * covered <= MAX_COVERED * n) & (longest <= LONGEST)


def repetition(docs: DataFrame, text_col: str = "text", out_col: str = "repetition") -> DataFrame:
    """docs with a struct column out_col (a column of that name is replaced): n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, span_starts, span_ends
    (in words), base_failed, kept. A null or empty text has no words and fails. Repeated rows are
    judged each; a text is one row's work, long ones alone; an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    out = docs.withColumn(out_col, measurer()(text_col))
    c = lambda x: F.col(f"{out_col}.{x}")
    base, kept = verdict(c("n_words"), c("n_repeat_words"), c("covered_words"), c("longest_repeat"))
    return out.withColumn(out_col, F.col(out_col).withField("base_failed", base).withField("kept", kept))
