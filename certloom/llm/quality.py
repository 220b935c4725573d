"""Quality rules on repetition inside a document, from a suffix array over its words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Words of the windows of n_repeat_words, and the base rules.
REPEAT, LEAST_WORDS, MOST_REPEAT_PERCENT = 5, 10, 20
#: The method's verdict: maximal repeats of at least MIN_REPEAT words may cover so much of the word
#: characters, and the longest may have so many words: three times those of the longest repeat in the
#: labelled sf0.1 documents that pass the base rules. There the first limit rejects 1 of 3,631, the second none.
MIN_REPEAT, MOST_COVERED, LONGEST = 8, 0.2, 40
#: Words whose suffixes are sorted at once (a longer document is sorted by itself).
CHUNK = 300_000


def suffix_array(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP with the suffix before) over the words of many documents.

    words: word ids; docs: each word's document, not decreasing. Suffixes end with their document
    and are ordered by it first, so repeats never cross documents. Ranks double in length;
    only suffixes that still share a rank are sorted again, by radix-free sorts of whole arrays.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = docs * (int(words.max()) + 1) + words
    ends = np.searchsorted(docs, docs, "right")
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    sorted_keys = keys[order]
    fresh = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    size = np.bincount(rank[:n], minlength=n)
    active = order[size[rank[order]] > 1]
    while len(active):
        ahead = active + step
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n)], -1)
        key = rank[active] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        inside = np.arange(len(active)) - np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))
        start = np.concatenate([[True], key[1:] != key[:-1]])
        new = np.maximum.accumulate(np.where(start, old + inside, 0))
        rank[active] = new
        levels.append(rank.copy())
        step *= 2
        counts = np.diff(np.append(np.flatnonzero(start), len(active)))
        active = active[np.repeat(counts > 1, counts)]
    sa = np.empty(n, np.int64)
    sa[rank[:n]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[at].copy(), sa[at - 1].copy()
    common = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = (levels[level][a] == levels[level][b]) & (a < n) & (b < n)
        a, b, common = a + (same << level), b + (same << level), common + (same << level)
        a, b = np.minimum(a, n), np.minimum(b, n)
    lcp[at] = common
    return sa, lcp


def covered(sa: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each word, whether a repeat of at least `least` words covers it: the union of the
    repeats' spans, first occurrences included."""
    n = len(sa)
    longest = np.maximum(lcp, np.append(lcp[1:], 0)) if n else lcp
    hit = longest >= least
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, sa[hit], 1)
    np.add.at(edge, sa[hit] + longest[hit], -1)
    return np.cumsum(edge[:n]) > 0


#: What precedes the members of an interval that do not all follow the same word.
DIVERSE = -1


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, words: np.ndarray, docs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(document, words, occurrences) of each maximal repeat of at least `least` words.

    They are the LCP intervals whose members do not all follow the same word. Only runs of LCP
    values that long are walked; the stack holds of each open interval its length, its first rank and the
    word before its members so far, which a closed interval hands to the one around it. So the walk
    is linear, however deep intervals nest.
    """
    out: list[tuple[int, int, int]] = []
    at = np.flatnonzero(lcp >= least)
    if not len(at):
        return out
    before = np.where((sa > 0) & (docs[sa - 1] == docs[sa]), words[sa - 1], DIVERSE)
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        low, high = int(run[0]) - 1, int(run[-1])
        doc, stack = int(docs[sa[low]]), []
        for rank, (word, value) in enumerate(zip(before[low : high + 1].tolist(), [*lcp[low + 1 : high + 1].tolist(), 0], strict=True)):
            first = rank
            while stack and stack[-1][0] > value:
                length, first, held = stack.pop()
                word = word if word == held else DIVERSE
                if word == DIVERSE:
                    out.append((doc, length, rank - first + 1))
            if stack and stack[-1][0] == value:
                if stack[-1][2] != word:
                    stack[-1][2] = DIVERSE
            elif value:
                stack.append([value, first, word])
    return out


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The figures of whole texts, by column."""
    words = [WORD.findall(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ids = pd.factorize(np.array(flat, object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    docs = np.repeat(np.arange(len(texts)), n_words)
    sa, lcp = suffix_array(ids, docs)
    out = {"n_words": n_words, "word_chars": np.bincount(docs, sizes, len(texts)).astype(np.int64)}
    out["n_symbols"] = np.array([len(SYMBOLS.findall(t)) for t in texts], np.int64)
    out["n_dup_lines"] = np.array([_dup_lines(t) for t in texts], np.int64)
    out["n_repeat_words"] = np.bincount(docs, covered(sa, lcp, REPEAT), len(texts)).astype(np.int64)
    out["repeat_chars"] = np.bincount(docs, sizes * covered(sa, lcp, MIN_REPEAT), len(texts)).astype(np.int64)
    out["n_repeats"], out["longest_repeat"] = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for doc, length, _ in maximal_repeats(sa, lcp, ids, docs, MIN_REPEAT):
        out["n_repeats"][doc] += 1
        out["longest_repeat"][doc] = max(out["longest_repeat"][doc], length)
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT_PERCENT * n_words)
    good = (out["repeat_chars"] <= MOST_COVERED * out["word_chars"]) & (out["longest_repeat"] <= LONGEST)
    out["kept"] = ~out["base_failed"] & good
    return out


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


FIGURES = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "n_repeats", "longest_repeat")]
    + [T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")]
)


def repetition(docs: DataFrame) -> DataFrame:
    """docs plus its figures and the verdict kept.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal
    to an earlier one) and n_repeat_words (words in windows of REPEAT words found twice or more) feed
    base_failed. From the suffix array: repeat_chars (characters of words that maximal repeats of
    at least MIN_REPEAT words cover), n_repeats and longest_repeat (words). kept is false if the
    base rules or the limits on these fail.

    Null or empty text has no words and fails. Ties and repeated rows each get their figures. An
    empty table gives an empty result. Columns of docs with the results' names are replaced.

    A map over batches without a shuffle; suffixes of about CHUNK words are sorted at once.
    """
    names = [f.name for f in FIGURES]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *FIGURES.fields])
    column = kept.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < len(batch):
                texts, size = [], 0
                while low + len(texts) < len(batch) and size < 6 * CHUNK:
                    texts.append(batch.column(column)[low + len(texts)].as_py() or "")
                    size += len(texts[-1])
                rows, figures = batch.slice(low, len(texts)), measure(texts)
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(figures[x]) for x in names]], names=[*rows.schema.names, *names])
                low += len(texts)

    return kept.mapInArrow(work, schema)


def op2_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
