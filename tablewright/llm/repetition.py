"""Quality rules on repetition, from a word suffix array of every text.

The suffix array of each text comes from prefix doubling over its words (words are runs without ASCII white
space), for the suffixes that still share their rank only. Longest common prefixes of neighbours follow from the
ranks of the doubling steps. The higher of a suffix's two prefixes is the longest repeat that starts there; the
union of all such spans of at least ``REPEAT_WORDS`` words is the text's covered part.

Null and empty texts have no words and fail for being short. Repeated rows are judged each on its own. Texts of any
length are worked on whole. Columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.batches import pieces, small_batches, text_bytes

REPEAT_WORDS = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """What a kept text satisfies: enough words, few repeated words, few repeated characters, no long repeat."""

    min_words: int = 10
    repeat_words_percent: int = 20
    covered_chars: float = 0.25
    longest_words: int = 100


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in SYMBOLS]] = 1
    return table


SYMBOL_TABLE = _symbol_table()


def longest_repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest word sequence that starts there and elsewhere in its text.

    ``doc`` numbers the texts from 0 on, ``word`` the distinct words; words of a text are adjacent.
    """
    n = len(word)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    ends = np.searchsorted(doc, doc, side="right")  # where the text of each word ends
    key = doc.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    start = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(fresh) - 1]
    levels, step = [rank.copy()], 1
    while True:
        size = np.bincount(rank, minlength=n)
        alive = np.flatnonzero(size[rank] > 1)
        if not len(alive):
            break
        after = alive + step
        second = np.where(after < ends[alive], rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[alive] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        both, alive = both[order], alive[order]
        old = rank[alive]
        place = np.arange(len(alive))
        group = place[np.r_[True, old[1:] != old[:-1]]]
        first = group[np.searchsorted(group, place, side="right") - 1]
        part = place[np.r_[True, both[1:] != both[:-1]]]
        begun = part[np.searchsorted(part, place, side="right") - 1]
        rank[alive] = old + begun - first
        levels.append(rank.copy())
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    p, q = left[near], right[near]
    common = np.zeros(len(near), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        a, b = p + common, q + common
        inside = (a < ends[p]) & (b < ends[q])
        same = inside & (levels[power][np.minimum(a, n - 1)] == levels[power][np.minimum(b, n - 1)])
        common += same.astype(np.int64) << power
    np.maximum.at(out, p, common)
    np.maximum.at(out, q, common)
    return out


def _per_text(doc: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, values, minlength=n).astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a string column."""
    n = len(texts)
    texts = texts.cast(pa.large_string()).fill_null("")
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    doc = pc.list_parent_indices(split).to_numpy()
    filled = pc.not_equal(words, "")
    words, doc = words.filter(filled), doc[filled.to_numpy(zero_copy_only=False)]
    chars = pc.utf8_length(words).to_numpy()
    ids = words.dictionary_encode().indices.to_numpy()
    repeat = longest_repeats(doc, ids)
    spans = np.flatnonzero(repeat >= REPEAT_WORDS)
    edge = np.bincount(spans, minlength=len(ids) + 1) - np.bincount(spans + repeat[spans], minlength=len(ids) + 1)
    covered = (np.cumsum(edge)[: len(ids)] > 0).astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, repeat)
    flat, offsets = text_bytes(texts)
    symbols = np.r_[0, np.cumsum(SYMBOL_TABLE[flat])][offsets]
    lines = pc.split_pattern(texts, "\n")
    line_doc, line = pc.list_parent_indices(lines).to_numpy(), lines.flatten()
    worded = pc.not_equal(pc.ascii_trim_whitespace(line), "")
    line, line_doc = line.filter(worded), line_doc[worded.to_numpy(zero_copy_only=False)]
    line_ids = line.dictionary_encode().indices.to_numpy()
    distinct = np.unique(line_doc * (int(line_ids.max(initial=0)) + 1) + line_ids) // (int(line_ids.max(initial=0)) + 1)
    return {
        "n_words": _per_text(doc, n),
        "word_chars": _per_text(doc, n, chars),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": _per_text(line_doc, n) - _per_text(distinct, n),
        "n_repeat_words": _per_text(doc, n, covered),
        "n_repeat_chars": _per_text(doc, n, covered * chars),
        "longest_repeat": longest,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeat_chars", "longest_repeat")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the ``COUNTS``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in COUNTS)], names=[id_col, *COUNTS])

    small_batches(docs.sparkSession)
    picked = docs.select(id_col, F.col(text_col).cast("string"))
    return picked.mapInArrow(run, ", ".join([f"{id_col} {picked.schema[0].dataType.simpleString()}", *(f"{k} long" for k in COUNTS)]))


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts with ``base_failed`` (too short, or too many repeated words) and ``kept``."""
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_words_percent * F.col("n_words"))
    fits = (F.col("n_repeat_chars") <= limits.covered_chars * F.col("word_chars")) & (F.col("longest_repeat") <= limits.longest_words)
    return counts(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fits)
