"""String similarity: share of the longest common subsequence in both lengths, 0 to 100.

Spark's ``levenshtein`` counts substitutions and gives other values, and a chain of higher-order functions
rebuilds its bit masks at every step, so the common length is one Arrow-batched function over NumPy vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tablewright.functions.text import normalize, sort_tokens

# One machine word holds a text of this many characters; longer ones use Python integers.
WORD = 64


def _lcs(a: str, b: str) -> int:
    """Common length of two texts of any length, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _codes(texts: list[str], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).copy()
    codes[np.arange(width) >= sizes[:, None]] = pad
    return codes, sizes


def _lcs_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Common lengths of many pairs at once; the left text of each pair fits one word."""
    a, a_size = _codes(left, WORD, 0xFFFFFFFE)
    b, _ = _codes(right, max(1, max(map(len, right))), 0xFFFFFFFF)
    free = np.full(len(left), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(b.shape[1]):
        same = np.packbits(a == b[:, j, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        hit = free & same
        free = (free + hit) | (free - hit)
    taken = np.unpackbits((~free).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (taken * (np.arange(WORD) < a_size[:, None])).sum(axis=1)


@pandas_udf(T.IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), dtype=np.int64)
    known = (a.notna() & b.notna()).to_numpy()
    left, right = a.to_numpy(dtype=object), b.to_numpy(dtype=object)
    batch: list[int] = []
    for i in np.flatnonzero(known):
        if len(left[i]) > len(right[i]):
            left[i], right[i] = right[i], left[i]
        if left[i] == right[i]:
            out[i] = len(left[i])
        elif len(left[i]) > WORD or len(right[i]) > 4 * WORD:
            out[i] = _lcs(left[i], right[i])
        elif left[i]:
            batch.append(i)
    for start in range(0, len(batch), 4096):
        part = batch[start : start + 4096]
        out[part] = _lcs_batch([left[i] for i in part], [right[i] for i in part])
    return pd.Series(out).where(known)


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts; two blank texts are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.try_divide(common_length(a, b) * F.lit(200.0), total))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity after sorting the words of each text."""
    return ratio(sort_tokens(a), sort_tokens(b))


def entity_ratio(a: Column, b: Column) -> Column:
    """Similarity of two names in normal form, 0 if either is blank."""
    x, y = normalize(a), normalize(b)
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(token_sort_ratio(x, y))


def within_length(a: Column, b: Column, threshold: int) -> Column:
    """Whether the lengths alone leave room for a similarity of ``threshold``; a test before the costly one."""
    shorter = F.least(F.length(a), F.length(b))
    return shorter * 200 >= (F.length(a) + F.length(b)) * threshold
