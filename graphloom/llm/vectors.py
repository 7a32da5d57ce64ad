"""Vectors of integers and the best of many scores: what the exact vector searches share.

Components are scaled and rounded down, as doubles, which hold such integers exactly. Inner products are computed as
doubles where no partial sum can pass 2**53 and with Python's own integers otherwise. A vector shorter than another
counts as followed by zeros. Scores beyond 64 bits are returned as the largest or smallest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id inside a search: it comes after every other id.
NO_ID = (1 << 63) - 1
#: Below every score; what does not count is minus infinity.
LOWEST = -1e300


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector takes part: it is not null, and no component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def distinct_rows(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Rows as (columns, copies), with ``copies`` at most ``most``: a result of so many rows can show no more of them."""
    return rows.groupBy(*columns).agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("copies"))


def matrix(vectors: pd.Series, scale: int, width: int = 0) -> np.ndarray:
    """One row of integers a vector, padded with zeros to the longest or to ``width``."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    width = max(width, int(lengths.max(initial=0)))
    flat = np.floor(scale * np.concatenate([np.zeros(0), *vectors]).astype(np.float64))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows of ``a`` and ``b`` are exact as doubles: no partial sum passes the norms' product."""
    return float(norms(a).max(initial=0)) * float(norms(b).max(initial=0)) < 2.0**53


def _clipped(m: np.ndarray) -> np.ndarray:
    return np.clip(m, -NO_ID, NO_ID).astype(np.int64)


def _whole(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


def all_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of every row of ``a`` with every row of ``b``."""
    return a @ b.T if exact(a, b) else _clipped(_whole(a) @ _whole(b).T)


def pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with the rows of ``b`` beside them."""
    if exact(a, b):
        return np.einsum("ij,ij->i", a, b)
    return _clipped((_whole(a) * _whole(b)).sum(axis=1))


class Best:
    """The ``k`` best entries of each of ``n`` lists: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.lists, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        #: What an entry of each list must reach to count.
        self.least = np.full(n, LOWEST)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least[lists]
        lists = np.concatenate((self.lists, lists[keep]))
        scores = np.concatenate((self.scores, scores[keep].astype(np.int64)))
        ids = np.concatenate((self.ids, ids[keep]))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        begin = np.searchsorted(lists, np.arange(self.n + 1))
        kept = np.arange(len(lists)) - begin[lists] < self.k
        self.lists, self.scores, self.ids = lists[kept], scores[kept], ids[kept]
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.least[full] = np.maximum(self.least[full], scores[begin[full] + self.k - 1])


def promising(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of a matrix that can be among the ``k`` best of their row and reach ``least``."""
    if scores.shape[1] > 4 * k and (scores >= least[:, None]).sum() > 4 * k * len(scores):
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    return np.nonzero(scores >= least[:, None])
