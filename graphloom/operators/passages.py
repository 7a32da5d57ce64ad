"""Keyword scores of texts against a stated set of queries, by Arrow batches: what of a score needs no sequence ratio.

A batch is read once for all queries of a block. Its bigrams become numbers that count from 0, and a table of rows by
bigrams says which text has which; the table is made for so few rows at a time that it has a bound."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row

#: Cells of a table of rows by bigrams.
CELLS = 1 << 22
#: One more than the largest code point, which keeps bigrams and single characters apart.
_POINTS = 0x110000


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _gram_codes(grams: list[str]) -> np.ndarray:
    """Bigrams as first * _POINTS + second; a text of one character is its own gram, _POINTS ** 2 + it."""
    return np.array([_POINTS * _POINTS + ord(g) if len(g) == 1 else ord(g[0]) * _POINTS + ord(g[1]) for g in grams], np.int64)


def shared_grams(texts: list[str], queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(grams of each text, grams that text and query share: a row a query), both of distinct grams."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points, row = _points("".join(texts)), np.repeat(np.arange(len(texts)), lengths)
    inner = np.flatnonzero(row[1:] == row[:-1])
    single = np.flatnonzero(lengths[row] == 1)
    rows = np.concatenate([row[inner], row[single]])
    # characters by their rank among those of the batch: few, so that pairs of them can be marked in a table
    seen = np.zeros(_POINTS, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    rank = (np.cumsum(seen) - 1)[points]
    d = len(alphabet)
    codes = np.concatenate([rank[inner] * d + rank[inner + 1], d * d + rank[single]])
    if d * d + d <= CELLS:
        there = np.zeros(d * d + d, bool)
        there[codes] = True
        used, codes = np.flatnonzero(there), (np.cumsum(there) - 1)[codes]
    else:
        used, codes = np.unique(codes, return_inverse=True)
    known = np.where(used < d * d, alphabet[used // d % max(d, 1)] * _POINTS + alphabet[used % max(d, 1)], _POINTS * _POINTS + alphabet[used % max(d, 1)]) if d else used
    order = np.argsort(known)
    columns = []
    for query in queries:
        at = np.searchsorted(known, query, sorter=order) if len(known) else np.zeros(0, np.int64)
        at = order[np.minimum(at, len(known) - 1)] if len(known) else at
        columns.append(at[known[at] == query] if len(known) else at)
    sizes, both = np.zeros(len(texts), np.int64), np.zeros((len(queries), len(texts)), np.int64)
    step, order = max(1, CELLS // max(1, len(known))), np.argsort(rows, kind="stable")
    rows, codes = rows[order], codes[order]
    for start in range(0, len(texts), step):
        a, b = np.searchsorted(rows, [start, start + step])
        has = np.zeros((min(step, len(texts) - start), len(known)), np.uint8)
        has[rows[a:b] - start, codes[a:b]] = 1
        sizes[start : start + step] = has.sum(axis=1, dtype=np.int64)
        for n, at in enumerate(columns):
            both[n, start : start + step] = has[:, at].sum(axis=1, dtype=np.int64)
    return sizes, both


def scorer(queries: list[Row], k: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (id, norm) to (at, id, norm, base, low, high) of the pairs that can be among the ``k`` best of their query at
    ``least``. queries: norm, grams, words of ``name_parts``, and ``at``, their place.

    A score lies between ``low`` and ``high``. A pair goes if ``k`` texts that this task has had score higher for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = [_gram_codes(q["grams"]) for q in queries]
        counts = [Counter(q["norm"]) for q in queries]
        best = np.full((len(queries), k), -np.inf)
        for batch in batches:
            norms = batch.column(1)
            texts = norms.to_pylist()
            if not texts:
                continue
            lengths = np.array([len(t) for t in texts], np.int64)
            sizes, both = shared_grams(texts, grams)
            contains = lambda word: pc.match_substring(norms, word).to_numpy(zero_copy_only=False)
            for n, q in enumerate(queries):
                words, long = q["words"], len(q["norm"])
                hits = sum((contains(w).astype(np.int64) for w in words), np.zeros(len(texts), np.int64)) / max(1, len(words))
                union = sizes + len(grams[n]) - both[n]
                base = 0.45 * hits + 0.25 * np.where((sizes > 0) & (len(grams[n]) > 0), both[n] / np.maximum(union, 1), 0.0)
                empty = (lengths == 0) | (long == 0)
                low = np.where(empty, 0.0, np.minimum(1.0, base + np.where(contains(q["norm"]), 0.15, 0.0)))
                best[n] = np.partition(np.concatenate([best[n], low]), -k)[-k:]
                floor = max(least, best[n, 0]) - 1e-6
                close = np.flatnonzero(np.where(empty, 0.0, low + 0.2 * np.minimum(lengths, long) / np.maximum(lengths + long, 1)) >= floor)
                if not len(close):
                    continue
                same = np.array([sum((counts[n] & Counter(texts[i])).values()) for i in close])
                high = np.where(empty[close], 0.0, np.minimum(1.0, low[close] + 0.2 * same / np.maximum(lengths[close] + long, 1)))
                kept = high >= floor
                at = pa.array(close[kept])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q["at"], np.int32)), batch.column(0).take(at), norms.take(at), pa.array(base[close][kept]), pa.array(low[close][kept]), pa.array(high[kept])], names=["at", "id", "norm", "base", "low", "high"])

    return run
