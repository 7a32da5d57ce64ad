"""Substring dedup of word windows with one compressed FM-index per shard.

Candidate segments (see ``segments``) are dealt to shards by their anchor. A shard's distinct segments become one
text over a dense alphabet, whose Burrows-Wheeler transform is kept as a wavelet matrix: one packed bit vector with
block counts per alphabet bit. The segments are then streamed through the index by backward search, all of a shard in
step: the matching statistics at a position are the longest stretch ending there that occurs twice or more, copies
counted, and every stretch at or above the threshold is reported as an interval.

Null and empty texts have no words and lose none; texts shorter than a window lose none; repeated rows repeat every
window they have. Inside a shard words are compared as they are, before it as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import row_key
from graphloom.llm.segments import WORDS, U, byte_symbols, merged, repeated_spans, word_bounds

WINDOW, GRAM = 35, 6
#: Neighbouring windows that share a longer anchor where one has too much text; alone, all windows of one are equal.
WIDTHS = (5, 1)
#: Words of a shard, and of one anchor before it is replaced by longer ones.
SHARD, HOT = 1 << 20, 1 << 21


class FMIndex:
    """Counts of patterns in a text of symbols 1..sigma, with 0 between its parts; ``weight`` of a row counts it so often."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int) -> None:
        self.n, sigma = len(text), int(text.max()) + 1
        order = suffix_order(text, depth)
        self.weights = np.concatenate(([0], np.cumsum(weight[order])))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.levels = max(1, (sigma - 1).bit_length())
        column = text[order - 1]  # the symbol before each suffix
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (column >> (self.levels - 1 - level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 2, U)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(int(self.n - bit.sum()))
            column = np.concatenate((column[bit == 0], column[bit == 1]))
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a level's bit vector."""
        word = at >> 6
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & ((U(1) << (at & 63).astype(U)) - U(1)))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, at)
            at = np.where(symbol >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of symbol + pattern from the rows of each pattern."""
        start = self.before[symbol] - self.base[symbol]
        return start + self._descend(symbol, low), start + self._descend(symbol, high)

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weights[high] - self.weights[low]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by rank doubling; patterns are never longer."""
    rank = text.astype(np.int64)
    length = 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - length] = rank[length:] + 1
        key = rank * (int(rank.max()) + 2 + len(rank)) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        rank = np.empty(len(order), np.int64)
        rank[order] = new
        length *= 2
        if length >= depth or new[-1] == len(order) - 1:
            return order


def matching_intervals(parts: list[np.ndarray], copies: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each part, the maximal half-open ranges of at least ``window`` symbols that occur twice or more in all."""
    lengths = np.array([len(p) for p in parts])
    flat = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int64) + 1
    starts = np.cumsum(lengths + 1) - lengths  # a separator stands before every part
    text = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(parts)) + 1, lengths)] = flat
    weight = np.zeros(len(text), np.int64)
    weight[:-1] = np.repeat(copies, lengths + 1)
    index = FMIndex(text, weight, int(min(lengths.max(), 1 << 20)) + 1)

    def search(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least position p >= first such that text[p..last] occurs twice, for each pair; last + 1 if there is none."""
        reached = last + 1
        low, high = np.zeros(len(last), np.int64), np.full(len(last), index.n)
        live = np.arange(len(last))
        while len(live):
            low_, high_ = index.extend(text[reached[live] - 1], low[live], high[live])
            twice = index.occurrences(low_, high_) >= 2
            live, low_, high_ = live[twice], low_[twice], high_[twice]
            low[live], high[live] = low_, high_
            reached[live] -= 1
            live = live[reached[live] > first[live]]
        return reached

    found: list[list[tuple[int, int]]] = [[] for _ in parts]
    part, end = np.arange(len(parts)), starts + lengths - 1
    keep = lengths >= window
    part, end = part[keep], end[keep]
    while len(part):
        reached = search(starts[part], end)
        long = end - reached + 1 >= window
        for p, a, b in zip(part[long].tolist(), (reached - starts[part])[long].tolist(), (end - starts[part])[long].tolist(), strict=True):
            found[p].append((a, b + 1))
        more = reached > starts[part]
        part, stop, end = part[more], reached[more] - 1, end[more]
        # the stretch from ``stop`` to ``end`` occurs once: find where it has to end to occur twice
        low, high = stop - 1, end.copy()
        while (open_ := high - low > 1).any():
            middle = (low[open_] + high[open_]) // 2
            twice = search(stop[open_], middle) <= stop[open_]
            low[open_] = np.where(twice, middle, low[open_])
            high[open_] = np.where(twice, high[open_], middle)
        more = low - starts[part] + 1 >= window
        part, end = part[more], low[more]
    return found


def repeated_word_spans(docs: DataFrame, window: int = WINDOW, widths: tuple[int, ...] = WIDTHS, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(row_key, firsts, lasts) in words; docs: row_key, text."""
    return repeated_spans(docs, WORDS, min(GRAM, window), window, lambda parts, copies: matching_intervals(parts, copies, window), widths, shard, hot)


def _with_spans(df: DataFrame, id_col: str, text_col: str, window: int, **limits) -> DataFrame:
    """The columns of ``df`` as a struct ``row``, the text, and its spans."""
    docs = df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    return docs.join(repeated_word_spans(docs.select("row_key", "text"), window, **limits), "row_key", "left")


def removal_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **limits) -> DataFrame:
    """One row per document: words, removed words and the digest of the words that stay."""

    @F.pandas_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def report(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, lasts in batches:
            rows = []
            for text, f, e in zip(texts, firsts, lasts, strict=True):
                data = byte_symbols(text)
                first, last = word_bounds(data)
                keep = np.ones(len(first), bool)
                for a, b in zip(*merged(f, e), strict=True):
                    keep[a:b] = False
                raw = data.tobytes()
                left = b" ".join([raw[a:b] for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True)])
                rows.append((len(first), int((~keep).sum()), hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    whole = _with_spans(df.select(id_col, text_col), id_col, text_col, window, **limits)
    return whole.select(F.col(f"row.{id_col}"), report("text", "firsts", "lasts").alias("r")).select(id_col, "r.*")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **limits) -> DataFrame:
    """The same rows and columns with repeated words cut out; what stands between the words that stay is unchanged.

    Where a stretch is cut, the white space before its first word goes with it. A text that loses nothing is unchanged;
    null stays null."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, firsts, lasts in batches:
            yield pd.Series([_cut_words(t, *merged(f, e)) for t, f, e in zip(texts, firsts, lasts, strict=True)], dtype=object)

    found = _with_spans(df, id_col, text_col, window, **limits)
    left = F.when(F.col("firsts").isNull(), F.col("text")).otherwise(cut("text", "firsts", "lasts"))
    return found.select("row", left.alias("left")).select(*[F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


def _cut_words(text: str | None, firsts: np.ndarray, lasts: np.ndarray) -> str | None:
    if text is None or not len(firsts):
        return text
    data = byte_symbols(text)
    first, last = word_bounds(data)
    raw, kept, at = data.tobytes(), [], 0
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        kept.append(raw[at : last[a - 1] if a else 0])
        at = int(last[b - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")
