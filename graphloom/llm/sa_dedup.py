"""Exact substring dedup of byte windows with suffix arrays, one per shard, built by linear grouping.

The construction sorts suffixes in two phases without renaming or recursion. The first phase keeps groups of suffixes
that agree on a prefix, starting with one group per first byte, and treats them from the highest to the lowest: every
suffix of a group points to the nearest earlier suffix of a lower group (its previous smaller), and the suffixes that
are pointed to move out of their group into new groups right above it, by how often they are pointed to and by the
group they come from. At the end a group's common prefix is the longest Lyndon prefix of its suffixes. The second
phase goes up the array; the suffix before each entry, and the chain of previous-smaller suffixes behind it, take the
next free places of their groups.

Equal 200-byte windows stand side by side in the array, so neighbours that agree on 200 bytes, and windows of segments
that have copies, are the repeated ones. Candidate segments and copies come from ``segments``.

Null and empty texts have no bytes and lose none; repeated rows repeat every window they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import row_key
from graphloom.llm.segments import BYTES, as_values, byte_symbols, merged, repeated_spans, run_hashes

WINDOW, GRAM = 200, 64
#: Neighbouring windows that share a longer anchor where one has too much text; with two, a group has 2**16 texts at most.
WIDTHS = (24, 2)
#: Bytes of a shard, and of one anchor before it is replaced by longer ones; sorting takes some 200 bytes a byte.
SHARD, HOT = 1 << 18, 1 << 19


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; the last symbol must be 0 and stand nowhere else."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    symbols = text.tolist()
    present = sorted(set(symbols))
    number = {s: g for g, s in enumerate(present)}
    group = [number[s] for s in symbols]
    members: list[list[int]] = [[] for _ in present]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(present) - 1))  # the group right below each one
    above = list(range(1, len(present))) + [-1]
    previous = [-1] * n
    done = bytearray(n)

    current = len(present) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = own
        if own:
            for i in own:
                done[i] = 1
            runs: dict[tuple[int, int], list[int]] = {}
            last, times = -1, 0
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                if p == last:
                    times += 1
                else:
                    if last >= 0:
                        key = (times, group[last])
                        if key in runs:
                            runs[key].append(last)
                        else:
                            runs[key] = [last]
                    last, times = p, 1
            if last >= 0:
                runs.setdefault((times, group[last]), []).append(last)
            if runs:
                for key in sorted(runs, reverse=True) if len(runs) > 1 else runs:
                    old, moved = key[1], runs[key]
                    new = len(members)
                    for p in moved:
                        group[p] = new
                    members.append(moved)
                    top = above[old]
                    below.append(old)
                    above.append(top)
                    above[old] = new
                    if top >= 0:
                        below[top] = new
        current = below[current]

    free = [0] * len(members)  # next place in each group's stretch of the array
    at = 0
    current = 0
    while current >= 0:
        free[current] = at
        at += len(members[current])
        current = above[current]
    order = [-1] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    free[group[n - 1]] += 1
    for i in range(n):
        p = order[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = previous[p]
    return np.array(order, np.int64)


def stretches(parts: list[np.ndarray], copies: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(part, first, last) of the stretches whose windows all have a hash that is met twice or more.

    A window whose hash is met once is met once itself, so nothing outside these stretches is repeated."""
    lengths = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), lengths)
    ends = np.cumsum(lengths)
    values = as_values(np.concatenate(parts))
    hashes = run_hashes(values, window)
    at = np.flatnonzero(ends[owner[: len(hashes)]] - np.arange(len(hashes)) >= window)
    _, same = np.unique(hashes[at], return_inverse=True)
    at = at[np.bincount(same, copies[owner[at]])[same] >= 2]
    if not len(at):
        return at, at, at
    begins = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
    first, last = at[begins], at[np.concatenate((begins[1:], [True]))] + window
    offset = (ends - lengths)[owner[first]]
    return owner[first], first - offset, last - offset


def repeated_ranges(parts: list[np.ndarray], copies: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each part, half-open ranges covered by windows that occur twice or more, copies counted."""
    part, first, last = stretches(parts, copies, window)
    found: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(part):
        number: dict[bytes, int] = {}
        same = [number.setdefault(parts[p][a:b].tobytes(), len(number)) for p, a, b in zip(part.tolist(), first.tolist(), last.tolist(), strict=True)]
        bodies = [np.frombuffer(b, np.uint8) for b in number]
        ranges = _decided(bodies, np.bincount(same, copies[part]).astype(np.int64), window)
        for p, a, s in zip(part.tolist(), first.tolist(), same, strict=True):
            found[p] += [(a + x, a + y) for x, y in ranges[s]]
    return found


def _decided(parts: list[np.ndarray], copies: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """Repeated ranges of distinct stretches, from neighbours in their suffix array."""
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.full(int((lengths + 1).sum()) + 1, 1, np.int64)  # 1 after every part, 0 at the end, bytes from 2
    text[-1] = 0
    text[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(parts)), lengths)] = np.concatenate(parts).astype(np.int64) + 2
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(parts)), lengths + 1)
    room = np.repeat(starts + lengths, lengths + 1) - np.arange(len(owner))  # symbols up to the end of the part
    order = order[order < len(owner)]
    order = order[room[order] >= window]
    marked = np.zeros(len(owner), bool)
    marked[order] = copies[owner[order]] >= 2
    left, right = order[:-1], order[1:]
    step = 0
    while step < window and len(left):  # drop neighbours as soon as they differ
        width = min(8, window - step)
        same = np.ones(len(left), bool)
        for j in range(step, step + width):
            same &= text[left + j] == text[right + j]
        left, right, step = left[same], right[same], step + width
    marked[left] = marked[right] = True
    at = np.flatnonzero(marked)
    covered = np.zeros(len(owner) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    inside = np.concatenate(([False], np.cumsum(covered)[:-1] > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    found: list[list[tuple[int, int]]] = [[] for _ in parts]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        found[owner[a]].append((a - int(starts[owner[a]]), b - int(starts[owner[a]])))
    return found


def repeated_byte_spans(docs: DataFrame, window: int = WINDOW, widths: tuple[int, ...] = WIDTHS, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(row_key, firsts, lasts) in bytes; docs: row_key, text."""
    return repeated_spans(docs, BYTES, min(GRAM, max(1, window // 2)), window, lambda parts, copies: repeated_ranges(parts, copies, window), widths, shard, hot)


def removal_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **limits) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs and the digest of the bytes that stay."""

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    def report(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, lasts in batches:
            rows = []
            for text, f, e in zip(texts, firsts, lasts, strict=True):
                raw, kept, at, gone = byte_symbols(text).tobytes(), hashlib.sha256(), 0, 0
                first, last = merged(f, e)
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    kept.update(raw[at:a])
                    at, gone = b, gone + b - a
                kept.update(raw[at:])
                rows.append((len(raw), gone, len(first), kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    spans = repeated_byte_spans(docs.select("row_key", "text"), window, **limits)
    found = docs.join(spans, "row_key", "left").select("id", report("text", "firsts", "lasts").alias("r"))
    return found.select(F.col("id").alias(id_col), "r.*")
