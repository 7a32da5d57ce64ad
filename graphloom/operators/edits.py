"""Edit similarities of all pairs of a group, by blocks: bit-parallel distances inside tasks, of which Spark deals the blocks.

Both sides of a group are dealt into blocks by the hash of their key, and every two blocks are one cell, so a task holds two
blocks and the scores of one cell however many rows a group has. A row goes to as many cells as the other side has blocks.
Distances are Myers' in Hyyrö's form: one word holds a column of the table, since names are cut at ``EDIT_CHARS``."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import EDIT_CHARS
from graphloom.session import spread

#: Rows of a block on either side, and words that a step works on, which stay in a core's cache.
BLOCK, STRIP = 1_024, 32_768


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the names' beginnings, a row each, and their lengths."""
    cut = [n[:EDIT_CHARS] for n in names]
    lengths = np.array([len(n) for n in cut], np.int64)
    wide = max(1, int(lengths.max(initial=1)))
    return np.array(cut, dtype=f"U{wide}").view(np.uint32).reshape(len(cut), wide), lengths


def distances(one: list[str], two: list[str]) -> np.ndarray:
    """Levenshtein distances of the first ``EDIT_CHARS`` characters, a row for each of ``one``."""
    found = np.zeros((len(one), len(two)), np.int16)
    if not one or not two:
        return found
    (left, m), (right, n) = _codes(one), _codes(two)
    word = np.uint32 if m.max() <= 32 else np.uint64
    for length in np.unique(n):
        at = np.flatnonzero(n == length)
        text = right[at, :length]
        step = max(1, STRIP // len(at))
        for start in range(0, len(one), step):
            found[start : start + step, at] = _strip(left[start : start + step], m[start : start + step], text, word)
    return found


def _strip(left: np.ndarray, m: np.ndarray, text: np.ndarray, word: type) -> np.ndarray:
    rows, alphabet = np.arange(len(left)), np.unique(left)
    places = np.zeros((len(left), len(alphabet) + 1), word)  # where a character stands; the last is any other character
    for j in range(left.shape[1]):
        has = rows[m > j]
        places[has, np.searchsorted(alphabet, left[has, j])] |= word(1 << j)
    near = np.minimum(np.searchsorted(alphabet, text), len(alphabet) - 1)
    columns = np.where(alphabet[near] == text, near, len(alphabet)).T.copy()
    shape = (len(left), len(text))
    up, down = np.full(shape, ~word(0)), np.zeros(shape, word)  # vertical steps of +1 and of -1
    x, y, equal, one = np.empty(shape, word), np.empty(shape, word), np.empty(shape, word), word(1)
    for j in range(text.shape[1]):
        np.take(places, columns[j], axis=1, out=equal, mode="clip")
        np.bitwise_and(equal, up, out=x)
        np.add(x, up, out=x)
        np.bitwise_xor(x, up, out=x)
        np.bitwise_or(x, equal, out=x)  # horizontal diagonal
        np.bitwise_or(equal, down, out=equal)  # vertical diagonal
        np.bitwise_or(x, up, out=y)
        np.invert(y, out=y)
        np.bitwise_or(y, down, out=y)  # horizontal +1
        np.bitwise_and(up, x, out=x)  # horizontal -1
        np.left_shift(y, one, out=y)
        np.bitwise_or(y, one, out=y)
        np.left_shift(x, one, out=x)
        np.bitwise_or(equal, y, out=up)
        np.invert(up, out=up)
        np.bitwise_or(up, x, out=up)
        np.bitwise_and(y, equal, out=down)
    whole = np.array([(1 << int(k)) - 1 for k in m], word)[:, None]
    return text.shape[1] + np.bitwise_count(up & whole).astype(np.int16) - np.bitwise_count(down & whole)


@cache
def _scores(places: int) -> np.ndarray:
    """1 - distance / longer by longer and distance, rounded as Spark rounds; 1 where both are empty."""
    table = np.ones((EDIT_CHARS + 1, EDIT_CHARS + 1))
    for longer in range(1, EDIT_CHARS + 1):
        for d in range(longer + 1):
            table[longer, d] = float(Decimal(repr(1 - d / longer)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return table


def all_pairs(left: DataFrame, right: DataFrame, a: str, b: str, places: int = 6, block: int = BLOCK) -> DataFrame:
    """(a, b, score) of every pair of a group; left: ``a``, group, name; right: ``b``, group, name. ``score`` is the
    ``edit_similarity`` of the names to so many places, null where one has no name."""

    def counted(rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias(n))

    left, right = spread(left.where(F.col("group").isNotNull())), right.where(F.col("group").isNotNull())
    blocks = counted(left, "across").join(counted(right, "down"), "group")
    sums = blocks.agg(F.sum(F.col("across") * F.col("down"))).first()[0] or 0
    tasks = max(4 * left.sparkSession.sparkContext.defaultParallelism, -(-sums // 16))

    def dealt(rows: DataFrame, key: str, mine: str, far: str, x: str, y: str) -> DataFrame:
        own: Column = F.pmod(F.xxhash64(key), F.col(mine)).cast("int").alias(x)
        met = rows.join(blocks, "group").select(F.col("group").alias("of"), own, F.explode(F.sequence(F.lit(0), F.col(far) - 1)).alias(y), key, "name")
        return met.repartition(tasks, *keys)

    keys = ("of", "x", "y")
    one, two = dealt(left, a, "across", "down", "x", "y"), dealt(right, b, "down", "across", "y", "x")

    def compare(cell: pa.Table, other: pa.Table) -> pa.Table:
        names = [t["name"].combine_chunks() for t in (cell, other)]
        said = [pc.fill_null(n, "").to_pylist() for n in names]
        d, (p, q) = distances(*said), [np.array([min(len(n), EDIT_CHARS) for n in side], np.int64) for side in said]
        scores = _scores(places)[np.maximum.outer(p, q), d].ravel() if d.size else np.zeros(0)
        unnamed = np.logical_or.outer(*[n.is_null().to_numpy(zero_copy_only=False) for n in names]).ravel()
        i, j = np.repeat(np.arange(len(p)), len(q)), np.tile(np.arange(len(q)), len(p))
        pairs = [cell[a].combine_chunks().take(pa.array(i)), other[b].combine_chunks().take(pa.array(j))]
        return pa.table([*pairs, pa.array(scores, mask=unnamed if unnamed.any() else None)], names=[a, b, "score"])

    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(compare, f"`{a}` {kind(left, a)}, `{b}` {kind(right, b)}, score double")
