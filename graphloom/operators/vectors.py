"""Cosines of vectors by blocks: products of matrices inside tasks, of which Spark deals the blocks.

Rows are dealt into blocks by the hash of their id, and every pair of blocks that must meet is one group of rows, so a task
holds two blocks and one strip of their cosines however many vectors there are. A row goes to as many groups as the other
side has blocks. Vectors of different length have no cosine; components are taken as doubles, and sums of products are
rounded by their user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and cosines that a strip holds.
BLOCK, STRIP = 8_192, 4_000_000


def _scaled(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    rows = np.array(vectors.tolist(), np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1.0, length)


def _strips(left: pd.DataFrame, right: pd.DataFrame, least: float, same: bool = False, k: int = 0) -> Iterator[pd.DataFrame]:
    """(a, b, score) at or above ``least``; ``same``: of a block with itself, each pair once; ``k``: of each a those that
    can be among its k best. Scores that are no number count as the highest, as in Spark."""
    x, y = _scaled(left["v"]), _scaled(right["v"])
    a, b = left["id"].to_numpy(), right["id"].to_numpy()
    step = max(1, STRIP // len(y))
    for start in range(0, len(x), step):
        scores = x[start : start + step] @ y.T
        floor = np.full(len(scores), least)
        if k and scores.shape[1] > k:
            floor = np.fmax(floor, np.partition(scores, -k, axis=1)[:, -k] - 1e-6)
        i, j = np.nonzero(~(scores < floor[:, None]))
        if same:
            i, j = i[start + i < j], j[start + i < j]
        if len(i):
            yield pd.DataFrame({"a": a[start + i], "b": b[j], "score": scores[i, j]})


def _usable(rows: DataFrame, id_col: str, vec: str, *keys: str) -> DataFrame:
    whole = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull())
    return rows.where(whole).select(*keys, F.col(id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"), F.size(vec).alias("width"))


def _blocks(n: Column, block: int) -> Column:
    return F.ceil(n / block).cast("int")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _number(score: str) -> Column:
    """Pandas hands on what is no number as null."""
    return F.coalesce(score, F.lit(float("nan"))).alias(score)


def alike_within(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(group, a, b, score) of all pairs of a group with a cosine of ``least`` or more, a < b; rows: group, id, embedding."""
    used = _usable(rows.where(F.col("group").isNotNull() & F.col("id").isNotNull()), "id", "embedding", "group").where(F.exists("v", lambda x: x != 0))
    counts = used.groupBy("group", "width").agg(F.count("*").alias("n")).select("group", "width", _blocks(F.col("n"), block).alias("blocks"))
    dealt = used.join(counts, ["group", "width"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("group", "width", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v")

    def compare(key: tuple, found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, _, x, y = key
        cell = pd.concat(found, ignore_index=True)
        left, right = cell[cell["own"] == x], cell[cell["own"] == y]
        if len(left) and len(right):
            for pairs in _strips(left, right, least, same=x == y):
                yield pairs.assign(group=group)[["group", "a", "b", "score"]]

    i, g = _kind(used, "id"), _kind(used, "group")
    pairs = met.groupBy("group", "width", "x", "y").applyInPandas(compare, f"`group` {g}, a {i}, b {i}, score double")
    return pairs.where("a <> b").select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _number("score"))


def best_cosines(queries: DataFrame, rows: DataFrame, k: int, least: float, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score) that hold the ``k`` best rows of each query at ``least`` or more; queries: query_id, vec;
    rows: id, vec. Some others may be among them."""
    asked, known = _usable(queries, "query_id", "vec"), _usable(rows, "id", "vec")
    size = lambda df: -(-df.count() // block) or 1
    across, down = size(queries), size(rows)
    deal = lambda df, n, m, mine, far: df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(far, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(asked, across, down, "x", "y"), deal(known, down, across, "y", "x")

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = list(_strips(one, two, least, k=k)) if len(one) and len(two) else []
        return pd.concat(found) if found else pd.DataFrame({"a": one["id"][:0], "b": two["id"][:0], "score": np.zeros(0)})

    keys = ("x", "y", "width")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"a {_kind(asked, 'id')}, b {_kind(known, 'id')}, score double")
    return pairs.select(F.col("a").alias("query_id"), F.col("b").alias("id"), _number("score"))
