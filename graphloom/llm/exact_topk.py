"""Exact top-k by inner product, with statistics of segments at several resolutions.

A vector is cut into a few segments, then into more. Of each the mean and the deviation are kept. For two vectors the
squared distance is at least the sum, over segments, of length times (difference of means squared plus difference of
deviations squared); as lengths of the whole vectors are known, that is an upper bound of the inner product: the sum
of length times (product of means plus product of deviations). Bounds are taken coarse to fine; a pair goes on to the
next level only while its bound reaches the query's k-th score so far, and exact scores are computed for what is left.

Queries and candidates are dealt into blocks by hash. Each pair of blocks is one group, held in memory; what it finds
best is merged by query. Blocks have a stated size, so a group never grows with the table.

Null ids take part as candidates, come last among ties and are no queries. Rows that agree in id and vector are one
query; as candidates each counts, and a query leaves out one such row, its own. Null vectors and vectors that hold a
null or non-finite component take no part; an empty vector scores 0. An empty table, or one without queries, gives no
rows. Only the two columns named are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.vectors import NO_ID, Best, all_scores, distinct_rows, matrix, norms, pair_scores, promising, usable, widened

#: Most queries, and most candidates, of one group.
QUERIES, CANDIDATES = 32_768, 65_536
#: Fewest candidates for which a further group is opened.
LEAST = 2_048
#: Segments a vector is cut into, coarse to fine.
SEGMENTS = (4, 16)
#: Rows of queries and candidates whose bounds are held at once.
TILE = 512, 2_048
#: A level's survivors are followed one by one once they are at most this share of all pairs.
SPARSE = 0.1


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, each times the root of the segment's length."""
    edges = np.linspace(0, m.shape[1], segments + 1).astype(int)
    out = np.empty((len(m), 2 * segments))
    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        mean = m[:, a:b].mean(axis=1)
        root = np.sqrt(b - a)
        out[:, s] = root * mean
        out[:, segments + s] = root * np.sqrt(((m[:, a:b] - mean[:, None]) ** 2).mean(axis=1))
    return out


class Levels:
    """Rows of integers with their statistics at every resolution that has fewer numbers than the rows themselves."""

    def __init__(self, m: np.ndarray):
        self.m, self.norms = m, norms(m)
        self.coarse = [statistics(m, s) for s in SEGMENTS if 2 * s < m.shape[1]]


def _tile(q: Levels, c: Levels, rows: slice, columns: slice, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) within a tile of pairs that can be among the k best."""
    slack = 1e-9 * (1 + float(q.norms[rows].max(initial=0)) * float(c.norms[columns].max(initial=0)))
    wanted, pairs = least - slack, None
    for a, b in zip(q.coarse, c.coarse, strict=True):
        a, b = a[rows], b[columns]
        if pairs is None:
            bound = a @ b.T >= wanted[:, None]
            if bound.mean() <= SPARSE:
                pairs = np.nonzero(bound)
        else:
            stay = np.einsum("ij,ij->i", a[pairs[0]], b[pairs[1]]) >= wanted[pairs[0]]
            pairs = pairs[0][stay], pairs[1][stay]
    if pairs is not None:
        return *pairs, pair_scores(q.m[rows][pairs[0]], c.m[columns][pairs[1]])
    scores = all_scores(q.m[rows], c.m[columns])
    pairs = promising(scores, least, k + 1)  # one of them may be the query's own row
    return *pairs, scores[pairs]


def best_of_block(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """The k best candidates of every query but ``own``, the place of its own row (-1: elsewhere)."""
    q, c = Levels(queries), Levels(candidates)
    chunks = [slice(a, a + TILE[0]) for a in range(0, len(queries), TILE[0])]
    best = [Best(len(queries[rows]), k) for rows in chunks]
    for at in range(0, len(candidates), TILE[1]):
        for rows, found in zip(chunks, best, strict=True):
            i, j, scores = _tile(q, c, rows, slice(at, at + TILE[1]), found.least, k)
            other = own[rows][i] != j + at
            found.add(i[other], scores[other], ids[j[other] + at])
    whole = Best(len(queries), k)
    whole.lists = np.concatenate([whole.lists, *(b.lists + rows.start for rows, b in zip(chunks, best, strict=True))])
    whole.scores, whole.ids = (np.concatenate([getattr(whole, name), *(getattr(b, name) for b in best)]) for name in ("scores", "ids"))
    return whole


def _search(k: int, scale: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "query_key": [], "id": [], "score": []}, dtype="int64")
        q, c = matrix(queries["v"], scale), matrix(candidates["v"], scale)
        width = max(q.shape[1], c.shape[1])
        at = {key: j for j, key in reversed(list(enumerate(zip(candidates["id"], map(bytes, candidates["v"]), strict=True))))}
        own = np.array([at.get(key, -1) for key in zip(queries["id"], map(bytes, queries["v"]), strict=True)])
        best = best_of_block(widened(q, width), own, widened(c, width), candidates["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": queries["id"].to_numpy()[best.lists], "query_key": queries["key"].to_numpy()[best.lists], "id": best.ids, "score": best.scores})

    return run


def top_matches(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): for each row where ``is_query`` holds, the k best other rows."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col), scale)).select(F.col(id_col).cast("bigint").alias("given"), F.col(vector_col).alias("v"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"))
    rows = rows.select(F.coalesce("given", F.lit(NO_ID)).alias("id"), "v", "asks")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-n // CANDIDATES), min(-(-n // LEAST), spread), 1)
    blocks = max(-(-asked // QUERIES), 1)
    one = distinct_rows(rows, ["id", "v", "asks"], k + 1).withColumn("key", F.xxhash64("id", "v"))
    number = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = one.where("asks").select("id", "key", "v", F.pmod("key", F.lit(blocks)).alias("block")).withColumn("group", number(groups))
    candidates = one.select("id", "v", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    candidates = candidates.withColumn("block", number(blocks)).withColumn("block", F.col("block").cast("bigint"))
    parts = max(groups * blocks, 1)
    left, right = (df.repartition(parts, "block", "group").groupBy("block", "group") for df in (queries, candidates))
    found = left.cogroup(right).applyInPandas(_search(k, scale), "query_id bigint, query_key bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(NO_ID)).alias(id_col), "score")
