"""Hard negatives by inner product, found through one-dimensional distance keys.

Every row x gets a component more, the root of M - |x|^2 with M no less than any squared length, and an anchor a zero:
then a higher inner product is a smaller distance. A few pivots are chosen; a row's key is its nearest pivot and its
distance from it, and rows are stored sorted by key, in groups of a stated size. By the triangle inequality rows whose
key differs by more than r from the anchor's own distance to that pivot are farther than r from the anchor.

A search scans key intervals around the anchor's distances, wider and wider, and stops where no row outside can be
nearer than the k-th found: first in the one group that is nearest, which gives every list a bound, then in every other
group that the bound does not rule out. Several score ranges of one anchor are searched at once; the annulus of a range
bounds its intervals from both sides. The bounds only save work: results are exact at every size.

Null ids take part as positives and negatives, come last among ties and are no anchors. Rows that agree in id, label
and vector are one anchor; as positives or negatives each counts. Rows with a null label, a null vector, or a null or
non-finite component take no part. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import small, stashed
from graphloom.llm.vectors import LOWEST, NO_ID, Best, all_scores, distinct_rows, matrix, norms, promising, usable, widened

#: Pivots, and the rows (those of least hash) they are chosen from; every row is stored, whatever its distance.
PIVOTS, SAMPLE = 16, 2_048
#: Most anchors, and about as many rows, of one group.
ANCHORS, GROUP = 16_384, 65_536
#: Fewest rows for which a further group is opened.
LEAST = 2_048
#: Rows of a key interval that are scanned at once, and anchors scanned with them.
SLICE = 512
POSITIVES, NEGATIVES = 5, 10
RESULT = "anchor_id bigint, key bigint, place int, id bigint, score bigint"


class Pivots:
    """Pivots chosen from a sample so that each is far from those before it, and distances in the longer space."""

    def __init__(self, sample: np.ndarray, top: float):
        self.top, self.m = top, sample[:1]
        while 0 < len(self.m) < min(PIVOTS, len(sample)):
            away = self.of_rows(sample).min(axis=1)
            if not away.max() > 0:
                break
            self.m = np.concatenate((self.m, sample[[int(away.argmax())]]))

    def _last(self, m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top - (m * m).sum(axis=1)))

    def _squares(self, m: np.ndarray) -> np.ndarray:
        width = max(m.shape[1], self.m.shape[1])
        m, p = widened(m, width), widened(self.m, width)
        return np.array([((m - x) ** 2).sum(axis=1) for x in p]).reshape(len(p), len(m)).T

    def of_rows(self, m: np.ndarray) -> np.ndarray:
        return np.sqrt(self._squares(m) + (self._last(m)[:, None] - self._last(self.m)[None, :]) ** 2)

    def of_anchors(self, m: np.ndarray) -> np.ndarray:
        return np.sqrt(self._squares(m) + self._last(self.m)[None, :] ** 2)


def _slices(pivot: np.ndarray) -> list[tuple[int, int]]:
    """Runs of at most SLICE rows of one pivot."""
    edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
    return [(a, min(a + SLICE, end)) for begin, end in zip(edges[:-1], edges[1:], strict=True) for a in range(begin, end, SLICE)]


def scan(anchors: dict, rows: dict, pivots: Pivots, k: int, same: bool) -> list[Best]:
    """The k best rows for each of the score ranges (lows, highs) of each anchor: of its own label, or of others.

    anchors: m, label, own (place of its own row), lows, highs; rows: m, id, label, pivot, distance, sorted by key."""
    m, lows, highs = anchors["m"], anchors["lows"], anchors["highs"]
    best = [Best(len(m), k) for _ in range(lows.shape[1])]
    for found, low in zip(best, lows.T, strict=True):
        found.least = np.maximum(found.least, low)
    base = norms(m) ** 2 + pivots.top
    slack = 1e-6 + 1e-7 * np.sqrt(base)
    to_pivots, cuts = pivots.of_anchors(m), _slices(rows["pivot"])
    gap, far = np.empty((len(m), len(cuts))), np.empty((len(m), len(cuts)))
    for s, (a, b) in enumerate(cuts):
        own, (low, high) = to_pivots[:, rows["pivot"][a]], rows["distance"][[a, b - 1]]
        gap[:, s], far[:, s] = np.maximum(0, np.maximum(low - own, own - high)), own + high
    order = np.argsort(np.nan_to_num(gap, nan=0.0), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(len(cuts))[None, :], axis=1)
    near = np.sqrt(np.maximum(0, base - 2 * highs.max(axis=1))) - slack
    begin, end = 0, 1
    while begin < len(cuts):  # intervals double until nothing outside can be nearer
        for s, (a, b) in enumerate(cuts):
            reach = np.sqrt(np.maximum(0, base - 2 * np.min([f.least for f in best], axis=0))) + slack
            due = np.flatnonzero((turn[:, s] >= begin) & (turn[:, s] < end) & ~(gap[:, s] > reach) & ~(far[:, s] < near))
            for part in range(0, len(due), SLICE):
                i = due[part : part + SLICE]
                scores = all_scores(m[i], rows["m"][a:b]).astype(np.float64)
                fits = (anchors["label"][i][:, None] == rows["label"][a:b]) == same
                fits[anchors["own"][i][:, None] == np.arange(a, b)] = False
                for w, found in enumerate(best):
                    inside = np.where(fits & (scores <= highs[i, w][:, None]), scores, -np.inf)
                    x, y = promising(inside, found.least[i], k)
                    found.add(i[x], scores[x, y], rows["id"][a:b][y])
        begin, end = end, 2 * end
    return best


def _padded(bounds: pd.Series, places: int, null: float, missing: float) -> np.ndarray:
    """One row of bounds an anchor; those with fewer ranges than others get ranges that nothing is in."""
    return np.array([[null if x is None or np.isnan(x) else float(x) for x in row] + [missing] * (places - len(row)) for row in bounds])


def _task(pivots: Pivots, k: int, scale: int, same: bool):
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(rows):
            return pd.DataFrame({c: [] for c in columns}, dtype="int64")
        rows = rows.sort_values(["pivot", "distance"], kind="stable", ignore_index=True)
        a, r = matrix(anchors["v"], scale), matrix(rows["v"], scale)
        width = max(a.shape[1], r.shape[1])
        names = [list(zip(t["id"], t["label"], map(bytes, t["v"]), strict=True)) for t in (anchors, rows)]
        at = {name: j for j, name in reversed(list(enumerate(names[1])))}
        places = max(map(len, anchors["lows"]))
        bounds = [_padded(anchors[c], places, *edges) for c, edges in (("lows", (LOWEST, -LOWEST)), ("highs", (np.inf, LOWEST)))]
        asked = {"m": widened(a, width), "label": anchors["label"].to_numpy(), "own": np.array([at.get(name, -1) for name in names[0]]), "lows": bounds[0], "highs": bounds[1]}
        stored = {"m": widened(r, width)} | {c: rows[c].to_numpy() for c in ("id", "label", "pivot", "distance")}
        out = [(anchors["id"].to_numpy()[b.lists], anchors["key"].to_numpy()[b.lists], np.full(len(b.lists), w), b.ids, b.scores) for w, b in enumerate(scan(asked, stored, pivots, k, same))]
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


class Index:
    """Rows (id, label, v, copies) stored sorted by (pivot, distance), and searches over them."""

    def __init__(self, one: DataFrame, scale: int):
        spark, self.scale = one.sparkSession, scale
        above = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * scale) + 1, 2))
        n, top = one.agg(F.sum("copies"), F.max(above)).first()
        sample = one.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").toPandas()["v"]
        self.pivots = pivots = Pivots(matrix(sample, scale), float(top or 0))
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        groups = max(-(-(n or 0) // GROUP), min(-(-(n or 0) // LEAST), self.partitions), 1)

        def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                away = pivots.of_rows(matrix(frame["v"], scale)) if len(frame) else np.zeros((0, 1))
                pivot = np.nan_to_num(away, nan=np.inf).argmin(axis=1)
                yield frame.assign(pivot=pivot, distance=away[np.arange(len(frame)), pivot])

        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in one.select('id', 'label', 'v').schema)}, pivot int, distance double"
        rows = one.select("id", "label", "v", F.explode(F.sequence(F.lit(1), "copies"))).drop("col").mapInPandas(keyed, schema)
        dealt = rows.repartitionByRange(groups, "pivot", "distance", "id").withColumn("group", F.spark_partition_id())
        self.rows = stashed(dealt.sortWithinPartitions("pivot", "distance"))
        self.ranges = stashed(self.rows.groupBy("group", "pivot").agg(F.min("distance").alias("from"), F.max("distance").alias("to")), 1)

    def gaps(self, anchors: DataFrame) -> DataFrame:
        """(id, key, group, gap, away): least distance that a row of the group can have, and the pivot's own distance."""
        pivots, scale = self.pivots, self.scale

        def away(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = pivots.of_anchors(matrix(frame["v"], scale))
                n, p = found.shape
                yield pd.DataFrame({"id": frame["id"].repeat(p), "key": frame["key"].repeat(p), "pivot": np.tile(np.arange(p), n), "away": found.ravel()})

        far = anchors.select("id", "key", "v").mapInPandas(away, "id bigint, key bigint, pivot int, away double")
        gap = F.nanvl(F.greatest(F.lit(0.0), F.col("from") - F.col("away"), F.col("away") - F.col("to")), F.lit(0.0))
        return far.join(small(self.ranges), "pivot").groupBy("id", "key", "group").agg(F.min(F.struct(gap.alias("gap"), "away")).alias("at")).select("id", "key", "group", "at.*")

    def _scan(self, anchors: DataFrame, visits: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
        """Anchors against the groups that ``visits`` (id, key, group) names for them."""
        asked = anchors.join(visits.select("id", "key", "group"), ["id", "key"]).withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
        stored = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        left, right = (df.repartition(max(self.partitions, blocks), "group", "block").groupBy("group", "block") for df in (asked, stored))
        return left.cogroup(right).applyInPandas(_task(self.pivots, k, self.scale, same), RESULT)

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, key, place, rank, id, score): the k best for each score range of every anchor.

        anchors: id, key, label, v, and arrays ``lows`` and ``highs`` of the ranges' least and largest scores or nulls."""
        anchors = stashed(anchors)
        blocks = max(-(-anchors.count() // ANCHORS), 1)
        gaps = stashed(self.gaps(anchors))
        nearest = gaps.groupBy("id", "key").agg(F.min_by("group", F.struct("gap", "away", "group")).alias("group"))
        first = stashed(self._scan(anchors, nearest, blocks, k, same))
        full = first.groupBy(F.col("anchor_id").alias("id"), "key", "place").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        raised = full.groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("least"))
        lows = F.transform("lows", lambda low, i: F.greatest(low, F.col("least")[i]))
        bound = anchors.join(raised, ["id", "key"], "left").withColumn("lows", lows).drop("least")
        square = F.aggregate("v", F.lit(self.pivots.top), lambda s, x: s + F.pow(F.abs(x.cast("double") * self.scale) + 1, 2))
        farthest = F.sqrt(F.greatest(F.lit(0.0), square - 2 * F.array_min("lows").cast("double")))
        reach = F.when(F.exists("lows", lambda x: x.isNull()), F.lit(float("inf"))).otherwise(F.nanvl(farthest, F.lit(float("inf"))))
        open_ = bound.select("id", "key", reach.alias("reach")).join(gaps, ["id", "key"]).where(F.col("gap") <= F.col("reach") * (1 + 1e-7) + 1e-6)
        rest = self._scan(bound, open_.join(nearest, ["id", "key", "group"], "left_anti"), blocks, k, same)
        order = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("score"), "id")
        found = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return found.select("anchor_id", "key", "place", F.col("rank").cast("int").alias("rank"), "id", "score")


def _of_hundred(score: Column, share: int, up: bool) -> Column:
    """share * score / 100 rounded up or down, exactly."""
    product = score.cast("decimal(20,0)") * F.lit(share)
    rest = F.pmod(-product if up else product, F.lit(100))
    whole = (product + rest) if up else (product - rest)
    return F.round(whole / F.lit(100)).cast("bigint")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the best other rows of its label; to each, its negatives are the best rows of other labels
    whose score is from ``low`` to ``high`` per cent of the positive's."""
    given = vectors.where(usable(F.col(vector_col), scale) & F.col(label_col).isNotNull())
    asks = F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False))
    named = given.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), asks.alias("asks"))
    one = stashed(distinct_rows(named, ["id", "label", "v", "asks"], max(positives, negatives) + 1))
    index = Index(one, scale)
    anchors = one.where("asks").select("id", F.xxhash64("id", "label", "v").alias("key"), "label", "v")
    anything = F.array(F.lit(None).cast("bigint"))
    liked = stashed(index.search(anchors.withColumns({"lows": anything, "highs": anything}), positives, True))
    ranges = liked.groupBy(F.col("anchor_id").alias("id"), "key").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    ranges = ranges.withColumns({"lows": F.transform("p", lambda p: _of_hundred(p["score"], low, True)), "highs": F.transform("p", lambda p: _of_hundred(p["score"], high, False))}).drop("p")
    found = index.search(anchors.join(ranges, ["id", "key"]), negatives, False)
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    to = liked.select("anchor_id", "key", (F.col("rank") - 1).alias("place"), real(F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(to, ["anchor_id", "key", "place"]).select("anchor_id", "positive_id", "rank", real(F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
