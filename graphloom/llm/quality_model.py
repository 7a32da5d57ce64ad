"""Quality classifier: random Fourier features of document statistics, ridge regression and isotonic calibration.

The statistics are counts and shares of the whole text. They are standardised by the training rows' moments and mapped
to FEATURES cosines whose inner products approximate a Gaussian kernel. Every partition sums its part of the normal
equations, per fold; the sums are added up and solved for one ridge model per left-out fold and one for all rows.
Out-of-fold scores, binned on a fixed grid, calibrate the final scores by pooling adjacent violators.

Training takes at most TRAIN_ROWS labelled rows: where there are more, those with the smallest hashes of their id
(a bounded, documented sample). Labels are learnt only from rows with crc32(id as text) mod 3 other than 1. Statistics
never include id, language, source or labels.

Null and empty texts have zero statistics and a score like any other; rows without a usable label are only scored;
with no training rows, or labels of one kind, every score is the mean label (0.5 without any). Repeated rows count as
often as they stand there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

FEATURES, WIDTH, RIDGE, FOLDS, SEED = 192, 3.5, 1.0, 4, 11
#: Most labelled rows that are trained on, and parts in which normal equations are summed before they are added up.
TRAIN_ROWS, PARTS = 1_000_000, 24
GRID = 400

_MARKS = {"upper": re.compile(r"[A-Z]"), "shout": re.compile(r"[!?]"), "symbol": re.compile(r"[#*$%&|<>{}\[\]=_~^\\]"), "digit": re.compile(r"[0-9]"), "stop": re.compile(r"[.,;:]"), "pipe": re.compile(r"\|")}
STATISTICS = ("chars", "words", "word_length", "distinct", "top_word", "echo", "lines", "dup_lines", "long_words", "packed", "letters", *_MARKS)


def statistics(text: str | None) -> list[float]:
    """Counts as logarithms, all else as shares between 0 and 1 or small ratios."""
    if not text:
        return [0.0] * len(STATISTICS)
    tokens = text.split()
    n, chars = max(1, len(tokens)), len(text)
    often: dict[str, int] = {}
    for t in tokens:
        often[t] = often.get(t, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    packed = zlib.compressobj(1)
    size = sum(len(packed.compress(raw[i : i + 65536])) for i in range(0, len(raw), 65536)) + len(packed.flush())
    return [
        np.log1p(chars),
        np.log1p(len(tokens)),
        min(20.0, chars / n),
        len(often) / n,
        max(often.values(), default=0) / n,
        sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(t) > 18 for t in tokens) / n,
        size / len(raw),
        np.log1p(n / max(1, len(lines))),
        *(len(p.findall(text)) / chars for p in _MARKS.values()),
    ]


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return df.withColumn("stats", measured(F.col(text_col)))


@dataclass
class Model:
    """What scoring needs: moments, the random map, weights and the calibration curve; a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.mapped(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0, 1)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a curve that never falls, at the blocks' mean positions."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at.tolist(), value.tolist(), weight.tolist(), strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["stats"].tolist(), float).reshape(-1, len(STATISTICS))


def fit(rows: DataFrame) -> Model:
    """rows: stats, label (0 or 1), fold; bounded by TRAIN_ROWS."""
    k = len(STATISTICS)
    sums = rows.select(F.count("*"), F.sum("label"), *[F.avg(F.col("stats")[i]) for i in range(k)], *[F.stddev_pop(F.col("stats")[i]) for i in range(k)]).first()
    n, ones = sums[0], sums[1] or 0
    rng = np.random.default_rng(SEED)
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in sums[2 + k :]])
    model = Model(np.array([x or 0.0 for x in sums[2 : 2 + k]]), scale, rng.normal(0, 1 / WIDTH, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.array([0.0]), np.array([ones / n if n else 0.5])))
    if not n or ones in (0, n):
        return model
    d = FEATURES + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d))
        for frame in frames:
            z, y, fold = model.mapped(_stacked(frame)), frame["label"].to_numpy(float), frame["fold"].to_numpy()
            for f in range(FOLDS):
                own = fold == f
                left[f] += z[own].T @ z[own]
                right[f] += z[own].T @ y[own]
        yield pd.DataFrame({"fold": range(FOLDS), "left": [m.ravel() for m in left], "right": list(right)})

    left, right = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d))
    for r in rows.coalesce(PARTS).mapInPandas(partial, "fold int, left array<double>, right array<double>").toLocalIterator():  # PARTS * FOLDS rows of fixed size
        left[r["fold"]] += np.array(r["left"]).reshape(d, d)
        right[r["fold"]] += np.array(r["right"])
    solve = lambda a, b: np.linalg.solve(a + RIDGE * np.eye(d), b)
    model.weights = solve(left.sum(axis=0), right.sum(axis=0))
    by_fold = np.array([solve(left.sum(axis=0) - left[f], right.sum(axis=0) - right[f]) for f in range(FOLDS)])

    def outside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = (model.mapped(_stacked(frame)) * by_fold[frame["fold"].to_numpy()]).sum(axis=1)
            yield pd.DataFrame({"bin": np.clip(np.round(scores * GRID), -GRID, 2 * GRID).astype(int), "label": frame["label"]})

    binned = rows.mapInPandas(outside, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").collect()  # 3 * GRID + 1 rows at most
    bins = np.array([(r["bin"] / GRID, r["ones"] / r["n"], r["n"]) for r in binned], float)
    model.curve = isotonic(bins[:, 0], bins[:, 1], bins[:, 2])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    held = F.crc32(F.col(id_col).cast("string")) % 3 == 1
    measured = materialize(with_statistics(docs.select(id_col, text_col), text_col).select(id_col, F.coalesce(held, F.lit(False)).alias("held_out"), "stats"))
    known = labels.where(F.col(label_col).isin(0, 1) & ~(F.crc32(F.col(id_col).cast("string")) % 3 == 1)).select(id_col, F.col(label_col).cast("double").alias("label"))
    total = known.count()
    if total > TRAIN_ROWS:
        share = TRAIN_ROWS / total
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = materialize(measured.join(known, id_col).select("stats", "label", F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int").alias("fold")))
    model = fit(rows)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for stats in batches:
            yield pd.Series(model.score(np.array(stats.tolist(), float).reshape(-1, len(STATISTICS))))

    found = measured.select(id_col, "held_out", scored("stats").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
