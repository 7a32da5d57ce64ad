"""Steps whose work grew too fast or stood in one task: blocks of vectors, floors of searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import fusion, retrieval, vectors
from graphloom.session import promising, spread


def cosines(rows):
    m = np.array([v for *_, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return m @ m.T


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), i, rng.normal(size=5).tolist()) for i, g in enumerate(rng.integers(0, 3, 90))]
    return rows, spark.createDataFrame(rows, "`group` int, id int, embedding array<double>")


def test_vectors_meet_once_however_they_are_dealt(some):
    rows, df = some
    c = cosines(rows)
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if rows[a][0] == rows[b][0] and c[a, b] >= 0.3}
    got = [(r.a, r.b) for r in vectors.alike_within(df, 0.3, block=7).collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_best_vectors_by_blocks(some):
    rows, df = some
    c = cosines(rows)
    vecs = df.select("id", F.col("embedding").alias("vec"))
    found = vectors.best_cosines(vecs.where("id % 5 = 0").withColumnRenamed("id", "query_id"), vecs, 4, 0.1, block=8)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 6), r.id))
    for q in range(0, 90, 5):
        want = sorted((-round(c[q, i], 6), i) for i in range(90) if c[q, i] >= 0.1)[:4]
        assert sorted(got[q])[:4] == want
    assert sum(map(len, got.values())) < 18 * 90 / 2  # blocks send their best only


def test_vectors_without_a_number_are_the_highest_as_in_spark(spark):
    df = spark.createDataFrame([(1, 1, [float("nan"), 1.0]), (1, 2, [1.0, 0.0]), (1, 3, [0.0, 1.0]), (1, 4, [1.0])], "`group` int, id int, embedding array<double>")
    assert sorted((r.a, r.b) for r in fusion.vector_pairs(df).collect()) == [(1, 2), (1, 3)]


def test_floor_keeps_the_best_and_ties(spark):
    rng = random.Random(1)
    rows = [(q, i, low, low + 0.1 * rng.random()) for q in ("x", None) for i in range(300) for low in (round(rng.random(), 2),)]
    pairs = spark.createDataFrame(rows, "q string, id int, low double, high double")
    kept = {(r.q, r.id) for r in promising(pairs, ["q"], "id", 5, 0.25).collect()}
    for q in ("x", None):
        fifth = sorted((low for p, _, low, _ in rows if p == q), reverse=True)[4]
        assert {(q, i) for p, i, _, high in rows if p == q and high >= fifth} <= kept
    assert len(kept) < 100


def test_searches_use_all_cores(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_are_taken_apart_before_they_are_paired(spark):
    nodes = spark.createDataFrame([("a", "red plate", 1)], "id string, name string, seq int")
    queries = spark.createDataFrame([(1, "a red plate")], "query_id int, query string")
    plan = retrieval.global_candidates(queries, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[: plan.index("Join")] and "regexp_replace" not in plan[plan.index("Join") :].split("\n")[0]
