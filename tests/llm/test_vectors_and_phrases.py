"""The exact vector searches and the collocations against brute force, with nulls, ties, copies and odd names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import collocations, exact_topk, hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, v string, key string, score string, rank string"


def vectors(seed=3, n=400, dims=24):
    """Vectors in clusters, with copies under other ids, whole repeated rows, ties, nulls and components that are not finite."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] * rng.choice([0.2, 1.0, 3.0]) + rng.normal(size=dims) * 0.2
        rows.append([i, v.tolist(), int(rng.integers(4))])
    for i in range(0, 60, 3):  # one vector under many ids
        rows[i][1] = rows[0][1]
    rows += [rows[5], rows[5], [None, rows[7][1], 1], [n + 1, None, 2], [n + 2, [1.0] * (dims - 1) + [None], 2], [n + 3, [math.nan] * dims, 1], [n + 4, [math.inf] * dims, 0]]
    rows += [[n + 20, rows[9][1], None], [n + 21, rows[9][1][: dims - 5], 3], [n + 22, [], 1], [-100, rows[11][1], 2], [-20, [0.0] * dims, 2]]
    rows += [[-200, rows[13][1], 9], [n + 31, rows[14][1], 9], [-300, rows[15][1], 8]]  # few of their label, or one
    return [(*r, "own", "own", "own", "own", "own") for r in rows]


def whole(rows, scale, width=24):
    """(id, numbers, label) of the rows that take part."""
    fit = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(scale * x) for x in r[1]] + [0] * (width - len(r[1])), r[2]) for r in fit]


def order(entry):
    score, vec_id = entry
    return -score, vec_id is None, vec_id or 0


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def top(rows, k, scale, step, width=24):
    parts, want = whole(rows, scale, width), set()
    for at, (q, x, _) in enumerate(parts):
        if q is not None and q % step == 0:
            best = sorted(((dot(x, y), c) for j, (c, y, _) in enumerate(parts) if j != at), key=order)[:k]
            want |= {(q, i, c, s) for i, (s, c) in enumerate(best, 1)}
    return want


@pytest.mark.parametrize("least", [2_048, 40])
def test_top_matches_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(exact_topk, "LEAST", least)
    monkeypatch.setattr(exact_topk, "TILE", (16, 64))
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in exact_topk.top_matches(df, F.col("vec_id") % 20 == 0, 7).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == top(rows, 7, 64, 20)


def test_bounds_prune_without_loss(monkeypatch):
    monkeypatch.setattr(exact_topk, "TILE", (16, 64))
    rng = np.random.default_rng(1)
    q = np.floor(rng.normal(size=(30, 64)).cumsum(axis=1) * 9)  # smooth rows, which segments describe well
    c = np.concatenate((np.floor(rng.normal(size=(900, 64)).cumsum(axis=1) * 9), q[:10]))
    ids = rng.permutation(len(c))
    best = exact_topk.best_of_block(q, np.full(len(q), -1), c, ids, 5)
    scores = (q @ c.T).astype(int)
    want = {(i, int(s), int(j)) for i in range(len(q)) for s, j in sorted(zip(scores[i], ids), key=lambda e: (-e[0], e[1]))[:5]}
    assert set(zip(best.lists.tolist(), best.scores.tolist(), best.ids.tolist())) == want
    followed = []
    keep, exact_topk.pair_scores = exact_topk.pair_scores, lambda a, b: (followed.append(len(a)), keep(a, b))[1]
    try:
        exact_topk.best_of_block(q, np.full(len(q), -1), c, ids, 5)
    finally:
        exact_topk.pair_scores = keep
    assert 0 < sum(followed) < len(q) * len(c) / 2


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = np.floor(rng.normal(size=(40, 50)) * 90), np.floor(rng.normal(size=(40, 50)) * 90)
    exact = a @ b.T
    bounds = [exact_topk.statistics(a, s) @ exact_topk.statistics(b, s).T for s in (1, 4, 16, 25)]
    for bound in bounds:
        assert (bound >= exact - 1e-6).all()
    assert bounds[-1].mean() < bounds[0].mean()


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(20, [2.0**30 + 1, 1.0]), (1, [2.0**27, 1.0]), (2, [2.0**27, 2.0]), (3, [2.0**27, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in exact_topk.top_matches(df, F.col("vec_id") == 20, 3, 1).orderBy("rank").collect()]
    assert got == [(20, 1, 2, (2**30 + 1) * 2**27 + 2), (20, 2, 1, (2**30 + 1) * 2**27 + 1), (20, 3, 3, (2**30 + 1) * 2**27 + 1)]


@pytest.mark.parametrize("search", [lambda df: exact_topk.top_matches(df, F.col("vec_id") % 20 == 0), lambda df: hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)])
def test_empty_tables_and_tables_without_queries(spark, search):
    df = spark.createDataFrame(vectors()[:1], SCHEMA)
    assert search(df.limit(0)).count() == 0
    assert search(df.where("vec_id = 0").withColumn("vec_id", F.lit(7).cast("bigint"))).count() == 0
    assert search(df).count() == 0  # nothing but the query itself


def negatives(rows, scale=256, step=100):
    parts, want = [p for p in whole(rows, scale) if p[2] is not None], set()
    for at, (a, x, label) in enumerate(parts):
        if a is None or a % step:
            continue
        scored = [(dot(x, y), c, lab) for j, (c, y, lab) in enumerate(parts) if j != at]
        ranked = sorted(scored, key=lambda e: order(e[:2]))
        for p, pid, _ in [e for e in ranked if e[2] == label][:5]:
            fit = [e for e in ranked if e[2] != label and 30 * p <= 100 * e[0] <= 90 * p][:10]
            want |= {(a, pid, i, c, p, s) for i, (s, c, _) in enumerate(fit, 1)}
    return want


@pytest.mark.parametrize(("seed", "least", "cut"), [(3, 2_048, 512), (4, 30, 16), (5, 60, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, least, cut):
    monkeypatch.setattr(hard_negatives, "LEAST", least)
    monkeypatch.setattr(hard_negatives, "SLICE", cut)
    rows = vectors(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).select(*columns).collect()]
    assert set(got) == negatives(rows, step=20) and got


def test_scans_skip_what_cannot_count():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 16)) * 4000
    m = np.floor(np.repeat(centres, 300, axis=0) + rng.normal(size=(2400, 16)) * 40)
    pivots = hard_negatives.Pivots(m[::20], float((m * m).sum(axis=1).max()) + 1)
    away = pivots.of_rows(m)
    pivot = away.argmin(axis=1)
    distance = away[np.arange(len(m)), pivot]
    by = np.lexsort((distance, pivot))
    rows = {"m": m[by], "id": by, "label": np.zeros(len(m), int), "pivot": pivot[by], "distance": distance[by]}
    anchors = {"m": m[:8], "label": np.zeros(8, int), "own": np.full(8, -1), "lows": np.full((8, 1), -1e300), "highs": np.full((8, 1), np.inf)}
    compared = []
    keep, hard_negatives.all_scores = hard_negatives.all_scores, lambda a, b: (compared.append(len(a) * len(b)), keep(a, b))[1]
    try:
        best = hard_negatives.scan(anchors, rows, pivots, 5, True)[0]
    finally:
        hard_negatives.all_scores = keep
    scores = (m[:8] @ m.T).astype(int)
    want = {(i, int(s), int(j)) for i in range(8) for s, j in sorted(zip(scores[i], range(len(m))), key=lambda e: (-e[0], e[1]))[:5]}
    assert set(zip(best.lists.tolist(), best.scores.tolist(), best.ids.tolist())) == want
    assert sum(compared) < 8 * len(m)


PIECE, SPACE = re.compile("[.,;:!?\n\x0b\x0c\r]"), re.compile("[ \t]+")


def mined(rows, least, best):
    counts, words = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in PIECE.split(text):
            w = [x for x in SPACE.split(piece) if x]
            words[lang] += len(w)
            counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in frequent.items():
            if any(frequent[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in frequent if len(q) > len(p)):
                continue
            cuts = [(1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1)}
    return out


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "aa", "b", "new", "York", "é", "\x00z", "of", "the", "x" * 300]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ",", " \r\n"]) for _ in range(n))
    rows = [(i, say(rng.choice([0, 1, 5, 60])) + "New york city " * rng.choice([0, 1]), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(150)]
    return [*rows, rows[3], rows[3], (None, None, "en"), (1, "", None), (2, "the of " * 900 + "\n" + say(2_000), "en"), (3, "a " * 700, "fr"), (4, "b a", "xx")]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"CHUNK": 500, "FLUSH": 400, "CELLS": 40, "PATTERNS": 900, "SEEN": 5, "LISTED": 20, "SLICE": 7}), (3, {"CELL_BYTES": 1_000_000, "SHARD_BITS": 5})])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    rows = texts(seed)
    df = spark.createDataFrame([(*r, "own", "own", 5) for r in rows], "doc_id bigint, text string, lang string, phrase string, words string, n int").repartition(4)
    got = [tuple(r) for r in collocations.collocations(df, 12, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows, 12, 40) and got


def test_collocations_of_an_empty_table(spark):
    df = spark.createDataFrame([("a b " * 300, "en")], "text string, lang string")
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.select(F.lit(None).cast("string").alias("text"), "lang")).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    a, n, l, r = 10**14 + 7, 10**15 + 3, 10**14 + 11, 10**14 + 13  # the products pass 64 bits
    counts = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    assert counts.select(collocations.exact_score("a", "n", "l", "r")).first()[0] == 1000 * a * n // (l * r)
