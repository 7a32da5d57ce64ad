"""The growing entity map against a model that reads chunks in order, and the name join against all pairs."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import blocking, fusion, resolution
from graphloom.schema import node_id

SCHEMA = "chunk_id string, name string, entity_type string, confidence double, seq bigint"


def similarity(q, c):
    norm = lambda t: re.sub(r"\s+", "", t.lower())
    grams = lambda t: {t} if len(t) == 1 else {t[i : i + 2] for i in range(len(t) - 1)}
    words = lambda t: {w for r in re.findall("[a-z0-9]+|[一-鿿]+", t) for w in (r if re.fullmatch("[一-鿿]{1,4}", r) else [r])}
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0

    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return 1 - row[-1] / max(len(x), len(y))

    a, b = norm(q), norm(c)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    score = 0.30 * difflib.SequenceMatcher(None, a, b).ratio() + 0.25 * jaccard(grams(a), grams(b)) + 0.20 * jaccard(words(a), words(b)) + 0.15 * edit(a[:64], b[:64])
    return max(score, 0.88) if len(a) >= 2 and (a in b or b in a) else score


def names_of(rng, n):
    """Long names in families that differ by a letter, a word or blanks, single letters, and contained ones."""
    say = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    out = {"a", "b", "ab", "A b", "é", "北京", "北京大学", "  "}
    while len(out) < n:
        base = " ".join(say(rng.randint(2, 9)) for _ in range(rng.randint(1, 9)))
        out.add(base)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(base))
            out.add(rng.choice([base.upper(), base.replace(" ", "  ", 1), base[:at] + rng.choice("xyz") + base[at + 1 :], base + "k", base[: len(base) // 2], base[:at] + base[at:] + " " + say(1)]))
    return sorted(out)[:n] if n < len(out) else sorted(out)


@pytest.mark.parametrize("threshold", [0.78, 0.82, 0.88, 0.89])
def test_name_join_loses_no_pair(spark, threshold):
    rng = random.Random(round(threshold * 100))
    names = [(rng.choice("TTU"), n) for n in names_of(rng, 220)]
    df = spark.createDataFrame(names, "entity_type string, name string").repartition(3)
    got = {(r.entity_type, r.a, r.b): r.score for r in blocking.similar_names(df, df, threshold).collect()}
    want = {(t, a, b): round(similarity(a, b), 9) for t, a in names for u, b in names if t == u and a != b and round(similarity(a, b), 9) >= threshold}
    assert got == pytest.approx(want) and len(want) > 40
    pairs = {(r.entity_type, r.a, r.b) for r in fusion.name_pairs(df, threshold).collect()}
    assert pairs == {k for k in want if k[1] < k[2]}


def test_name_join_forms_few_pairs_and_has_no_nested_loop(spark):
    names = spark.range(4_000).select(F.lit("T").alias("entity_type"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    pairs = blocking.candidate_pairs(names, names, 0.89)
    assert pairs.count() < 4_000 * 4_000 / 20
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def model(proposals, nodes, decisions, low_only, own, fast=0.92):
    """Chunks in order, each against what is there before it."""
    order = {}
    for p in proposals:
        order[p[0]] = min(order.get(p[0], p[4]), p[4])
    there = {}
    for vec_id, name, kind, _ in sorted(nodes, key=lambda n: n[3]):
        there.setdefault((kind, name), vec_id)
    out = {}
    for chunk in sorted(order, key=order.get):
        seen, added = set(), {}
        for _, name, kind, confidence, seq in sorted((p for p in proposals if p[0] == chunk), key=lambda p: p[4]):
            if not name or (kind, name) in seen:
                continue
            seen.add((kind, name))
            if (kind, name) in there:
                out[seq] = ("known", there[kind, name])
                continue
            if not low_only or confidence < 0.85:
                scored = sorted((-round(round(similarity(name, n), 9) + 0.03, 9), i) for (k, n), i in there.items() if k == kind)
                if scored and -scored[0][0] >= fast:
                    out[seq] = ("fast_path", scored[0][1])
                    continue
                said = next((m for c, n, m, same, _ in sorted(decisions, key=lambda d: d[4]) if (c, n) == (chunk, name) and same and m), None)
                if said:
                    out[seq] = ("judged", said)
                    continue
            out[seq] = ("new", own[kind, name])
            added[kind, name] = own[kind, name]
        there |= added
    return out


@pytest.mark.parametrize(("seed", "low_only", "parts", "fast"), [(1, False, 1, 0.92), (1, False, 8, 0.92), (2, True, 4, 0.82), (3, False, 4, 0.8), (4, True, 4, 0.92)])
def test_resolution_equals_reading_chunks_in_order(spark, seed, low_only, parts, fast):
    rng = random.Random(seed)
    names = names_of(rng, 70)
    rows = [(f"c{rng.randrange(40)}", rng.choice([*names, names[3], names[3], ""]), rng.choice("TTU"), rng.choice([0.5, 0.8, 0.9, 1.0]), i) for i in range(420)]
    known = [(f"n{i}", n, "T", i) for i, n in enumerate(rng.sample(names, 6))] + [("n9", "zed", "U", 9)]
    said = [(c, n, rng.choice(["n1", "n2", None]), rng.random() < 0.8, i) for i, (c, n) in enumerate(rng.sample([(r[0], r[1]) for r in rows], 60))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    nodes = spark.createDataFrame(known, "id string, name string, entity_type string, seq bigint")
    decisions = spark.createDataFrame(said, "chunk_id string, name string, match_id string, is_same boolean, seq bigint")
    keys = spark.createDataFrame([(t, n) for t in "TU" for n in names], "entity_type string, name string").withColumn("id", node_id("entity_type", "name"))
    own = {(r.entity_type, r.name): r.id for r in keys.collect()}
    got = {r.seq: (r.how, r.node_id) for r in resolution.resolve(df, nodes, decisions, low_only, fast_score=fast).collect()}
    assert got == model(rows, known, said, low_only, own, fast)
    assert {"known", "fast_path", "judged", "new"} == {how for how, _ in got.values()}


def test_chains_of_similar_names_settle_in_order(spark):
    """Each name resembles only the few before it, so whether it is a node hangs on all of those."""
    rng = random.Random(6)
    words, names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(40)], []
    for i in range(12):
        words[27 + i] = f"0{i:02}"
        names.append("-".join(words))
    rows = [(f"c{i:02}", n, "T", 0.5, i) for i, n in enumerate(names)]
    nodes = spark.createDataFrame([], "id string, name string, entity_type string, seq bigint")
    own = {("T", r.name): r.id for r in spark.createDataFrame([("T", n) for n in names], "entity_type string, name string").withColumn("id", node_id("entity_type", "name")).collect()}
    got = {r.seq: (r.how, r.node_id) for r in resolution.resolve(spark.createDataFrame(rows, SCHEMA), nodes, fast_score=0.9).collect()}
    assert got == model(rows, [], [], False, own, 0.9) and {h for h, _ in got.values()} == {"new", "fast_path"}


def test_resolution_of_empty_tables(spark):
    nodes = spark.createDataFrame([("n1", "a", "T", 1)], "id string, name string, entity_type string, seq bigint")
    rows = spark.createDataFrame([("c", "a", "T", 1.0, 1), ("c", None, "T", 1.0, 2), ("c", "b", None, None, 3)], SCHEMA)
    assert resolution.resolve(rows.limit(0), nodes).count() == 0
    assert {r.seq: r.how for r in resolution.resolve(rows, nodes).collect()} == {1: "known", 3: "new"}
    assert {r.seq: r.how for r in resolution.resolve(rows, nodes.limit(0)).collect()} == {1: "new", 3: "new"}


def test_spellings_of_one_name_are_compared_once(spark):
    rows = [("A", spell(f"Account-{i}-of-x")) for i in (1212, 2121, 7) for spell in (str, str.upper, lambda s: s.replace("-of", "  -of"))]
    df = spark.createDataFrame([*rows, ("A", " "), ("A", None)], "entity_type string, name string")
    seen, real = [], blocking.candidate_pairs
    blocking.candidate_pairs = lambda a, b, t: seen.append((a.count(), b.count())) or real(a, b, t)
    try:
        found = {(r.a, r.b): r.score for r in blocking.similar_names(df, df, 0.89).collect()}
    finally:
        blocking.candidate_pairs = real
    same = {(a, b) for _, a in rows for _, b in rows if a != b and fn_norm(a) == fn_norm(b)}
    assert seen == [(3, 3)] and {p for p, s in found.items() if s == 1.0} == same and len(same) == 18


def fn_norm(name):
    return "".join(name.lower().split())
