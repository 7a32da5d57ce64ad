"""Dictionary mentions against a scan word by word."""

import random
import re

import pytest

from graphloom.operators import evolution, retrieval

WORD = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("extra", [0, 30_000])
def test_mentions_equal_a_scan(spark, extra):
    """Also with more terms than are broadcast."""
    rng = random.Random(5)
    vocabulary = ["New", "york", "York", "city", "é", "of", "A1", "the", "北京", "x"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n", "_"]) for _ in range(n))
    chunks = [(f"c{i}", say(rng.choice([0, 1, 4, 60]))) for i in range(60)] + [("none", None), ("empty", "")]
    terms = {(say(rng.randint(1, 4)), rng.choice("TU")) for _ in range(60)} | {("new york", "T"), ("NEW-YORK", "T"), ("york", "U"), ("?!", "T"), ("", "T")}
    terms |= {(f"term {i} of {i % 7}", "T") for i in range(extra)}
    got = {tuple(r) for r in evolution.dictionary_mentions(spark.createDataFrame(chunks, "chunk_id string, chunk string").repartition(3), spark.createDataFrame(sorted(terms), "term string, entity_type string")).collect()}
    by_words = {}
    for term, kind in terms:
        by_words.setdefault(tuple(WORD.findall(term.lower())), []).append((term, kind))
    want = set()
    for chunk_id, text in chunks:
        w = WORD.findall((text or "").lower())
        for i in range(len(w)):
            k = max((k for k in range(1, 6) if i + k <= len(w) and tuple(w[i : i + k]) in by_words), default=0)
            want |= {(chunk_id, i + 1, k, term, kind) for term, kind in (by_words[tuple(w[i : i + k])] if k else [])}
    assert got == want and len(want) > 100


def test_empty_dictionaries_and_chunks(spark):
    chunks = spark.createDataFrame([("c", "a b")], "chunk_id string, chunk string")
    terms = spark.createDataFrame([("a", "T")], "term string, entity_type string")
    assert evolution.dictionary_mentions(chunks, terms.limit(0)).count() == 0
    assert evolution.dictionary_mentions(chunks.limit(0), terms).count() == 0


def test_quotas_count_seeds_of_any_rank(spark):
    ranks = spark.createDataFrame([(f"n{i:02}", 1 / (1 + i)) for i in range(20)], "id string, rank double")
    nodes = spark.createDataFrame([(f"n{i:02}", "文档片段" if i % 2 else "A") for i in range(20)], "id string, entity_type string")
    seeds = nodes.where("id IN ('n18', 'n16', 'n15')")
    got = {(r.id, r.kind) for r in retrieval.rank_quotas(ranks, nodes, seeds, 3).collect()}
    assert got == {("n16", "entity"), ("n18", "entity"), ("n00", "entity"), ("n01", "anchor"), ("n03", "anchor"), ("n05", "anchor")}
    few = {r.id for r in retrieval.rank_quotas(ranks, nodes, nodes.where("entity_type = 'A'"), 3).where("kind = 'entity'").collect()}
    assert few == {f"n{i:02}" for i in range(0, 20, 2)}
