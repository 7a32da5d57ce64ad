"""The near-duplicate stage of the pipeline against all pairs: linked exactly where five-word shingles are 0.8 alike."""

import itertools
import random
import re

import pytest

import corpus_pipeline
from graphloom.llm import shingle_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    """Texts with one to many changed words, chains of copies, one stock line in most, and a large group of copies."""
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    stock, texts = say(12), []
    for _ in range(40):
        base = say(rng.choice([6, 25, 60, 120, 300])) + stock * rng.randrange(2)
        texts.append(base)
        for _ in range(3):
            texts.append(changed := list(rng.choice([base, texts[-1]])))
            for _ in range(rng.randrange(1, 2 + len(base) // 40)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(99_999)}"
    large = say(100)
    for _ in range(80):
        texts.append(changed := list(large))
        for at in rng.sample(range(100), rng.randrange(4)):
            changed[at] = f"y{rng.randrange(99_999)}"
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, rows[3][1].upper()), (None, rows[-1][1] + " tail"), rows[5], ((1 << 53) + 1, "one two"), (None, "alone " * 3), (None, "alone " * 3)]
    return rows


def expected(rows):
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))
    tight = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        shared, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * shared >= 4 * either:
            tight += 5 * shared < 4.5 * either
            of = [of[a] if x == of[b] else x for x in of]
    return of, tight


@pytest.mark.parametrize("order", [{}, {"sample": 1, "least": 3}, {"sample": 1, "least": 30}])
def test_components_are_those_of_all_pairs(spark, order):
    rows = corpus()
    of, tight = expected(rows)
    assert tight > 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = shingle_dedup.near_duplicates(docs, **order).collect()
    assert len(got) == len(rows)
    want = sorted(sorted(map(str, (rows[i][0] for i in range(len(rows)) if of[i] == g))) for g in set(of))
    groups = {}
    for r in got:
        groups.setdefault(r.component, []).append(str(r.id))
    assert sorted(map(sorted, groups.values())) == want


def test_the_stage_keeps_one_row_of_each_group(spark):
    rows = corpus()
    of, _ = expected(rows)
    least = [min((rows[i][0] for i in range(len(rows)) if of[i] == g and rows[i][0] is not None), default=None) for g in set(of)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, least))
