"""A large group of near copies with many changes: linked as all pairs are, while few pairs are tried."""

import itertools
import random

from graphloom.llm import shingle_dedup


def copies(n, words=150, most=7):
    """Copies of one text with 0 to ``most`` changed words each; two link where they differ in about three."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5_000)}" for _ in range(words)]
    for _ in range(n):
        changed = list(base)
        for at in rng.sample(range(words), rng.randrange(most + 1)):
            changed[at] = f"x{rng.randrange(99_999_999)}"
        yield " ".join(changed)


def test_a_group_of_near_copies_is_not_tried_pair_by_pair(spark, monkeypatch):
    texts, tried, alike = list(copies(400)), [], shingle_dedup.alike

    def counted(pairs, sketches):
        tried.append(pairs.count())
        return alike(pairs, sketches)

    monkeypatch.setattr(shingle_dedup, "alike", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    groups = {}
    for r in shingle_dedup.near_duplicates(docs, sample=1).collect():
        groups.setdefault(r.component, set()).add(r.id)
    sets, of = [set(shingle_dedup.shingle_set(t).tolist()) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if of[a] != of[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            of = [of[a] if x == of[b] else x for x in of]
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in range(len(texts)) if of[i] == g) for g in set(of))
    assert 100 < max(map(len, groups.values())) < 350
    assert sum(tried) < 10 * len(texts)
