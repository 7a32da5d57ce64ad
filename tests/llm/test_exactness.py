"""Substring dedup where hashes, ids and sizes could go wrong."""

import hashlib
import random

import pytest

import numpy as np

from graphloom.llm import fm_dedup, sa_dedup
from graphloom.llm.segments import U, mix, word_symbols

from test_llm_operators import WORD, repeated


def words_of(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_words_whose_polynomials_agree_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    shared = " ".join(words_of(random.Random(1), 34))
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}")], "doc_id bigint, text string")
    assert [r.n_removed for r in fm_dedup.removal_report(docs).collect()] == [0, 0]
    docs = docs.union(docs.where("doc_id = 1").selectExpr("3L", "text"))
    assert {r.doc_id: r.n_removed for r in fm_dedup.removal_report(docs).collect()} == {1: 35, 2: 0, 3: 35}


@pytest.mark.parametrize("report", [fm_dedup.removal_report, sa_dedup.removal_report])
def test_large_ids_beside_a_null_id(spark, report):
    docs = spark.createDataFrame([(2**53 + 1, "a b c"), (None, "d e f"), (2**53 + 3, "x")], "doc_id bigint, text string")
    assert {r.doc_id for r in report(docs).collect()} == {2**53 + 1, None, 2**53 + 3}


def contexts(rng):
    """One passage in many different surroundings, whole, cut and with one letter changed; and a text of several pieces."""
    passage = words_of(rng, 70)
    texts = [" ".join(words_of(rng, rng.randint(0, 30)) + passage[rng.randint(0, 20) : rng.randint(45, 70)] + words_of(rng, rng.randint(0, 30))) for _ in range(120)]
    changed = list(passage)
    changed[rng.randint(0, 69)] = "changed"
    long = words_of(rng, 70_000)
    return [*texts, " ".join(changed), texts[5], texts[5], " ".join(long), " ".join(long[65_500:65_560]) + " end", " ".join(long[:40])]


@pytest.mark.parametrize("hot", [None, 300, 3_000])
def test_anchors_with_much_text_are_split_without_loss(spark, hot):
    texts = contexts(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    limits = {} if hot is None else {"hot": hot, "shard": 4_000}
    cut = [WORD.findall(t) for t in texts]
    want = {i: sum(gone) for i, gone in enumerate(repeated(cut, 35))}
    assert {r.doc_id: r.n_removed for r in fm_dedup.removal_report(docs, **limits).collect()} == want

    raw = [t.encode() for t in texts if len(t) < 20_000]
    short = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(raw)], "doc_id bigint, text string").repartition(4)
    want = {i: (sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()) for i, (b, gone) in enumerate(zip(raw, repeated(raw, 200), strict=True))}
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in sa_dedup.removal_report(short, **limits).collect()} == want


def words_of_one_hash(rng, count=3):
    """Words of 16 letters that ``word_symbols`` maps to one value: the second half makes up for the first."""
    state = lambda block: mix(mix(np.array([16], U) + U(0x9E3779B97F4A7C15)) * U(0xD6E8FEB86659FD93) ^ np.frombuffer(block, "<u8")) * U(0xD6E8FEB86659FD93)
    first = b"abcdefgh"
    target = state(first) ^ np.frombuffer(b"ijklmnop", "<u8")
    found = [first + b"ijklmnop"]
    while len(found) < count:
        block = bytes(rng.choices(range(33, 127), k=8))
        rest = (state(block) ^ target).tobytes()
        if all(33 <= x < 127 for x in rest):
            found.append(block + rest)
    assert len(set(found)) == count and len(set(word_symbols(b" ".join(found)).tolist())) == 1
    return [w.decode() for w in found]


@pytest.mark.parametrize("many", [False, True])
def test_words_that_share_a_hash_are_told_apart(spark, many):
    rng = random.Random(8)
    one, two, three = words_of_one_hash(rng)
    shared = " ".join(words_of(rng, 34))
    texts = [f"{shared} {one}", f"{shared} {two}", f"{shared}\t{three} end"]
    if many:  # several distinct segments at each anchor, and true copies among them
        texts += [f"start {shared} {one} x y", f"{two} {shared}", f"z  {shared} {two}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: sum(gone) for i, gone in enumerate(repeated([WORD.findall(t) for t in texts], 35))}
    for limits in ({}, {"hot": 40, "shard": 60}):
        assert {r.doc_id: r.n_removed for r in fm_dedup.removal_report(docs, **limits).collect()} == want
    assert want[1] == (35 if many else 0)
