"""Segmentations beyond a word's best ones keep their probability after one of them was drawn."""

import random
import string

import numpy as np
import pytest

from graphloom.llm import sp_codec


def test_a_long_unspaced_text_is_sampled_beyond_its_best_segmentations():
    vocab, rng, n = sp_codec.Pieces(sp_codec.MODEL), random.Random(3), 60
    vocab.score = {p: s * 0.15 for p, s in vocab.score.items()}
    vocab._score = vocab._score * 0.15
    text = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(160))
    total, best = sp_codec.word_lattice(vocab, sp_codec.SPACE + text, sp_codec.BEST)
    held = sum(np.exp(s - total) for s, _ in best)
    assert held < 0.05
    got = list(sp_codec.sampled([text] * n, np.arange(n, dtype=np.uint64), 4, sp_codec._Table(vocab)))
    assert len(got) == 4 * n == len({(i, tuple(f.tolist())) for i, *_, f in got})
    assert all(sp_codec.decode(vocab, f.tolist()) == text for *_, f in got)
    for rank in range(4):
        assert sum(tuple(f.tolist()) in {ids for _, ids in best} for _, r, *_, f in got if r == rank) <= 0.1 * n + 5 * held * n


@pytest.mark.parametrize("best", [1, 2])
def test_later_samples_follow_the_lattice(monkeypatch, best):
    monkeypatch.setattr(sp_codec, "BEST", best)
    vocab = sp_codec.Pieces(sp_codec.MODEL)
    vocab.score = {p: s * 0.15 for p, s in vocab.score.items()}
    vocab._score = vocab._score * 0.15

    def paths(word, at=0):
        if at == len(word):
            yield 0.0, ()
        else:
            for end, score, ids in vocab.edges(word, at):
                yield from ((score + s, ids + rest) for s, rest in paths(word, end))

    every = list(paths("▁thet"))
    p = np.exp([s for s, _ in every])
    p /= p.sum()
    place, m, n = {path: j for j, (_, path) in enumerate(every)}, len(every), 12_000
    seen, inclusion = np.zeros((3, m)), np.zeros(m)
    for _, rank, logp, _, q, f in sp_codec.sampled(["thet"] * n, np.arange(n, dtype=np.uint64), 3, sp_codec._Table(vocab)):
        j = place[tuple(f.tolist())]
        assert logp == pytest.approx(np.log(p[j]), abs=1e-6)
        seen[rank, j] += 1
        inclusion[j] += 1 / q
    want = np.zeros((3, m))
    for a in range(m):
        want[0, a] = p[a]
        for b in set(range(m)) - {a}:
            two = p[a] * p[b] / (1 - p[a])
            want[1, b] += two
            for c in set(range(m)) - {a, b}:
                want[2, c] += two * p[c] / (1 - p[a] - p[b])
    assert np.allclose(seen / n, want, atol=0.02)
    assert np.allclose(inclusion[p > 0.1] / n, 1, atol=0.06)  # the scores weigh each segmentation back to one
