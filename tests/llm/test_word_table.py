"""Distinct words are taken apart once a worker, and batches of words give the segmentations of single words."""

import random
import string

import numpy as np

from graphloom.llm import sp_codec


def test_words_that_come_again_are_not_taken_apart_again(monkeypatch):
    rng, asked, lattices = random.Random(5), [], sp_codec.lattices

    def counted(vocab, words, best):
        asked.append(len(words))
        return lattices(vocab, words, best)

    monkeypatch.setattr(sp_codec, "lattices", counted)
    words = ["▁" + "".join(rng.choice(string.ascii_lowercase) for _ in range(4)) for _ in range(260_000)]
    table = sp_codec._Table(sp_codec.pieces(sp_codec.MODEL))
    parts = [words[i : i + 65_000] for i in range(0, len(words), 65_000)]
    for part in [*parts, *parts]:
        numbers = table.rows([part[:9], [], part[9:]])
        assert [table.words[i] for i in numbers[:50].tolist()] == part[:50]
    assert sum(asked) == len(set(words))


def test_tables_that_overflow_hold_the_right_segmentations(monkeypatch):
    monkeypatch.setattr(sp_codec, "CACHE", 60)
    rng, vocab = random.Random(6), sp_codec.pieces(sp_codec.MODEL)
    table, width = sp_codec._Table(vocab), sp_codec.BEST + 1
    words = ["▁" + "".join(rng.choice("etaoinsé🙂") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    for _ in range(60):
        some = rng.sample(words, 25) + rng.sample(words[:20], 5) if rng.randrange(9) else rng.sample(words, 150)
        for word, i in zip(some, table.rows([some]).tolist(), strict=True):
            total, best = sp_codec.word_lattice(vocab, word, sp_codec.BEST)
            assert np.allclose(table.logp[i, : len(best)], [s - total for s, _ in best], atol=1e-6)
            assert not table.p[i, len(best) : sp_codec.BEST].any()
            for j, (score, _) in enumerate(best):
                slot = i * width + j
                ids = table.ids[table.first[slot] : table.first[slot] + table.counts[slot]].tolist()
                assert b"".join(vocab.raw[k] for k in ids).decode() == word.replace("▁", " ")
