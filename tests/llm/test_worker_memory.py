"""Memory of a worker does not grow with what it has read, and what it remembers changes no result."""

import gc
import random
import string
import time
import tracemalloc

import numpy as np

from graphloom.llm import sp_codec


def test_tables_that_overflow_leave_nothing_behind(monkeypatch):
    monkeypatch.setattr(sp_codec, "CACHE", 2_000)
    rng, table = random.Random(7), sp_codec._Table(sp_codec.pieces(sp_codec.MODEL))
    gc.collect()
    gc.disable()  # a worker's collector meets old objects late or never
    tracemalloc.start()
    try:
        sizes = []
        for _ in range(40):
            table.rows([["▁" + "".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(1_500)]])
            sizes.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
        gc.enable()
    assert max(sizes[20:]) < 1.3 * max(sizes[:20])


def test_tables_are_bounded_by_pieces_too(monkeypatch):
    monkeypatch.setattr(sp_codec, "CACHE", 500)
    rng, vocab = random.Random(8), sp_codec.pieces(sp_codec.MODEL)
    table = sp_codec._Table(vocab)
    for _ in range(12):
        words = ["▁" + "".join(rng.choice("etaoins") for _ in range(600)) for _ in range(15)]
        for word, i in zip(words, table.rows([words]).tolist(), strict=True):
            slot = i * (sp_codec.BEST + 1)
            ids = table.ids[table.first[slot] : table.first[slot] + table.counts[slot]].tolist()
            assert b"".join(vocab.raw[k] for k in ids).decode() == word.replace("▁", " ")
        assert len(table.words) < 60


def test_segmentations_of_a_word_do_not_depend_on_the_words_beside_it():
    rng, vocab = random.Random(9), sp_codec.pieces(sp_codec.MODEL)
    words = list({"▁" + "".join(rng.choice("abcxyz") for _ in range(rng.randrange(4, 24))) for _ in range(4_000)})

    def found(words):
        out = {}
        for places, norms, scores, paths in sp_codec.lattices(vocab, words, sp_codec.BEST):
            for r, (i, norm) in enumerate(zip(places, norms.tolist(), strict=True)):
                assert np.isfinite(norm)
                out[words[i]] = [(s, tuple(k for k in path.tolist() if k >= 0)) for s, path in zip(scores[r].tolist(), paths[r], strict=True) if s > -1e200]
        return out

    together = found(words)
    assert together == {w: p for i in range(0, len(words), 40) for w, p in found(words[i : i + 40]).items()}
    assert all(together[w] == [*sp_codec.word_lattice(vocab, w, sp_codec.BEST)[1]] for w in words[:500])


def test_drawing_takes_time_in_proportion_to_the_word():
    vocab, rng = sp_codec.pieces(sp_codec.MODEL), random.Random(10)

    def seconds(n):
        word, began = "▁" + "abcxyz" * (n // 6), time.process_time()
        ids = sp_codec.sample_path(vocab, word, iter(rng.random, 2), [])[1]
        assert b"".join(vocab.raw[k] for k in ids).decode() == word.replace("▁", " ")
        return time.process_time() - began

    seconds(6_000)
    assert min(seconds(96_000), seconds(96_000)) < 7 * max(seconds(24_000), seconds(24_000))
