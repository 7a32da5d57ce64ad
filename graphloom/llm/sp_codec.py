"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice is a chain of word lattices, since no piece of the vocabulary reaches over a word's start. A
segmentation's probability is the product of its pieces' probabilities (Zipf's law over the vocabulary's merge ranks),
normalised over the whole lattice. Samples come from a perturbed A-star search: every set of segmentations is a node
whose key is its log-probability plus Gumbel noise, conditioned so that a set's key is the largest of its parts' keys.
The best node is always opened next; it follows its best member to a whole segmentation and leaves one node per word
for the segmentations that branch off there. The first segmentations out are an exact sample without replacement. The
key of the next node is the threshold from which each sample's inclusion score is computed.

Noise is a counter hash of the row key, the sample and the word's place, so results do not depend on partitions, up to the
last digits of keys; equally probable segmentations of a word have one order, whatever words are beside it.
The search runs on arrays over many texts at once. Each distinct word keeps its BEST most probable segmentations;
the others share one branch that is sampled on the lattice itself whenever it is drawn; what was drawn is excluded
there from then on, and the rest of its probability stays.

Characters outside the vocabulary, and a literal U+2581, are spelled by byte pieces, so decoding gives back exactly the
text. Null and empty texts have one segmentation without pieces; texts with fewer distinct segmentations than asked
for return what there is. Rows that repeat have equal samples, since the seed is the row's id.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, count, islice
from math import exp, log
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.segments import U, encoded, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, BEST, SEED = 2, 4, 17
#: Bytes of texts that are cut at once, words in a batch of them, distinct words that a worker remembers, and pieces it
#: remembers for each of these: memory of a worker does not grow with what it has read.
BYTES, BATCH, CACHE, KEPT = 1_000_000, 50_000, 400_000, 32
SPACE = "▁"
#: Stands for a literal U+2581 while a text is cut; no valid text has it.
_LITERAL = "\udb81"
#: No piece holds a line feed but the byte piece, and none has a space mark after another character.
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n+|{SPACE}+")


class Pieces:
    """Vocabulary with log-probabilities; ``spell`` gives a character's byte pieces."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        size = processor.get_piece_size()
        plain = [i for i in range(size) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
        weight = {i: 1.0 / (rank + 2.7) for rank, i in enumerate(plain)}
        total = sum(weight.values())
        self.ids = {processor.id_to_piece(i): i for i in plain}
        self.score = {p: log(weight[i] / total) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.byte_score = log(min(weight.values()) / total) - log(256)
        self.byte_id = {int(processor.id_to_piece(i)[3:5], 16): i for i in range(size) if processor.is_byte(i)}
        self.raw = [b""] * size
        for p, i in self.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])

        begun = list(dict.fromkeys(p[:n] for p in self.ids for n in range(1, len(p) + 1)))  # pieces and what pieces begin with
        self.begun = frozenset(begun)
        self.raw_length = np.array([len(r) for r in self.raw], np.int32)
        self.raw_first, self.raw_bytes = (np.cumsum(self.raw_length) - self.raw_length).astype(np.int32), np.frombuffer(b"".join(self.raw), np.uint8)
        hashes, padded = np.zeros(len(begun), U), np.array(begun)
        codes = padded.view(np.uint32).reshape(len(begun), -1).astype(U)
        for column in codes.T:
            hashes = np.where(column > 0, self.grow(hashes, column), hashes)
        size = 1 << 19
        self._hash, self._id, self._score = np.zeros(size, U), np.full(size, -1, np.int32), np.full(size, -np.inf)
        for p, h in zip(begun, hashes, strict=True):
            slot = int(h >> U(45))
            while self._hash[slot]:
                slot = (slot + 1) % size
            self._hash[slot], self._id[slot], self._score[slot] = h, self.ids.get(p, 0), self.score.get(p, -np.inf)
        self._chars = np.zeros(0x110000, bool)
        self._chars[[ord(p) for p in self.ids if len(p) == 1]] = True

    @staticmethod
    def grow(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Hashes of strings from those of the strings without their last characters."""
        return mix(hashes * U(0x9E3779B97F4A7C15) + codes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashed strings in the table, -1 for those that no piece begins with."""
        slot = (hashes >> U(45)).astype(np.int64)
        met = self._hash[slot]
        other = np.flatnonzero((met != hashes) & (met > 0))
        while len(other):
            slot[other] = (slot[other] + 1) % len(self._hash)
            met[other] = then = self._hash[slot[other]]
            other = other[(then != hashes[other]) & (then > 0)]
        return np.where(met == hashes, slot, -1)

    def has_char(self, codes: np.ndarray) -> np.ndarray:
        return self._chars[codes]

    def spell(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in (SPACE if char == _LITERAL else char).encode("utf-8", "surrogatepass"))

    def edges(self, word: str, at: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(end, log-probability, pieces) of what can start at a place in a word."""
        spelled = True
        for end in range(at + 1, min(len(word), at + self.longest) + 1):
            piece = word[at:end]
            if piece not in self.begun:
                break
            if piece in self.score:
                yield end, self.score[piece], (self.ids[piece],)
                spelled = spelled and end > at + 1
        if spelled:
            ids = self.spell(word[at])
            yield at + 1, self.byte_score * len(ids), ids


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def _tagged(scores: list[float], origins: list[int]) -> tuple[float, ...]:
    """Scores whose last eight bits say where they come from, as ``_same_length`` has them: equal ones have one order."""
    n = len(scores)
    bits = unpack(f"{n}q", pack(f"{n}d", *scores))
    return unpack(f"{n}d", pack(f"{n}q", *[b & ~255 | min(o, 255) for b, o in zip(bits, origins, strict=True)]))


def word_lattice(vocab: Pieces, word: str, best: int) -> tuple[float, list[tuple[float, tuple[int, ...]]]]:
    """Log-sum over all segmentations, and the ``best`` most probable ones with their log-probabilities, unnormalised."""
    n = len(word)
    total = [0.0] * (n + 1)
    tops: list = [None] * n + [[(0.0, ())]]
    for at in range(n - 1, -1, -1):
        sums, scores, origins, options = [], [], [], []
        for end, score, ids in vocab.edges(word, at):
            sums.append(score + total[end])
            origin = (end - at - 1) * best
            for s, tail in tops[end]:
                scores.append(score + s)
                origins.append(origin)
                options.append((ids, tail))
                origin += 1
        if len(sums) == 1:
            total[at] = sums[0]
        else:
            top = max(sums)
            total[at] = top + log(sum(exp(x - top) for x in sums))
        tagged = _tagged(scores, origins)
        order = sorted(range(len(tagged)), key=tagged.__getitem__, reverse=True) if len(tagged) > 1 else [0]
        tops[at] = [(tagged[o], options[o]) for o in order[:best]]
    flat = []
    for s, chain in tops[0]:
        out: list[int] = []
        while chain:
            out += chain[0]
            chain = chain[1]
        flat.append((s, tuple(out)))
    return total[0], flat


def _edges_and_sums(vocab: Pieces, word: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
    """What can start at each place of a word, and the log-sum over all segmentations from there."""
    n = len(word)
    total = [0.0] * (n + 1)
    edges = [list(vocab.edges(word, at)) for at in range(n)]
    for at in range(n - 1, -1, -1):
        sums = [score + total[end] for end, score, _ in edges[at]]
        top = max(sums)
        total[at] = top + log(sum([exp(x - top) for x in sums]))
    return edges, total


#: The same for words of at most TOGETHER characters, remembered.
_edges_and_sums_again = lru_cache(maxsize=1024)(_edges_and_sums)


def sample_path(vocab: Pieces, word: str, noise: Iterator[float], excluded: list[tuple[float, tuple[int, ...]]]) -> tuple[float, tuple[int, ...]]:
    """A segmentation drawn from the lattice without the excluded ones (each with its log-probability given the word).

    At every node the excluded segmentations that would pass an edge are taken off the edge's probability."""
    n = len(word)
    edges, total = (_edges_and_sums if len(word) > TOGETHER else _edges_and_sums_again)(vocab, word)
    at, out, so_far, left = 0, [], 0.0, excluded  # left: those that agree with all that is drawn so far
    while at < n:
        options, whole, k = [], 0.0, len(out)
        for end, score, ids in edges[at]:
            logp = so_far + score
            passing = [(x, e) for x, e in left if e[k : k + len(ids)] == ids] if left else left
            barred = sum([exp(x - logp - total[end] + total[0]) for x, _ in passing]) if passing else 0.0
            if barred < 1 - 1e-9:
                weight = exp(score + total[end] - total[at]) * (1 - barred)
                whole += weight
                options.append((weight, end, ids, logp, passing))
        u = next(noise) * whole
        for weight, end, ids, logp, passing in options:  # noqa: B007
            u -= weight
            if u < 0:
                break
        out += ids
        at, so_far, left = end, logp, passing
    return so_far - total[0], tuple(out)


#: Longest word whose lattice is computed together with others of its length, and words in one computation.
TOGETHER, BLOCK = 40, 8192


def lattices(vocab: Pieces, words: list[str], best: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """``word_lattice`` of many words: (places of the words, log-sums, scores of the best, their pieces ended by -1).

    Words of one length that need no byte pieces are computed together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lengths[lengths > TOGETHER] = 0
    order = np.argsort(lengths, kind="stable")
    lasts = np.cumsum(np.bincount(lengths))
    for length in np.unique(lengths).tolist():
        rows = order[lasts[length - 1] if length else 0 : lasts[length]].tolist()
        plain = np.zeros(len(rows), bool)
        if length and len(rows) > 8:
            codes = np.array([words[i] for i in rows], f"U{length}").view(np.uint32).reshape(-1, length)
            plain = vocab.has_char(codes).all(axis=1)
            together = np.flatnonzero(plain)
            for low in range(0, len(together), BLOCK):
                part = together[low : low + BLOCK]
                yield [rows[r] for r in part.tolist()], *_same_length(vocab, codes[part], best)
        for r in np.flatnonzero(~plain).tolist():
            total, found = word_lattice(vocab, words[rows[r]], best)
            scores, paths = np.full((1, best), -np.inf), np.full((1, best, max(len(p) for _, p in found)), -1, np.int32)
            for j, (score, path) in enumerate(found):
                scores[0, j], paths[0, j, : len(path)] = score, path
            yield [rows[r]], np.array([total]), scores, paths


#: Stands for no segmentation; sums of two of them are still numbers.
_NONE = -1e300


def _same_length(vocab: Pieces, codes: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, length = codes.shape
    codes = np.ascontiguousarray(codes.T.astype(U))
    total = np.zeros((length + 1, n))
    tops = np.full((length + 1, best, n), _NONE)
    tops[length, 0] = 0
    ends, tails, piece = (np.zeros((length, best, n), kind) for kind in (np.int16, np.int16, np.int32))
    rows = np.arange(n)
    reach, width = min(length, vocab.longest), [0] * length + [1]  # width: segmentations kept from a place on, at most
    all_scores, all_ids = np.empty((reach, n)), np.empty((reach, n), np.int32)
    for at in range(length - 1, -1, -1):
        hashes, live, used = np.zeros(n, U), rows, []
        for end in range(at + 1, min(length, at + vocab.longest) + 1):
            hashes = vocab.grow(hashes, codes[end - 1] if len(live) == n else codes[end - 1][live])
            slot = vocab.find(hashes)
            begun = slot >= 0
            if not begun.all():  # no piece is longer than what pieces begin with
                live, hashes, slot = live[begun], hashes[begun], slot[begun]
            if not len(live):
                break
            score = vocab._score[slot]
            if (score > -np.inf).any():
                e = len(used)
                used.append(end)
                if len(live) == n:
                    np.maximum(score, _NONE, out=all_scores[e])
                    all_ids[e] = vocab._id[slot]
                else:
                    all_scores[e], all_ids[e] = _NONE, 0
                    all_scores[e, live], all_ids[e, live] = np.maximum(score, _NONE), vocab._id[slot]
        m = len(used)
        scores, ids = all_scores[:m], all_ids[:m]
        sums = scores + total[used]
        top = sums.max(axis=0)
        sums -= top
        total[at] = top + np.log(np.exp(sums, out=sums).sum(axis=0))
        deep = max(width[end] for end in used)
        width[at] = min(best, sum(width[end] for end in used))
        options = np.empty((deep, m, n))
        for e, end in enumerate(used):
            np.add(tops[end, :deep], scores[e], out=options[:, e])
        options = options.reshape(deep * m, n)
        tail, edge = np.divmod(np.arange(deep * m), m)
        origin = (np.array(used) - at - 1)[edge] * best + tail  # by the word alone, whatever words are beside it
        bits = options.view(np.int64)  # the last eight bits of a score say where it comes from
        bits &= ~255
        bits |= origin[:, None]
        row_of, edge_of = np.zeros((2, reach * best), np.int64)
        row_of[origin], edge_of[origin] = np.arange(deep * m), edge
        end_of, tail_of = np.divmod(np.arange(reach * best), best)
        end_of += at + 1
        for r in range(width[at]):
            highest = options[: (r + 1) * m].max(axis=0)  # of an edge's tails the better ones go first
            place = highest.view(np.int64) & 255
            tops[at, r], ends[at, r], tails[at, r], piece[at, r] = highest, end_of[place], tail_of[place], ids[edge_of[place], rows]
            if r + 1 < width[at]:
                options[row_of[place], rows] = 2 * _NONE
    at, rank = np.zeros((best, n), np.int64), np.repeat(np.arange(best)[:, None], n, axis=1)
    none = tops[0] <= _NONE  # fewer segmentations than asked for
    at[none] = length
    steps = []
    while (at < length).any():
        live = at < length
        here = np.minimum(at, length - 1)
        steps.append(np.where(live, piece[here, rank, rows], -1))
        at, rank = np.where(live, ends[here, rank, rows], at), np.where(live, tails[here, rank, rows], rank)
    return total[0], np.where(none, -np.inf, tops[0]).T, np.array(steps).transpose(2, 1, 0)


def _numbers(words: list[str]) -> defaultdict[str, int]:
    """The place of each word; a word that is asked for and not there gets the next place. Is freed as soon as nothing has it."""
    return defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))


class _Table:
    """Choices of distinct words: BEST segmentations and one branch for all others. Kept over batches, up to CACHE words
    and KEPT pieces for each of these."""

    def __init__(self, vocab: Pieces) -> None:
        self.vocab = vocab
        self._clear()

    def _clear(self, room: int = 0) -> None:
        room, width = max(room, CACHE), BEST + 1
        self.index = _numbers([])
        self.words: list[str] = []
        self.p, self.cumulative, self.log_rest, self.logp = (np.zeros((room, width)) for _ in range(4))
        self.counts, self.first = np.zeros(room * width, np.int32), np.zeros(room * width, np.int64)
        self.ids, self.filled = np.zeros(room * 8, np.int32), 0
        self.again = np.zeros(room, bool)  # words met twice or more

    def _shrink(self) -> None:
        """Keep the words that were met again; most words stand once in the corpus."""
        width = BEST + 1
        keep = np.flatnonzero(self.again[: len(self.words)])
        slots = (keep[:, None] * width + np.arange(width)).ravel()
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        n = int(ends[-1]) if len(ends) else 0
        ids = np.zeros(max(n, len(self.p) * 8), np.int32)
        for low in range(0, len(slots), 1 << 16):
            some = slots[low : low + (1 << 16)]
            flat = self.pieces_at(some)
            ids[ends[low] - counts[low] :][: len(flat)] = flat
        for table in (self.p, self.cumulative, self.log_rest, self.logp):
            table[: len(keep)] = table[keep]
        self.counts[: len(slots)], self.first[: len(slots)] = counts, ends - counts
        self.ids, self.filled = ids, n
        self.words = [self.words[i] for i in keep.tolist()]
        self.index = _numbers(self.words)
        self.again[:] = False

    def pieces_at(self, slots: np.ndarray) -> np.ndarray:
        """The pieces of slots, one slot's after another's."""
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[slots] - (ends - counts), counts)
        at += np.arange(len(at))
        return self.ids[at]

    def rows(self, cut: list[list[str]]) -> np.ndarray:
        """The row of every word of every text; words that are new are added, all at once."""
        total = sum(map(len, cut))
        out = self._numbered(cut, total)
        if len(self.index) > len(self.p) or self.filled > KEPT * CACHE:
            self._shrink()
            out = self._numbered(cut, total)
            if len(self.words) + len(self.index) > len(self.p) or 2 * self.filled > KEPT * CACHE:
                distinct = len(set(chain.from_iterable(cut)))
                self._clear(distinct)
                out = self._numbered(cut, total)
        known = len(self.words)
        if len(self.index) > known:
            self._add(list(islice(self.index, known, None)))
        often = np.bincount(out, minlength=1)
        self.again[np.flatnonzero(often[:known])] = True
        self.again[np.flatnonzero(often >= 2)] = True
        return out

    def _numbered(self, cut: list[list[str]], total: int) -> np.ndarray:
        """The number of every word; words that are new get the next numbers, in the order in which they stand."""
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, total)

    def _add(self, words: list[str]) -> None:
        """Fill the rows of words that were numbered last."""
        width, old = BEST + 1, len(self.words)
        self.words += words
        order, logps, counted, ids = [], [], [], []
        for places, norm, scores, paths in lattices(self.vocab, words, BEST):
            order += places
            logps.append(scores - norm[:, None])
            here = paths >= 0
            counted.append(here.sum(axis=2))
            ids.append(paths[here].astype(np.int32))
        here = old + np.array(order)
        p = np.exp(np.pad(np.concatenate(logps), ((0, 0), (0, 1)), constant_values=-np.inf))
        counts = np.pad(np.concatenate(counted), ((0, 0), (0, 1)))
        rest = np.where(counts[:, BEST - 1] > 0, 1 - p.sum(axis=1), 0)
        p[:, BEST] = np.where(rest > 1e-9, rest, 0)
        p /= p.sum(axis=1, keepdims=True)
        others = np.where((p > 0).sum(axis=1, keepdims=True) > 1, p.sum(axis=1, keepdims=True) - p, 0)
        with np.errstate(divide="ignore"):
            self.log_rest[here], self.logp[here] = np.log(np.maximum(others, 0)), np.log(p)
        self.p[here], self.cumulative[here] = p, np.cumsum(p, axis=1)
        counts, flat = counts.ravel(), np.concatenate(ids)
        slots = (here[:, None] * width + np.arange(width)).ravel()
        self.counts[slots], self.first[slots] = counts, self.filled + np.cumsum(counts) - counts
        if self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.filled], np.zeros(len(self.ids) // 4 + len(flat), np.int32)))
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)


@lru_cache(maxsize=1)
def word_table(model: str) -> _Table:
    """One table a worker, for all its tasks; what is in it changes no result."""
    return _Table(pieces(model))


def _uniform_at(seed: int, stream: int, place: int) -> float:
    """``_uniform`` of single numbers."""
    whole = (1 << 64) - 1
    x = seed + stream * 0xA24BAED4963EE407 + place * 0x9FB21C651E98DF25 & whole
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
    x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
    return (((x ^ x >> 31) >> 11) + 0.5) * (1.0 / (1 << 53))


def _uniform(seed: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """In (0, 1), from a hash of row seed, stream and place."""
    x = mix(seed + U(stream * 0xA24BAED4963EE407 % (1 << 64)) + place.astype(U) * U(0x9FB21C651E98DF25))
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class _Sampler:
    def __init__(self, table: _Table, lengths: np.ndarray, word: np.ndarray, seeds: np.ndarray) -> None:
        self.vocab, self.table = table.vocab, table
        self.word, self.lengths = word, lengths
        self.start = np.cumsum(self.lengths) - self.lengths
        self.text = np.repeat(np.arange(len(lengths)), self.lengths)
        self.place = np.arange(len(self.word)) - self.start[self.text]
        self.seed = mix(seeds + U(SEED))
        self.special: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}  # (sample, place) whose rest branch was drawn
        self.drawn: dict[tuple[int, int], list[tuple[float, tuple[int, ...]]]] = {}  # what the node there has taken from the rest branch

    def _draw(self, sample: int) -> np.ndarray:
        """A choice for every word by its probability."""
        u = _uniform(self.seed[self.text], 3 * sample, self.place)
        cumulative = self.table.cumulative[self.word]
        return np.minimum((u[:, None] >= cumulative).sum(axis=1), BEST)

    def _scores(self, choice: np.ndarray, sample: int) -> np.ndarray:
        out = self.table.logp[self.word, choice]
        for i in np.flatnonzero(choice == BEST).tolist():
            if (sample, i) not in self.special:
                unit, taken = int(self.word[i]), []
                first, counts = self.table.first, self.table.counts
                for j in range(BEST):
                    slot = unit * (BEST + 1) + j
                    taken.append((float(self.table.logp[unit, j]), tuple(self.table.ids[first[slot] : first[slot] + counts[slot]].tolist())))
                taken += self.drawn.get((sample, i), [])
                seed, place = int(self.seed[self.text[i]]), int(self.place[i])
                noise = (_uniform_at(seed, (sample << 32) + 1_000 + k, place) for k in range(1 << 30))
                self.special[sample, i] = sample_path(self.vocab, self.table.words[unit], noise, taken)
                self.drawn[sample, i] = [*self.drawn.get((sample, i), []), self.special[sample, i]]
            out[i] = self.special[sample, i][0]
        return out

    def _left(self, sample: int, i: int) -> float:
        """Probability of the rest branch at a node without what was drawn from it."""
        left = float(self.table.p[self.word[i], BEST]) - sum(exp(x) for x, _ in self.drawn.get((sample, i), []))
        return left if left > 1e-9 else 0.0

    def _others(self, choice: np.ndarray, sample: int) -> np.ndarray:
        """Log-probability of all that a first choice has left at each place."""
        out = self.table.log_rest[self.word, choice]
        for i in np.flatnonzero(choice == BEST).tolist():
            if left := float(self.table.p[self.word[i], :BEST].sum()) + self._left(sample, i):
                out[i] = log(left)
        return out

    def _before(self, scores: np.ndarray) -> np.ndarray:
        """Sum of the scores of the words before each one, within its text."""
        total = np.cumsum(scores) - scores
        return total - (total[self.start[self.text]] if len(total) else 0)

    def _keys(self, phi: np.ndarray, bound: np.ndarray, sample: int) -> np.ndarray:
        """Gumbel keys with location phi, none above the bound of their text."""
        noise = -np.log(_uniform(self.seed[self.text], 3 * sample + 1, self.place))
        with np.errstate(over="ignore", invalid="ignore"):
            out = phi - np.log(np.exp(np.minimum(phi - bound[self.text], 700.0)) + noise)
        return np.where(np.isneginf(phi), -np.inf, out)

    def run(self, samples: int):
        """Yield (alive, log-probability, key, choice array, words' scores) per sample, then the last threshold."""
        n = len(self.lengths)
        root = -np.log(-np.log(_uniform(self.seed, 2, np.zeros(n, np.int64))))
        choices = [self._draw(0)]
        scores = [self._scores(choices[0], 0)]
        phi = self._before(scores[0])
        masks = [np.where(choices[0] < BEST, 1 << choices[0], 0).astype(np.int64)]  # the rest branch is never used up by one draw
        fronts = [self._keys(phi + self._others(choices[0], 0), root, 0)]
        keys, alive = [root], [np.ones(n, bool)]
        full = self.lengths > 0
        for sample in range(1, samples + 1):
            key, parent, at = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for s, front in enumerate(fronts):
                top = np.full(n, -np.inf)
                top[full] = np.maximum.reduceat(front, self.start[full]) if full.any() else top[full]
                better = top > key
                hit = np.flatnonzero((front == top[self.text]) & better[self.text])[::-1]
                at[self.text[hit]] = hit
                key[better], parent[better] = top[better], s
            live = np.isfinite(key)
            keys.append(key)
            alive.append(live)
            if sample == samples:
                break
            parent_of = parent[self.text]
            base = np.choose(parent_of, choices) if len(choices) > 1 else choices[0].copy()
            base_scores = np.choose(parent_of, scores) if len(scores) > 1 else scores[0].copy()
            fresh = self._draw(sample)
            turn = at[self.text]
            here = np.arange(len(self.word))
            after = (here > turn) & live[self.text]
            choice = np.where(after, fresh, base)
            mask = np.where(after & (fresh < BEST), 1 << fresh, 0)
            spots = at[live]
            taken = np.choose(parent[live], [m[spots] for m in masks])
            p = self.table.p[self.word[spots]] * ~(taken[:, None] >> np.arange(BEST + 1) & 1).astype(bool)
            for row, (s, i) in enumerate(zip(parent[live].tolist(), spots.tolist(), strict=True)):
                if (s, i) in self.drawn:
                    p[row, BEST] = self._left(s, i)
                    self.drawn[sample, i] = self.drawn[s, i]
            sums = np.cumsum(p, axis=1)
            u = _uniform(self.seed[self.text[spots]], 3 * sample + 2, self.place[spots]) * sums[:, -1]
            picked = np.minimum((u[:, None] >= sums).sum(axis=1), BEST)
            choice[spots] = picked
            mask[spots] = taken | np.where(picked < BEST, 1 << picked, 0)
            for s, i in [k for k in self.special if choice[k[1]] == BEST and k[1] < turn[k[1]] and parent_of[k[1]] == k[0]]:
                self.special[sample, i] = self.special[s, i]
            own = np.where(here < turn, base_scores, 0.0)
            own[here >= turn] = self._scores(choice, sample)[here >= turn]
            phi = self._before(own)
            rest = self._others(choice, sample)
            p[np.arange(len(spots)), picked] = [self._left(sample, i) if c == BEST else 0.0 for c, i in zip(picked.tolist(), spots.tolist(), strict=True)]
            with np.errstate(divide="ignore"):
                rest[spots] = np.log(p.sum(axis=1))
            front = self._keys(phi + rest, key, sample)
            front[(here < turn) | ~live[self.text]] = -np.inf
            for s in range(len(fronts)):
                used = spots[parent[live] == s]
                fronts[s][used] = -np.inf
            choices.append(choice)
            scores.append(own)
            masks.append(mask)
            fronts.append(front)
        for s in range(samples):
            total = np.bincount(self.text, scores[s], minlength=n) if s < len(scores) else None
            if total is not None:
                yield s, alive[s], total, keys[s], keys[samples], choices[s]

    def pieces_of(self, choice: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of all texts and their number per text."""
        slot = self.word * (BEST + 1) + choice
        counts, first = self.table.counts[slot].copy(), self.table.first[slot]
        extra = [i for s, i in self.special if s == sample and choice[i] == BEST]
        for i in extra:
            counts[i] = len(self.special[sample, i][1])
        ends = np.cumsum(counts)
        source = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(first, counts)
        flat = self.table.ids[np.minimum(source, max(0, len(self.table.ids) - 1))] if len(source) else np.zeros(0, np.int32)
        for i in extra:
            flat[ends[i] - counts[i] : ends[i]] = self.special[sample, i][1]
        return flat, np.bincount(self.text, counts, minlength=len(self.lengths)).astype(np.int64)


def units(text: str | None) -> list[str]:
    """Words with the spaces before them; a space is put before the text as the vocabulary expects."""
    return _UNIT.findall(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)) if text else []


def decode(vocab: Pieces, ids) -> str:
    """The text of a list of pieces."""
    return b"".join(map(vocab.raw.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def spelled(vocab: Pieces, found: list[np.ndarray]) -> list[bytes]:
    """What ``decode`` reads for each list of pieces, as UTF-8 bytes; all lists at once."""
    if not found:
        return []
    flat = np.concatenate(found)
    lengths = vocab.raw_length[flat]
    ends = np.cumsum(lengths)
    from_ = np.repeat(vocab.raw_first[flat] - (ends - lengths), lengths)
    from_ += np.arange(len(from_))
    raw = vocab.raw_bytes[from_].tobytes()
    stops = np.concatenate(([0], ends))[np.cumsum([len(f) for f in found])].tolist()
    return [raw[a + 1 : b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def sampled(texts: list[str | None], seeds: np.ndarray, samples: int, table: _Table) -> Iterator[tuple]:
    """(text, rank, log-probability, key, inclusion, pieces) of every sample of every text."""
    low = 0
    cut = [units(t) for t in texts]
    edges = [0]
    for i, total in enumerate(accumulate(map(len, cut))):
        if total - low >= BATCH:
            edges.append(i + 1)
            low = total
    if edges[-1] < len(cut):
        edges.append(len(cut))
    word, lengths = table.rows(cut), np.array([len(c) for c in cut], np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    for a, b in zip(edges, edges[1:], strict=False):
        sampler = _Sampler(table, lengths[a:b], word[at[a] : at[b]], seeds[a:b])
        for rank, alive, logp, key, threshold, choice in sampler.run(samples):
            flat, counts = sampler.pieces_of(choice, rank)
            ends = np.cumsum(counts)
            with np.errstate(over="ignore"):
                inclusion = -np.expm1(-np.exp(np.minimum(logp - threshold, 700.0)))
            for i in np.flatnonzero(alive).tolist():
                yield a + i, rank, float(logp[i]), float(key[i]), float(inclusion[i]), flat[ends[i] - counts[i] : ends[i]]


def segmentations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """One row per row and sample: id, rank, log_prob, perturbed, inclusion, pieces, n_pieces, round_trip."""
    schema = f"{id_col} string, rank int, log_prob double, perturbed double, inclusion double, n_pieces bigint, round_trip boolean, pieces array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = pieces(model), word_table(model)
        for batch in (b for b in batches if b.num_rows):
            seeds = batch["seed"].to_numpy().view(U)
            size = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(), dtype=np.int64)
            parts = np.unique(size // BYTES, return_index=True)[1].tolist()
            for low, high in zip(parts, [*parts[1:], batch.num_rows], strict=True):
                ids, texts = batch["id"][low:high].to_pylist(), batch["text"][low:high].to_pylist()  # of a part at once
                made = list(sampled(texts, seeds[low:high], samples, table))
                given = [encoded(t) for t in texts]
                i, rank, p, key, inclusion, found = map(list, zip(*made, strict=True))
                ends = np.cumsum([0, *map(len, found)])
                back = [b == given[k] for k, b in zip(i, spelled(vocab, found), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32, copy=False)))
                columns = [pa.array([ids[k] for k in i], pa.string()), pa.array(rank, pa.int32()), pa.array(p, pa.float64()), pa.array(key, pa.float64()), pa.array(inclusion, pa.float64()), pa.array(np.diff(ends)), pa.array(back, pa.bool_()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "rank", "log_prob", "perturbed", "inclusion", "n_pieces", "round_trip", "pieces"])

    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("seed"))
    return given.mapInArrow(run, schema).withColumn(id_col, F.col(id_col).cast(kind))
