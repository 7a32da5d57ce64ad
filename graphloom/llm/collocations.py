"""Collocations: phrases of two to five words that stand together more often than their parts would by chance.

Three scans of the texts, none of which keeps more than a stated amount:

1. Every phrase occurrence is counted in a sketch of hashed cells. A cell's count is an upper bound of the count of each
   phrase in it, so a phrase whose cell stays below the threshold is none. The sketch has cells in proportion to the
   text, dealt into shards of a fixed size that are summed apart.
2. Occurrences in heavy cells whose shorter phrases are in heavy cells too give the candidates, as texts.
3. Candidates and the words in them are compiled into Aho-Corasick automata, every pattern between delimiters. They are
   run over the normalized texts; overlapping matches count. Sums over all scans are exact and decide.

Heavy cells and patterns are dealt into blocks of a stated size; where there are several, each has a scan of its own.
Everything is by language. Scores are exact: products are decimals of 38 digits, divided as whole numbers.

Null texts are empty, null languages are ``und``. Repeated rows count as often as they stand. Texts of any length are
cut between pieces, which no phrase crosses. An empty table gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, UPPER, small, stashed
from graphloom.llm.segments import encoded, mix, word_hashes

LONGEST, LEAST, BEST = 5, 100, 2_000
#: Bytes of text for each cell of the sketch, which makes about three occurrences a cell; and bits of a shard's cells.
CELL_BYTES, SHARD_BITS = 8, 20
#: Bytes of text that are worked on at once; cells that are summed before they are handed on.
CHUNK, FLUSH = 1 << 21, 1 << 22
#: Heavy cells, and bytes of patterns, that one scan takes to the workers.
CELLS, PATTERNS = 4_000_000, 16 << 20
#: Candidates a task keeps before it hands them on, and heavy cells whose candidates are gathered together.
SEEN, LISTED = 200_000, 10_000
#: Patterns whose counts are summed together.
SLICE = 16_384
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes.maketrans(UPPER.encode() + _PIECE_ENDS + b"\t", LOWER.encode() + b"\n" * len(_PIECE_ENDS) + b" ")
U, _ODD = np.uint64, np.uint64(0x9E3779B97F4A7C15)


def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """(lang, lower-cased pieces, one a line) in chunks of about CHUNK bytes, each of whole pieces."""
    for frame in frames:
        for lang, group in frame.groupby("lang"):
            waiting, size = [], 0
            for text in group["text"]:
                waiting.append(encoded(text).translate(_NORMAL))
                size += len(waiting[-1]) + 1
                if size >= CHUNK:
                    yield from ((lang, part) for part in _cut(b"\n".join(waiting)))
                    waiting, size = [], 0
            if size:
                yield from ((lang, part) for part in _cut(b"\n".join(waiting)))


def _cut(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > 2 * CHUNK:
        end = raw.rfind(b"\n", at, at + CHUNK)
        end = raw.find(b"\n", at + CHUNK) if end < 0 else end
        if end < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


class Phrases:
    """Hashes of all phrases of a chunk: ``hashes[k - 2]`` has those of k words by first word, ``inside`` which are real."""

    def __init__(self, lang: str, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        ends = data == 0x0A
        word = np.concatenate(([False], ~ends & (data != 0x20), [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.first, self.last = edges[::2], edges[1::2]
        piece = np.cumsum(ends, dtype=np.int32)[self.first] if len(self.first) else np.zeros(0, np.int32)
        words = word_hashes(raw, self.first, self.last)
        so_far = words ^ U(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        self.hashes, self.inside = [], []
        for k in range(2, LONGEST + 1):
            so_far = mix(so_far[:-1] * _ODD + words[k - 1 :])
            self.hashes.append(so_far)
            self.inside.append(piece[k - 1 :] == piece[: len(so_far)])


def _sketched(docs: DataFrame, bits: int) -> DataFrame:
    """(shard, cells) where ``cells`` packs gaps between hit cells and their counts."""
    within = U((1 << SHARD_BITS) - 1)

    def packed(waiting: list[np.ndarray]) -> pd.DataFrame:
        cells, counts = np.unique(np.concatenate(waiting), return_counts=True)
        shard = (cells >> U(SHARD_BITS)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(cells)]
        deflate = zstandard.ZstdCompressor(1).compress
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            gaps = np.diff((cells[a:b] & within).astype(np.uint32), prepend=np.uint32(0))
            rows.append((shard[a], deflate(gaps.tobytes() + counts[a:b].astype(np.uint32).tobytes())))
        return pd.DataFrame(rows, columns=["shard", "cells"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, held = [], 0
        for lang, raw in chunks(frames):
            found = Phrases(lang, raw)
            for hashes, inside in zip(found.hashes, found.inside, strict=True):
                waiting.append(hashes[inside] >> U(64 - bits))
                held += len(waiting[-1])
            if held >= FLUSH:
                yield packed(waiting)
                waiting, held = [], 0
        if held:
            yield packed(waiting)

    return docs.mapInPandas(run, "shard bigint, cells binary")


def heavy_cells(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """(cell) of the sketch with ``bits`` bits whose count reaches ``least``."""

    def total(group: pd.DataFrame) -> pd.DataFrame:
        sums, inflate = np.zeros(1 << SHARD_BITS, np.int64), zstandard.ZstdDecompressor().decompress
        for packed in group["cells"]:
            gaps, counts = np.frombuffer(inflate(packed), np.uint32).reshape(2, -1)
            sums[np.cumsum(gaps)] += counts
        cells = np.flatnonzero(sums >= least)
        return pd.DataFrame({"cell": cells + (int(group["shard"].iloc[0]) << SHARD_BITS)})

    return _sketched(docs, bits).groupBy("shard").applyInPandas(total, "cell bigint")


def _candidates(docs: DataFrame, bits: int, heavy: np.ndarray, block: tuple[int, int], shards: int) -> DataFrame:
    """(lang, shard, phrases), compressed lines, of phrases that can have ``least`` occurrences; ``heavy`` has all heavy
    cells from ``block[0]`` on and below ``block[1]``, other cells are taken for heavy but give no phrases."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = sent.value
        mask = U((1 << SHARD_BITS) - 1)
        marked = np.zeros(1 << SHARD_BITS, bool)
        marked[cells & mask] = True
        low, high = map(U, block)
        seen: dict[str, set[bytes]] = {}
        for lang, raw in chunks(frames):
            found, mine = Phrases(lang, raw), seen.setdefault(lang, set())
            before = None
            for k, (hashes, inside) in enumerate(zip(found.hashes, found.inside, strict=True), 2):
                cell = hashes >> U(64 - bits)
                own = (cell >= low) & (cell < high)
                good = inside & (marked[cell & mask] | ~own)
                if before is not None:
                    good &= before[:-1] & before[1:]
                at = np.flatnonzero(good & own)
                place = np.searchsorted(cells, cell[at])
                true = cells[np.minimum(place, len(cells) - 1)] == cell[at]
                good[at[~true]] = False
                at, before = at[true], good
                mine.update([raw[a:b] for a, b in zip(found.first[at].tolist(), found.last[at + k - 1].tolist(), strict=True)])
            if sum(map(len, seen.values())) > SEEN:
                yield packed(seen)
                seen = {}
        yield packed(seen)

    def packed(seen: dict[str, set[bytes]]) -> pd.DataFrame:
        dealt: dict[tuple[str, int], list[bytes]] = {}
        for lang, phrases in seen.items():
            for phrase in {b" ".join(filter(None, x.split(b" "))) for x in phrases}:
                dealt.setdefault((lang, xxhash.xxh3_64_intdigest(phrase) % shards), []).append(phrase)
        deflate = zstandard.ZstdCompressor(1).compress
        return pd.DataFrame([(*to, deflate(b"\n".join(sorted(phrases)))) for to, phrases in dealt.items()], columns=["lang", "shard", "phrases"])

    return docs.mapInPandas(run, "lang string, shard bigint, phrases binary")


def _listed(group: pd.DataFrame) -> pd.DataFrame:
    """Each phrase of one language and shard once."""
    inflate = zstandard.ZstdDecompressor().decompress
    found = set().union(*(inflate(packed).split(b"\n") for packed in group["phrases"]))
    return pd.DataFrame({"lang": group["lang"].iloc[0], "phrase": [p.decode("utf-8", "surrogatepass") for p in found]})


def candidates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase) of at least all phrases with ``least`` occurrences. docs: lang, text, without nulls."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(SHARD_BITS, (size // CELL_BYTES).bit_length())
    heavy = stashed(heavy_cells(docs, bits, least))
    size = heavy.count()
    blocks, shards = -(-size // CELLS), max(1, size // LISTED)
    span = -(-(1 << bits) // max(blocks, 1))
    found = []
    for low in range(0, (1 << bits) if blocks else 0, span):
        cells = heavy.where(F.col("cell").between(low, low + span - 1)).toPandas()["cell"].to_numpy()
        if len(cells):
            found.append(_candidates(docs, bits, np.sort(cells).astype(U), (low, low + span), shards))
    return reduce(DataFrame.union, found).groupBy("lang", "shard").applyInPandas(_listed, "lang string, phrase string") if found else docs.select("lang", F.col("text").alias("phrase")).limit(0)


def _scanned(docs: DataFrame, sent: Broadcast, block: int) -> DataFrame:
    """(lang, block, part, counts) by task: overlapping matches of patterns, in slices of SLICE; part -1 has all words."""

    def automaton(phrases: list[str]) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            built.add_word(f" {phrase} ", i)
        built.make_automaton()
        return built

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, ahocorasick.Automaton] = {}
        counts: dict[str, Counter] = {}
        for lang, raw in chunks(frames):
            text = " " + raw.decode("utf-8", "surrogatepass").replace("\n", " \n ") + " "
            while "  " in text:
                text = text.replace("  ", " ")
            mine = counts.setdefault(lang, Counter())
            if block == 0:
                mine[-1] += text.count(" ") - 1 - text.count("\n")
            if lang not in built:
                built[lang] = automaton(sent.value.get(lang, []))
            if len(built[lang]):
                mine.update(map(itemgetter(1), built[lang].iter(text)))
        rows, deflate = [], zstandard.ZstdCompressor(1).compress
        for lang, found in counts.items():
            if block == 0:
                rows.append((lang, block, -1, deflate(np.array([found.pop(-1)], np.int64).tobytes())))
            hits = np.zeros(len(sent.value.get(lang, [])), np.int64)
            hits[list(found)] = list(found.values())
            rows += [(lang, block, at // SLICE, deflate(hits[at : at + SLICE].tobytes())) for at in range(0, len(hits), SLICE)]
        yield pd.DataFrame(rows, columns=["lang", "block", "part", "counts"])

    return docs.mapInPandas(run, "lang string, block int, part int, counts binary")


def _summed(sent: list[Broadcast]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Counts of one slice of patterns, of all tasks together."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        inflate = zstandard.ZstdDecompressor().decompress
        lang, block, part = (group[c].iloc[0] for c in ("lang", "block", "part"))
        total = sum(np.frombuffer(inflate(packed), np.int64) for packed in group["counts"])
        phrases = [""] if part < 0 else sent[block].value[lang][part * SLICE : (part + 1) * SLICE]
        return pd.DataFrame({"lang": lang, "phrase": phrases, "f": total})

    return run


def phrase_counts(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, f): exact occurrences of phrases and of the words in them; of the empty phrase, all words."""
    words = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
    patterns = stashed(phrases.union(words).distinct())
    size = patterns.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0
    blocks = max(1, -(-size // PATTERNS))
    sent, scans = [], []
    for block in range(blocks):
        held: dict[str, list[str]] = {}
        for lang, phrase in patterns.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)) == block).toPandas().itertuples(index=False):
            held.setdefault(lang, []).append(phrase)
        sent.append(docs.sparkSession.sparkContext.broadcast(held))
        scans.append(_scanned(docs, sent[-1], block))
    return reduce(DataFrame.union, scans).groupBy("lang", "block", "part").applyInPandas(_summed(sent), "lang string, phrase string, f bigint")


def exact_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)); the products have up to 38 digits, so nothing is rounded."""
    whole = [f"cast({c} as decimal(19,0))" for c in (f"1000 * {a}", n, left, right)]
    return F.expr(f"({whole[0]} * {whole[1]}) div ({whole[2]} * {whole[3]})")


def collocations(df: DataFrame, least: int = LEAST, best: int = BEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` collocations.

    A phrase is cut where its score, floor(1000 * a * n / (l * r)), is least; it goes if a longer phrase that holds it
    has as many occurrences."""
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stashed(phrase_counts(docs, stashed(candidates(docs, least))))
    frequent = counts.where((F.col("f") >= least) & F.col("phrase").contains(" ")).withColumn("words", F.split("phrase", " "))
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    sizes = F.sequence(F.lit(1), F.size("words") - 1)
    joined = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    cut = frequent.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(sizes).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    left, right = (counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(small(totals), "lang")
    scored = scored.withColumn("score", exact_score("a", "n", "l", "r"))
    least_cut = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    inner = frequent.where(F.size("words") > 2).select("lang", F.explode(starts).alias("phrase"), F.col("f").alias("longer"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least_cut.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
