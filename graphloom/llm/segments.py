"""Repeated windows over a whole corpus: which stretches of ``window`` symbols start in two places or more.

Symbols are words or bytes, hashed to 64-bit values. Every window's anchor is the least hash of its runs of ``k``
symbols, the first of them where there are several, so equal windows have equal anchors in equal places; an anchor only
says what may be equal. Consecutive windows with the same place form a segment. Only segments whose anchor occurs twice
or more can hold a repeated window. Equal segments are one, with its number of copies: they are told apart by anchor and
a 128-bit BLAKE2b digest of their own bytes (words joined by one space), never by the hashes of their symbols.

* Where an anchor has one distinct segment, its copies repeat all of it.
* The distinct segments of other anchors go to shards, in which an index decides (FM-index or suffix array, see the
  callers). All segments of an anchor go to one shard, so equal windows meet. The index compares bytes, or whole words.
* An anchor with more distinct text than fits a shard is replaced by longer ones (see ``_split``), first for groups of
  neighbouring windows and then for smaller ones, so no shard grows with the corpus and the index still decides.

Symbols shuffled by the first step are a few per cent of the text. Joins have a unique side, so a key that a third of
all rows share can be split at run time.

Texts of any length are cut into pieces that overlap by a window less one. Repeated rows share their key and count as
copies. An empty table has no spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scope, forget, stashed

#: Symbols hashed at once; longer texts are cut into pieces that overlap by a window less one.
PIECE = 1 << 16
U = np.uint64
_ODD, _ODD2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(values: np.ndarray, k: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """Hash of every run of k values: a polynomial in ``odd``, by doubling, then mixed."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total, done, power, length, scale = None, 0, values, 1, int(odd)
    while k:
        if k & 1:
            part = power[done : done + n]
            total = part if total is None else total * U(scale) + part
            done += length
        k >>= 1
        if k:
            power, length = power[:-length] * U(scale) + power[length:], 2 * length
            scale = scale * scale % (1 << 64)
    return mix(total)


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least of every ``width`` consecutive hashes, from prefix and suffix minima of blocks."""
    n = len(hashes) - width + 1
    padded = np.full(-(-len(hashes) // width) * width, ~U(0), U)
    padded[: len(hashes)] = hashes
    blocks = padded.reshape(-1, width)
    at = np.arange(len(padded), dtype=np.int32).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1)
    fresh = np.ones(blocks.shape, bool)
    fresh[:, 1:] = blocks[:, 1:] < before[:, :-1]
    first_before = np.maximum.accumulate(np.where(fresh, at, 0), axis=1).ravel()[width - 1 : width - 1 + n]
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    first_after = np.minimum.accumulate(np.where(blocks == after, at, len(padded))[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.where(after.ravel()[:n] <= before.ravel()[width - 1 : width - 1 + n], first_after, first_before)


_WHOLE = (1 << 64) - 1


def _signed(digest: int) -> int:
    return digest - (digest >> 63 << 64)


def content(body: bytes) -> bytes:
    """What tells segments apart; nobody can make up two bodies that share it."""
    return blake2b(body, digest_size=16).digest()


def cut_segments(symbols: np.ndarray, lengths: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """(first, windows, lead, anchor) of the segments of texts that stand one after another in ``symbols``."""
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return none, none, none, none.view(U)
    hashes = run_hashes(as_values(symbols), k)
    least = window_minima(hashes, window - k + 1)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(least)]
    whole = ends - np.arange(len(least)) >= window  # the window stays inside its text
    starts = whole.copy()
    starts[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(starts)
    stop = np.flatnonzero(whole & ~np.concatenate((whole[1:] & ~starts[1:], [False]))) + 1
    return first, stop - first, least[first] - first, hashes[least[first]]


def pieces(sizes: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (text, from, to) of about PIECE symbols; every window of every text is in exactly one of them."""
    batch, filled = [], 0
    for i, n in enumerate(sizes):
        at = 0
        while n - at >= window:
            to = min(n, at + PIECE)
            batch.append((i, at, to))
            filled += to - at
            if filled >= PIECE:
                yield batch
                batch, filled = [], 0
            at = to - window + 1 if to < n else n
    if batch:
        yield batch


@dataclass(frozen=True)
class Kind:
    """How UTF-8 bytes become symbols: ``plain`` gives equal bytes for equal sequences of symbols, ``symbols`` hashes them
    to 64-bit values (or leaves bytes), ``slicer`` gives stretches of a plain text as bytes, and ``read`` symbols of
    stretches that are equal if and only if the stretches' bytes or words are."""

    plain: Callable[[bytes], bytes]
    symbols: Callable[[bytes], np.ndarray]
    slicer: Callable[[bytes], Callable[[int, int], bytes]]
    read: Callable[[list[bytes]], list[np.ndarray]]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _segments(docs: DataFrame, kind: Kind, k: int, window: int) -> DataFrame:
    """(row_key, start, n, lead, anchor, content) of every segment of every text; the anchor is ``lead`` symbols in."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame["row_key"].to_numpy()
            for low in range(0, len(frame), 256):
                raws = [kind.plain(encoded(t)) for t in frame["text"].iloc[low : low + 256]]
                texts = [kind.symbols(raw) for raw in raws]
                bodies = [kind.slicer(raw) for raw in raws]
                for batch in pieces([len(t) for t in texts], window):
                    parts = [texts[i][a:b] for i, a, b in batch]
                    lengths = np.array([len(p) for p in parts])
                    symbols = np.concatenate(parts)
                    first, n, lead, anchor = cut_segments(symbols, lengths, k, window)
                    offsets = np.cumsum(lengths) - lengths
                    part = np.searchsorted(offsets, first, "right") - 1
                    begin = np.array([a for _, a, _ in batch])
                    owner = np.array([i for i, _, _ in batch])[part]
                    start = first - offsets[part] + begin[part]
                    digests = [content(bodies[i](a, b)) for i, a, b in zip(owner.tolist(), start.tolist(), (start + n + window - 1).tolist(), strict=True)]
                    yield pd.DataFrame({"row_key": keys[low + owner], "start": start, "n": n.astype(np.int32), "lead": lead.astype(np.int32), "anchor": anchor.view(np.int64), "content": digests})

    return docs.select("row_key", "text").mapInPandas(scan, "row_key binary, start bigint, n int, lead int, anchor bigint, content binary")


Solver = Callable[[list[np.ndarray], np.ndarray], list[list[tuple[int, int]]]]
RANGES = "array<struct<first:bigint,last:bigint>>"


def repeated_spans(docs: DataFrame, kind: Kind, k: int, window: int, solve: Solver, widths: tuple[int, ...], shard: int, hot: int) -> DataFrame:
    """(row_key, firsts, lasts): half-open ranges of symbols covered by windows that start in two places or more.

    docs: row_key, text. Ranges may overlap. ``solve`` gets the distinct segments of a shard and their numbers of copies,
    and says which ranges of each are covered by repeated windows."""
    work = Scope()
    with work:
        spans = _spans(docs, kind, k, window, solve, widths, shard, hot)
        gathered = spans.groupBy("row_key").agg(F.collect_set("s").alias("s"))
        found = gathered.select("row_key", F.transform("s", lambda s: s["first"]).alias("firsts"), F.transform("s", lambda s: s["last"]).alias("lasts"))
    out = stashed(found)
    work.close()
    return out


def _spans(docs: DataFrame, kind: Kind, k: int, window: int, solve: Solver, widths: tuple[int, ...], shard: int, hot: int) -> DataFrame:
    """(row_key, s) for every range of every text; reads working tables."""
    segments = stashed(_segments(docs, kind, k, window))
    often = stashed(segments.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    again = stashed(segments.join(often, "anchor"))
    forget(segments, often)
    distinct = stashed(again.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("row_key", "start", "n", "lead")).alias("at")))
    grouped, alone = _grouped(distinct.select("anchor", "content", "copies", "at", F.col("at.n").alias("n")), window)
    bodies = stashed(_cut(docs, grouped, kind, window))
    found = stashed(alone.union(_ranges(bodies, kind, window, solve, widths, shard, hot)))
    own = again.select("row_key", "start", "anchor", "content").join(found, ["anchor", "content"]).select("row_key", "start", F.explode("ranges").alias("r"))
    return own.select("row_key", F.struct((F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.last")).alias("last")).alias("s"))


def _grouped(distinct: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct segments of anchors with several, with ``size``, the symbols of them all; and (anchor, content, ranges) of
    the others, whose copies repeat all of them."""
    length = F.col("n") + (window - 1)
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum(length).alias("size"))
    joined = distinct.join(groups, "anchor")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), length.cast("bigint").alias("last")))
    return joined.where("contents > 1").drop("contents"), joined.where("contents = 1").select("anchor", "content", whole.alias("ranges"))


def _cut(docs: DataFrame, distinct: DataFrame, kind: Kind, window: int) -> DataFrame:
    """The bytes of each distinct segment, taken from the text where it first stands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 64):
                rows = []
                for text, parts in zip(frame["text"].iloc[low : low + 64], frame["pieces"].iloc[low : low + 64], strict=True):
                    body = kind.slicer(kind.plain(encoded(text)))
                    rows += [(p["anchor"], p["content"], p["copies"], p["n"], p["lead"], p["size"], body(p["start"], p["start"] + p["n"] + window - 1)) for p in parts]
                if rows:
                    yield pd.DataFrame(rows, columns=["anchor", "content", "copies", "n", "lead", "size", "body"])

    wanted = distinct.groupBy(F.col("at.row_key").alias("key")).agg(F.collect_list(F.struct("anchor", "content", "copies", "at.start", "n", "at.lead", "size")).alias("pieces"))
    return docs.select("row_key", "text").join(wanted, F.col("row_key") == F.col("key")).select("text", "pieces").mapInPandas(run, BODY)


BODY = "anchor bigint, content binary, copies bigint, n int, lead int, size bigint, body binary"


def _ranges(bodies: DataFrame, kind: Kind, window: int, solve: Solver, widths: tuple[int, ...], shard: int, hot: int) -> DataFrame:
    """(anchor, content, ranges) of distinct segments, by shards; anchors with too much text for one are split first."""

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "content"])
        ranges = solve(kind.read(group["body"].tolist()), group["copies"].to_numpy())
        rows = [(a, c, [{"first": x, "last": y} for x, y in r]) for a, c, r in zip(group["anchor"], group["content"], ranges, strict=True) if r]
        return pd.DataFrame(rows, columns=["anchor", "content", "ranges"])

    fit = bodies.where(F.col("size") <= hot) if widths else bodies
    total = fit.agg(F.sum(F.col("n") + (window - 1))).first()[0] or 0
    shards = max(1, -(-total // shard))
    dealt = fit.select("anchor", "content", "copies", "body", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInPandas(lambda g: decide(g), f"anchor bigint, content binary, ranges {RANGES}")
    large = bodies.where(F.col("size") > hot)
    return found.union(_split(large, kind, window, solve, widths, shard, hot)) if widths and large.limit(1).count() else found


def _split(large: DataFrame, kind: Kind, window: int, solve: Solver, widths: tuple[int, ...], shard: int, hot: int) -> DataFrame:
    """(anchor, content, ranges) of segments whose anchor has too much distinct text for one shard.

    Windows that have the anchor in the same place, give or take ``width`` - 1 symbols, all hold the window - width + 1
    symbols around it. The hash of those is a longer anchor, of shorter segments, that takes the place of the first."""
    width, rest = widths[0], widths[1:]
    columns = ["parent", "parent_content", "shift", "copies", "n", "lead", "anchor", "content", "body"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for anchor, whole, copies, n, lead, body in zip(*(frame[c] for c in ("anchor", "content", "copies", "n", "lead", "body")), strict=True):
                symbols, part = kind.symbols(body), kind.slicer(body)
                offset = lead - np.arange(n)
                begins = np.flatnonzero(np.concatenate(([True], offset[1:] // width != offset[:-1] // width)))
                for i, j in zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True):
                    q = (lead - i) // width
                    shared = symbols[lead - width * q : lead - width * q - width + 1 + window].tobytes()
                    longer = xxhash.xxh3_64_intdigest(shared + int(q).to_bytes(8, "little", signed=True), anchor & _WHOLE)
                    own = part(i, j + window - 1)
                    rows.append((anchor, whole, i, copies, j - i, lead - i, _signed(longer), content(own), own))
            yield pd.DataFrame(rows, columns=columns)

    schema = "parent bigint, parent_content binary, shift bigint, copies bigint, n int, lead int, anchor bigint, content binary, body binary"
    children = stashed(large.mapInPandas(run, schema).dropDuplicates(["parent", "parent_content", "shift"]))
    often = children.groupBy("anchor").agg(F.sum("copies").alias("c")).where("c > 1").select("anchor")
    one = children.join(often, "anchor").groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("body").alias("body"))
    grouped, alone = _grouped(stashed(one), window)
    bodies = stashed(grouped.select(*[c.split()[0] for c in BODY.split(", ")]))
    back = children.select("parent", "parent_content", "shift", "anchor", "content").join(alone.union(_ranges(bodies, kind, window, solve, rest, shard, hot)), ["anchor", "content"])
    shifted = F.transform("ranges", lambda r: F.struct((F.col("shift") + r["first"]).alias("first"), (F.col("shift") + r["last"]).alias("last")))
    return back.groupBy(F.col("parent").alias("anchor"), F.col("parent_content").alias("content")).agg(F.flatten(F.collect_list(shifted)).alias("ranges"))


def merged(firsts, lasts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges with those that overlap or touch joined."""
    if firsts is None or not len(firsts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(firsts, kind="stable")
    first, last = np.asarray(firsts)[order], np.maximum.accumulate(np.asarray(lasts)[order])
    begins = np.concatenate(([True], first[1:] > last[:-1]))
    return first[begins], last[np.concatenate((begins[1:], [True]))]


def byte_symbols(text: str | None) -> np.ndarray:
    """The UTF-8 bytes of a text, as they are."""
    return np.frombuffer(encoded(text), np.uint8)


def as_values(symbols: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit values; words are such values already."""
    return BYTE_VALUE[symbols] if symbols.dtype == np.uint8 else symbols


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte offsets (half-open) of the words between ASCII white space."""
    inside = np.concatenate(([False], ~_IS_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


#: Longest word in bytes that is hashed together with others, eight bytes at a time.
TOGETHER = 256
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def word_symbols(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word between ASCII white space."""
    return word_hashes(raw, *word_bounds(np.frombuffer(raw, np.uint8)))


def word_hashes(raw: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch; each block of eight bytes is mixed into what went before.

    Different words can share one (and such words can be made up): good for finding what may be equal, not for telling."""
    data, length = np.frombuffer(raw, np.uint8), last - first
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(length.astype(U) + _ODD)
    live, at = np.flatnonzero(length <= TOGETHER), 0
    while len(live):
        left = length[live] - at
        out[live] = mix(out[live] * _ODD2 ^ (blocks[first[live] + at] & _KEEP[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(length > TOGETHER).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : last[i]])
    return out


def _slice_words(raw: bytes) -> Callable[[int, int], bytes]:
    first, last = (edges.tolist() for edges in word_bounds(np.frombuffer(raw, np.uint8)))
    return lambda a, b: raw[first[a] : last[b - 1]]


def _read_words(bodies: list[bytes]) -> list[np.ndarray]:
    """Words numbered within a shard: equal numbers are equal words."""
    number: dict[bytes, int] = {}
    return [np.array([number.setdefault(w, len(number)) for w in b.split()], np.int64) for b in bodies]


BYTES = Kind(lambda raw: raw, lambda raw: np.frombuffer(raw, np.uint8), lambda raw: lambda a, b: raw[a:b], lambda bodies: [np.frombuffer(b, np.uint8) for b in bodies])
WORDS = Kind(lambda raw: b" ".join(raw.split()), word_symbols, _slice_words, _read_words)
