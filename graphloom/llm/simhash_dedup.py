"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints of 64 bits link where they differ in at most RADIUS = 4 bits. Every bit i gets a vector m(i) of
RADIUS + 1 bits, each vector used equally often; for every non-zero v, the mask of v keeps the bits with odd m(i)·v.
Any 4 differing bits give 4 linear equations in 5 unknowns, so some non-zero v leaves all of them out: that pair
collides in the table of v. Every mask keeps half of the bits, so a bucket's members can only differ in the other
half. A bucket with too many distinct fingerprints is split by the same construction over its free bits: 32 free
bits, then 16, then 8. After the third level a bucket holds at most 2**8 distinct fingerprints, so groups are bounded
by construction and no pair is lost. Within a bucket only the edges of a spanning forest are sent on, never all pairs.

Copies share a fingerprint and count once. Components are found by alternating minimum-label rounds over distinct
fingerprints, each round written to the shared checkpoint folder.

An empty table has no rows; texts of any length are read whole, in blocks; other columns are not looked at. Null and empty
texts have no shingles and the fingerprint zero, which is linked like any other. Repeated rows are in
one component. Rows with a null id are fingerprinted; a component whose ids are all null has a null component_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NARROW_ROWS, forget, row_key, stashed

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Stands for a missing id; no id is larger.
NO_ID = (1 << 63) - 1
#: Distinct fingerprints of a bucket that are compared in one task; more are split by further masks.
BUCKET = 2_000
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by one space; of the whole sequence if it is shorter."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(first[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(found) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[start : start + BLOCK]).view(np.uint8).reshape(-1, 8)
        for byte in range(8):  # 256 counts a byte say how often each of its bits is set
            votes[8 * byte : 8 * byte + 8] += np.bincount(block[:, byte], minlength=256) @ _BIT_OF
    return int(sum(1 << b for b in np.flatnonzero(2 * votes > len(hashes)).tolist()))


_BIT_OF = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprinted(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Add ``print``: the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts], np.uint64).view(np.int64))

    return df.withColumn("print", prints(F.col(text_col)))


def _links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links inside one bucket."""
    values = prints.view(np.uint64)
    unseen, edges = np.arange(len(values)), []
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            near = np.bitwise_count(values[unseen] ^ values[at]) <= radius
            for other in unseen[near].tolist():
                edges.append((int(prints[at]), int(prints[other])))
                queue.append(other)
            unseen = unseen[~near]
    return edges


def _vectors(bits: int, radius: int) -> list[int]:
    """m(i): all vectors in turn; where bits are fewer than vectors, odd ones, which every mask still halves."""
    return [i % (1 << radius + 1) if bits >> radius + 1 else (2 * i + 1) % (1 << radius + 1) for i in range(bits)]


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """One mask per non-zero vector over the set bits of ``free``."""
    bits = [b for b in range(BITS) if free >> b & 1]
    own = _vectors(len(bits), radius)
    return [sum(1 << b for b, m in zip(bits, own, strict=True) if (m & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _masks_under(path: tuple[int, ...], radius: int) -> np.ndarray:
    """Masks of the next level, over the bits that the masks along ``path`` have left free."""
    free = (1 << BITS) - 1
    for v in path:
        free ^= covering_masks(free, radius)[v]
    return np.array(covering_masks(free, radius), np.uint64)


def split(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """Each row once per mask of its level; rows: print, then the mask and key columns v1, k1, v2, k2 of earlier levels."""
    earlier = [c for i in range(1, level) for c in (f"v{i}", f"k{i}")]
    kinds = ", ".join(["print bigint", *[f"{c} {'int' if c[0] == 'v' else 'bigint'}" for c in [*earlier, f"v{level}", f"k{level}"]]])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part in frame.groupby([f"v{i}" for i in range(1, level)]) if level > 1 else [((), frame)]:
                masks = _masks_under(tuple(map(int, path)), radius)
                values = part["print"].to_numpy().view(np.uint64)
                out = {c: np.tile(part[c].to_numpy(), len(masks)) for c in ["print", *earlier]}
                out[f"v{level}"] = np.repeat(np.arange(len(masks), dtype=np.int32), len(values))
                out[f"k{level}"] = (values[None, :] & masks[:, None]).ravel().view(np.int64)
                yield pd.DataFrame(out)

    return rows.select("print", *earlier).mapInPandas(spread, kinds)


def linked_pairs(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = 3) -> DataFrame:
    """(a, b): edges that join every pair of distinct fingerprints within ``radius`` into one component."""

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def links(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for groups in batches:
            yield pd.Series([[{"a": a, "b": b} for a, b in _links(np.asarray(g, np.int64), radius)] for g in groups])

    edges, rows = None, prints.select("print")
    for level in range(1, levels + 1):
        keys = [c for i in range(1, level + 1) for c in (f"v{i}", f"k{i}")]
        finer = split(rows, level, radius)
        sizes = stashed(finer.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
        fit = sizes if level == levels else sizes.where(F.col("n") <= bucket)
        groups = finer.join(fit, keys).groupBy(*keys).agg(F.collect_list("print").alias("g"))
        found = groups.select(F.explode(links("g")).alias("e")).select("e.a", "e.b")
        edges = found if edges is None else edges.union(found)
        over = sizes.where(F.col("n") > bucket)
        if level == levels or not over.limit(1).count():
            break
        rows = finer.join(over, keys).drop("n")
    return edges.distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(print, component) with the least ``label`` reachable; nodes: print, label.

    Each round gives a node the least label of its neighbours and itself, and then that of the node it points to. Labels
    are broadcast while they are few; a round's table replaces the one before."""
    both = stashed(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = stashed(nodes.join(both.select(F.col("a").alias("print")).distinct(), "print", "left_semi").select("print", F.struct(F.col("label"), F.col("print").alias("at")).alias("best")))
    n = linked.count()
    parts = 1 + n // NARROW_ROWS
    few = F.broadcast if n <= NARROW_ROWS else lambda df: df  # each table below has n rows at most
    while True:
        near = both.join(few(linked), both["b"] == linked["print"]).groupBy("a").agg(F.min("best").alias("near"))
        moved = stashed(linked.join(few(near), linked["print"] == near["a"]).select("print", "best", F.least("best", "near").alias("next")), parts)
        target = moved.select(F.col("print").alias("p"), F.col("next").alias("jump"))
        jumped = stashed(moved.join(few(target), F.col("next.at") == F.col("p")).select("print", F.least("next", "jump").alias("best"), (F.col("best") != F.least("next", "jump")).alias("changed")), parts)
        changed = jumped.where("changed").limit(1).count()
        forget(linked, moved)
        linked = jumped
        if not changed:
            break
    forget(both)
    return nodes.join(linked, "print", "left").select("print", F.coalesce(F.col("best.label"), F.col("label")).alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: id, row_key (of id and text), print, component (least id reachable over links)."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    prints = stashed(fingerprinted(narrow, "text", shingle).select("id", "row_key", "print"))
    nodes = stashed(prints.groupBy("print").agg(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("label")))
    edges = stashed(linked_pairs(nodes.select("print")))
    of = components(nodes, edges)
    return prints.join(of, "print").select("id", "row_key", "print", F.nullif("component", F.lit(NO_ID)).alias("component"), F.col("component").alias("_component"))


def hex_digits(fingerprints: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fingerprints)), 16, "0")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of every near-duplicate component, the one with the least id; columns of ``df``.

    Rows without an id are grouped by equal fingerprints if nothing with an id is linked to them."""
    found = near_duplicates(df, id_col, text_col, shingle)
    alone = F.when(F.col("component").isNull(), F.col("print"))
    first = found.groupBy("_component", alone.alias("_alone")).agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row_key")).alias("row")).select(F.col("row.row_key").alias("key"))
    return of_keys(df, first, id_col, text_col)


def of_keys(df: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each key; keys: key (of id and text)."""
    keyed = df.select(F.struct(*df.columns).alias("row"), row_key(id_col, text_col).alias("key"))
    return keyed.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
