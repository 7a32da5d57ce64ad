"""Near-duplicates: SimHash with covering tables, completed by an exact similarity join over five-word shingles.

Texts whose shingle sets have a Jaccard similarity of 0.8 or more link. Shingles are five lower-cased words, as 64-bit
hashes; texts with equal sets are one node. The covering tables of ``simhash_dedup`` propose the sets whose
fingerprints differ in four bits or fewer. Fingerprints of sets at 0.8 often differ in more, so a prefix-filter join finds
the rest: under any one order of all shingles, two sets of n and m shingles at or above 4/5 share one of the first
n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1. The order is that of the hashes, with frequent shingles last; which are
frequent is estimated on every SAMPLE-th text and only decides how large groups get, never what is found.

Only connected components are wanted, so not every pair of a large group of copies is formed. First the proposed pairs,
and every set with two that share a prefix shingle, are compared: the one that has the shingle earliest, which in a group
of near copies has the fewest shingles of its own and so is like most others, and the largest. Then every pair that shares
a prefix shingle and is still in two components is tried: the sets outside a shingle's largest component against all of its
sets. Both sets must have as many shingles from the shared one on as a pair at 4/5 has in common (the first shingle that
a pair shares leaves at least these), so sets with more changes than two copies may have between them never meet. Pairs
must share bytes of their sketches, and are verified on the whole sets.

Null and empty texts have the empty set and are one group. Repeated rows are in one component and one of them stays.
Texts of any length are read whole, an empty table gives no rows, and clashing columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import forget, narrow, row_key, stashed
from graphloom.llm.simhash_dedup import NO_ID, components, fingerprint, linked_pairs, shingle_hashes

SHINGLE = 5
#: One in SAMPLE texts is asked for frequent shingles: those in OFTEN of its sets, the ORDERED most frequent at most.
SAMPLE, OFTEN, ORDERED = 8, 4, 1_000_000
#: Bytes of a set's sketch, those that two sets must share to be compared (at a similarity of 0.8 fewer are shared once in
#: 10**11 pairs or so), and hashes that are sketched at once.
SLOTS, SHARED, BLOCK = 64, 28, 1 << 13
_ODD = np.random.default_rng(5).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, SHINGLE))


def prefix(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of n ascending hashes, those in ``often`` (ascending too) taken last."""
    n = len(hashes)
    size = n - (4 * n + 4) // 5 + 1 if n else 0
    if len(often) and n:
        known = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
        hashes = np.concatenate((hashes[~known], hashes[known]))
    return hashes[:size]


def sketch(hashes: np.ndarray) -> bytes:
    """One byte each of the least of SLOTS rehashings of a set; the empty set has zeros."""
    low = np.full(SLOTS, ~np.uint64(0))
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK]
        low = np.minimum(low, (block[None, :] * _ODD[:, None]).min(axis=1))
    return (low >> np.uint64(40)).astype(np.uint8).tobytes() if len(hashes) else bytes(SLOTS)


def frequent(docs: DataFrame, sample: int = SAMPLE, least: int = OFTEN) -> np.ndarray:
    """Shingles that ``least`` distinct sets of the sampled texts have, ascending; at most ORDERED reach the driver."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text")
    found = some.select(_sets("text").alias("hashes")).withColumn("key", F.xxhash64("hashes")).dropDuplicates(["key"])
    counted = found.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counted.orderBy(F.desc("n"), "h").limit(ORDERED).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _sets(text: str) -> Column:
    @F.pandas_udf("array<bigint>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t).view(np.int64) for t in texts])

    return sets(F.col(text))


def signatures(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """(id, row_key, print, simhash, n, prefix, sketch): hash, fingerprint and size of the shingle set, its prefix and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    @F.pandas_udf("print bigint, simhash bigint, n int, prefix array<bigint>, sketch binary")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            hashes = [shingle_hashes(t, SHINGLE) for t in texts]
            found = [np.unique(h) for h in hashes]
            prints = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in found], np.uint64).view(np.int64)
            simhashes = np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)
            yield pd.DataFrame({"print": prints, "simhash": simhashes, "n": [len(h) for h in found], "prefix": [prefix(h, shared.value).view(np.int64) for h in found], "sketch": [sketch(h) for h in found]})

    return stashed(docs.select("id", "row_key", signature("text").alias("s"))).select("id", "row_key", "s.*")


def _similar(shared: Column) -> Column:
    """Jaccard similarity of 4/5 or more, from the number of shared shingles: s / (na + nb - s) >= 4/5."""
    return 9 * shared >= 4 * (F.col("na") + F.col("nb"))


def close_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): sets whose SimHash fingerprints the covering tables link, as edges of a forest; distinct: print, simhash."""
    least = distinct.groupBy("simhash").agg(F.min("print").alias("a"), F.count("*").alias("m"))
    same = distinct.join(narrow(least.where("m > 1")), "simhash").select("a", F.col("print").alias("b")).where("a <> b")
    first = narrow(least.select("simhash", "a"))
    links = linked_pairs(distinct.select(F.col("simhash").alias("print")).distinct())
    ends = links.join(first.select(F.col("simhash").alias("a"), F.col("a").alias("pa")), "a").join(first.select(F.col("simhash").alias("b"), F.col("a").alias("pb")), "b")
    return same.union(ends.select("pa", "pb"))


def _in_reach(n: str, pos: str, other_n: str, other_pos: str) -> Column:
    """Whether both sets have the 4/9 of all their shingles that a pair at 4/5 shares from a common one's place on."""
    due = 4 * (F.col(n) + F.col(other_n))
    return (9 * (F.col(n) - F.col(pos)) >= due) & (9 * (F.col(other_n) - F.col(other_pos)) >= due)


def first_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): every set with the earliest and the largest that share a prefix shingle; rows: h, pos, print, n, low, high."""
    met = rows.select("print", "n", "pos", F.explode(F.array("low", "high")).alias("l"))
    return met.where((F.col("l.print") != F.col("print")) & _in_reach("n", "pos", "l.n", "l.pos")).select(F.least("print", "l.print").alias("a"), F.greatest("print", "l.print").alias("b")).distinct()


def other_pairs(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that share a prefix shingle in reach of both."""
    placed = rows.select("h", "print", "n", "pos").join(narrow(parts), "print")
    torn = placed.groupBy("h").agg((F.min("component") != F.max("component")).alias("torn")).where("torn").select("h")
    placed = stashed(placed.join(torn, "h"))
    sizes = placed.groupBy("h", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("h").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    marked = stashed(placed.join(main, "h").withColumn("is_main", F.col("component") == F.col("main")).drop("main"))
    side = lambda df, s: df.select("h", F.col("print").alias(f"p{s}"), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"at{s}"), F.col("component").alias(f"c{s}"), F.col("is_main").alias(f"m{s}"))
    met = side(marked.where("NOT is_main"), "x").join(side(marked, "y"), "h").where(_in_reach("nx", "atx", "ny", "aty") & (F.col("cx") != F.col("cy")) & (F.col("my") | (F.col("px") < F.col("py"))))
    return met.select(F.least("px", "py").alias("a"), F.greatest("px", "py").alias("b")).distinct()


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches share enough bytes to be worth a comparison; sketches: print, sketch."""

    @F.pandas_udf("int")
    def shared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two in batches:
            x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, SLOTS) for c in (one, two))
            yield pd.Series((x == y).sum(axis=1), dtype="int32")

    side = lambda s: sketches.select(F.col("print").alias(s), F.col("sketch").alias(f"s{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(shared("sa", "sb") >= SHARED).select("a", "b")


def verified(pairs: DataFrame, narrow_docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar; nodes: print, row_key. Only sets of these pairs are made and moved."""
    asked = pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct()
    wanted = nodes.join(narrow(asked), "print", "left_semi").select(F.col("print"), F.col("row_key").alias("key"))
    texts = narrow_docs.join(narrow(wanted), F.col("row_key") == F.col("key")).dropDuplicates(["print"])
    sets = stashed(texts.select("print", _sets("text").alias("hashes")))
    side = lambda s: sets.select(F.col("print").alias(s), F.col("hashes").alias(f"h{s}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").withColumns({"na": F.size("ha"), "nb": F.size("hb")})
    return met.where(_similar(F.size(F.array_intersect("ha", "hb")))).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: int = OFTEN) -> DataFrame:
    """One row per row of ``df``: id, row_key (of id and text), print, component (least id and a set's hash)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    signed = signatures(docs, frequent(docs, sample, least))
    counted = stashed(signed.groupBy("print").agg(F.count("*").alias("m"), F.struct(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("id"), F.col("print")).alias("label"), F.min("row_key").alias("row_key")))
    copies = narrow(counted.where("m > 1").select("print"))
    # one row a set: most sets stand once, and only those of copies are gathered
    whole = signed.select("print", "n", "prefix")
    sets = whole.join(copies, "print", "left_anti").union(whole.join(copies, "print", "left_semi").groupBy("print").agg(F.first("n"), F.first("prefix")))
    listed = sets.select("print", "n", F.posexplode("prefix").alias("pos", "h"))
    one = F.struct("n", "pos", "print")
    shared = listed.groupBy("h").agg(F.min_by(one, F.struct("pos", "print")).alias("low"), F.max(one).alias("high"), F.count("*").alias("m")).where("m > 1").drop("m")
    rows = stashed(listed.join(stashed(shared), "h"))

    members = stashed(rows.select("print").distinct())
    facts = signed.join(narrow(members), "print", "left_semi").select("print", "simhash", "sketch", "row_key")
    facts = stashed(facts.groupBy("print").agg(F.first("simhash").alias("simhash"), F.first("sketch").alias("sketch"), F.min("row_key").alias("row_key")))
    texts = docs.select("row_key", "text")
    near = stashed(alike(close_pairs(facts.select("print", "simhash")).union(first_pairs(rows)).distinct(), facts))
    edges = stashed(verified(near, texts, facts))
    parts = stashed(components(members.withColumn("label", F.col("print")), edges))
    more = stashed(alike(other_pairs(rows, parts), facts))
    edges = stashed(edges.union(verified(more, texts, facts)))
    of = stashed(components(counted.select("print", "label"), edges))
    forget(rows, members, facts, near, parts, more, edges)
    return signed.select("id", "row_key", "print").join(of, "print").select("id", "row_key", "print", "component")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every near-duplicate component, the one with the least id; columns of ``df``.

    What goes is joined out by key, so texts that stay are not shuffled where few go; repeated rows are gathered."""
    found = near_duplicates(df, id_col, text_col).select("component", F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row_key").alias("row"))
    first = found.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("m")).where("m > 1")
    met = stashed(found.join(first, "component").select(F.col("row.row_key").alias("key"), (F.col("row.row_key") == F.col("first.row_key")).alias("stays")))
    gone = narrow(met.where("NOT stays").select("key").distinct())
    repeated = narrow(met.where("stays").groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"))
    left = df.select(F.struct(*df.columns).alias("row"), row_key(id_col, text_col).alias("key")).join(gone, "key", "left_anti")
    alone, again = left.join(repeated, "key", "left_anti"), left.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return alone.select("row.*").union(again.select("row.*"))
