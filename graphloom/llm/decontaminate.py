"""Benchmark decontamination by winnowing.

Training texts and benchmark items are cut into words. Every window of GUARANTEE - GRAM + 1 consecutive gram hashes
gives its smallest hash as a fingerprint, so a span of GUARANTEE shared words always shares a fingerprint. Document and
item fingerprints are joined, and each document that meets an item is extended to all places where a whole window of an
item's words stands in it; the comparison is on the words themselves, so hash collisions can only cost time. Items
shorter than GUARANTEE words are one window: they are met by the hash of their whole word sequence among the document's
runs of that many words (at most GUARANTEE - 1 lengths).

Null texts and empty texts have no words; items without words match nothing; repeated items count once by id; items
with a null id mark words but are not listed. Rows of documents that repeat each get their own equal result. Texts of
any length are whole; an empty table of either kind marks nothing. Other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NON_WORD, covered, gram_hashes, lower_ascii, narrow, paired, positions, row_key, small, words

GUARANTEE, GRAM = 10, 5


def item_words(text: Column) -> Column:
    return words(lower_ascii(text), NON_WORD)


def fingerprints(tokens: Column) -> Column:
    """Distinct minima over all windows of GUARANTEE - GRAM + 1 = 6 gram hashes, by doubling: 2, 4, then 4 and 4 that overlap."""
    lower = lambda a, b: F.least(a, b)
    minima = paired(paired(paired(gram_hashes(tokens, GRAM), 1, lower), 2, lower), 2, lower)
    return F.when(F.size(tokens) >= GUARANTEE, F.array_distinct(minima)).otherwise(F.array().cast("array<bigint>"))


def lengths(items: DataFrame) -> list[int]:
    """How many words the items' windows have: at most GUARANTEE different numbers."""
    return sorted(r["k"] for r in items.select("k").distinct().collect())


def _marks(tokens: Column, k: int) -> Column:
    """What a text with a window of k words shares with the item: a fingerprint, or the hash of a short item's words."""
    if k == GUARANTEE:
        return fingerprints(tokens)
    return F.array_distinct(F.transform(gram_hashes(tokens, k), lambda h: F.xxhash64(F.lit(k), h)))


def windows(tokens: Column, k: int) -> Column:
    """All windows of k words, as texts, in order."""
    return F.transform(positions(1, F.size(tokens) - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))


def met_documents(docs: DataFrame, items: DataFrame, ks: list[int]) -> DataFrame:
    """(row_key) of the documents that share a fingerprint, or a short item's whole word sequence, with an item."""
    prints = items.select(F.explode(reduce(lambda rest, k: F.when(F.col("k") == k, _marks(F.col("words_i"), k)).otherwise(rest), ks, F.array().cast("array<bigint>"))).alias("print")).distinct()
    asked = docs.select("row_key", F.explode(F.concat(*[_marks(F.col("tokens"), k) for k in ks])).alias("print"))
    return asked.join(narrow(prints), "print", "left_semi").select("row_key").distinct()


def contaminated_places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row_key, first, last, item_id) for every window of an item that stands in a document, as half-open word spans.

    docs: row_key, tokens; items: item_id, text. Windows are compared as texts, by a join on them: only documents that
    fingerprints lead to are looked at, and of those only positions and windows are moved, never a text's words."""
    items = items.select("item_id", item_words(F.col("text")).alias("words_i")).where(F.size("words_i") > 0).withColumn("k", F.least(F.size("words_i"), F.lit(GUARANTEE)))
    ks = lengths(items)
    if not ks:
        return docs.select("row_key", *[F.lit(0).alias(c) for c in ("first", "last")], F.lit(None).alias("item_id")).limit(0)
    held = reduce(lambda rest, k: F.when(F.col("k") == k, windows(F.col("words_i"), k)).otherwise(rest), ks, F.array().cast("array<string>"))
    wanted = items.select("item_id", "k", F.explode(held).alias("window")).distinct()
    met = docs.join(narrow(met_documents(docs, items, ks)), "row_key", "left_semi")
    found = [met.select("row_key", F.lit(k).alias("k"), F.posexplode(windows(F.col("tokens"), k)).alias("first", "window")) for k in ks]
    hits = reduce(DataFrame.union, found).join(small(wanted), ["k", "window"])
    return hits.select("row_key", "first", (F.col("first") + F.col("k")).alias("last"), "item_id")


def contaminated_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row_key, spans, item_ids) of the documents that hold a window, gathered by text; neither outgrows it."""
    spans, ids = F.collect_set(F.struct("first", "last")), F.collect_set(F.col("item_id").cast("string"))
    return contaminated_places(docs, items).groupBy("row_key").agg(F.array_sort(spans).alias("spans"), F.array_sort(ids).alias("item_ids"))


def decontamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, words inside shared windows, and the items they come from."""
    cut = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), item_words(F.col(text_col)).alias("tokens"))
    hits = contaminated_spans(cut.select("row_key", "tokens"), items)
    whole = cut.select("id", "row_key", F.size("tokens").cast("bigint").alias("n_words")).join(hits, "row_key", "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("bigint"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return whole.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no window of any item, with the columns of ``docs``."""
    cut = docs.select(row_key(id_col, text_col).alias("row_key"), item_words(F.col(text_col)).alias("tokens"))
    hits = contaminated_places(cut, items).select("row_key").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col, text_col).alias("row_key"))
    return keyed.join(narrow(hits), "row_key", "left_anti").select("row.*")
