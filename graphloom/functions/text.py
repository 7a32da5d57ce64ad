"""Scalar text functions as column expressions."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NGRAM, EDIT_CHARS, CONTENT_CHARS = 2, 64, 600


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate once, use many times inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(value: Column) -> Column:
    """``value``, in a projection of its own: one generated method for it and its neighbours passes what the JVM compiles."""
    return bind(value, lambda x: x)


def clean(text: Column) -> Column:
    """At most one blank line in a row, every line stripped, ends stripped, in that order."""
    lines = F.split(F.regexp_replace(text, "\n{3,}", "\n\n"), "\n")
    return F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), "\n"), r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def keyword_tokens(text: Column) -> Column:
    """Distinct runs of [a-z0-9] or CJK of the normalised text; CJK runs of four or fewer are split into characters."""
    runs = F.regexp_extract_all(normalize(text), F.lit(r"([a-z0-9]+|[一-鿿]+)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[一-鿿]{1,4}$"), F.filter(F.split(r, ""), lambda c: c != "")).otherwise(F.array(r)))))


def ngrams(text: Column, n: int = NGRAM) -> Column:
    """Distinct character n-grams of the normalised text; shorter texts are their own n-gram, empty ones have none."""

    def cut(t: Column) -> Column:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (n - 1))), lambda i: t.substr(i, F.lit(n))))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(grams)

    return bind(normalize(text), cut)


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer, over the first 64 characters; two empty strings are equal."""
    x, y = F.substring(a, 1, EDIT_CHARS), F.substring(b, 1, EDIT_CHARS)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; the order of arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """The most that difflib's ratio can be, from the characters that both texts have."""
    counts = [[Counter(x or "") for x in side] for side in (a, b)]
    totals = [len(x or "") + len(y or "") for x, y in zip(a, b, strict=True)]
    return pd.Series([2.0 * sum((x & y).values()) / n if n else 1.0 for x, y, n in zip(*counts, totals, strict=True)], dtype="float64")


def length_bound(a: Column, b: Column) -> Column:
    """The same from lengths alone: a sequence can match the shorter text's characters."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def name_parts(text: Column) -> Column:
    """What similarities of a name are made of: computed once a row, where a search pairs rows."""
    return F.struct(normalize(text).alias("norm"), ngrams(text).alias("grams"), keyword_tokens(text).alias("words"))


def chunk_parts(content: Column) -> Column:
    """The same of a chunk, of which the first characters are compared."""
    c = F.substring(normalize(content), 1, CONTENT_CHARS)
    return F.struct(c.alias("norm"), ngrams(c).alias("grams"))


def _set_jaccard(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats, whose union needs no array."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def name_shares(query: Column, candidate: Column) -> tuple[Column, Column, Column]:
    """What ``name_similarity`` of two ``name_parts`` has from their bigrams, words and edits."""
    return 0.25 * _set_jaccard(query["grams"], candidate["grams"]), 0.20 * _set_jaccard(query["words"], candidate["words"]), 0.15 * edit_similarity(query["norm"], candidate["norm"])


def inside(query: Column, candidate: Column) -> Column:
    """Whether one of two ``name_parts`` stands in the other."""
    q, c = query["norm"], candidate["norm"]
    return (F.length(q) >= 2) & (c.contains(q) | q.contains(c)) & (F.length(c) > 0)


def compared(query: Column, candidate: Column) -> Column:
    """-1 where a name is empty, 1 where they are equal, 0.88 where one contains the other, else 0; null for a null name."""
    q, c = query["norm"], candidate["norm"]
    found = F.when((F.length(q) == 0) | (F.length(c) == 0), F.lit(-1.0)).when(q == c, F.lit(1.0)).when(inside(query, candidate), F.lit(0.88)).otherwise(F.lit(0.0))
    return F.when(q.isNotNull() & c.isNotNull(), found)


def name_score(least: Column, rest: Column) -> Column:
    """Similarity from ``compared`` and the weighted sum of the parts, or a bound of that."""
    return F.when(least < 0, F.lit(0.0)).when(least == 1, F.lit(1.0)).otherwise(F.greatest(rest, least))


def _name_similarity(query: Column, candidate: Column, sequence: Callable[[Column, Column], Column]) -> Column:
    q, c = name_parts(query), name_parts(candidate)
    grams, words, edits = name_shares(q, c)
    return name_score(compared(q, c), 0.30 * sequence(q["norm"], c["norm"]) + grams + words + edits)


def name_similarity(query: Column, candidate: Column) -> Column:
    """Weighted sequence, n-gram, keyword and edit similarity; 1 if equal, 0.88 at least where one contains the other."""
    return _name_similarity(query, candidate, sequence_ratio)


def name_bound(query: Column, candidate: Column) -> Column:
    """The most that ``name_similarity`` can be, without Python: a sequence can match the shorter name's characters."""
    return _name_similarity(query, candidate, length_bound)


def chunk_base(query: Column, chunk: Column) -> Column:
    """Token hits and n-grams of ``name_parts`` and ``chunk_parts``: what a chunk's similarity has before its sequence ratio."""
    tokens = query["words"]
    hits = F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(F.size(F.filter(tokens, lambda t: chunk["norm"].contains(t))) / F.size(tokens))
    return 0.45 * hits + 0.25 * _set_jaccard(query["grams"], chunk["grams"])


def chunk_score(query: Column, chunk: Column, base: Column, sequence: Column) -> Column:
    """Similarity from its base and a sequence ratio, or from a bound of that."""
    q, c = query["norm"], chunk["norm"]
    return F.when((F.length(q) == 0) | (F.length(c) == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), base + 0.10 * sequence + F.when(c.contains(q), 0.15).otherwise(0.0)))


def chunk_similarity(query: Column, content: Column) -> Column:
    """Token hits, n-grams and sequence ratio; containment adds 0.15; at most 1."""
    q, c = name_parts(query), chunk_parts(content)
    return chunk_score(q, c, chunk_base(q, c), sequence_ratio(q["norm"], c["norm"]))


def literal_score(query: Column, name: Column) -> Column:
    """2 where the name stands in the text, else the share of its bigrams found there; both as ``name_parts``."""
    grams, n = name["grams"], name["norm"]
    return F.when(query["norm"].contains(n) & (F.length(n) > 0), F.lit(2.0)).when(F.size(grams) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(grams, query["grams"])) / F.size(grams))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_dot(a: Column, b: Column) -> Column:
    """Inner product of L2-normalised vectors."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def heading_level(line: Column) -> Column:
    """Level of a heading line: # marks, dotted numbers (six at most), 一、 and 第X章; 0 for other lines."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+", 1)
    numbers = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\s+", 1)
    return (
        F.when(marks != "", F.length(marks))
        .when(numbers != "", F.least(F.lit(6), F.size(F.split(numbers, r"\."))))
        .when(line.rlike(r"^[一二三四五六七八九十]+、"), F.lit(2))
        .when(line.rlike(r"^第[一二三四五六七八九十百]+[章节规回]"), F.lit(1))
        .otherwise(F.lit(0))
    )


def clean_heading(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^#+", ""))


def cache_key(text: Column) -> Column:
    """Key under which a text's embedding is kept."""
    return F.md5(text)


def format_triple(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit("] --("), relation, F.lit(")--> ["), target, F.lit("]"))


def salvage_json(text: Column) -> Column:
    """The first of: the whole text, its fenced block, its outermost braces, that parses as JSON; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull() & (F.trim(t) != ""), t)
    return F.coalesce(valid(text), valid(fenced), valid(braces))


def safe_session(name: Column) -> Column:
    kept = F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_-]", ""), 1, 64)
    return F.when(kept == "", F.lit("default")).otherwise(kept)


def mask_secret(value: Column) -> Column:
    """First and last four characters around stars; short secrets are all stars."""
    n = F.length(value)
    return F.when(n > 8, F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), n - 8), value.substr(n - 3, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))
