"""License scans: an exact containment join between text blocks and license templates.

A block is any run of as many consecutive words as the template has, over line ends, or the whole text where that is
shorter; so words of a statement that are strewn over a long line don't make one. A template matches a block if at least
CONTAINMENT of its distinct words are in the block. Blocks are looked for in pieces of twice the longest template's words,
one such length apart, so every block is inside a piece. The join is the prefix-filter join: template words are ordered by
how many documents of the whole corpus have them, rarest first; a piece with a block that reaches the threshold must hold
one of the first |T| - need + 1 words of the template (prefix filter), must have at least ``need`` words (length filter),
and from the first shared word on both sides must have enough words left (positional filter). What passes is verified on
the word sets of its blocks, so the join is exact. Templates are a fixed table of bounded size; pieces without a prefix
word never leave their row. Texts of any length are whole; other columns may have any name but the three that are added.

Base phrases are found besides as runs of consecutive words. A null text is empty; empty tables give no rows;
repeated rows each get the same result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NON_WORD, let, lower_ascii, positions, words

CONTAINMENT = 0.8

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Statements by which texts name their license, in lower case, and the label of each.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "public-domain"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)


def needed(template_words: int, containment: float) -> int:
    """Least number of shared words; the epsilon keeps exact multiples from rounding up."""
    return max(1, ceil(containment * template_words - 1e-9))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for text, _ in templates for w in text.split()})


def document_frequency(df: DataFrame, text_col: str, vocab: list[str]) -> dict[str, int]:
    """How many documents have each template word; at most one row per template word reaches the driver."""
    found = df.select(F.explode(F.array_intersect(words(lower_ascii(F.col(text_col)), NON_WORD), F.array(*map(F.lit, vocab)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def phrase_places(tokens: Column, phrases=PHRASES) -> Column:
    """(start, label) of every place where a phrase's words stand consecutively."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    def places(phrase: str, label: str, line: Column) -> Column:
        parts = phrase.split()
        starts = F.filter(positions(1, F.size(tokens) - (len(parts) - 1)), lambda i: F.slice(tokens, i, len(parts)) == F.array(*map(F.lit, parts)))
        found = F.transform(starts, lambda i: F.struct((i - 1).cast("bigint").alias("start"), F.lit(label).alias("label")))
        return F.when(line.contains(f" {phrase} "), found).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))

    return let(joined, lambda line: F.concat(*[places(p, label, line) for p, label in phrases.items()]))


def template_matches(df: DataFrame, text_col: str, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Columns of ``df`` with one row per (row, block, template) at or above the containment threshold."""
    spark = df.sparkSession
    vocab = vocabulary(templates)
    often = document_frequency(df, text_col, vocab)
    order = sorted(vocab, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, sets = [], []
    for t, (text, label) in enumerate(templates):
        ranks = sorted({rank[w] for w in text.split()})
        need = needed(len(ranks), containment)
        sets.append((t, label, ranks, need, len(text.split())))
        prefixes += [(r, t, i, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefix_of = spark.createDataFrame(prefixes, "rank int, template int, at_t int, size_t int, need int")
    whole = spark.createDataFrame(sets, "template int, label string, words_t array<int>, need_t int, length int")

    known, first = F.array(*map(F.lit, order)), sorted({r for r, *_ in prefixes})
    least = min(need for *_, need in sets)
    ranked = F.map_from_arrays(known, F.array(*map(F.lit, range(len(order)))))
    longest = max(length for *_, length in sets)
    runs = let(words(lower_ascii(F.col(text_col)), NON_WORD), lambda w: F.transform(positions(0, F.floor((F.size(w) - 1) / longest).cast("int")), lambda j: F.slice(w, j * longest + 1, F.lit(2 * longest))))
    marks = F.array(*[F.lit(order[r]) for r in first])
    blocks = F.transform(runs, lambda x: F.struct(F.array_intersect(x, known).alias("words_b"), x.alias("run")))
    blocks = F.filter(blocks, lambda b: (F.size(b["words_b"]) >= least) & F.arrays_overlap(b["words_b"], marks))
    rows = df.select(*df.columns, F.posexplode(blocks).alias("block", "b")).select(*df.columns, "block", "b.*")
    rows = rows.withColumn("words_b", F.array_sort(F.transform("words_b", lambda w: F.element_at(ranked, w))))
    rows = rows.withColumn("run", F.transform("run", lambda w: F.coalesce(F.try_element_at(ranked, w), F.lit(-1))))
    pairs = rows.select("*", F.posexplode("words_b").alias("at_b", "rank")).join(F.broadcast(prefix_of), "rank")  # as many rows as template words at most
    left = F.least(F.col("size_t") - F.col("at_t"), F.size("words_b") - F.col("at_b"))
    earlier = F.exists(F.slice("words_b", F.lit(1), F.col("at_b")), lambda r: F.array_contains("words_t", r))
    found = pairs.where((F.size("words_b") >= F.col("need")) & (left >= F.col("need"))).join(F.broadcast(whole), "template")  # one row a template
    in_run = lambda i: F.size(F.array_intersect(F.slice("run", i, F.col("length")), "words_t"))
    starts = positions(1, F.greatest(F.lit(1), F.size("run") - F.col("length") + 1))
    whole_block = F.size(F.array_intersect("words_b", "words_t"))
    found = found.where(~earlier & (whole_block >= F.col("need_t")))
    found = found.withColumn("_shared", F.array_max(F.transform(starts, in_run))).where(F.col("_shared") >= F.col("need_t"))
    return found.select(*df.columns, "block", "label", (F.col("_shared") / F.size("words_t")).alias("containment"))


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels of phrases and templates, best containment."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    matched = (
        template_matches(narrow, "text")
        .groupBy("row_key", F.col("id").alias("id_"))
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        .withColumnRenamed("row_key", "row_key_")
    )
    tokens = narrow.withColumn("tokens", words(lower_ascii(F.col("text")), NON_WORD))
    base = tokens.select("id", "row_key", F.size("tokens").cast("bigint").alias("n_words"), phrase_places(F.col("tokens")).alias("places"))
    both = base.join(matched, (base["row_key"] == matched["row_key_"]) & base["id"].eqNullSafe(matched["id_"]), "left")
    starts = F.transform("places", lambda p: p["start"])
    own = F.array_distinct(F.transform("places", lambda p: p["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
