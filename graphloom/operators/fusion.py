"""Entity resolution: validation, name resolution, blocking, clustering and redirection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import apart, compared, length_bound, name_bound, name_parts, name_score, name_shares, name_similarity, sequence_ratio
from graphloom.operators.blocking import candidate_pairs
from graphloom.operators.traversal import connected_components
from graphloom.operators.vectors import alike_within
from graphloom.schema import RESERVED_RELATIONS, allows
from graphloom.session import against_all, materialize, promising, small, spread

ENTITY_THRESHOLD, PREDICATE_THRESHOLD, SEMANTIC_THRESHOLD = 0.88, 0.82, 0.80
FAST_PATH, TYPE_BONUS, CANDIDATES, LOW_CONFIDENCE = 0.92, 0.03, 8, 0.85


def validate_entities(proposals: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds reason: null, missing_name or entity_type_not_in_schema. An empty schema rejects everything here."""
    known = entities.select(F.col("name").alias("entity_type"), F.lit(True).alias("_known")).distinct()
    judged = proposals.join(small(known), "entity_type", "left")
    reason = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("missing_name")).when(F.col("_known").isNull(), F.lit("entity_type_not_in_schema"))
    return judged.withColumn("reason", reason).drop("_known")


def resolve_names(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mentions: seq, chunk_id, name, wanted_types -> node_id: the single candidate, else the one of this chunk, else
    the single one that the constraint allows, else null."""
    found = mentions.join(nodes.select(F.col("name"), F.col("id").alias("_id"), F.col("entity_type").alias("_type"), F.col("source_chunk_ids").alias("_chunks")), "name", "left")
    here = F.array_contains("_chunks", F.col("chunk_id"))
    fits = allows(F.col("wanted_types"), F.col("_type"))
    counted = found.groupBy("seq", "chunk_id", "name").agg(
        F.count("_id").alias("n"), F.min("_id").alias("only"), F.min(F.when(here, F.col("_id"))).alias("local"), F.count_if(fits & F.col("_id").isNotNull()).alias("n_fit"), F.min(F.when(fits, F.col("_id"))).alias("fit")
    )
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("local").isNotNull(), F.col("local")).when(F.col("n_fit") == 1, F.col("fit"))
    return counted.select("seq", "chunk_id", "name", chosen.alias("node_id"))


def validate_relations(proposals: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds reason: relation_type_not_in_schema, endpoint_not_found, source_type_mismatch or target_type_mismatch."""
    types = nodes.groupBy("name").agg(F.min_by("entity_type", "seq").alias("_type"))
    rules = relations.select(F.col("name").alias("relation_type"), F.lit(True).alias("_rule"), F.col("source_types").alias("_s"), F.col("target_types").alias("_t"))
    joined = (
        proposals.join(small(rules), "relation_type", "left")
        .join(types.select(F.col("name").alias("source_name"), F.col("_type").alias("_from")), "source_name", "left")
        .join(types.select(F.col("name").alias("target_name"), F.col("_type").alias("_to")), "target_name", "left")
    )
    reason = (
        F.when(F.col("_rule").isNull(), F.lit("relation_type_not_in_schema"))
        .when(F.col("_from").isNull() | F.col("_to").isNull(), F.lit("endpoint_not_found"))
        .when(~allows(F.col("_s"), F.col("_from")), F.lit("source_type_mismatch"))
        .when(~allows(F.col("_t"), F.col("_to")), F.lit("target_type_mismatch"))
    )
    return joined.withColumn("reason", reason).drop("_rule", "_s", "_t", "_from", "_to")


def rule_correction(entities: DataFrame, relations: DataFrame, types: list[str], relation_types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop rows with missing fields, undeclared types, copies of (name, type), and relations with unknown ends.

    Returns the rows that stay, with all their columns, and in one row how many of either kind went."""
    filled = lambda *cs: F.lit(True) if not cs else (F.trim(F.coalesce(cs[0], F.lit(""))) != "") & filled(*cs[1:])
    good = entities.where(filled("name", "entity_type") & F.col("entity_type").isin(types))
    kept = good.groupBy("name", "entity_type").agg(F.min_by(F.struct(*entities.columns), "seq").alias("_row")).select("_row.*")
    names = kept.select("name").distinct()
    rest = relations.where(filled("source_name", "target_name", "relation_type") & F.col("relation_type").isin(relation_types))
    for end in ("source_name", "target_name"):
        rest = rest.join(names.withColumnRenamed("name", end), end, "left_semi")
    rest = rest.select(*relations.columns)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    counts = n(entities, "e").join(n(kept, "ek")).join(n(relations, "r")).join(n(rest, "rk"))  # one row each
    return kept, rest, counts.select((F.col("e") - F.col("ek")).alias("entities_corrected"), (F.col("r") - F.col("rk")).alias("relations_corrected"))


def apply_corrections(entities: DataFrame, relations: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corrections: kind, action (remove or modify), target_name, new_value. Removing an entity removes its relations;
    a relation goes if its source or its type is named, and takes the new type if its source or its type is to be modified."""
    pick = lambda kind, action: corrections.where((F.col("kind") == kind) & (F.col("action") == action))
    changes = lambda kind, key, new: pick(kind, "modify").groupBy(F.col("target_name").alias(key)).agg(F.min("new_value").alias(new))
    gone = pick("entity", "remove").select(F.col("target_name").alias("name")).distinct()
    left = entities.join(gone, "name", "left_anti").join(changes("entity", "name", "_new"), "name", "left").withColumn("entity_type", F.coalesce("_new", "entity_type"))
    off = pick("relation", "remove").select("target_name").distinct()
    rest = relations
    for end in ("source_name", "target_name"):
        rest = rest.join(gone.withColumnRenamed("name", end), end, "left_anti")
    for end in ("source_name", "relation_type"):
        rest = rest.join(off.withColumnRenamed("target_name", end), end, "left_anti")
    rest = rest.join(changes("relation", "source_name", "_by_source"), "source_name", "left").join(changes("relation", "relation_type", "_by_type"), "relation_type", "left")
    return left.select(*entities.columns), rest.withColumn("relation_type", F.coalesce("_by_source", "_by_type", "relation_type")).select(*relations.columns)


def fuzzy_candidates(queries: DataFrame, nodes: DataFrame, top: int = CANDIDATES, threshold: float = 0.25) -> DataFrame:
    """queries: query_id, query, entity_type. Best ``top`` nodes per query by name similarity, same type +0.03.

    Every query meets every node, as the low threshold asks; queries are a stated set and are broadcast in blocks, equal
    ones once. Names are taken apart once a row, and Python compares only pairs whose bound can be among the best."""
    asked = materialize(queries.select("query", "entity_type").distinct().withColumn("_q", name_parts(F.col("query"))))
    named = materialize(spread(nodes.select("id", "name", F.col("entity_type").alias("_type"))).withColumn("_c", name_parts(F.col("name"))))
    q, c = F.col("_q"), F.col("_c")
    bonus = F.when(F.col("_type") == F.col("entity_type"), TYPE_BONUS).otherwise(0.0)
    grams, words, edits = name_shares(q, c)
    score = lambda rest: name_score(F.col("_least"), rest) + bonus
    of = ["query", "entity_type"]
    # first by lengths and containment, which are cheap, then by all that needs no Python
    met = against_all(asked, named).withColumns({"_least": compared(q, c), "_long": apart(0.30 * length_bound(q["norm"], c["norm"]))})
    likely = promising(met.withColumns({"low": F.col("_least") + bonus, "high": score(F.col("_long") + 0.60)}), of, "id", top, threshold)
    likely = likely.withColumns({"_words": words, "_grams": grams, "_edits": apart(edits)}).withColumn("_base", F.col("_grams") + F.col("_words") + F.col("_edits"))
    likely = promising(likely.withColumns({"low": score(F.col("_base")), "high": score(F.col("_base") + F.col("_long"))}), of, "id", top, threshold)
    # written, or the filter on the score would be moved below the joins, and Python with it
    likely = materialize(likely.select(*of, "id", "name", "_type", "_least", "_grams", "_words", "_edits", q["norm"].alias("_a"), c["norm"].alias("_b")))
    exact = 0.30 * sequence_ratio("_a", "_b") + F.col("_grams") + F.col("_words") + F.col("_edits")
    scored = likely.select(*of, "id", "name", F.round(score(exact), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query", "entity_type").orderBy(F.desc("score"), "id"))
    best = scored.where(F.col("score") >= threshold).withColumn("rank", rank).where(F.col("rank") <= top)
    same = best["query"].eqNullSafe(queries["query"]) & best["entity_type"].eqNullSafe(queries["entity_type"])
    return best.join(queries, same).select("query_id", "id", "name", "score", "rank")


def name_pairs(names: DataFrame, threshold: float = ENTITY_THRESHOLD) -> DataFrame:
    """(entity_type, a, b, score) of distinct names of a type at or above a threshold over 0.75, without loss; a < b."""
    pairs = candidate_pairs(names, names, threshold).where("a < b")
    likely = pairs.where(name_bound(F.col("a"), F.col("b")) >= threshold - 1e-6)
    scored = likely.select("entity_type", "a", "b", F.round(name_similarity(F.col("a"), F.col("b")), 9).alias("score"))
    return scored.where(F.col("score") >= threshold)


def name_clusters(names: DataFrame, threshold: float = ENTITY_THRESHOLD) -> DataFrame:
    """(entity_type, name, cluster): names joined by chains of similar pairs, clusters of two or more."""
    key = lambda c: F.concat_ws("␟", "entity_type", c)
    pairs = name_pairs(names, threshold)
    edges = pairs.select(key("a").alias("source_id"), key("b").alias("target_id"))
    nodes = names.select("entity_type", "name").distinct().withColumn("id", key("name"))
    parts = connected_components(nodes.join(edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct(), "id", "left_semi"), edges)
    return nodes.join(parts, "id").select("entity_type", "name", F.element_at(F.split("component", "␟"), -1).alias("cluster"))


def canonical(clusters: DataFrame, support: DataFrame) -> DataFrame:
    """(entity_type, name, canonical): the member with most support; support: entity_type, name, n."""
    ranked = clusters.join(support, ["entity_type", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("entity_type", "cluster").agg(F.min(F.struct(-F.col("n"), "name")).alias("_b")).select("entity_type", "cluster", F.col("_b.name").alias("canonical"))
    return clusters.join(best, ["entity_type", "cluster"]).select("entity_type", "name", "canonical")


def predicate_frequency(edges: DataFrame) -> DataFrame:
    """How often each relation that is not reserved occurs."""
    return edges.where(~F.col("relation_type").isin(*RESERVED_RELATIONS)).groupBy("relation_type").agg(F.count("*").alias("n"))


def moved(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between merged nodes, loops dropped; mapping: id, into."""
    for end in ("source_id", "target_id"):
        edges = edges.join(mapping.select(F.col("id").alias(end), F.col("into").alias("_into")), end, "left").withColumn(end, F.coalesce("_into", end)).drop("_into")
    return edges.where("source_id <> target_id")


def redirect(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move edges to merged nodes and keep the first of equal ones, with all its columns and its id; mapping: id, into."""
    first = moved(edges, mapping).groupBy("source_id", "target_id", "relation_type").agg(F.min_by(F.struct(*edges.columns), "seq").alias("_row"))
    return first.select("_row.*")


def vector_pairs(rows: DataFrame, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """(group, a, b, score) of vectors of a group with cosine at or above the threshold, exactly, by blocks (``vectors``).

    Vectors that are null, empty or zero, or hold a null, have no direction and no pairs."""
    scored = alike_within(rows, threshold - 1e-6).withColumn("score", F.round("score", 6))
    return scored.where(F.col("score") >= threshold)
