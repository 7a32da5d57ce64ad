"""Fusion: clusters become one node each, edges follow, predicates are rewritten and what breaks the schema is mended.

Nodes: id, name, entity_type, properties (map), source_chunk_ids, evidence_quotes, confidence, seq. A judge is a table;
without one the deterministic rules below decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import fusion, graph
from graphloom.operators.governance import confidence_one, confidence_two, support
from graphloom.operators.traversal import connected_components
from graphloom.schema import DOCUMENT_NODES, edge_id
from graphloom.session import materialize, small

#: Characters of a node's semantic text, and sizes of a semantic cluster.
SEMANTIC_CHARS, CLUSTER = 512, (2, 12)


def semantic_text(name: Column, properties: Column) -> Column:
    """Name and ``key:value`` of properties that are neither private nor empty, by key, cut."""
    shown = F.map_filter(properties, lambda k, v: ~k.startswith("_") & (F.coalesce(v, F.lit("")) != ""))
    parts = F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.substring(F.array_join(F.concat(F.array(name), F.coalesce(parts, F.array().cast("array<string>"))), " | "), 1, SEMANTIC_CHARS)


def canonical_members(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, into, canonical) of each cluster's nodes: the member with most source chunks leads, ties by seq.

    clusters: entity_type, name, cluster. Each member is a node of that type and name, the first where names repeat."""
    first = nodes.groupBy("entity_type", "name").agg(F.min_by(F.struct("id", "source_chunk_ids", "seq"), "seq").alias("n"))
    members = clusters.join(first, ["entity_type", "name"]).select("entity_type", "cluster", "name", "n.*")
    order = Window.partitionBy("entity_type", "cluster").orderBy(F.desc(F.size("source_chunk_ids")), "seq")
    lead = F.first(F.struct("id", "name")).over(order)
    return members.select("id", lead["id"].alias("into"), lead["name"].alias("canonical"))


def merge_nodes(nodes: DataFrame, mapping: DataFrame, aliases: bool = False) -> DataFrame:
    """One node for each ``into``: sources united, quotes merged, its own properties first and missing ones from the others.

    mapping: id, into, canonical. With ``aliases`` the other names are kept under that property."""
    marked = nodes.join(mapping.select("id", "into", F.col("canonical").alias("_name")), "id", "left")
    grouped = marked.withColumn("_into", F.coalesce("into", "id")).withColumn("_own", F.col("id") == F.col("_into"))
    lead = F.col("_own").cast("int") * -1
    kept = [c for c in nodes.columns if c not in ("id", "name", "properties", "source_chunk_ids", "evidence_quotes")]
    rest = grouped.groupBy(F.col("_into").alias("id")).agg(
        *[F.min_by(c, F.struct(lead, "seq")).alias(c) for c in kept],
        F.min_by(F.coalesce("_name", "name"), F.struct(lead, "seq")).alias("name"),
        F.collect_set(F.when(~F.col("_own"), F.col("name"))).alias("_names"),
    )
    # every value once, by key, before anything is gathered: groups grow with distinct values, not with copies
    values = grouped.where(F.col("properties").isNotNull()).select("_into", "_own", "seq", F.explode("properties").alias("k", "v")).where(F.coalesce("v", F.lit("")) != "")
    properties = values.groupBy("_into", "k").agg(F.min_by("v", F.struct(lead, "seq")).alias("v")).groupBy(F.col("_into").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    sources = grouped.select("_into", F.explode("source_chunk_ids").alias("c")).groupBy(F.col("_into").alias("id")).agg(F.array_sort(F.collect_set("c")).alias("source_chunk_ids"))
    quotes = graph.first_quotes(grouped.withColumn("seq", F.when(F.col("_own"), F.lit(-1).cast("bigint")).otherwise(F.col("seq"))), ["_into"]).withColumnRenamed("_into", "id")
    merged = rest.join(properties, "id", "left").join(sources, "id", "left").join(quotes, "id", "left")
    none = F.array().cast("array<string>")
    props = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    names = F.array_sort(F.filter("_names", lambda n: n != F.col("name")))
    if aliases:
        props = F.when(F.size(names) > 0, F.map_concat(F.map_filter(props, lambda k, v: k != "aliases"), F.create_map(F.lit("aliases"), F.array_join(names, "|")))).otherwise(props)
    return merged.withColumns({"properties": props, "source_chunk_ids": F.coalesce("source_chunk_ids", none), "evidence_quotes": F.coalesce("evidence_quotes", graph.no_quotes())}).select(*nodes.columns)


def redirect_united(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move edges, drop loops, derive ids again and unite the sources of edges that fall together."""
    moved = fusion.moved(edges, mapping).withColumn("id", edge_id("source_id", "relation_type", "target_id"))
    kept = [c for c in edges.columns if c not in ("id", "source_chunk_ids")]
    one = moved.groupBy("id").agg(*[F.min_by(c, "seq").alias(c) for c in kept])
    sources = moved.select("id", F.explode("source_chunk_ids").alias("c")).groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("source_chunk_ids"))
    return one.join(sources, "id", "left").withColumn("source_chunk_ids", F.coalesce("source_chunk_ids", F.array().cast("array<string>"))).select(*edges.columns)


def cluster_entities(nodes: DataFrame, edges: DataFrame, threshold: float = fusion.ENTITY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Names alike within a type become one node; edges keep their ids, the first of equal ones stays."""
    names = nodes.where(~F.col("entity_type").isin(*DOCUMENT_NODES)).select("entity_type", "name").distinct()
    mapping = canonical_members(fusion.name_clusters(names, threshold), nodes)
    return merge_nodes(nodes, mapping), fusion.redirect(edges, mapping)


def predicate_clusters(edges: DataFrame, threshold: float = fusion.PREDICATE_THRESHOLD) -> DataFrame:
    """(entity_type, name, canonical) of predicates that are alike. Edges are read once, to count their predicates."""
    counted = materialize(fusion.predicate_frequency(edges).select(F.lit("relation").alias("entity_type"), F.col("relation_type").alias("name"), "n"))
    return fusion.canonical(fusion.name_clusters(counted.select("entity_type", "name"), threshold), counted)


def predicate_mapping(edges: DataFrame, threshold: float = fusion.PREDICATE_THRESHOLD) -> DataFrame:
    """(relation_type, canonical) of predicates that are another's wording; the most frequent one leads."""
    return predicate_clusters(edges, threshold).where("name <> canonical").select(F.col("name").alias("relation_type"), "canonical")


def rewrite_predicates(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with their predicate's canonical form; ids stay and nothing is merged. mapping: relation_type, canonical."""
    return edges.join(small(mapping), "relation_type", "left").withColumn("relation_type", F.coalesce("canonical", "relation_type")).select(*edges.columns)


def semantic_clusters(vectors: DataFrame, threshold: float = fusion.SEMANTIC_THRESHOLD) -> DataFrame:
    """(group, id, cluster): vectors joined by chains of pairs at the threshold, clusters of 2 to 12; vectors: group, id, embedding."""
    pairs = fusion.vector_pairs(vectors, threshold)
    key = lambda c: F.concat_ws("␟", "group", F.col(c).cast("string"))
    edges = pairs.select(key("a").alias("source_id"), key("b").alias("target_id"))
    members = pairs.select("group", F.col("a").alias("n")).union(pairs.select("group", "b")).distinct().withColumn("id", key("n"))
    found = members.join(connected_components(members, edges), "id").select("group", F.col("n").alias("id"), F.col("component").alias("cluster"))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("_n")).where(F.col("_n").between(*CLUSTER))
    return found.join(sizes, "cluster").select("group", "id", "cluster")


def merge_groups(nodes: DataFrame, edges: DataFrame, groups: DataFrame, inductive: list[str], rule: str = "two") -> tuple[DataFrame, DataFrame]:
    """Merge a judge's groups (id, into, canonical) of induced knowledge and set confidences by support.

    Rule ``one`` is the run's own (aliases kept, edges united), ``two`` the endpoint's."""
    own = rule == "one"
    merged = merge_nodes(nodes, groups, aliases=own)
    n = support(F.array_distinct("source_chunk_ids"))
    value = confidence_one(F.col("confidence"), n) if own else confidence_two(F.col("confidence"), n)
    merged = merged.withColumn("confidence", F.when(F.col("entity_type").isin(*inductive), value).otherwise(F.col("confidence")))
    return merged, redirect_united(edges, groups) if own else fusion.redirect(edges, groups)


def post_correct(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame, entity_fixes: DataFrame, relation_fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mend what the gate rejects. entity_fixes: name, action, new_type; relation_fixes: id, action, new_type.

    Undeclared types are remapped or removed as answered and stay without an answer; edges against a constraint go; edges
    of undeclared relations are remapped if answered so with a declared relation, else they go."""
    judged = graph.judge_nodes(nodes, entities)
    declared = small(entities.select(F.col("name").alias("new_type")).distinct())
    remap = entity_fixes.where("action = 'remap'").join(declared, "new_type", "left_semi").groupBy("name").agg(F.min("new_type").alias("_new"))
    drop = entity_fixes.where("action = 'remove'").select("name").distinct().withColumn("_gone", F.lit(True))
    fixed = judged.join(remap, "name", "left").join(drop, "name", "left")
    bad = F.col("violation").isNotNull()
    gone = bad & F.col("_new").isNull() & F.coalesce("_gone", F.lit(False))
    left = fixed.where(~gone).withColumn("entity_type", F.when(bad, F.coalesce("_new", "entity_type")).otherwise(F.col("entity_type"))).select(*nodes.columns)
    known = small(relations.select(F.col("name").alias("new_type")).distinct())
    answers = relation_fixes.where("action = 'remap'").join(known, "new_type", "left_semi").groupBy("id").agg(F.min("new_type").alias("_new"))
    # only an undeclared relation can need an answer; all other edges are not dealt by id for it
    names = relations.select(F.col("name").alias("relation_type")).distinct()
    asked = edges.join(small(names), "relation_type", "left_anti").join(answers, "id", "left").select(*edges.columns, "_new")
    rest = edges.join(small(names), "relation_type", "left_semi").select(*edges.columns, F.lit(None).cast("string").alias("_new"))
    removed = fixed.where(gone).select("id", F.lit(True).alias("_gone")).distinct()
    ends = judged.where("violation IS NULL").select("id", "entity_type").join(removed, "id", "full")
    judged_edges = graph.judge_edges(ends, asked.union(rest), relations)
    off = F.col("violation") == "relation_type_not_in_schema"
    against = F.col("violation").isin("source_type_mismatch", "target_type_mismatch")
    kept = judged_edges.where(F.coalesce(~against & ~(off & F.col("_new").isNull()), F.lit(True)))
    kept = kept.withColumn("relation_type", F.when(off, F.coalesce("_new", "relation_type")).otherwise(F.col("relation_type")))
    return left, kept.select(*edges.columns)


def fuse(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame, cluster: bool = True, canonicalise: bool = True, correct: bool = True, entity_fixes: DataFrame | None = None, relation_fixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters, predicates, correction, each if asked for; then (nodes, edges, gate report)."""
    spark = nodes.sparkSession
    if cluster:
        nodes, edges = cluster_entities(nodes, edges)
    if canonicalise:
        edges = rewrite_predicates(edges, predicate_mapping(edges))
    if correct:
        none = lambda key: spark.createDataFrame([], f"{key} string, action string, new_type string")
        nodes, edges = post_correct(nodes, edges, entities, relations, none("name") if entity_fixes is None else entity_fixes, none("id") if relation_fixes is None else relation_fixes)
    return nodes, edges, graph.gate_report(*graph.gate(nodes, edges, entities, relations))
