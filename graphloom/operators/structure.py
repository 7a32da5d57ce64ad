"""Structure and bridge layers: segment and section chains, mention and co-occurrence edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import BRIDGE_EDGES, CO_OCCURRENCE, CO_OCCURS, DOCUMENT, DOCUMENT_NODES, IN_DOCUMENT, IN_SECTION, MENTIONED_IN, NEXT_SECTION, NEXT_SEGMENT, SECTION, SEGMENT, UNCLASSIFIED, edge_id, identity


def _edges(rows: DataFrame, relation: str) -> DataFrame:
    """id, source_id, target_id, relation_type, and what else the rows have."""
    more = [c for c in rows.columns if c not in ("source_id", "target_id")]
    return rows.withColumn("relation_type", F.lit(relation)).withColumn("id", edge_id("source_id", "relation_type", "target_id")).select("id", "source_id", "target_id", "relation_type", *more)


def next_segments(chunks: DataFrame) -> DataFrame:
    """chunks: doc_id, idx, chunk_id -> edges between consecutive chunks of a document."""
    following = F.lead("chunk_id").over(Window.partitionBy("doc_id").orderBy("idx"))
    return _edges(chunks.select(F.col("chunk_id").alias("source_id"), following.alias("target_id")).where("target_id IS NOT NULL"), NEXT_SEGMENT)


def sections(chunks: DataFrame) -> DataFrame:
    """chunks: doc_id, idx, chunk_id, heading_path -> one row per section of the heading paths: id, name, parent, depth."""
    path = F.explode(F.transform(F.sequence(F.lit(1), F.size("heading_path")), lambda n: F.slice("heading_path", 1, n)))
    rows = chunks.where(F.size("heading_path") > 0).select(F.col("doc_id").cast("string").alias("doc"), path.alias("path")).distinct()
    key = lambda p: identity("sec_", "doc", F.concat_ws("␟", p))
    parent = F.when(F.size("path") > 1, key(F.slice("path", 1, F.size("path") - 1)))
    return rows.select("doc", key("path").alias("id"), F.element_at("path", -1).alias("name"), parent.alias("parent"), F.size("path").alias("depth"))


def section_chain(chunks: DataFrame) -> DataFrame:
    """Edges from each leaf section to the next different one; chunks without headings are skipped and reset nothing."""
    titled = chunks.where(F.size("heading_path") > 0).withColumn("section", identity("sec_", F.col("doc_id").cast("string"), F.concat_ws("␟", "heading_path")))
    before = F.lag("section").over(Window.partitionBy("doc_id").orderBy("idx"))
    return _edges(titled.select(before.alias("source_id"), F.col("section").alias("target_id")).where("source_id <> target_id").distinct(), NEXT_SECTION)


def anchors(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, anchor, is_empty): chunks without nodes are their own anchor, others get one of their own."""
    used = nodes.select(F.explode("source_chunk_ids").alias("chunk_id")).distinct().withColumn("_used", F.lit(True))
    return chunks.join(used, "chunk_id", "left").select("chunk_id", "doc_id", F.when(F.col("_used"), F.concat("chunk_id", F.lit("_seg"))).otherwise(F.col("chunk_id")).alias("anchor"), F.col("_used").isNull().alias("is_empty"))


def membership(chunks: DataFrame) -> DataFrame:
    """Edges of chunks into their leaf sections or, without headings, their documents; and of sections into what is above."""
    doc = F.concat(F.lit("doc_"), F.substring(F.col("doc_id").cast("string"), 1, 24))
    whole = _edges(chunks.where("size(heading_path) = 0").select(F.col("chunk_id").alias("source_id"), doc.alias("target_id")), IN_DOCUMENT)
    leaf = identity("sec_", F.col("doc_id").cast("string"), F.concat_ws("␟", "heading_path"))
    inside = _edges(chunks.where(F.size("heading_path") > 0).select(F.col("chunk_id").alias("source_id"), leaf.alias("target_id")), IN_SECTION)
    tree = sections(chunks)
    top = _edges(tree.where("parent IS NULL").select(F.col("id").alias("source_id"), F.concat(F.lit("doc_"), F.substring("doc", 1, 24)).alias("target_id")), IN_DOCUMENT)
    below = _edges(tree.where("parent IS NOT NULL").select(F.col("id").alias("source_id"), F.col("parent").alias("target_id")), IN_SECTION)
    return whole.union(inside).union(top).union(below)


def structure_nodes(chunks: DataFrame) -> DataFrame:
    """Document, section and segment nodes: id, name, entity_type."""
    doc = chunks.select(F.concat(F.lit("doc_"), F.substring(F.col("doc_id").cast("string"), 1, 24)).alias("id"), F.col("doc_id").cast("string").alias("name"), F.lit(DOCUMENT).alias("entity_type")).distinct()
    return doc.union(sections(chunks).select("id", "name", F.lit(SECTION))).union(chunks.select("chunk_id", "chunk_id", F.lit(SEGMENT)))


def mentions(nodes: DataFrame, anchored: DataFrame) -> DataFrame:
    """Edges from each node to the anchors of its chunks."""
    pairs = nodes.select(F.col("id").alias("source_id"), F.explode("source_chunk_ids").alias("chunk_id")).join(anchored.select("chunk_id", F.col("anchor").alias("target_id")), "chunk_id")
    one = pairs.where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))
    return _edges(one.withColumn("confidence", F.lit(1.0)), MENTIONED_IN)


def co_occurrences(nodes: DataFrame, edges: DataFrame, most: int = CO_OCCURRENCE) -> DataFrame:
    """Edges of pairs that share a chunk of 2 to ``most`` nodes and have no edge yet but bridges; confidence 0.3, the first
    chunk is the source.

    Chunks are counted before their nodes are gathered, so none grows beyond ``most``."""
    members = nodes.select("id", F.explode("source_chunk_ids").alias("chunk_id")).distinct()
    fit = members.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("chunk_id")
    gathered = members.join(fit, "chunk_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = gathered.select("chunk_id", F.explode("ids").alias("a"), "ids").select("chunk_id", "a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    first = pairs.groupBy("a", "b").agg(F.min("chunk_id").alias("chunk_id"))
    real = edges.where(~F.col("relation_type").isin(*BRIDGE_EDGES))
    linked = real.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    new = first.join(linked, ["a", "b"], "left_anti")
    return _edges(new.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.array("chunk_id").alias("source_chunk_ids"), F.lit(0.3).alias("confidence")), CO_OCCURS)


def backfill(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structure and bridge layers for an existing draft: (nodes, edges) by id, in which known rows stay as they are.

    Unclassified nodes that are a chunk's own stay its anchor. Running it again changes nothing."""
    own = nodes.where(F.col("entity_type") == UNCLASSIFIED).select(F.col("id").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    anchored = chunks.join(own.withColumn("_own", F.lit(True)), "chunk_id", "left").select(*chunks.columns, F.when(F.col("_own"), F.col("chunk_id")).otherwise(F.concat("chunk_id", F.lit("_seg"))).alias("anchor"))
    doc = F.col("doc_id").cast("string")
    segments = anchored.where("anchor <> chunk_id").select(F.col("anchor").alias("id"), F.concat(F.lit("片段-"), F.substring(doc, 1, 8), F.lit("-"), F.col("idx").cast("string")).alias("name"), F.lit(SEGMENT).alias("entity_type"))
    layer = structure_nodes(chunks).where(F.col("entity_type") != SEGMENT).union(segments)
    as_anchor = anchored.drop("chunk_id").withColumnRenamed("anchor", "chunk_id")
    known = nodes.where(~F.col("entity_type").isin(*DOCUMENT_NODES))
    made = [next_segments(as_anchor), membership(as_anchor), section_chain(chunks), mentions(known, anchored)]
    # co-occurrence counts the nodes of real chunks only
    inside = known.select("id", F.explode("source_chunk_ids").alias("chunk_id")).join(anchored.select("chunk_id"), "chunk_id", "left_semi").select("id", F.array("chunk_id").alias("source_chunk_ids"))
    made.append(co_occurrences(inside, edges))
    columns = ["id", "source_id", "target_id", "relation_type"]
    fresh = made[0].select(*columns)
    for part in made[1:]:
        fresh = fresh.union(part.select(*columns))
    add = lambda old, new, cols: old.select(*cols).union(new.select(*cols).dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").select(*cols))
    return add(nodes, layer, ["id", "name", "entity_type"]), add(edges, fresh, columns)
