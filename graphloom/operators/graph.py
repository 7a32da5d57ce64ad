"""Property-graph storage operators: upserts, provenance, projection, the publish gate and table changes.

``seq`` is the ingest order and settles every first-wins and last-wins rule, since a DataFrame has no row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import BRIDGE_EDGES, COLD_START, DOCUMENT_NODES, MAX_QUOTES, MENTIONED_IN, QUOTES, RESERVED_ENTITIES, RESERVED_RELATIONS, STRUCTURE_EDGES, allows, edge_id, packed, unpacked
from graphloom.session import BROADCAST_ROWS, small


def no_quotes() -> Column:
    return F.array().cast(QUOTES)


def first_quotes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, evidence_quotes) by ``merge_quotes``: the rows of a key in order of seq, the first of them the stored one.

    Copies go before anything is gathered, and a key sends on MAX_QUOTES quotes of each kind at most."""
    first = rows.groupBy(*keys).agg(F.min("seq").alias("_first"))
    one = rows.select(*keys, "seq", F.posexplode("evidence_quotes").alias("pos", "q"))
    one = one.groupBy(*keys, "q.chunk_id", F.coalesce("q.quote", F.lit("")).alias("quote")).agg(F.min(F.struct("seq", "pos", "q.verified")).alias("at"))
    place = F.row_number().over(Window.partitionBy(*keys, F.col("quote") == "").orderBy("at.seq", "at.pos", "chunk_id", "quote"))
    few = one.withColumn("_n", place).where(F.col("_n") <= MAX_QUOTES)
    listed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at.seq", "at.pos", "chunk_id", "quote", "at.verified"))).alias("_q"))
    kept = F.filter("_q", lambda q: (q["quote"] != "") | (q["seq"] == F.col("_first")))
    quotes = F.transform(F.slice(kept, 1, MAX_QUOTES), lambda q: F.struct(q["chunk_id"].alias("chunk_id"), q["quote"].alias("quote"), q["verified"].alias("verified")))
    return listed.join(first, keys).select(*keys, quotes.cast(QUOTES).alias("evidence_quotes"))


def merge_quotes(stored: Column, incoming: Column) -> Column:
    """Stored quotes, then incoming ones that are neither empty nor known by (chunk, quote); eight at most."""

    def add(kept: Column, q: Column) -> Column:
        seen = F.exists(kept, lambda k: (k["chunk_id"] == q["chunk_id"]) & (k["quote"] == q["quote"]))
        return F.when((F.size(kept) >= MAX_QUOTES) | seen, kept).otherwise(F.concat(kept, F.array(q)))

    real = F.filter(incoming, lambda q: F.coalesce(q["quote"], F.lit("")) != "")
    return F.aggregate(F.concat(stored, real), no_quotes(), add)


def upsert(rows: DataFrame, keys: list[str], copies: str | None = None) -> DataFrame:
    """One row per key: chunk ids united, quotes merged, every other column from the first row; ``copies`` names a count."""
    first = [F.min_by(c, "seq").alias(c) for c in rows.columns if c not in (*keys, "source_chunk_ids", "evidence_quotes", "seq")]
    counted = [F.count("*").alias(copies)] if copies else []
    one = rows.groupBy(*keys).agg(*first, F.min("seq").alias("seq"), *counted)
    sources = rows.select(*keys, F.explode("source_chunk_ids").alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_set("c")).alias("source_chunk_ids"))
    merged = one.join(sources, keys, "left").join(first_quotes(rows, keys), keys, "left")
    return merged.withColumns({"source_chunk_ids": F.coalesce("source_chunk_ids", F.array().cast("array<string>")), "evidence_quotes": F.coalesce("evidence_quotes", no_quotes())})


def upsert_nodes(rows: DataFrame) -> DataFrame:
    return upsert(rows, ["name", "entity_type"])


def upsert_edges(rows: DataFrame, copies: str | None = None) -> DataFrame:
    return upsert(rows, ["id"], copies)


def search(nodes: DataFrame, text: str, n: int = 20) -> DataFrame:
    """The first ``n`` nodes, by name, whose name holds the text in any case."""
    return nodes.where(F.lower("name").contains(text.lower())).orderBy("name", "id").limit(n)


def link_provenance(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Add chunk ids and quotes to the nodes that exist; links: id, chunk_id, quote, verified, seq."""
    rows = links.select("id", "chunk_id", "seq", F.array(F.struct("chunk_id", "quote", "verified")).cast(QUOTES).alias("evidence_quotes"))
    sources = rows.groupBy("id").agg(F.array_sort(F.collect_set("chunk_id")).alias("_chunks"))
    added = sources.join(first_quotes(rows, ["id"]).withColumnRenamed("evidence_quotes", "_quotes"), "id", "left")
    none, empty = F.array().cast("array<string>"), F.array().cast(QUOTES)
    return (
        nodes.join(added, "id", "left")
        .withColumn("source_chunk_ids", F.array_sort(F.array_union("source_chunk_ids", F.coalesce("_chunks", none))))
        .withColumn("evidence_quotes", merge_quotes(F.col("evidence_quotes"), F.coalesce("_quotes", empty)))
        .drop("_chunks", "_quotes")
    )


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace: the last row of each key."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, "seq").alias(c) for c in rows.columns if c not in (*keys, "seq")], F.max("seq").alias("seq"))


def projection(nodes: DataFrame, edges: DataFrame, documents: bool = False, bridges: bool = False, simple: bool = False) -> tuple[DataFrame, DataFrame]:
    """Knowledge layer by default; with the document layer, or bridge edges and the nodes that they need."""
    kept = nodes if documents or bridges else nodes.where(~F.col("entity_type").isin(*DOCUMENT_NODES))
    hidden = ([] if documents else list(STRUCTURE_EDGES)) + ([] if bridges else list(BRIDGE_EDGES))
    shown = edges.where(~F.col("relation_type").isin(*hidden)) if hidden else edges
    shown = with_both_ends(shown, kept)
    return kept, last_parallel(shown) if simple else shown


def view(nodes: DataFrame, edges: DataFrame, hide_documents: bool = True, hide_co_occurrence: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the graph page shows: mention edges go with the document layer, co-occurrence on its own."""
    hidden = [*(STRUCTURE_EDGES + (MENTIONED_IN,) if hide_documents else ()), *([BRIDGE_EDGES[1]] if hide_co_occurrence else [])]
    kept = nodes.where(~F.col("entity_type").isin(*DOCUMENT_NODES)) if hide_documents else nodes
    return kept, with_both_ends(edges.where(~F.col("relation_type").isin(*hidden)) if hidden else edges, kept)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def last_parallel(edges: DataFrame) -> DataFrame:
    """A simple digraph: of all edges from one node to another the last one is left. Ids are packed while edges are dealt."""
    short = edges.select(packed("source_id").alias("_s"), packed("target_id").alias("_t"), "relation_type", "seq")
    last = short.groupBy("_s", "_t").agg(F.max_by("relation_type", "seq").alias("relation_type"), F.max("seq").alias("seq"))
    return last.select(unpacked("_s").alias("source_id"), unpacked("_t").alias("target_id"), "relation_type", "seq")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete nodes by id and the edges at either end of them."""
    left = nodes.join(gone.select("id"), "id", "left_anti")
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return left, edges


def has_verified(quotes: Column) -> Column:
    """Any quote that is verified or was never checked."""
    return F.exists(quotes, lambda q: F.coalesce(q["verified"], F.lit(True)))


def judge_nodes(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes with ``violation``: null for declared and reserved types, and for all if nothing is declared."""
    if not entities.limit(1).count():
        return nodes.withColumn("violation", F.lit(None).cast("string"))
    known = small(entities.select(F.col("name").alias("entity_type"), F.lit(True).alias("_known")).distinct())
    allowed = F.coalesce("_known", F.lit(False)) | F.col("entity_type").isin(*RESERVED_ENTITIES)
    return nodes.join(known, "entity_type", "left").withColumn("violation", F.when(~allowed, F.lit("entity_type_not_in_schema"))).drop("_known")


def gate(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame, require_evidence: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with ``violation``: null, or the first rule that fails.

    A copy of an edge counts as a duplicate even if the first copy fails the evidence rule."""
    judged = judge_nodes(nodes, entities)
    return judged, judge_edges(judged.where("violation IS NULL").select("id", "entity_type"), edges, relations, require_evidence)


def judge_edges(valid: DataFrame, edges: DataFrame, relations: DataFrame, require_evidence: bool = False) -> DataFrame:
    """Edges with ``violation``; valid: id, entity_type, and ``_gone`` if edges of nodes that go are to be dropped.

    What the evidence rule asks is settled before edges meet nodes, so their quotes are shuffled only where a caller wants
    them. Sources come last: copies of an edge are then where its source is. In shuffles ids are packed, and an edge's own
    id is left out where it follows from its ends and relation."""
    columns = [c for c in edges.columns if c != "_lack"]
    if require_evidence and "_lack" not in edges.columns:
        edges = lacking(edges)
    own = F.coalesce(F.col("id") == edge_id("source_id", "relation_type", "target_id"), F.lit(False)) if "id" in columns else F.lit(True)
    short = {"_s": packed("source_id"), "_t": packed("target_id")} | ({"_own": own, "_id": F.when(~own, F.col("id"))} if "id" in columns else {})
    edges = edges.withColumns(short).drop("source_id", "target_id", "id")
    more = [c for c in ("_gone",) if c in valid.columns]
    end = lambda c, kind: valid.select(packed("id").alias(c), F.col("entity_type").alias(kind), *[F.col(g).alias(f"{g}{kind}") for g in more])
    ends = edges.join(end("_t", "_to"), "_t", "left").join(end("_s", "_from"), "_s", "left")
    free = relations.limit(1).count() == 0
    rules = relations.select(F.col("name").alias("relation_type"), F.lit(True).alias("_rule"), "source_types", "target_types")
    ends = ends.join(small(rules), "relation_type", "left")
    exempt = F.col("relation_type").isin(*RESERVED_RELATIONS) | F.lit(free)
    first = (
        F.when(F.col("_from").isNull() | F.col("_to").isNull(), F.lit("dangling_edge"))
        .when(~exempt & F.col("_rule").isNull(), F.lit("relation_type_not_in_schema"))
        .when(~exempt & ~allows(F.col("source_types"), F.col("_from")), F.lit("source_type_mismatch"))
        .when(~exempt & ~allows(F.col("target_types"), F.col("_to")), F.lit("target_type_mismatch"))
    )
    ranked = ends.withColumn("violation", first)
    same = Window.partitionBy("_s", "_t", "relation_type", F.col("violation").isNull()).orderBy("seq")
    ranked = ranked.withColumn("violation", F.coalesce("violation", F.when(F.row_number().over(same) > 1, F.lit("duplicate_edge"))))
    if require_evidence:
        ranked = ranked.withColumn("violation", F.coalesce("violation", "_lack"))
    if more:
        ranked = ranked.where(~F.coalesce("_gone_from", F.lit(False)) & ~F.coalesce("_gone_to", F.lit(False)))
    whole = ranked.withColumns({"source_id": unpacked("_s"), "target_id": unpacked("_t")})
    if "id" in columns:
        whole = whole.withColumn("id", F.when(F.col("_own"), edge_id("source_id", "relation_type", "target_id")).otherwise(F.col("_id")))
    return whole.select(*columns, "violation")


def lacking(edges: DataFrame) -> DataFrame:
    """Adds ``_lack``: what the evidence rule has against an edge by itself, or null."""
    none = F.size("evidence_quotes") == 0
    lack = F.when(~none & ~has_verified(F.col("evidence_quotes")), F.lit("unverified_evidence")).when(none & (F.size("source_chunk_ids") == 0), F.lit("missing_evidence"))
    return edges.withColumn("_lack", F.when(~F.col("relation_type").isin(*RESERVED_RELATIONS), lack))


def gate_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, violation, n): counts of valid ('ok') and rejected rows."""
    count = lambda df, kind: df.groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "violation", "n")
    return count(nodes, "node").union(count(edges, "edge"))


def publish(nodes: DataFrame, edges: DataFrame, rules: tuple[DataFrame, DataFrame] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The rows of a new published version: those that pass the gate, or with the gate off all nodes and whole edges."""
    if rules is None:
        return nodes, with_both_ends(edges, nodes)
    good = [df.where("violation IS NULL").drop("violation") for df in gate(nodes, edges, *rules, **options)]
    return good[0], good[1]


def import_graph(nodes: DataFrame, edges: DataFrame, existing: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cold start from named rows: (nodes, edges, stats). Nodes: name, entity_type, properties (JSON), seq; edges by name.

    Properties are last-wins; an edge's end is the last node of that name; edges with a missing end or a copy are skipped.
    Undeclared types are counted, if a schema is given, and imported all the same."""
    from graphloom.schema import node_id

    merged = latest(nodes.withColumn("id", node_id("entity_type", "name")), ["id"]).withColumn("source_chunk_ids", F.array(F.lit(COLD_START)))
    known = existing.select("id").withColumn("_old", F.lit(True))
    named = merged.groupBy("name").agg(F.max_by("id", "seq").alias("id"))
    ends = edges.join(named.select(F.col("name").alias("source_name"), F.col("id").alias("source_id")), "source_name", "left").join(named.select(F.col("name").alias("target_name"), F.col("id").alias("target_id")), "target_name", "left")
    whole = ends.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    unique = whole.withColumn("id", edge_id("source_id", "relation_type", "target_id")).groupBy("id").agg(*[F.min_by(c, "seq").alias(c) for c in ("source_id", "target_id", "relation_type")])
    off = lambda rows, column, declared: F.lit(0).cast("bigint") if declared is None else F.count_if(~F.col(column).isin([r["name"] for r in declared.select("name").distinct().limit(BROADCAST_ROWS).collect()]))  # noqa: E731  a schema
    stats = (
        merged.join(known, "id", "left").agg(F.count_if(F.col("_old").isNull()).alias("nodes_created"), F.count_if("_old").alias("nodes_merged"), off(merged, "entity_type", entities).alias("undeclared_nodes"))
        .join(ends.agg(F.count("*").alias("edges_seen")))  # one row each
        .join(unique.agg(F.count("*").alias("edges_created"), off(unique, "relation_type", relations).alias("undeclared_edges")))
        .select("nodes_created", "nodes_merged", "undeclared_nodes", "edges_created", "undeclared_edges", (F.col("edges_seen") - F.col("edges_created")).alias("edges_skipped"))
    )
    return merged, unique, stats


def hierarchy_graph(rows: DataFrame, levels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (name, entity_type) of non-empty cells and edges between non-empty neighbours."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("entity_type"), F.col(c).cast("string").alias("name")) for i, c in enumerate(levels)])
    filled = lambda x: F.coalesce(F.trim(x["name"]) != "", F.lit(False))
    nodes = rows.select(F.explode(F.filter(cells, filled)).alias("c")).select("c.name", "c.entity_type").distinct()
    pairs = F.filter(F.zip_with(F.slice(cells, 1, len(levels) - 1), F.slice(cells, 2, len(levels) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: filled(p["a"]) & filled(p["b"]))
    edges = rows.select(F.explode(pairs).alias("p")).select(F.col("p.a.name").alias("source_name"), F.col("p.b.name").alias("target_name"), F.concat("p.a.entity_type", F.lit("-"), "p.b.entity_type").alias("relation_type")).distinct()
    return nodes, edges


def structure_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bridge edges before and after a backfill, in one row."""
    bridge = F.count_if(F.col("relation_type").isin(*BRIDGE_EDGES))
    return before.agg(bridge.alias("bridge_edges_before")).join(after.agg(bridge.alias("bridge_edges_after"), F.count("*").alias("edges_total")))  # one row each
