"""Entity resolution of one run: proposals against known nodes, evidence, and nodes for what is left over.

Proposals: chunk_id, name, entity_type, confidence, seq. A judge is a table of decisions (name, match_id, is_same, and if
need be chunk_id and seq); without one every proposal that nothing matched becomes a node of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.blocking import similar_names
from graphloom.operators.fusion import CANDIDATES, FAST_PATH, LOW_CONFIDENCE, TYPE_BONUS, fuzzy_candidates
from graphloom.schema import COLD_START, DOCUMENT_NODES, MAX_QUOTE_CHARS, QUOTES, RESERVED_ENTITIES, RESERVED_RELATIONS, UNCLASSIFIED, node_id
from graphloom.session import against_all, materialize, small

#: Candidates recalled for a name, matches of a query word, confidence of inferred relations and of fallback nodes.
RECALL, MATCHES, INFERRED, FALLBACK = 20, 5, 0.7, 0.5
#: Stands for a time before the first chunk.
BEFORE = -(1 << 62)


def dedup_in_chunk(proposals: DataFrame) -> DataFrame:
    """The first proposal of each (name, type) in a chunk, with ``copies``; proposals without a name go."""
    first = F.min_by(F.struct(*proposals.columns), "seq").alias("_row")
    kept = proposals.where(F.coalesce("name", F.lit("")) != "").groupBy("chunk_id", "name", "entity_type").agg(first, F.count("*").alias("copies"))
    return kept.select("_row.*", "copies")


def exact_hits(proposals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``node_id``: the known node of that name and type, or null."""
    known = nodes.groupBy("name", "entity_type").agg(F.min_by("id", "seq").alias("node_id"))
    return proposals.join(known, ["name", "entity_type"], "left")


def to_disambiguate(pending: DataFrame, low_confidence_only: bool = False, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Proposals that are worth a comparison: all, or only those below the confidence threshold."""
    return pending.where(F.coalesce("confidence", F.lit(1.0)) < threshold) if low_confidence_only else pending


def prefer_type(candidates: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """candidates: query_id, id, score, rank, same_type. Those of the same type if there are any, else all; ``limit`` each."""
    whole = Window.partitionBy("query_id")
    kept = candidates.withColumn("_any", F.bool_or("same_type").over(whole)).where(F.col("same_type") | ~F.col("_any"))
    return kept.withColumn("rank", F.row_number().over(whole.orderBy("rank"))).where(F.col("rank") <= limit).drop("_any")


def recall(pending: DataFrame, nodes: DataFrame, top: int = RECALL, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, id, name, score, rank, same_type) of the known nodes nearest to each proposal, its own type preferred."""
    queries = pending.select(F.col("seq").alias("query_id"), F.col("name").alias("query"), "entity_type")
    found = fuzzy_candidates(queries, nodes, top)
    typed = found.join(nodes.select("id", F.col("entity_type").alias("_type")), "id").join(queries.select("query_id", "entity_type"), "query_id")
    return prefer_type(typed.withColumn("same_type", F.col("_type") == F.col("entity_type")).drop("_type", "entity_type"), limit)


def fast_path(candidates: DataFrame, threshold: float = FAST_PATH) -> DataFrame:
    """(query_id, node_id) where the best candidate has the same type and a score that needs no judge."""
    return candidates.where((F.col("rank") == 1) & F.col("same_type") & (F.col("score") >= threshold)).select("query_id", F.col("id").alias("node_id"))


def merged_candidates(candidates: DataFrame, top: int = RECALL) -> DataFrame:
    """Candidates of a chunk for its judge: chunk_id, id, score. Best score of each node, first seen first, 3 ``top`` at most;
    candidates: chunk_id, query_id, rank, id, score."""
    best = candidates.groupBy("chunk_id", "id").agg(F.max("score").alias("score"), F.min(F.struct("query_id", "rank")).alias("_seen"))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("_seen", "id"))
    return best.withColumn("place", place).where(F.col("place") <= 3 * top).drop("_seen")


def decide(pending: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Adds node_id and is_new: what the judge matched, else a node of the proposal's own name and type."""
    own = node_id("entity_type", "name")
    return judged(pending, decisions).withColumns({"node_id": F.coalesce("match_id", own), "is_new": F.col("match_id").isNull()}).drop("match_id")


def judged(pending: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Adds match_id, null where no decision applies.

    decisions: name, match_id, is_same, and if they have them chunk_id, the chunk they were made for, and seq, their order.
    The first decision of a name (in its chunk) that matches something counts."""
    if decisions is None:
        return pending.withColumn("match_id", F.lit(None).cast("string"))
    keys = [c for c in ("chunk_id", "name") if c in decisions.columns]
    order = "seq" if "seq" in decisions.columns else "match_id"
    matched = decisions.where(F.col("is_same") & F.col("match_id").isNotNull()).groupBy(*keys).agg(F.min_by("match_id", F.struct(order, "match_id")).alias("match_id"))
    return pending.join(matched, keys, "left")


def resolve(proposals: DataFrame, nodes: DataFrame, decisions: DataFrame | None = None, low_confidence_only: bool = False, confidence: float = LOW_CONFIDENCE, fast_score: float = FAST_PATH) -> DataFrame:
    """chunk_id, name, entity_type, seq, node_id, how (known, fast_path, judged or new) of a run's proposals.

    Chunks come in order of their first proposal, and each is compared with all nodes that are known or that chunks
    before it made. A name that is a node already is ``known``. Otherwise the most similar node of its type is taken at
    ``fast_score`` or more (``fast_path``), else what the judge matched (``judged``), else the name becomes a node
    (``new``). With ``low_confidence_only`` a proposal at or above the threshold is not compared and becomes one at once.
    A judge is shown nodes that exist, so its matches are taken as they are.

    Nothing is read in order: a name that was refused once stays refused, since the node it resembles stays. So of each
    name only the first chunk that compares it without a match and the first that does not compare it matter, and when
    it becomes a node follows from the names it resembles (``creation``). Null names go; a null type is one of its own.
    """
    one = dedup_in_chunk(proposals).withColumn("entity_type", F.coalesce("entity_type", F.lit("")))
    chunks = proposals.groupBy("chunk_id").agg(F.min("seq").alias("at"))
    compared = (F.coalesce("confidence", F.lit(1.0)) < confidence) if low_confidence_only else F.lit(True)
    rows = judged(one, decisions).join(chunks, "chunk_id").withColumn("compared", compared).select("chunk_id", "at", "name", "entity_type", "seq", "compared", "match_id")
    rows = materialize(rows)
    known = nodes.withColumn("entity_type", F.coalesce("entity_type", F.lit(""))).groupBy("name", "entity_type").agg(F.min_by("id", "seq").alias("id"))
    names = rows.groupBy("entity_type", "name").agg(F.min(F.when(F.col("compared") & F.col("match_id").isNull(), F.col("at"))).alias("a"), F.min(F.when(~F.col("compared"), F.col("at"))).alias("b"))
    every = names.join(known, ["entity_type", "name"], "full").withColumn("t", F.when(F.col("id").isNotNull(), F.lit(BEFORE)))
    every = materialize(every.withColumn("id", F.coalesce("id", node_id("entity_type", "name"))))
    asked = every.where("t IS NULL").select("entity_type", "name")
    close = materialize(similar_names(asked, every, fast_score - TYPE_BONUS))
    made = creation(every, close)
    near = close.join(made.where("t IS NOT NULL").select("entity_type", F.col("name").alias("b"), "t", "id"), ["entity_type", "b"])
    steps = Window.partitionBy("entity_type", "a").orderBy("t", "id")
    best = near.withColumn("best", F.min(F.struct((-F.col("score")).alias("score"), "id")).over(steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    better = best.withColumn("before", F.lag("best").over(steps)).where(F.col("before").isNull() | (F.col("before") != F.col("best")))
    liked = better.groupBy("entity_type", F.col("a").alias("name")).agg(F.array_sort(F.collect_list(F.struct("t", F.col("best.id").alias("id")))).alias("steps"))
    placed = rows.join(made.select("entity_type", "name", "t", "id"), ["entity_type", "name"]).join(liked, ["entity_type", "name"], "left")
    then = F.filter("steps", lambda s: s["t"] < F.col("at"))
    direct = F.when(F.size(then) > 0, F.get(then, F.size(then) - 1)["id"])
    fast = F.when(F.col("compared"), direct)
    is_known, is_new = F.coalesce(F.col("t") < F.col("at"), F.lit(False)), F.coalesce(F.col("t") == F.col("at"), F.lit(False))
    how = F.when(is_known, "known").when(fast.isNotNull(), "fast_path").when(F.col("match_id").isNotNull() & F.col("compared"), "judged").when(is_new, "new")
    found = placed.withColumns({"how": how, "fast": fast})
    chosen = F.when(F.col("how") == "fast_path", F.col("fast")).when(F.col("how") == "judged", F.col("match_id")).otherwise(F.col("id"))
    return found.select("chunk_id", "name", "entity_type", "seq", chosen.alias("node_id"), "how")


def creation(names: DataFrame, close: DataFrame) -> DataFrame:
    """``names`` with ``t``, the chunk at which each became a node: null for never, BEFORE for known nodes.

    names: entity_type, name, id, t (BEFORE or null), a (first chunk that compares the name without a match) and b (first
    that doesn't compare it). close: entity_type, a, b, the names that ``a`` resembles. A name becomes a node at its b, or at
    its a if that is earlier and no name that it resembles is a node by then.

    By rounds over a table: a name is settled when every name it resembles that could be a node earlier is. The earliest
    open name always can be, so rounds end; there are as many as the longest chain of names that resemble each other, each
    earlier than the next."""
    first = F.least("a", "b")
    settled = F.col("t").isNotNull() | F.col("a").isNull() | F.coalesce(F.col("b") <= F.col("a"), F.lit(False))
    state = names.withColumns({"open": ~settled, "t": F.when(settled, F.coalesce("t", first))})
    edges = close.join(state.where("open").select("entity_type", F.col("name").alias("a"), F.col("a").alias("at")), ["entity_type", "a"])
    earlier = state.select("entity_type", F.col("name").alias("b"), F.coalesce("t", first).alias("first"))
    edges = materialize(edges.join(earlier, ["entity_type", "b"]).where("first < at").select("entity_type", "a", "b", "at"))
    done, open_ = [materialize(state.where("NOT open"))], materialize(state.where("open"))
    settled_names = done[0]
    while open_.limit(1).count():
        now = settled_names.select("entity_type", F.col("name").alias("b"), F.lit(False).alias("waits"), F.col("t").alias("by")).union(open_.select("entity_type", "name", F.lit(True), F.col("b")))
        told = edges.join(now, ["entity_type", "b"])
        blocks = F.coalesce(F.col("by") < F.col("at"), F.lit(False))
        said = told.groupBy("entity_type", F.col("a").alias("name")).agg(F.bool_or(blocks).alias("blocked"), F.bool_or(F.col("waits")).alias("waits"))
        judged_ = materialize(open_.join(said, ["entity_type", "name"], "left"))
        ready = F.coalesce(F.col("blocked"), F.lit(False)) | ~F.coalesce(F.col("waits"), F.lit(False))
        fresh = judged_.where(ready).withColumn("t", F.when(F.coalesce(F.col("blocked"), F.lit(False)), F.col("b")).otherwise(F.col("a"))).select(*names.columns, "open")
        done.append(fresh)
        settled_names = reduce(DataFrame.unionByName, done)
        open_ = judged_.where(~ready).select(*open_.columns)
        edges = materialize(edges.join(open_.select("entity_type", F.col("name").alias("a")), ["entity_type", "a"], "left_semi"))
    return settled_names.drop("open")


def evidence_mode(abstractness: Column) -> Column:
    """Induced knowledge quotes spans, all else is quoted word for word."""
    return F.when(abstractness == "inductive", "span").otherwise("verbatim")


def evidence(chunk_id: Column, quotes: Column, chunk: Column, mode: Column, longest: int = MAX_QUOTE_CHARS) -> Column:
    """Quotes as stored: trimmed, blank ones dropped, cut, and checked against the chunk in verbatim mode only."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    cut = F.transform(F.filter(F.transform(quotes, lambda q: F.regexp_replace(q, r"(?U)^\s+|\s+$", "")), lambda q: q != ""), lambda q: F.substring(q, 1, longest))
    stored = F.transform(cut, lambda q: F.struct(chunk_id.alias("chunk_id"), q.alias("quote"), F.when(mode == "verbatim", bare(F.coalesce(chunk, F.lit(""))).contains(bare(q))).alias("verified")))
    return F.coalesce(stored, F.array()).cast(QUOTES)


def split_lanes(entities: DataFrame) -> DataFrame:
    """Adds lane: inductive, or surface for all other and unknown degrees of abstraction."""
    return entities.withColumn("lane", F.when(F.col("abstractness") == "inductive", "inductive").otherwise("surface"))


def confident(relations: DataFrame, threshold: float = INFERRED) -> DataFrame:
    """Relations inferred across chunks that are kept."""
    return relations.where(F.col("confidence") >= threshold)


def peer_types(relations: DataFrame, fresh: DataFrame) -> DataFrame:
    """(peer, relation): types at the other end of relations that a new type takes part in; fresh: name."""
    ends = lambda near, far: relations.select(F.col("name").alias("relation"), F.explode(near).alias("name"), F.col(far).alias("far")).join(small(fresh.select("name").distinct()), "name", "left_semi").select("relation", F.explode("far").alias("peer"))
    both = ends("source_types", "target_types").union(ends("target_types", "source_types")).distinct()
    return both.join(fresh.select(F.col("name").alias("peer")).distinct(), "peer", "left_anti").select("peer", "relation")


def legacy_messages(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id, problem) of what the publish step used to log: missing ends, undeclared types. An empty schema allows all."""
    ids = nodes.select("id")
    missing = None
    for end in ("source_id", "target_id"):
        rows = edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(F.lit("edge").alias("kind"), "id", F.lit(f"missing {end}").alias("problem"))
        missing = rows if missing is None else missing.union(rows)
    for kind, rows, column, declared, reserved in (("node", nodes, "entity_type", entities, RESERVED_ENTITIES), ("edge", edges, "relation_type", relations, RESERVED_RELATIONS)):
        if declared.limit(1).count():
            off = rows.where(~F.col(column).isin(*reserved)).join(small(declared.select(F.col("name").alias(column)).distinct()), column, "left_anti")
            missing = missing.union(off.select(F.lit(kind), "id", F.lit(f"undeclared {column}")))
    return missing


def fallback_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node for every chunk that no node comes from; chunks: doc_id, idx, chunk_id."""
    used = nodes.select(F.explode("source_chunk_ids").alias("chunk_id")).distinct()
    name = F.concat(F.lit("片段-"), F.substring(F.col("doc_id").cast("string"), 1, 8), F.lit("-"), F.col("idx").cast("string"))
    return chunks.join(used, "chunk_id", "left_anti").select(F.col("chunk_id").alias("id"), name.alias("name"), F.lit(UNCLASSIFIED).alias("entity_type"), F.array("chunk_id").alias("source_chunk_ids"), F.lit(FALLBACK).alias("confidence"))


def match_words(words: DataFrame, nodes: DataFrame, top: int = MATCHES) -> DataFrame:
    """(query_id, word, id, tier) of the nodes a query's words mean: exact lower-case names, else the ``top`` most similar,
    else names that hold the word or stand in it (two characters or more). words: query_id, word; a bounded set."""
    asked = words.select(F.lower("word").alias("_w"), "word").distinct()
    named = nodes.where(F.coalesce("name", F.lit("")) != "").select("id", "name", "entity_type", F.lower("name").alias("_n"))
    exact = named.join(asked, F.col("_n") == F.col("_w")).select("word", "id", F.lit("exact").alias("tier"))
    rest = materialize(asked.join(exact.select("word").distinct(), "word", "left_anti"))
    queries = rest.select(F.col("word").alias("query_id"), F.col("word").alias("query"), F.lit(None).cast("string").alias("entity_type"))
    fuzzy = materialize(fuzzy_candidates(queries, named, top).select(F.col("query_id").alias("word"), "id", F.lit("fuzzy").alias("tier")))
    last = rest.join(fuzzy.select("word").distinct(), "word", "left_anti").where(F.length("_w") > 1)
    inside = against_all(last, named).where(F.col("_n").contains(F.col("_w")) | F.col("_w").contains(F.col("_n"))).select("word", "id", F.lit("part").alias("tier"))
    return words.join(exact.union(fuzzy).union(inside), "word").select("query_id", "word", "id", "tier")


def lookup(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by id without the pseudo source of imports; ids: chunk_id."""
    return chunks.join(ids.where(F.col("chunk_id") != COLD_START).select("chunk_id").distinct(), "chunk_id", "left_semi")


def recalled_ids(walked: DataFrame, recalled: DataFrame) -> DataFrame:
    """(query_id, chunk_ids): ids found on the graph and by text, each once; both: query_id, chunk_id."""
    return walked.select("query_id", "chunk_id").union(recalled.select("query_id", "chunk_id")).groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def knowledge(nodes: DataFrame) -> DataFrame:
    """Nodes outside the document layer."""
    return nodes.where(~F.col("entity_type").isin(*DOCUMENT_NODES))
