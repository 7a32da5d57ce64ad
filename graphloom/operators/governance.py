"""Review, gaps, statistics, sampling, budgets and plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import has_verified, remove_nodes
from graphloom.schema import BRIDGE_EDGES, COLD_START, DOCUMENT_NODES, RESERVED_ENTITIES, RESERVED_RELATIONS, STRUCTURE_EDGES, UNCLASSIFIED, packed, unpacked
from graphloom.session import small


def support(source_ids: Column) -> Column:
    """Number of sources that are no imports."""
    return F.size(F.filter(source_ids, lambda s: s != COLD_START))


def confidence_one(confidence: Column, n: Column) -> Column:
    """min(0.95, 1 - 0.5 / n) to three places; unchanged without support."""
    return F.when(n <= 0, confidence).otherwise(F.bround(F.least(F.lit(0.95), 1 - 0.5 / F.greatest(n, F.lit(1))), 3))


def confidence_two(confidence: Column, n: Column) -> Column:
    """min(1, n / 3) to three places; unchanged without support."""
    return F.when(n == 0, confidence).otherwise(F.bround(F.least(F.lit(1.0), n / 3), 3))


def draft_diff(draft: DataFrame, published: DataFrame, compared: list[str]) -> DataFrame:
    """Draft rows with change: new, changed or unchanged; only the compared columns count."""
    old = published.select("id", F.struct(*compared).alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.struct(*compared) != F.col("_old"), "changed").otherwise("unchanged")
    return draft.join(old, "id", "left").withColumn("change", state).drop("_old")


def review_queue(draft: DataFrame, published: DataFrame) -> DataFrame:
    """New and changed knowledge nodes. draft: id, name, entity_type, confidence, evidence_quotes, source_chunk_ids,
    violation, seq, and review_status if decisions were stored; pending without."""
    rows = draft_diff(draft.where(~F.col("entity_type").isin(*DOCUMENT_NODES)), published, ["name", "entity_type"]).where("change <> 'unchanged'")
    return _judged(rows.withColumn("title", F.col("name")))


def fresh_edges(draft: DataFrame, published: DataFrame) -> DataFrame:
    """Draft edges that are not as published, with ``_old``, the published relations of their id, for ``review_edges``.

    For drafts whose ids follow from ends and relation: then all copies of an edge stay or go, and a gate after this finds
    in them what it would find in the whole draft. Only what is left is dealt again for the gate and for names."""
    old = published.select(packed("id").alias("_pid"), "relation_type").repartition("_pid").groupBy("_pid").agg(F.collect_list("relation_type").alias("_old"))
    short = draft.withColumns({"_pid": packed("id"), "_s": packed("source_id"), "_t": packed("target_id")}).drop("id", "source_id", "target_id")
    same = F.col("_old").isNotNull() & F.forall("_old", lambda r: r == F.col("relation_type"))
    kept = short.join(old, "_pid", "left").where(~same)
    return kept.withColumns({"id": unpacked("_pid"), "source_id": unpacked("_s"), "target_id": unpacked("_t")}).select(*draft.columns, "_old")


def review_edges(draft: DataFrame, published: DataFrame, nodes: DataFrame) -> DataFrame:
    """New and changed edges outside the structure and bridge layers; a title names both ends, ? where one is missing.

    draft: judged edges, all of them or what ``fresh_edges`` leaves; then ``published`` is not met again."""
    shown = draft.where(~F.col("relation_type").isin(*STRUCTURE_EDGES, *BRIDGE_EDGES))
    if "_old" in draft.columns:
        met = shown.withColumn("_old", F.explode_outer("_old"))
        state = F.when(F.col("_old").isNull(), "new").when(F.col("relation_type") != F.col("_old"), "changed").otherwise("unchanged")
        rows = met.withColumn("change", state).drop("_old").where("change <> 'unchanged'")
    else:
        rows = draft_diff(shown, published, ["relation_type"]).where("change <> 'unchanged'")
    for end in ("source_id", "target_id"):
        known = nodes.select(packed("id").alias("_end"), F.col("name").alias(f"_{end}"))
        rows = rows.withColumn("_end", packed(end)).join(known, "_end", "left").drop("_end")
    name = lambda c: F.coalesce(f"_{c}", F.lit("?"))
    return _judged(rows.withColumn("title", F.concat(name("source_id"), F.lit(" --["), F.col("relation_type"), F.lit("]--> "), name("target_id"))).drop("_source_id", "_target_id"))


def _judged(rows: DataFrame) -> DataFrame:
    verified = F.when(F.size("evidence_quotes") == 0, F.lit(True)).otherwise(has_verified(F.col("evidence_quotes")))
    status = F.coalesce("review_status", F.lit("pending")) if "review_status" in rows.columns else F.lit("pending")
    return rows.withColumns({"verified": verified, "n_support": support(F.col("source_chunk_ids")), "review_status": status})


def by_risk(queue: DataFrame) -> DataFrame:
    """The queue from its riskiest item: violations, unverified, low confidence, then order of arrival; a global sort."""
    return queue.orderBy(F.col("violation").isNull(), "verified", "confidence", "seq")


def review_totals(queue: DataFrame) -> DataFrame:
    """Items, those still pending, with violations and unverified."""
    return queue.agg(F.count("*").alias("total"), F.count_if(F.col("review_status") == "pending").alias("pending"), F.count_if(F.col("violation").isNotNull()).alias("with_violations"), F.count_if(~F.col("verified")).alias("unverified"))


def decide(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """decisions: kind (node or edge), id, decision (approve or reject), actor, ts; the last one of an item counts.

    Returns the draft with ``review_status`` of approved items and without rejected ones and the edges at rejected nodes,
    and a case for each rejection: kind, action, before_name, before_type, ts."""
    last = decisions.groupBy("kind", "id").agg(F.max_by(F.struct("decision", "ts"), F.struct("ts", "decision")).alias("d")).select("kind", "id", "d.*")
    pick = lambda kind, what: last.where((F.col("kind") == kind) & (F.col("decision") == what)).select("id", "ts")
    approved = lambda rows, kind: rows.join(pick(kind, "approve").select("id", F.lit("approved").alias("review_status")), "id", "left")
    gone_nodes, gone_edges = pick("node", "reject"), pick("edge", "reject")
    cases = nodes.join(gone_nodes, "id").select(F.lit("entity").alias("kind"), F.lit("delete").alias("action"), F.col("name").alias("before_name"), F.col("entity_type").alias("before_type"), "ts")
    cases = cases.union(edges.join(gone_edges, "id").select(F.lit("relation"), F.lit("delete"), F.lit(None).cast("string"), "relation_type", "ts"))
    left_nodes, left_edges = remove_nodes(nodes, edges.join(gone_edges, "id", "left_anti"), gone_nodes)
    return approved(left_nodes, "node"), approved(left_edges, "edge"), cases


def reflection_hints(cases: DataFrame, most: int = 12) -> DataFrame:
    """Lines of advice from the last cases, oldest first: cases: kind, action, before_name, before_type, after_name,
    after_type, seq. Modifications advise only where the type changed."""
    recent = cases.orderBy(F.desc("seq")).limit(most)
    name, before, after = F.coalesce("after_name", "before_name", F.lit("")), F.coalesce("before_type", F.lit("")), F.coalesce("after_type", "before_type", F.lit(""))
    changed = (F.col("action") == "modify") & (before != "") & (after != "") & (before != after)
    entity = F.col("kind") == "entity"
    line = (
        F.when((F.col("action") == "delete") & entity, F.concat(F.lit("avoid entity: "), F.coalesce("before_name", F.lit("")), F.lit(" ("), before, F.lit(")")))
        .when(F.col("action") == "delete", F.concat(F.lit("avoid relation: "), before))
        .when(changed & entity, F.concat(F.lit("entity "), name, F.lit(" is "), after, F.lit(", not "), before))
        .when(changed, F.concat(F.lit("relation "), before, F.lit(" is better put as "), after))
    )
    return recent.select("seq", line.alias("line")).where("line IS NOT NULL").orderBy("seq")


def violation_histogram(queue: DataFrame) -> DataFrame:
    return queue.where("violation IS NOT NULL").groupBy("violation").agg(F.count("*").alias("n"))


def evidence_rate(queue: DataFrame, inductive: list[str]) -> DataFrame:
    """Whole per cent of verified items among pending ones that are not induced; 100 where there are none."""
    rows = queue.where((F.col("review_status") == "pending") & ~F.col("entity_type").isin(*inductive))
    n, good = F.count("*"), F.count_if("verified")
    return rows.agg(n.alias("n"), F.when(n == 0, 100).otherwise(F.round(100 * good / n)).cast("int").alias("rate"))


def plan_lane(types: DataFrame) -> DataFrame:
    """(plan_id, lane): inductive where all knowledge types are, surface where none is, else mixed, as with no types at all;
    types: plan_id, abstractness (null for a plan without types)."""
    n, induced = F.count("abstractness"), F.count_if(F.col("abstractness") == "inductive")
    return types.groupBy("plan_id").agg(F.when(n == 0, "mixed").when(induced == n, "inductive").when(induced == 0, "surface").otherwise("mixed").alias("lane"))


def low_confidence(nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    return nodes.where(F.col("confidence") < threshold)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): how many edge ends touch a node."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def type_facets(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("entity_type").agg(F.count("*").alias("n"))


def of_types(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes of the chosen types; types: entity_type."""
    return nodes.join(small(types.select("entity_type").distinct()), "entity_type", "left_semi")


def badges(documents: DataFrame, runs: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: documents being parsed, whether a run is going on, pending items and items with violations."""
    parsing = documents.agg(F.count_if(F.col("status") == "parsing").alias("parsing"))
    going = runs.agg(F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("running"))
    open_ = queue.agg(F.count_if(F.col("review_status") == "pending").alias("pending"), F.count_if(F.col("violation").isNotNull()).alias("violations"))
    return parsing.join(going).join(open_)  # one row each


def high_risk(rows: DataFrame, inductive: list[str]) -> DataFrame:
    """Adds high_risk: violations, inductive with fewer than two sources, unverified, or confidence below 0.8."""
    return rows.withColumn("high_risk", F.col("violation").isNotNull() | (F.col("entity_type").isin(*inductive) & (F.col("n_support") < 2)) | ~F.col("verified") | (F.col("confidence") < 0.8))


def schema_gaps(nodes: DataFrame, rejected: DataFrame, entities: DataFrame, examples: int = 5) -> DataFrame:
    """(entity_type, n, examples) of types in use or rejected that are neither declared nor reserved."""
    used = nodes.select("entity_type", "name").union(rejected.select("entity_type", "name"))
    missing = used.where(~F.col("entity_type").isin(*RESERVED_ENTITIES)).join(small(entities.select(F.col("name").alias("entity_type"))), "entity_type", "left_anti")
    return _with_examples(missing, ["entity_type"], "name", examples)


def _with_examples(rows: DataFrame, keys: list[str], example: str, most: int) -> DataFrame:
    """(keys, n, examples): rows of each key, and its first distinct examples by name."""
    counted = rows.groupBy(*keys, example).agg(F.count("*").alias("_c"))
    few = counted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(example))).where(F.col("_r") <= most)
    shown = few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(example)), "|").alias("examples"))
    return counted.groupBy(*keys).agg(F.sum("_c").alias("n")).join(shown, keys)


def relation_gaps(edges: DataFrame, nodes: DataFrame, rejected: DataFrame, relations: DataFrame, examples: int = 5) -> DataFrame:
    """(relation_type, n, source_type, target_type, examples) of relations in use or rejected that are neither declared nor
    reserved; rejected: relation_type, example."""
    declared = small(relations.select(F.col("name").alias("relation_type")))
    off = edges.where(~F.col("relation_type").isin(*RESERVED_RELATIONS)).join(declared, "relation_type", "left_anti")
    end = lambda e: nodes.select(F.col("id").alias(e), F.col("name").alias(f"_{e}"))
    named = off.join(end("source_id"), "source_id", "left").join(end("target_id"), "target_id", "left")
    text = F.concat("_source_id", F.lit(" --("), F.col("relation_type"), F.lit(")--> "), F.col("_target_id"))
    said = rejected.where(~F.col("relation_type").isin(*RESERVED_RELATIONS)).join(declared, "relation_type", "left_anti").select("relation_type", "example")
    counted = _with_examples(named.select("relation_type", text.alias("example")).union(said), ["relation_type"], "example", examples)
    ends = relation_ends(off, nodes).drop("n")
    return counted.join(ends, "relation_type", "left").select("relation_type", "n", F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce("target_type", F.lit("")).alias("target_type"), "examples")


def fallback_segments(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(F.col("entity_type") == UNCLASSIFIED).alias("fallback_chunks"))


def by_count(gaps: DataFrame, key: str = "entity_type") -> DataFrame:
    """Gaps by count, then by name; a global sort of as many rows as there are types."""
    return gaps.orderBy(F.desc("n"), key)


def relation_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation_type, source_type, target_type, n): the most frequent pair of end types; ties by name."""
    return most_frequent_ends(end_types(edges, nodes).where("_from AND _to").drop("_from", "_to"))


def end_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation_type, source_type, target_type, _from, _to, n): how many edges have ends of which types, and whether these
    ends are there. An edge's target gives way to its type before sources are met, and edges alike by then are counted."""
    kind = lambda end, name, there: nodes.select(F.col("id").alias(end), F.col("entity_type").alias(name), F.lit(True).alias(there))
    to = edges.select("source_id", "target_id", "relation_type").join(kind("target_id", "target_type", "_to"), "target_id", "left")
    some = to.groupBy("source_id", "relation_type", "target_type", "_to").agg(F.count("*").alias("n"))
    both = some.join(kind("source_id", "source_type", "_from"), "source_id", "left")
    there = lambda c: F.coalesce(c, F.lit(False))
    return both.groupBy("relation_type", "source_type", "target_type", there("_from").alias("_from"), there("_to").alias("_to")).agg(F.sum("n").alias("n"))


def most_frequent_ends(counted: DataFrame) -> DataFrame:
    """Of each relation the pair of end types with most edges; ties by name."""
    best = F.row_number().over(Window.partitionBy("relation_type").orderBy(F.desc("n"), "source_type", "target_type"))
    return counted.withColumn("_r", best).where("_r = 1").drop("_r")


def rejected_stats(rejected: DataFrame) -> DataFrame:
    """Total, by reason, and by (kind, item_type), in one pass over grouping sets; level says which."""
    sets = rejected.groupingSets([[], ["reason"], ["kind", "item_type"]], "reason", "kind", "item_type")
    level = F.when(F.grouping("reason") == 0, "reason").when(F.grouping("kind") == 0, "type").otherwise("total")
    return sets.agg(level.alias("level"), F.count("*").alias("n")).select("level", "reason", "kind", "item_type", "n")


def rejected_examples(rejected: DataFrame, most: int = 5) -> DataFrame:
    """(kind, item_type, n, examples) with the first distinct names of each."""
    return _with_examples(rejected, ["kind", "item_type"], "name", most)


def f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 over distinct stripped, lower-cased (source, relation, target)."""
    cols = ("source", "relation", "target")
    norm = lambda df, tag: df.select(*[F.lower(F.trim(c)).alias(c) for c in cols]).distinct().withColumn(tag, F.lit(1))
    both = norm(predicted, "p").join(norm(gold, "g"), list(cols), "full_outer")
    counts = both.agg(F.count("p").alias("n_predicted"), F.count("g").alias("n_gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("n_hit"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.bround(a / b, 4))
    hit, p, g = F.col("n_hit"), F.col("n_predicted"), F.col("n_gold")
    return counts.select("n_predicted", "n_gold", "n_hit", ratio(hit, p).alias("precision"), ratio(hit, g).alias("recall"), ratio(2 * hit, p + g).alias("f1"))


def token_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("project_id", "run_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("calls"))


def run_cost(profile: DataFrame, size: int = 500, one_pass: bool = True, extras: int = 0, inductive: bool = False) -> DataFrame:
    """Calls and tokens of a run over n_chunks: int((size + 1200) / 0.8) tokens in, 600 out per call."""
    per_chunk = (1 if one_pass else 2) + extras + (2 if inductive else 0)
    calls = F.col("n_chunks") * per_chunk
    return profile.withColumns({"calls": calls, "input_tokens": calls * int((size + 1200) / 0.8), "output_tokens": calls * 600})


def within_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks of a run that are still worked on: tokens spent before a chunk are below the budget; 0 is no limit."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("spent", before).where((F.col("spent") < budget) | F.lit(budget == 0))


def file_profile(docs: DataFrame, key: str = "source") -> DataFrame:
    """Documents, characters and the longest text of each file group."""
    return docs.groupBy(key).agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("longest"))


def chunk_profile(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, chunk_count, file_size, max_chunk_length); a file without a known size has the length of its chunks.

    chunks: doc_id, chunk; files: doc_id, file_size."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.length("chunk")).alias("_chars"), F.max(F.length("chunk")).alias("max_chunk_length"))
    return counted.join(files.select("doc_id", "file_size"), "doc_id", "left").select("doc_id", "chunk_count", F.coalesce("file_size", "_chars").alias("file_size"), "max_chunk_length")


def headers(docs: DataFrame) -> DataFrame:
    """(doc_id, headers): cells of the first line of a table file that is neither blank nor a sheet's name."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    cells = F.filter(F.transform(F.split(F.get(lines, F.lit(0)), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.coalesce(cells, F.array().cast("array<string>")).alias("headers"))


def outline(docs: DataFrame, most: int = 15) -> DataFrame:
    """The first heading-like lines of a document: 2 to 40 characters, no sentence end."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    short = lines.withColumn("line", F.trim("line")).where(F.length("line").between(2, 40) & ~F.col("line").rlike(r"[.!?。！？]$"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return short.withColumn("rank", rank).where(F.col("rank") <= most)


def stride_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows at int(i * len / n) of each group, i = 0..n-1; groups of n rows or fewer are whole."""
    size = rows.groupBy(group).agg(F.count("*").alias("_len"))
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    numbered = rows.join(size, group).withColumn("position", at)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_len") / n).cast("int"))
    return numbered.where((F.col("_len") <= n) | F.array_contains(wanted, F.col("position"))).drop("_len")


def even_sample(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first row and evenly spaced ones at round(i * (len - 1) / (k - 1)), half to even, without repeats."""
    size = rows.groupBy(group).agg(F.count("*").alias("_len"))
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    wanted = F.transform(F.sequence(F.lit(0), F.lit(max(0, k - 1))), lambda i: F.bround(i * (F.col("_len") - 1) / max(1, k - 1)).cast("int"))
    return rows.join(size, group).withColumn("position", at).where(F.array_contains(wanted, F.col("position"))).drop("_len")


def stratified_sample(rows: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """Rows of every group: a floor of two (or one) and a share of the rest by its size, evenly spaced from the first on.

    With as many groups as the budget or more, one row of each of ``budget`` groups at even strides."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_len"))
    n = sizes.count()
    if n >= budget:
        at = F.row_number().over(Window.orderBy(group)) - 1  # one row a group
        wanted = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.floor(i * (F.lit(n) / F.lit(budget))).cast("int"))
        quotas = sizes.withColumn("_at", at).where(F.array_contains(wanted, F.col("_at"))).select(group, "_len", F.lit(1).alias("quota"))
    else:
        base = 2 if budget >= 2 * n else 1
        whole = sizes.agg(F.sum("_len").alias("_all"))
        quota = base + F.bround((budget - base * n) * F.col("_len") / F.col("_all")).cast("int")
        quotas = sizes.join(F.broadcast(whole)).select(group, "_len", quota.alias("quota"))  # one row
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    wanted = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("quota") - 1)), lambda i: F.bround(i * ((F.col("_len") - 1) / F.greatest(F.lit(1), F.col("quota") - 1))).cast("int"))
    return rows.join(quotas, group).withColumn("position", place).where((F.col("_len") <= F.col("quota")) | F.array_contains(wanted, F.col("position"))).drop("_len")


def newest(rows: DataFrame, n: int, order: str = "ts", tie: str = "id") -> DataFrame:
    """The last n entries, newest first."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def history(turns: DataFrame, rounds: int = 5) -> DataFrame:
    """The messages of the last rounds of every session; older ones are left to the summary."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.where("role <> 'system'").withColumn("_r", rank).where(F.col("_r") <= 2 * rounds).drop("_r")


def folded(turns: DataFrame, summaries: DataFrame, rounds: int = 5, cut: int = 120) -> DataFrame:
    """(conv_id, summary): the stored summary and, below it, a line for each older message, cut; no model is asked.

    summaries: conv_id, summary. A session's older messages are gathered by one task, as its summary is one text."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    older = turns.where("role <> 'system'").withColumn("_r", rank).where(F.col("_r") > 2 * rounds)
    lines = older.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, cut)).alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    joined = lines.join(summaries, "conv_id", "full_outer")
    return joined.select("conv_id", F.concat_ws("\n", F.nullif("summary", F.lit("")), text).alias("summary"))


def utility(questions: DataFrame) -> DataFrame:
    """Share of answered questions and mean score; questions: answered (boolean), score. Unanswered ones score nothing."""
    n = F.count("*")
    return questions.agg(n.alias("n"), F.when(n == 0, 0.0).otherwise(F.bround(F.sum(F.when(F.col("answered"), F.col("score")).otherwise(0.0)) / n, 4)).alias("utility"), F.count_if("answered").alias("answered"))


def type_usage(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_type, n) of every declared type; n is 0 for one that is not used."""
    return entities.select(F.col("name").alias("entity_type")).distinct().join(type_facets(nodes), "entity_type", "left").select("entity_type", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def retention(facts: DataFrame, key: str) -> DataFrame:
    """Facts, supported ones and their share, at most 1; facts: supported (boolean)."""
    good = F.count_if("supported")
    return facts.groupBy(key).agg(F.count("*").alias("facts"), good.alias("supported"), F.round(F.least(F.lit(1.0), good / F.count("*")), 4).alias("retention"))


def structure_problems(rows: DataFrame, required: list[str], properties: str = "properties", least: int = 2) -> DataFrame:
    """Adds missing: the required keys of an induced item whose value is shorter than ``least`` characters."""
    value = lambda k: F.length(F.trim(F.coalesce(F.col(properties)[k], F.lit(""))))
    return rows.withColumn("missing", F.filter(F.array(*map(F.lit, required)), lambda k: value(k) < least))


def models(calls: DataFrame, simple: str, normal: str, complex_: str) -> DataFrame:
    """Adds model, by complexity; an unknown one gets the normal model."""
    return calls.withColumn("model", F.when(F.col("complexity") == "simple", simple).when(F.col("complexity") == "complex", complex_).otherwise(normal))


@dataclass
class Step:
    id: str
    primitive: str
    depends_on: list[str] = field(default_factory=list)


def plan_problems(steps: list[Step]) -> list[str]:
    """Repeated ids, missing dependencies and cycles of a plan."""
    ids = [s.id for s in steps]
    problems = [f"repeated id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    problems += [f"{s.id} depends on missing {d}" for s in steps for d in s.depends_on if d not in ids]
    waiting = {s.id: {d for d in s.depends_on if d in ids} for s in steps}
    while ready := [i for i, deps in waiting.items() if not deps]:
        for i in ready:
            waiting.pop(i)
        for deps in waiting.values():
            deps.difference_update(ready)
    return problems + (["cycle among " + ", ".join(sorted(waiting))] if waiting else [])


def compile_plan(options: dict[str, bool]) -> list[Step]:
    """The steps of an extraction run from its switches, each depending on the one before."""
    names = ["chunk", "propose", "validate"] + [n for n in ("disambiguate", "cross_chunk", "self_correct", "induce", "post_correct") if options.get(n)] + ["upsert", "gate"]
    return [Step(n, n, names[i - 1 : i] if i else []) for i, n in enumerate(names)]


def parse_plan(steps: list[Step]) -> dict[str, bool]:
    given = {s.primitive for s in steps}
    return {n: n in given for n in ("disambiguate", "cross_chunk", "self_correct", "induce", "post_correct")}
