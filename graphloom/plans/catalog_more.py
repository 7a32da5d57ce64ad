"""Registered queries of storage, resolution, fusion, review, schema evolution and ranked retrieval, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import chunking, evolution, fusion, governance, graph, merging, resolution, retrieval, store, structure, traversal
from graphloom.plans import catalog as base
from graphloom.plans import fixtures as fx
from graphloom.plans.catalog import query
from graphloom.schema import QUOTES, chunk_id, node_id
from graphloom.session import dealt, ensure_checkpoint_dir, spread, table

# ---- storage -----------------------------------------------------------------------------------------------------


def _store(spark) -> store.Store:
    """A store of its own below the shared folder."""
    ensure_checkpoint_dir(spark)
    return store.Store(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")


_CHUNK_ROWS = f"chunk_rows AS (SELECT {base._CHUNK_ID} chunk_id, doc_id, idx, substr(text, idx*400+1, 500) chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text)-1)//400+1)) idx FROM documents WHERE trim(text)<>''))"


def _chunk_rows(spark, sf_dir):
    cut = chunking.windows(table(spark, sf_dir, "documents"))
    return cut.select(chunk_id(F.col("doc_id"), F.col("idx")).alias("chunk_id"), "doc_id", "idx", "chunk")


@query(f"WITH {_CHUNK_ROWS} SELECT chunk_id, doc_id, CASE WHEN doc_id%5=0 THEN 'again' ELSE chunk END chunk FROM chunk_rows WHERE doc_id%7<>0")
def store_chunks(spark, sf_dir):
    """Saved, partly saved again, and deleted for some documents."""
    kept, rows = _store(spark), _chunk_rows(spark, sf_dir)
    kept.save_chunks(rows.withColumn("seq", F.lit(1)))
    kept.save_chunks(rows.where("doc_id % 5 = 0").withColumns({"chunk": F.lit("again"), "seq": F.lit(2)}))
    kept.delete_chunks(rows.where("doc_id % 7 = 0"))
    return kept.chunks().select("chunk_id", "doc_id", "chunk")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') t, doc_id%2 later FROM documents)
 SELECT doc_id, later::BIGINT batch, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY later, 'doc_id='||doc_id||'/') = 1 THEN 'parsed' ELSE 'duplicate' END status FROM d""")
def upload_stream(spark, sf_dir):
    """All documents as files, uploaded by a stream in two runs; the second refuses what the first has had."""
    kept = _store(spark)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_id="), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    for later in (0, 1):
        store.write_texts(spread(texts.where(F.pmod("doc_id", F.lit(2)) == later)), f"{kept.root}/files")
        kept.upload_stream(f"{kept.root}/files", f"{kept.root}/progress", most=1_000_000)
    return kept.log("documents").select(F.regexp_extract("path", r"doc_id=(-?[0-9]+)\.txt", 1).cast("bigint").alias("doc_id"), "batch", "status")


@query(f"WITH {_CHUNK_ROWS} SELECT chunk_id, doc_id, idx FROM chunk_rows WHERE doc_id IN (SELECT doc_id FROM labels)")
def chunks_of_documents(spark, sf_dir):
    kept = _store(spark)
    kept.save_chunks(_chunk_rows(spark, sf_dir).withColumn("seq", F.lit(1)))
    return kept.chunks(table(spark, sf_dir, "labels")).select("chunk_id", "doc_id", "idx")


@query(f"WITH {fx.SQL_DRAFT_NODES} SELECT chunk_id, count(*) n FROM (SELECT DISTINCT unnest(source_chunk_ids) chunk_id FROM draft_nodes) JOIN (SELECT 'chunk_'||(doc_id%60) c FROM documents) ON c=chunk_id WHERE chunk_id<>'cold_start' GROUP BY 1")
def chunk_lookup(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("chunk_"), (F.col("doc_id") % 60).cast("string")).alias("chunk_id"))
    ids = fx.draft_nodes(spark, sf_dir).select(F.explode("source_chunk_ids").alias("chunk_id"))
    return resolution.lookup(ids, chunks).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query(f"WITH {fx.SQL_GATE} SELECT 'node' kind, id, 2 AS \"version\" FROM judged_nodes WHERE violation IS NULL UNION ALL SELECT 'edge', id, 2 FROM judged_edges WHERE violation IS NULL")
def store_publish(spark, sf_dir):
    """Published twice; the second version is read back, by the gate's rules."""
    kept = _store(spark)
    kept.replace_draft(fx.draft_nodes(spark, sf_dir), fx.draft_edges(spark, sf_dir))
    rules = fx.ontology(spark)
    kept.publish(rules, require_evidence=True)
    kept.publish(rules, require_evidence=True)
    nodes, edges, version = kept.graph("published")
    return nodes.select(F.lit("node").alias("kind"), "id", F.lit(version).alias("version")).union(edges.select(F.lit("edge"), "id", F.lit(version)))


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region')} SELECT 'before' AS \"when\", (SELECT count(*) FROM star_nodes) nodes, (SELECT count(*) FROM star_edges) edges UNION ALL SELECT 'after', (SELECT count(*) FROM star_nodes), (SELECT count(*) FROM star_edges) UNION ALL SELECT 'draft', 0, 0")
def store_export(spark, sf_dir):
    """What is exported before publishing and after the draft was rejected, and what is left of the draft."""
    kept = _store(spark)
    kept.replace_draft(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, ("in_region",)))
    count = lambda when, pair: pair[0].agg(F.count("*").alias("nodes")).join(pair[1].agg(F.count("*").alias("edges"))).select(F.lit(when).alias("when"), "nodes", "edges")  # noqa: E731  one row each
    before = kept.export()
    kept.publish()
    kept.restart()
    return count("before", before).union(count("after", kept.export())).union(count("draft", kept.graph("draft")[:2]))


@query(f"WITH {fx.SQL_NODES} SELECT id, CASE WHEN seq%6=0 THEN 'renamed '||name ELSE name END AS name, entity_type FROM star_nodes WHERE seq%10<>3")
def node_patch(spark, sf_dir):
    kept, nodes = _store(spark), fx.star_nodes(spark, sf_dir)
    kept.replace_draft(nodes, fx.star_edges(spark, sf_dir, ("in_region",)))
    kept.patch("nodes", nodes.where("seq % 6 = 0").select("id", F.concat(F.lit("renamed "), "name").alias("name")), ["name"])
    kept.delete_nodes(nodes.where("seq % 10 = 3").select("id"))
    return kept.graph("draft")[0].select("id", "name", "entity_type")


@query("SELECT event_id, event_type FROM events WHERE event_type='click' AND event_id%2=0 ORDER BY ts DESC, event_id DESC LIMIT 40")
def rejected_log(spark, sf_dir):
    """Two appends; the newest entries of one reason are listed."""
    kept, rows = _store(spark), table(spark, sf_dir, "events").where("event_id % 2 = 0")
    kept.append("rejected", rows.where("event_id % 4 = 0"))
    kept.append("rejected", rows.where("event_id % 4 = 2"))
    return kept.listed("rejected", 40, F.col("event_type") == "click", tie="event_id").select("event_id", "event_type")


@query("SELECT conv_id, turn, substr(coalesce(text,''),1,1200) digest FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 30")
def run_log_tail(spark, sf_dir):
    kept = _store(spark)
    kept.append("run_log", table(spark, sf_dir, "conversations").select("conv_id", "turn", store.prompt_digest(F.col("text")).alias("digest")))
    return kept.listed("run_log", 30, order="conv_id", tie="turn").select("conv_id", "turn", "digest")


@query(f"WITH {fx.SQL_NODES} SELECT id, name, len(embedding)::INT dims FROM star_nodes JOIN embeddings ON seq-3000000000=vec_id WHERE entity_type='Part'")
def entity_index(spark, sf_dir):
    nodes = fx.star_nodes(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 3_000_000_000).alias("seq"), F.col("embedding").alias("vec"))
    return store.entity_index(nodes, nodes.join(vectors, "seq").select("id", "vec"), "vector").select("id", "name", F.size("vec").alias("dims"))


@query("SELECT doc_id, CASE WHEN trim(text)='' THEN 0 ELSE (length(text)-1)//250+1 END::BIGINT chunk_count, least(300, length(text))::INT max_chunk_length FROM documents")
def rechunk_facts(spark, sf_dir):
    return store.rechunk(table(spark, sf_dir, "documents").select("doc_id", "text"), "sliding_window", 300, 50)[1]


@query("SELECT version, 'v'||version note, (2+version)::BIGINT entity_types, 1::BIGINT relation_types FROM range(1, 4) t(version)")
def schema_versions(spark, sf_dir):
    kept = _store(spark)
    for n in (1, 2, 3):
        names = ["Region", "Nation", "Part", "Zone", "Gadget"][: 2 + n]
        kept.apply_schema(spark.createDataFrame([(x, "entity") for x in names] + [("near", "relation")], "name string, kind string"), f"v{n}")
    return kept.schema_versions().select(F.col("version").cast("bigint").alias("version"), "note", "entity_types", "relation_types")


@query(r"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o)-1)::INT idx, trim(p) chunk, (b0+length(p)-length(ltrim(p)))::INT start_char, (b0+length(p)-length(ltrim(p))+length(trim(p)))::INT end_char FROM (SELECT doc_id, p, o, coalesce(sum(length(p)+1) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b0 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) p, generate_subscripts(string_split(text, chr(10)), 1) o FROM documents)) WHERE trim(p)<>''")
def paragraph_offsets(spark, sf_dir):
    return chunking.paragraph_offsets(table(spark, sf_dir, "documents"), separator="\n")


# ---- resolution --------------------------------------------------------------------------------------------------

_RUN = "run_rows AS (SELECT 'r'||(event_id//10) chunk_id, 'user'||user_id AS name, event_type entity_type, event_id seq, (event_id%100)/100 confidence FROM events)"
_KNOWN = "known AS (SELECT 'user'||user_id AS name, event_type entity_type, min(event_id) seq FROM events WHERE user_id%3=0 GROUP BY ALL)"


def _run_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("r"), F.expr("event_id div 10").cast("string")).alias("chunk_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("entity_type"), F.col("event_id").alias("seq"), ((F.col("event_id") % 100) / 100).alias("confidence"))


def _known(spark, sf_dir):
    rows = _run_rows(spark, sf_dir).where("CAST(substr(name, 5) AS INT) % 3 = 0")
    return rows.groupBy("name", "entity_type").agg(F.min("seq").alias("seq")).withColumn("id", node_id("entity_type", "name"))


@query(f"WITH {_RUN} SELECT chunk_id, name, entity_type, min(seq) seq, count(*) copies FROM run_rows GROUP BY 1, 2, 3")
def in_chunk_dedup(spark, sf_dir):
    return resolution.dedup_in_chunk(_run_rows(spark, sf_dir)).select("chunk_id", "name", "entity_type", "seq", "copies")


_VARIANTS = """said AS (SELECT 'r'||(event_id//10) chunk_id, CASE event_id%3 WHEN 0 THEN 'Account-'||user_id||'-of-'||event_type WHEN 1 THEN 'ACCOUNT-'||user_id||'-of-'||event_type ELSE 'account-'||user_id||'  -of-  '||event_type END AS name, event_type entity_type, event_id seq FROM events)"""
_NODE = "'n_'||substr(sha1(entity_type||chr(9247)||name),1,24)"


@query(rf"""WITH {_VARIANTS}, one AS (SELECT chunk_id, name, entity_type, min(seq) seq, min(min(seq)) OVER (PARTITION BY chunk_id) c, lower(regexp_replace(name, '\s+', '', 'g')) norm FROM said GROUP BY chunk_id, name, entity_type),
 firsts AS (SELECT name, entity_type, norm, {_NODE} id, min(c) a FROM one GROUP BY ALL), made AS (SELECT *, min(a) OVER (PARTITION BY entity_type, norm) = a is_node FROM firsts),
 best AS (SELECT entity_type, norm, min(id) id FROM made WHERE is_node GROUP BY ALL)
 SELECT o.seq, CASE WHEN is_node THEN m.id ELSE b.id END node_id, CASE WHEN NOT is_node THEN 'fast_path' WHEN m.a = o.c THEN 'new' ELSE 'known' END how FROM one o JOIN made m USING (name, entity_type) JOIN best b ON b.entity_type=o.entity_type AND b.norm=o.norm""")
def entity_map(spark, sf_dir):
    """Spellings of one account meet what earlier chunks of the run have made: whole resolution over all events."""
    events, user = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    spelt = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Account-"), user, F.lit("-of-"), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("ACCOUNT-"), user, F.lit("-of-"), "event_type")).otherwise(F.concat(F.lit("account-"), user, F.lit("  -of-  "), "event_type"))
    rows = events.select(F.concat(F.lit("r"), F.expr("event_id div 10").cast("string")).alias("chunk_id"), spelt.alias("name"), F.col("event_type").alias("entity_type"), F.lit(1.0).alias("confidence"), F.col("event_id").alias("seq"))
    none = fx.star_nodes(spark, sf_dir).limit(0)
    return resolution.resolve(rows, none).select("seq", "node_id", "how")


@query(f"WITH {_RUN}, {_KNOWN} SELECT r.seq, k.name IS NOT NULL hit FROM run_rows r LEFT JOIN known k ON r.name=k.name AND r.entity_type=k.entity_type")
def exact_hits(spark, sf_dir):
    return resolution.exact_hits(_run_rows(spark, sf_dir), _known(spark, sf_dir)).select("seq", F.col("node_id").isNotNull().alias("hit"))


@query(f"WITH {_RUN} SELECT seq FROM run_rows WHERE confidence<0.85")
def low_confidence_gate(spark, sf_dir):
    return resolution.to_disambiguate(_run_rows(spark, sf_dir), low_confidence_only=True).select("seq")


_CANDIDATES = "cand AS (SELECT a.event_id//20 query_id, a.event_id id, (a.event_id*7%50)/50 score, a.event_type='click' same_type, 'r'||(a.event_id//100) chunk_id FROM events a), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM cand)"


def _candidates(spark, sf_dir):
    from pyspark.sql import Window

    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 20").alias("query_id"), key.alias("id"), ((key * 7 % 50) / 50).alias("score"), (F.col("event_type") == "click").alias("same_type"), F.concat(F.lit("r"), F.expr("event_id div 100").cast("string")).alias("chunk_id"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


@query(f"WITH {_CANDIDATES}, p AS (SELECT *, bool_or(same_type) OVER (PARTITION BY query_id) any_same FROM ranked), q AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) r FROM p WHERE same_type OR NOT any_same) SELECT query_id, id, r::INT rank FROM q WHERE r<=8")
def candidate_recall(spark, sf_dir):
    return resolution.prefer_type(_candidates(spark, sf_dir)).select("query_id", "id", "rank")


@query(f"WITH {_CANDIDATES} SELECT query_id, id node_id FROM ranked WHERE rank=1 AND same_type AND score>=0.92")
def fast_path(spark, sf_dir):
    return resolution.fast_path(_candidates(spark, sf_dir))


@query(f"WITH {_CANDIDATES}, b AS (SELECT chunk_id, id%30 id, max(score) score, min((query_id, rank)) seen FROM ranked GROUP BY 1, 2), o AS (SELECT chunk_id, id, score, row_number() OVER (PARTITION BY chunk_id ORDER BY seen, id) p FROM b) SELECT chunk_id, id, score, p::INT place FROM o WHERE p<=15")
def candidate_merge(spark, sf_dir):
    return resolution.merged_candidates(_candidates(spark, sf_dir).withColumn("id", F.col("id") % 30), top=5)


@query(f"WITH {_RUN}, {_KNOWN}, one AS (SELECT chunk_id, name, entity_type, min(seq) seq FROM run_rows GROUP BY 1, 2, 3) SELECT o.seq, CASE WHEN k.name IS NOT NULL THEN 'known' WHEN substr(o.name,5)::INT%3=1 THEN 'judged' ELSE 'new' END how FROM one o LEFT JOIN known k ON o.name=k.name AND o.entity_type=k.entity_type")
def judged_decisions(spark, sf_dir):
    """Known names, names a judge has matched, and new ones."""
    rows = resolution.exact_hits(resolution.dedup_in_chunk(_run_rows(spark, sf_dir)), _known(spark, sf_dir))
    pending = rows.where("node_id IS NULL").drop("node_id")
    said = pending.select("name").distinct().where("CAST(substr(name, 5) AS INT) % 3 = 1").select("name", F.lit("n_x").alias("match_id"), F.lit(True).alias("is_same"))
    done = resolution.decide(pending, said).select("seq", F.when(F.col("is_new"), "new").otherwise("judged").alias("how"))
    return rows.where("node_id IS NOT NULL").select("seq", F.lit("known").alias("how")).union(done)


@query(r"SELECT doc_id, len(q)::INT n, q[1] first_quote, contains(regexp_replace(text,'\s+','','g'), regexp_replace(q[1],'\s+','','g')) verified FROM (SELECT doc_id, text, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x<>''), lambda x: substr(x,1,300)) q FROM documents)")
def evidence_normalise(spark, sf_dir):
    stored = resolution.evidence(F.col("doc_id").cast("string"), F.split("text", "\n"), F.col("text"), F.lit("verbatim"))
    rows = table(spark, sf_dir, "documents").select("doc_id", stored.alias("q"))
    return rows.select("doc_id", F.size("q").alias("n"), F.get("q", F.lit(0))["quote"].alias("first_quote"), F.get("q", F.lit(0))["verified"].alias("verified"))


@query("SELECT * FROM (VALUES ('Region','surface','verbatim'),('Nation','surface','verbatim'),('Customer','surface','verbatim'),('Supplier','surface','verbatim'),('Part','inductive','span')) t(name, lane, mode)")
def lane_split(spark, sf_dir):
    return resolution.split_lanes(fx.ontology(spark)[0]).select("name", "lane", resolution.evidence_mode(F.col("abstractness")).alias("mode"))


@query(f"WITH {_RUN} SELECT seq FROM run_rows WHERE confidence>=0.7")
def confident_relations(spark, sf_dir):
    return resolution.confident(_run_rows(spark, sf_dir)).select("seq")


@query(f"WITH {fx.SQL_RULES}, fresh(name) AS (VALUES ('Supplier'),('Region')), a AS (SELECT name relation, unnest(source_types) s, target_types t FROM rules), b AS (SELECT name relation, unnest(target_types) s, source_types t FROM rules), j AS (SELECT relation, unnest(t) peer FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE s IN (SELECT name FROM fresh)) SELECT DISTINCT peer, relation FROM j WHERE peer NOT IN (SELECT name FROM fresh)")
def peer_types(spark, sf_dir):
    return resolution.peer_types(fx.ontology(spark)[1], spark.createDataFrame([("Supplier",), ("Region",)], "name string"))


@query(f"WITH {fx.SQL_DRAFT_NODES}, {fx.SQL_DRAFT_EDGES}, {fx.SQL_RULES} SELECT 'edge' kind, id, 'missing source_id' problem FROM draft_edges WHERE source_id NOT IN (SELECT id FROM draft_nodes) UNION ALL SELECT 'edge', id, 'missing target_id' FROM draft_edges WHERE target_id NOT IN (SELECT id FROM draft_nodes) UNION ALL SELECT 'node', id, 'undeclared entity_type' FROM draft_nodes WHERE entity_type NOT IN (SELECT name FROM types) UNION ALL SELECT 'edge', id, 'undeclared relation_type' FROM draft_edges WHERE relation_type NOT IN (SELECT name FROM rules)")
def legacy_validate(spark, sf_dir):
    return resolution.legacy_messages(fx.draft_nodes(spark, sf_dir), fx.draft_edges(spark, sf_dir), *fx.ontology(spark))


@query(f"WITH {base._CHUNKS} SELECT chunk_id id, '片段-'||substr(doc_id::VARCHAR,1,8)||'-'||idx AS name, 0.5::DOUBLE confidence FROM chunks WHERE idx%3<>1")
def fallback_nodes(spark, sf_dir):
    chunks = base._chunks(spark, sf_dir)
    nodes = chunks.where("idx % 3 = 1").select(F.array("chunk_id").alias("source_chunk_ids"))
    return resolution.fallback_nodes(chunks, nodes).select("id", "name", "confidence")


@query(f"{base._BRIDGE}, {fx.sql_edges('in_region','in_nation')} SELECT (SELECT count(*) FROM star_edges WHERE relation_type IN ('提及于','共现')) bridge_edges_before, (SELECT count(*) FROM (SELECT DISTINCT id, chunk_id FROM u JOIN bridge_chunks USING (chunk_id))) mention_edges")
def structure_backfill(spark, sf_dir):
    """Bridge edges before, and mention edges after, a backfill of the whole draft that was run twice."""
    chunks = base._bridge_chunks(spark, sf_dir).withColumn("heading_path", F.array().cast("array<string>"))
    nodes, edges = base._bridge_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, ("in_region", "in_nation"))
    first = structure.backfill(chunks, nodes, edges)
    again = structure.backfill(chunks, nodes, first[1])
    counts = graph.structure_counts(edges, again[1].where("relation_type <> '共现'"))
    return counts.select("bridge_edges_before", F.col("bridge_edges_after").alias("mention_edges"))


@query(f"WITH {fx.SQL_NODES}, w AS (SELECT p_partkey query_id, CASE p_partkey%100 WHEN 0 THEN upper(p_name||'#'||p_partkey) ELSE 'SUPPLIER#' END word FROM part WHERE p_partkey%50=0) SELECT query_id, word, id, 'exact' tier FROM w JOIN star_nodes ON lower(name)=lower(word)")
def node_match_exact(spark, sf_dir):
    """Query words that are names, in any case; the fuzzy and partial tiers are tested on a small fixture."""
    part = table(spark, sf_dir, "part").where("p_partkey % 50 = 0")
    words = part.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 100 == 0, F.upper(fx.part_name())).otherwise("SUPPLIER#").alias("word"))
    return resolution.match_words(words, fx.star_nodes(spark, sf_dir)).where("tier = 'exact'")


@query()
def node_match(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey % 50 = 0")
    return resolution.match_words(part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("word")), fx.star_nodes(spark, sf_dir))


@query("SELECT item_id query_id, list_sort(list_distinct(list_concat(list(a), list(b)))) chunk_ids FROM (SELECT item_id, 'c'||(doc_id%9) a, 'c'||(doc_id%4) b FROM benchmark JOIN documents ON doc_id%(SELECT count(*) FROM benchmark)=item_id) GROUP BY 1")
def recall_union(spark, sf_dir):
    n = table(spark, sf_dir, "benchmark").count()
    rows = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id") % n == F.col("item_id"))
    ids = lambda k: rows.select(F.col("item_id").alias("query_id"), F.concat(F.lit("c"), (F.col("doc_id") % k).cast("string")).alias("chunk_id"))
    return resolution.recalled_ids(ids(9), ids(4))


# ---- fusion ------------------------------------------------------------------------------------------------------

_PARTS = "parts AS (SELECT p_partkey seq, 'p'||p_partkey id, p_name||'#'||p_partkey AS name, p_brand brand, p_size size, 'm'||(p_partkey%200) into_, 'c'||(p_partkey%40) c FROM part)"


def _parts(spark, sf_dir):
    """Part nodes with properties; every fourth has no brand."""
    key = F.col("p_partkey")
    brand = F.when(key % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
    quote = F.struct(F.concat(F.lit("c"), (key % 40).cast("string")).alias("chunk_id"), F.col("p_brand").alias("quote"), F.lit(True).alias("verified"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key.cast("string")).alias("id"), fx.part_name().alias("name"), F.lit("Part").alias("entity_type"), F.create_map(F.lit("brand"), brand, F.lit("size"), F.col("p_size").cast("string"), F.lit("_own"), F.lit("x")).alias("properties"), F.array(F.concat(F.lit("c"), (key % 40).cast("string")), F.lit("cold_start")).alias("source_chunk_ids"), F.array(quote).cast(QUOTES).alias("evidence_quotes"), F.lit(0.4).alias("confidence"), key.alias("seq"))


def _part_groups(spark, sf_dir):
    """Parts whose keys agree modulo 200 are one, led by the least key."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 200).alias("g"))
    lead = part.groupBy("g").agg(F.min("p_partkey").alias("l"))
    return part.join(lead, "g").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("l").cast("string")).alias("into"), F.concat(F.lit("merged "), F.col("l").cast("string")).alias("canonical"))


_MERGED = f"WITH {_PARTS}, g AS (SELECT *, min(seq) OVER (PARTITION BY into_) lead FROM parts), b AS (SELECT into_, coalesce(max(CASE WHEN seq=lead AND seq%4<>0 THEN brand END), min_by(brand, seq) FILTER (WHERE seq%4<>0)) brand, max(CASE WHEN seq=lead THEN size END) size, count(DISTINCT c) n, min(lead) lead FROM g GROUP BY 1)"


@query(f"{_MERGED} SELECT 'p'||lead id, 'merged '||lead AS name, brand, size::VARCHAR size, (n+1)::INT n_sources FROM b")
def cluster_merge(spark, sf_dir):
    found = merging.merge_nodes(_parts(spark, sf_dir), _part_groups(spark, sf_dir))
    return found.select("id", "name", F.col("properties")["brand"].alias("brand"), F.col("properties")["size"].alias("size"), F.size("source_chunk_ids").alias("n_sources"))


@query(f"{_MERGED} SELECT 'p'||lead id, round_even(least(0.95, 1-0.5/n), 3)::DOUBLE confidence, (SELECT string_agg(name, '|' ORDER BY name) FROM g WHERE g.into_=b.into_ AND seq<>g.lead) aliases FROM b")
def semantic_merge_run(spark, sf_dir):
    """The run's own rule: aliases are kept and confidence follows support by formula I."""
    edges = spark.createDataFrame([], "id string, source_id string, target_id string, relation_type string, source_chunk_ids array<string>, seq bigint")
    nodes, _ = merging.merge_groups(_parts(spark, sf_dir), edges, _part_groups(spark, sf_dir), ["Part"], "one")
    return nodes.select("id", "confidence", F.col("properties")["aliases"].alias("aliases"))


@query(f"{_MERGED} SELECT 'p'||lead id, round_even(least(1.0, n/3), 3)::DOUBLE confidence FROM b")
def semantic_merge_endpoint(spark, sf_dir):
    edges = spark.createDataFrame([], "id string, source_id string, target_id string, relation_type string, source_chunk_ids array<string>, seq bigint")
    return merging.merge_groups(_parts(spark, sf_dir), edges, _part_groups(spark, sf_dir), ["Part"], "two")[0].select("id", "confidence")


@query("WITH e AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem), m AS (SELECT 's'||s source_id, 'p'||(p%200) target_id, 'c'||(p%7) c FROM e), d AS (SELECT source_id, target_id, list_sort(list(DISTINCT c)) cs FROM m GROUP BY 1, 2) SELECT 'e_'||substr(sha1(source_id||chr(9247)||'supplies'||chr(9247)||target_id),1,24) id, source_id, target_id, array_to_string(cs, ',') chunks FROM d")
def redirect_united(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    rows = dealt(rows, "l_partkey", source=rows).distinct()
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = rows.select(F.concat_ws("-", "l_suppkey", "l_partkey").alias("id"), name("s", "l_suppkey").alias("source_id"), name("p", "l_partkey").alias("target_id"), F.lit("supplies").alias("relation_type"), F.array(F.concat(F.lit("c"), (F.col("l_partkey") % 7).cast("string"))).alias("source_chunk_ids"), (F.col("l_suppkey") * 10**7 + F.col("l_partkey")).alias("seq"))
    found = merging.redirect_united(edges, _part_groups(spark, sf_dir))
    return found.select("id", "source_id", "target_id", F.array_join("source_chunk_ids", ",").alias("chunks"))


@query(f"WITH {fx.SQL_DRAFT_EDGES} SELECT id, seq, CASE WHEN relation_type='suplies' THEN 'supplies' ELSE relation_type END relation_type FROM draft_edges")
def predicate_rewrite(spark, sf_dir):
    edges = fx.draft_edges(spark, sf_dir).withColumn("relation_type", F.when(F.col("relation_type") == "suplies", "supplies to").otherwise(F.col("relation_type")))
    return merging.rewrite_predicates(edges, merging.predicate_mapping(edges)).select("id", "seq", "relation_type")


@query(f"WITH {fx.SQL_GATE}, fixed AS (SELECT *, entity_type='Gadget' AND seq%2=0 gone FROM judged_nodes) SELECT 'node' kind, id, seq, CASE WHEN entity_type='Gadget' THEN 'Part' ELSE entity_type END AS type FROM fixed WHERE NOT gone UNION ALL SELECT 'edge', id, seq, CASE WHEN v2='relation_type_not_in_schema' THEN 'supplies' ELSE relation_type END FROM copies WHERE coalesce(v2 NOT IN ('source_type_mismatch','target_type_mismatch'), true) AND NOT (coalesce(v2='relation_type_not_in_schema', false) AND id NOT IN (SELECT id FROM draft_edges WHERE relation_type='suplies' AND seq%3<>0)) AND source_id NOT IN (SELECT id FROM fixed WHERE gone) AND target_id NOT IN (SELECT id FROM fixed WHERE gone)")
def post_correction(spark, sf_dir):
    nodes, edges = fx.draft_nodes(spark, sf_dir), fx.draft_edges(spark, sf_dir)
    off = nodes.where("entity_type = 'Gadget'")
    said = off.select("name", F.when(F.col("seq") % 2 == 0, "remove").otherwise("remap").alias("action"), F.lit("Part").alias("new_type"))
    fixes = edges.where("relation_type = 'suplies' AND seq % 3 <> 0").select("id", F.lit("remap").alias("action"), F.lit("supplies").alias("new_type"))
    left = merging.post_correct(nodes, edges, *fx.ontology(spark), said, fixes)
    return left[0].select(F.lit("node").alias("kind"), "id", "seq", F.col("entity_type").alias("type")).union(left[1].select(F.lit("edge"), "id", "seq", "relation_type"))


@query()
def fusion_pipeline(spark, sf_dir):
    """Predicates, correction without answers, and the gate's report over the whole draft.

    Names of this draft differ in their numbers only, so clusters are formed in ``cluster_merge`` and in the tests."""
    nodes = fx.draft_nodes(spark, sf_dir).withColumn("properties", F.create_map().cast("map<string,string>"))
    return merging.fuse(nodes, fx.draft_edges(spark, sf_dir), *fx.ontology(spark), cluster=False)[2]


@query("SELECT label \"group\", vec_id id FROM embeddings WHERE false")
def semantic_clusters(spark, sf_dir):
    """Vectors alike at the threshold; see the tests for clusters, as there are none in small tables."""
    return merging.semantic_clusters(table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "embedding"), threshold=0.95).select("group", "id")


@query("SELECT 'p'||p_partkey id, substr(p_name||'#'||p_partkey||CASE WHEN p_partkey%4=0 THEN '' ELSE ' | brand:'||p_brand END||' | size:'||p_size, 1, 512) said FROM part")
def semantic_text(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", merging.semantic_text(F.col("name"), F.col("properties")).alias("said"))


# ---- review and reflection ---------------------------------------------------------------------------------------

_EDGE_QUEUE = f"WITH {fx.SQL_GATE}, q AS (SELECT j.*, CASE WHEN p.id IS NULL THEN 'new' WHEN p.relation_type<>j.relation_type THEN 'changed' ELSE 'unchanged' END change, coalesce(a.name,'?')||' --['||j.relation_type||']--> '||coalesce(b.name,'?') title FROM judged_edges j LEFT JOIN (SELECT * FROM star_edges WHERE seq%4<>0) p ON j.id=p.id LEFT JOIN draft_nodes a ON j.source_id=a.id LEFT JOIN draft_nodes b ON j.target_id=b.id)"


@query(f"{_EDGE_QUEUE} SELECT id, seq, change, violation, title FROM q WHERE change<>'unchanged'")
def review_edges(spark, sf_dir):
    published = fx.star_edges(spark, sf_dir, ("in_region", "in_nation", "supplies")).where("seq % 4 <> 0")
    draft = governance.fresh_edges(graph.lacking(fx.draft_edges(spark, sf_dir)), published)
    rows = graph.gate(fx.draft_nodes(spark, sf_dir), draft, *fx.ontology(spark), require_evidence=True)[1]
    return governance.review_edges(rows, published, fx.draft_nodes(spark, sf_dir)).select("id", "seq", "change", "violation", "title")


@query(f"{base._QUEUE}, o AS (SELECT id FROM queue JOIN draft_nodes d USING (id) WHERE change<>'unchanged' ORDER BY violation IS NULL, queue.verified, queue.confidence, d.seq LIMIT 200) SELECT id FROM o")
def review_first(spark, sf_dir):
    """The two hundred riskiest items."""
    return governance.by_risk(base._queue(spark, sf_dir)).limit(200).select("id")


_DECIDED = "SELECT id, seq, CASE WHEN seq%5=0 THEN 'approve' WHEN seq%5=1 THEN 'reject' END d FROM star_nodes"


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region','in_nation')}, d AS ({_DECIDED}) SELECT 'node' kind, id, CASE WHEN d='approve' THEN 'approved' END status FROM d WHERE coalesce(d<>'reject', true) UNION ALL SELECT 'edge', id, NULL FROM star_edges WHERE source_id NOT IN (SELECT id FROM d WHERE d='reject') AND target_id NOT IN (SELECT id FROM d WHERE d='reject') UNION ALL SELECT 'case', NULL, name FROM star_nodes WHERE seq%5=1")
def review_decisions(spark, sf_dir):
    nodes, edges = fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, ("in_region", "in_nation"))
    said = nodes.where("seq % 5 < 2").select(F.lit("node").alias("kind"), "id", F.when(F.col("seq") % 5 == 0, "approve").otherwise("reject").alias("decision"), F.lit("a").alias("actor"), F.col("seq").alias("ts"))
    left = governance.decide(nodes, edges, said)
    none = F.lit(None).cast("string")
    return left[0].select(F.lit("node").alias("kind"), "id", F.col("review_status").alias("status")).union(left[1].select(F.lit("edge"), "id", "review_status")).union(left[2].select(F.lit("case"), none, "before_name"))


_CASES = "cases AS (SELECT event_id seq, CASE WHEN event_id%2=0 THEN 'entity' ELSE 'relation' END kind, CASE WHEN event_id%3=0 THEN 'delete' ELSE 'modify' END action, 'u'||user_id before_name, event_type before_type, CASE WHEN event_id%5=0 THEN event_type ELSE 'other' END after_type FROM events)"


@query(f"WITH {_CASES}, r AS (SELECT * FROM cases ORDER BY seq DESC LIMIT 12), l AS (SELECT seq, CASE WHEN action='delete' AND kind='entity' THEN 'avoid entity: '||before_name||' ('||before_type||')' WHEN action='delete' THEN 'avoid relation: '||before_type WHEN before_type<>after_type AND kind='entity' THEN 'entity '||before_name||' is '||after_type||', not '||before_type WHEN before_type<>after_type THEN 'relation '||before_type||' is better put as '||after_type END line FROM r) SELECT seq, line FROM l WHERE line IS NOT NULL")
def reflection_hints(spark, sf_dir):
    key = F.col("event_id")
    cases = table(spark, sf_dir, "events").select(key.alias("seq"), F.when(key % 2 == 0, "entity").otherwise("relation").alias("kind"), F.when(key % 3 == 0, "delete").otherwise("modify").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("before_name"), F.col("event_type").alias("before_type"), F.lit(None).cast("string").alias("after_name"), F.when(key % 5 == 0, F.col("event_type")).otherwise("other").alias("after_type"))
    return governance.reflection_hints(cases)


@query(f"WITH {fx.SQL_GATE} SELECT violation, count(*) n FROM judged_edges WHERE violation IS NOT NULL GROUP BY 1")
def violation_histogram(spark, sf_dir):
    return governance.violation_histogram(base._gated(spark, sf_dir)[1])


@query(f"{base._QUEUE} SELECT count(*) n, round(100*count(*) FILTER (WHERE verified)/count(*))::INT rate FROM queue WHERE change<>'unchanged' AND entity_type<>'Part'")
def evidence_rate(spark, sf_dir):
    return governance.evidence_rate(base._queue(spark, sf_dir), ["Part"])


@query("SELECT user_id plan_id, CASE WHEN count(*) FILTER (WHERE event_type='click')=count(*) THEN 'inductive' WHEN count(*) FILTER (WHERE event_type='click')=0 THEN 'surface' ELSE 'mixed' END lane FROM events GROUP BY 1")
def plan_lanes(spark, sf_dir):
    return governance.plan_lane(table(spark, sf_dir, "events").select(F.col("user_id").alias("plan_id"), F.when(F.col("event_type") == "click", "inductive").otherwise("surface").alias("abstractness")))


@query(f"WITH {fx.SQL_DRAFT_NODES} SELECT id FROM draft_nodes WHERE confidence<0.8")
def low_confidence_nodes(spark, sf_dir):
    return governance.low_confidence(fx.draft_nodes(spark, sf_dir)).select("id")


@query(f"WITH {fx.SQL_DRAFT_NODES} SELECT entity_type, count(*) n FROM draft_nodes WHERE entity_type IN ('Part','Gadget','Region') GROUP BY 1")
def type_facets(spark, sf_dir):
    chosen = spark.createDataFrame([("Part",), ("Gadget",), ("Region",), ("Zone",)], "entity_type string")
    return governance.type_facets(governance.of_types(fx.draft_nodes(spark, sf_dir), chosen))


@query(f"{base._QUEUE} SELECT (SELECT count(*) FROM documents WHERE doc_id%9=0) parsing, true running, count(*) pending, count(*) FILTER (WHERE violation IS NOT NULL) violations FROM queue WHERE change<>'unchanged'")
def status_badges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "parsing").otherwise("parsed").alias("status"))
    runs = table(spark, sf_dir, "events").select(F.when(F.col("event_id") == 1, "running").otherwise("done").alias("status"))
    return governance.badges(docs, runs, base._queue(spark, sf_dir))


@query("SELECT kind, item_type, count(*) n, array_to_string(list_sort(list_distinct(list(name)))[1:5], '|') examples FROM (SELECT CASE WHEN event_id%2=0 THEN 'entity' ELSE 'relation' END kind, 't'||(user_id%7) item_type, 'user'||user_id AS name FROM events) GROUP BY 1, 2")
def rejected_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "entity").otherwise("relation").alias("kind"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("item_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))
    return governance.rejected_examples(rows)


@query(f"WITH {fx.SQL_NODES}, {fx.SQL_DRAFT_EDGES}, m AS (SELECT relation_type, a.name||' --('||relation_type||')--> '||b.name ex, a.entity_type s, b.entity_type t FROM draft_edges e LEFT JOIN star_nodes a ON e.source_id=a.id LEFT JOIN star_nodes b ON e.target_id=b.id WHERE relation_type NOT IN ('in_region','in_nation','supplies','ordered','near')) SELECT relation_type, count(*) n, 'Supplier' source_type, 'Part' target_type FROM m GROUP BY 1")
def relation_gaps(spark, sf_dir):
    none = spark.createDataFrame([], "relation_type string, example string")
    return governance.relation_gaps(fx.draft_edges(spark, sf_dir), fx.star_nodes(spark, sf_dir), none, fx.ontology(spark)[1]).select("relation_type", "n", "source_type", "target_type")


@query(f"WITH {base._CHUNKS} SELECT count(*) FILTER (WHERE idx%3<>1) fallback_chunks FROM chunks")
def fallback_segments(spark, sf_dir):
    chunks = base._chunks(spark, sf_dir)
    return governance.fallback_segments(resolution.fallback_nodes(chunks, chunks.where("idx % 3 = 1").select(F.array("chunk_id").alias("source_chunk_ids"))))


@query(f"WITH {_CHUNK_ROWS} SELECT doc_id, count(*) chunk_count, CASE WHEN doc_id%2=0 THEN doc_id ELSE sum(length(chunk)) END::BIGINT file_size, max(length(chunk))::INT max_chunk_length FROM chunk_rows GROUP BY 1")
def chunk_profile(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("file_size"))
    return governance.chunk_profile(_chunk_rows(spark, sf_dir), files)


@query("SELECT p_partkey doc_id, [p_name, p_brand, p_type] headers FROM part")
def header_inference(spark, sf_dir):
    rows = F.concat(F.lit("# sheet\n\n"), F.concat_ws(" | ", "p_name", "p_brand", "p_type"), F.lit("\nx | y"))
    return governance.headers(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), rows.alias("text")))


@query("WITH o AS (SELECT conv_id, turn, role||': '||substr(coalesce(text,''),1,120) line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations WHERE role<>'system') SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) summary FROM o WHERE r>2 GROUP BY 1")
def history_folded(spark, sf_dir):
    none = spark.createDataFrame([], "conv_id bigint, summary string")
    return governance.folded(table(spark, sf_dir, "conversations"), none, rounds=1)


@query("SELECT count(*) n, round_even(sum(CASE WHEN event_id%3>0 THEN value ELSE 0 END)/count(*), 4) utility, count(*) FILTER (WHERE event_id%3>0) answered FROM events")
def downstream_utility(spark, sf_dir):
    return governance.utility(table(spark, sf_dir, "events").select((F.col("event_id") % 3 > 0).alias("answered"), F.col("value").alias("score")))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'small' WHEN 'view' THEN 'large' ELSE 'middle' END model FROM events")
def model_choice(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "simple").when(F.col("event_type") == "view", "complex").otherwise("unknown").alias("complexity"))
    return governance.models(calls, "small", "middle", "large").select("event_id", "model")


@query("SELECT doc_id, md5(text) cache_key FROM documents")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.cache_key(F.col("text")).alias("cache_key"))


# ---- schema evolution --------------------------------------------------------------------------------------------


@query(f"WITH {fx.SQL_NODES} SELECT entity_type AS name, string_agg(name, '|' ORDER BY seq) examples FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY seq) r FROM star_nodes) WHERE r<=3 GROUP BY 1")
def reverse_schema_types(spark, sf_dir):
    found = evolution.reverse_schema(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, base._KINDS))[0]
    return found.select("name", F.array_join("examples", "|").alias("examples"))


@query("SELECT * FROM (VALUES ('in_nation','Customer','Nation'),('in_region','Nation','Region'),('supplies','Supplier','Part')) t(name, source_type, target_type)")
def reverse_schema_relations(spark, sf_dir):
    return evolution.reverse_schema(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, base._KINDS))[1].select("name", "source_type", "target_type")


@query("SELECT * FROM (VALUES ('a','Region',''),('b','',''),('c','','Part')) t(name, source_type, target_type)")
def relation_end_repair(spark, sf_dir):
    rows = spark.createDataFrame([("a", "Region", "Zone"), ("b", "", ""), ("c", "Zone", "Part")], "name string, source_type string, target_type string")
    return evolution.repaired(rows, fx.ontology(spark)[0])


@query(f"WITH {fx.SQL_DRAFT_NODES} SELECT entity_type AS name, '图谱中出现的「'||entity_type||'」类型' definition FROM draft_nodes WHERE entity_type='Gadget' GROUP BY 1")
def schema_placeholders(spark, sf_dir):
    none = spark.createDataFrame([], "entity_type string, name string")
    gaps = governance.by_count(governance.schema_gaps(fx.draft_nodes(spark, sf_dir), none, fx.ontology(spark)[0]))
    return evolution.placeholders(gaps).select("name", "definition")


@query("SELECT doc_id, 'chunks: '||n||chr(10)||'size: '||s||coalesce(chr(10)||h, '') AS profile FROM (SELECT doc_id, count(*) n, sum(length(chunk)) s FROM (SELECT doc_id, substr(text, i*400+1, 500) chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text)-1)//400+1)) i FROM documents WHERE trim(text)<>'')) GROUP BY 1) LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY r) h FROM (" + base.ORACLE_SQL["outline"].replace("SELECT *", "SELECT doc_id, line, rank r", 1) + ") GROUP BY 1) USING (doc_id)")
def document_profiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", F.lit(None).cast("bigint").alias("file_size"))
    return evolution.document_profile(governance.chunk_profile(_chunk_rows(spark, sf_dir), sizes), governance.outline(docs))


@query("SELECT source AS domain, array_to_string(list_sort(list_distinct(list(lang))), ',') concepts FROM documents GROUP BY 1")
def domain_concepts(spark, sf_dir):
    found = evolution.domain_concepts(table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("concept")))
    return found.select("domain", F.array_join("concepts", ",").alias("concepts"))


@query("SELECT * FROM (VALUES ('Region','surface','verbatim'),('Nation','normalized','verbatim'),('Customer','surface','verbatim'),('Supplier','normalized','verbatim'),('Part','inductive','span')) t(name, abstractness, evidence_mode)")
def extraction_semantics(spark, sf_dir):
    said = spark.createDataFrame([("Nation", "normalized"), ("Region", "vague")], "name string, abstractness string")
    return evolution.semantics(fx.ontology(spark)[0], said)


@query("SELECT * FROM (VALUES ('就职于','人物','组织'),('位于','组织','地点')) t(name, source_type, target_type)")
def default_schema(spark, sf_dir):
    return evolution.suggested(spark)[1].select("name", "source_type", "target_type")


@query("SELECT name FROM (SELECT 'user'||user_id AS name FROM events GROUP BY 1) WHERE NOT (substr(name,5)::INT%4=0)")
def faithful_items(spark, sf_dir):
    items = _run_rows(spark, sf_dir).select("name").distinct()
    key = F.substring("name", 5, 9).cast("int")
    return evolution.judged(items, items.where(key % 2 == 0).select("name", (key % 4 != 0).alias("supported")))


_TERMS = ("the", "und", "que", "les")
_TERM_ROWS = ", ".join(f"('{t}')" for t in _TERMS)


@query(f"WITH {_CHUNK_ROWS} SELECT chunk_id, t AS name FROM chunk_rows, (VALUES {_TERM_ROWS}) v(t) WHERE contains(lower(chunk), t)")
def propose_entities(spark, sf_dir):
    terms = spark.createDataFrame([(t, "Word") for t in _TERMS], "term string, entity_type string")
    return evolution.propose(_chunk_rows(spark, sf_dir), terms).select("chunk_id", "name")


_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x<>'')"
_DICTIONARY = f"""raw AS (SELECT p_name term, 'Part' entity_type FROM part UNION SELECT s_name, 'Supplier' FROM supplier UNION SELECT array_to_string({_SPLIT.format("text")}[1:k], ' '), 'Phrase' FROM benchmark, (VALUES (2), (3), (5)) v(k)),
 terms AS (SELECT term, entity_type, len(w)::INT words, array_to_string(w, ' ') k FROM (SELECT *, {_SPLIT.format("term")} w FROM raw) WHERE len(w)>0)"""


@query(f"""WITH {_CHUNK_ROWS}, {_DICTIONARY}, cut AS (SELECT chunk_id, {_SPLIT.format("chunk")} w FROM chunk_rows), n AS (SELECT DISTINCT words FROM terms),
 runs AS (SELECT chunk_id, words, p, array_to_string(w[p:p+words-1], ' ') k FROM cut, n, unnest(range(1, len(w)-words+2)) t(p)),
 met AS (SELECT chunk_id, p::INT "at", words, term, entity_type FROM runs JOIN terms USING (words, k)) SELECT * FROM met QUALIFY words = max(words) OVER (PARTITION BY chunk_id, "at")""")
def dictionary_mentions(spark, sf_dir):
    """Names of parts and suppliers and openings of benchmark items, wherever they stand in the chunks of all documents."""
    opening = lambda k: table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(evolution.dictionary_words(F.col("text")), 1, k), " ").alias("term"), F.lit("Phrase").alias("entity_type"))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.lit("Part").alias("entity_type")).union(table(spark, sf_dir, "supplier").select("s_name", F.lit("Supplier")))
    terms = names.union(opening(2)).union(opening(3)).union(opening(5))
    return evolution.dictionary_mentions(_chunk_rows(spark, sf_dir), terms)


@query("WITH u AS (SELECT DISTINCT event_id//10 c, 'user'||user_id AS name, event_type t FROM events) SELECT 'r'||a.c chunk_id, a.name source_name, b.name target_name, 'follows' relation_type FROM u a JOIN u b ON a.c=b.c AND a.t='click' AND b.t='view' AND a.name<>b.name")
def propose_relations(spark, sf_dir):
    declared = spark.createDataFrame([("follows", "click", "view")], "name string, source_type string, target_type string")
    return evolution.propose_relations(_run_rows(spark, sf_dir), declared)


# ---- ranked retrieval --------------------------------------------------------------------------------------------


@query()
def ppr_quotas(spark, sf_dir):
    """Entities and anchors by personalised PageRank over knowledge and bridge edges, until ranks settle."""
    bridge = base._bridge_nodes(spark, sf_dir)
    chunks = base._bridge_chunks(spark, sf_dir)
    anchored = structure.anchors(chunks, bridge)
    nodes = bridge.select("id", "entity_type").union(anchored.select("anchor", F.lit("文档片段")))
    edges = fx.star_edges(spark, sf_dir, ("in_region", "in_nation")).select("source_id", "target_id").union(structure.mentions(bridge, anchored).select("source_id", "target_id"))
    seeds = base._seed(spark, sf_dir, "Supplier", 4)
    ranks = traversal.personalised_pagerank(nodes, edges, seeds)
    return retrieval.rank_quotas(ranks, nodes, seeds)


@query(f"WITH {fx.SQL_NODES}, r AS (SELECT id, entity_type, seq%1000/1000 rank, seq%400=0 seed FROM star_nodes), k AS (SELECT id, rank, seed AND entity_type<>'Region' s, CASE WHEN entity_type='Region' THEN 'anchor' ELSE 'entity' END kind FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY s DESC, rank DESC, id) n FROM k) SELECT id, kind, rank FROM o WHERE n<=30 OR s")
def rank_quotas(spark, sf_dir):
    nodes = fx.star_nodes(spark, sf_dir)
    typed = nodes.withColumn("entity_type", F.when(F.col("entity_type") == "Region", "文档片段").otherwise(F.col("entity_type")))
    return retrieval.rank_quotas(nodes.select("id", (F.col("seq") % 1000 / 1000).alias("rank")), typed, nodes.where("seq % 400 = 0 AND entity_type <> 'Region'"))


@query(f"WITH {fx.SQL_NODES} SELECT id, name FROM star_nodes WHERE seq%3=0 OR seq%5=0")
def merged_view(spark, sf_dir):
    nodes = fx.star_nodes(spark, sf_dir).select("id", "name", "seq")
    return retrieval.merged_view(nodes.where("seq % 3 = 0"), nodes.where("seq % 5 = 0")).select("id", "name")


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region')} SELECT 'kept' what, count(*) n FROM star_nodes WHERE entity_type<>'Part' UNION ALL SELECT 'edges', count(*) FROM star_edges")
def projected_graph(spark, sf_dir):
    nodes = fx.star_nodes(spark, sf_dir)
    layered = nodes.withColumn("entity_type", F.when(F.col("entity_type") == "Part", "文档片段").otherwise(F.col("entity_type")))
    kept, edges = graph.projection(layered, fx.star_edges(spark, sf_dir, ("in_region", "supplies")), simple=True)
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n").union(edges.agg(F.count("*")).select(F.lit("edges"), "count(1)"))


@query(f"WITH {fx.SQL_NODES}, q AS (SELECT item_id query_id, text||' Customer#000000001' query FROM benchmark WHERE item_id%50=0) SELECT query_id, id, rank::INT rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY seq) rank FROM q JOIN star_nodes ON contains(query, name)) WHERE rank<=20")
def global_candidates(spark, sf_dir):
    """Candidates whose name stands in the query; those by shared bigrams come after them and are tested apart."""
    queries = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" Customer#000000001")).alias("query"))
    return retrieval.global_candidates(queries, fx.star_nodes(spark, sf_dir)).where("score = 2").select("query_id", "id", "rank")


@query(f"WITH {fx.SQL_DRAFT_NODES}, {fx.sql_edges('in_region','in_nation')}, s AS (SELECT id FROM star_nodes WHERE entity_type='Supplier' ORDER BY seq LIMIT 2), m AS (SELECT id FROM s UNION SELECT target_id FROM star_edges WHERE source_id IN (SELECT id FROM s)) SELECT DISTINCT unnest(source_chunk_ids) chunk_id FROM draft_nodes WHERE id IN (SELECT id FROM m)")
def walked_chunks(spark, sf_dir):
    nodes, edges = fx.draft_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, ("in_region", "in_nation"))
    seeds = base._seed(spark, sf_dir, "Supplier")
    walked = traversal.fan_out_bfs(edges, seeds, 1)
    return traversal.walked_chunks(walked, nodes, edges.withColumn("source_chunk_ids", F.array().cast("array<string>")), seeds)


@query("SELECT id, number, line FROM (SELECT conv_id id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS number, role||' --(said)--> '||role line FROM conversations) WHERE number<=40")
def community_relations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    members = turns.select(key.alias("id"), F.col("conv_id").alias("community_id"))
    edges = turns.select(key.alias("source_id"), key.alias("target_id"), F.lit("said").alias("relation_type"), F.col("turn").alias("seq"))
    found = traversal.community_relations(members, turns.select(key.alias("id"), F.col("role").alias("name")), edges)
    return found.select(F.col("community_id").alias("id"), "number", "line")


@query("SELECT c_custkey, s_suppkey, (c_name=s_name)::INT::DOUBLE score FROM customer JOIN supplier ON c_nationkey=s_nationkey WHERE false")
def sequence_ratio(spark, sf_dir):
    """difflib's ratio of names in one nation, of which none is equal; values are tested against difflib itself.

    A ratio is 1 where all characters of both texts match in order, so only equal texts (null counts as empty) are paired."""
    text = lambda c: F.coalesce(c, F.lit(""))
    same = (F.col("c_nationkey") == F.col("s_nationkey")) & (text("c_name") == text("s_name"))
    pairs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), same)
    return pairs.select("c_custkey", "s_suppkey", fn.sequence_ratio(F.col("c_name"), F.col("s_name")).alias("score")).where("score = 1")


@query("SELECT doc_id, l.level, trim(regexp_replace(line, '^#+', '')) title FROM (SELECT doc_id, unnest(['## Part '||doc_id, doc_id||'.2 Sub', '一、 x', '第二章 y', 'plain '||doc_id]) line FROM documents) d, LATERAL (SELECT CASE WHEN starts_with(line,'##') THEN 2 WHEN regexp_matches(line, '^\\d+\\.2 ') THEN 2 WHEN starts_with(line,'一') THEN 2 WHEN starts_with(line,'第') THEN 1 ELSE 0 END level) l")
def heading_levels(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    lines = F.array(F.concat(F.lit("## Part "), key), F.concat(key, F.lit(".2 Sub")), F.lit("一、 x"), F.lit("第二章 y"), F.concat(F.lit("plain "), key))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(lines).alias("line"))
    return rows.select("doc_id", fn.heading_level(F.col("line")).alias("level"), fn.clean_heading(F.col("line")).alias("title"))


@query(f"SELECT (SELECT count(*) FROM {base._ENTITY_PROPOSALS})-(SELECT count(*) FROM (SELECT DISTINCT name, entity_type FROM {base._ENTITY_PROPOSALS} WHERE trim(name)<>'' AND entity_type IN ('click','purchase'))) entities_corrected, 0::BIGINT relations_corrected")
def rule_correct_counts(spark, sf_dir):
    none = spark.createDataFrame([], "source_name string, target_name string, relation_type string")
    return fusion.rule_correction(base._entity_proposals(spark, sf_dir), none, ["click", "purchase"], [])[2]
