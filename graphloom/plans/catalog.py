"""Registered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import chunking, edits, evolution, fusion, governance, graph, merging, resolution, retrieval, structure, traversal
from graphloom.plans import fixtures as fx
from graphloom.schema import QUOTES, allows, chunk_id, format_constraint, merge_schema, node_id, prune, undeclared_ends
from graphloom.session import materialize, small, table
from graphloom.streaming.incremental import unprocessed, upsert_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- chunking and text -------------------------------------------------------------------------------------------


@query("SELECT doc_id, (s//400)::INT idx, s::INT start_char, substr(text, s+1, 500) chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) s FROM documents WHERE trim(text)<>'')")
def chunk_window(spark, sf_dir):
    return chunking.windows(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o)-1)::INT idx, p chunk FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) p, generate_subscripts(string_split(text, chr(10)), 1) o FROM documents) WHERE p<>''")
def chunk_paragraph(spark, sf_dir):
    return chunking.paragraphs(table(spark, sf_dir, "documents"), separator="\n")


@query()
def chunk_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.split_documents(docs, "fixed_length")


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.split_documents(table(spark, sf_dir, "documents"), "recursive_character")


@query()
def chunk_hierarchical(spark, sf_dir):
    html = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style|title)>.*?</\1>", ""), r"<h1>", "\n# ")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace(html, r"</h1>|</?p>|<br>", "\n"), r"<[^>]*>", "").alias("text"))
    return chunking.split_documents(pages, "hierarchical", level=1)


@query(r"SELECT doc_id, trim(array_to_string(list_transform(string_split(regexp_replace(text, '\n{3,}', chr(10)||chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), ' '||chr(10)) cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.clean(F.col("text")).alias("cleaned"))


@query("SELECT sha256(text) content_hash, min(doc_id) doc_id, count(*) copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, count(*) n_docs, sum(length(text))::BIGINT n_chars, max(length(text))::INT longest FROM documents GROUP BY 1")
def file_profile(spark, sf_dir):
    return governance.file_profile(table(spark, sf_dir, "documents"))


@query(r"SELECT * FROM (SELECT doc_id, line_no::INT line_no, line, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT rank FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)-1 line_no, trim(unnest(string_split(text, chr(10)))) line FROM documents) WHERE length(line) BETWEEN 2 AND 40 AND NOT regexp_matches(line, '[.!?。！？]$')) WHERE rank<=15")
def outline(spark, sf_dir):
    return governance.outline(table(spark, sf_dir, "documents"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(1, length(n)-1)+1), lambda i: substr(n, i, 2)))"


@query(f"WITH p AS (SELECT DISTINCT p_name n0 FROM part), g AS (SELECT n0, {_GRAMS} k FROM (SELECT n0, regexp_replace(lower(n0), '\\s+', '', 'g') n FROM p)) SELECT a.n0 a, b.n0 b, round(len(list_intersect(a.k, b.k))/(len(a.k)+len(b.k)-len(list_intersect(a.k, b.k))), 6) score FROM g a JOIN g b ON a.n0<b.n0 AND split_part(a.n0,' ',1)=split_part(b.n0,' ',1)")
def ngram_jaccard(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("w", F.split("a", " ")[0])
    pairs = names.join(names.withColumnRenamed("a", "b"), "w").where("a < b")
    return pairs.select("a", "b", F.round(fn.jaccard(fn.ngrams(F.col("a")), fn.ngrams(F.col("b"))), 6).alias("score"))


@query(r"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(p_name||' '||p_brand), '\s+', '', 'g'), '[a-z0-9]+'))), '|') tokens FROM part")
def keyword_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(fn.keyword_tokens(F.concat_ws(" ", "p_name", "p_brand"))), "|").alias("tokens"))


@query("SELECT c_custkey, s_suppkey, round(1-levenshtein(c_name, s_name)/greatest(length(c_name), length(s_name)), 6) score FROM customer JOIN supplier ON c_nationkey=s_nationkey")
def edit_similarity(spark, sf_dir):
    """All pairs of a nation, as the SQL has it, by blocks of customers and suppliers that are dealt over all cores."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("group"), F.col("c_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("group"), F.col("s_name").alias("name"))
    return edits.all_pairs(customers, suppliers, "c_custkey", "s_suppkey")


# ---- identities, upserts and imports -----------------------------------------------------------------------------


@query(f"WITH {fx.SQL_NODES} SELECT * FROM star_nodes")
def node_ids(spark, sf_dir):
    return fx.star_nodes(spark, sf_dir)


@query(f"WITH {fx.sql_edges()} SELECT * FROM star_edges")
def edge_ids(spark, sf_dir):
    return fx.star_edges(spark, sf_dir)


def _proposed(spark, sf_dir):
    """Every line item proposes its part by the shared part name, from the chunk of its order."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    seq = (F.col("l_orderkey") * 10**9 + F.col("l_partkey") * 10**3 + F.col("l_linenumber")).alias("seq")
    chunk = F.concat(F.lit("c"), (F.col("l_orderkey") % 40).cast("string"))
    quote = F.struct(chunk.alias("chunk_id"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("p_brand")).alias("quote"), F.lit(True).alias("verified"))
    return line.select(F.col("p_name").alias("name"), F.lit("Part").alias("entity_type"), node_id(F.lit("Part"), "p_name").alias("id"), F.col("l_suppkey").cast("double").alias("confidence"), F.array(chunk).alias("source_chunk_ids"), F.array(quote).cast(QUOTES).alias("evidence_quotes"), seq).distinct()


_PROPOSED = "proposed AS (SELECT DISTINCT p_name AS name, 'n_'||substr(sha1('Part'||chr(9247)||p_name),1,24) id, l_suppkey::DOUBLE confidence, 'c'||(l_orderkey%40) chunk, CASE WHEN l_linenumber=1 THEN '' ELSE p_brand END quote, (l_orderkey*1000000000+l_partkey*1000+l_linenumber)::BIGINT seq FROM lineitem JOIN part ON l_partkey=p_partkey)"


def _by_seq_confidence(rows):
    """Equal seq values are settled by the smaller confidence before the upsert sees them."""
    return rows.groupBy("name", "entity_type", "id", "seq").agg(F.min("confidence").alias("confidence"), F.flatten(F.sort_array(F.collect_set("source_chunk_ids"))).alias("source_chunk_ids"), F.flatten(F.sort_array(F.collect_set("evidence_quotes"))).alias("evidence_quotes"))


@query(f"WITH {_PROPOSED}, one AS (SELECT name, id, seq, min(confidence) confidence FROM proposed GROUP BY ALL) SELECT o.name, 'Part' entity_type, min(o.id) id, min_by(o.confidence, o.seq) confidence, min(o.seq) seq, (SELECT array_to_string(list_sort(list_distinct(list(p.chunk))), ',') FROM proposed p WHERE p.name=o.name) chunks FROM one o GROUP BY o.name")
def node_upsert(spark, sf_dir):
    found = graph.upsert_nodes(_by_seq_confidence(_proposed(spark, sf_dir)))
    return found.select("name", "entity_type", "id", "confidence", "seq", F.array_join("source_chunk_ids", ",").alias("chunks"))


@query(
    f"WITH {_PROPOSED}, f AS (SELECT name, min(seq) seq FROM proposed GROUP BY 1), q AS (SELECT p.name, chunk, quote, min(p.seq) seq FROM proposed p JOIN f ON p.name=f.name WHERE quote<>'' OR p.seq=f.seq GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq, chunk, quote) n FROM q) SELECT names.name, coalesce(string_agg(chunk||':'||quote, ',' ORDER BY n) FILTER (WHERE n<=8), '') quotes FROM (SELECT DISTINCT name FROM proposed) names LEFT JOIN r ON r.name=names.name GROUP BY 1"
)
def evidence_merge(spark, sf_dir):
    found = graph.upsert_nodes(_by_seq_confidence(_proposed(spark, sf_dir)))
    return found.select("name", F.array_join(F.transform("evidence_quotes", lambda q: F.concat_ws(":", q["chunk_id"], q["quote"])), ",").alias("quotes"))


@query(f"WITH {fx.SQL_DRAFT_EDGES} SELECT id, min(source_id) source_id, min(target_id) target_id, min(relation_type) relation_type, min(seq) seq, count(*) copies FROM draft_edges GROUP BY id")
def edge_upsert(spark, sf_dir):
    return graph.upsert_edges(fx.draft_edges(spark, sf_dir), "copies").select("id", "source_id", "target_id", "relation_type", "seq", "copies")


@query(f"WITH {fx.SQL_DRAFT_NODES}, links AS (SELECT 'n_'||substr(sha1('Part'||chr(9247)||p_name||'#'||p_partkey),1,24) id, list_distinct(list('ev_'||(l_orderkey%7))) cs FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_linenumber=2 GROUP BY 1) SELECT n.id, array_to_string(list_sort(list_distinct(list_concat(source_chunk_ids, coalesce(cs, [])))), ',') chunks FROM draft_nodes n LEFT JOIN links l ON n.id=l.id")
def provenance_link(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    links = line.select(node_id(F.lit("Part"), fx.part_name()).alias("id"), F.concat(F.lit("ev_"), (F.col("l_orderkey") % 7).cast("string")).alias("chunk_id"), F.lit("q").alias("quote"), F.lit(True).alias("verified"), F.col("l_orderkey").alias("seq"))
    return graph.link_provenance(fx.draft_nodes(spark, sf_dir), links).select("id", F.array_join("source_chunk_ids", ",").alias("chunks"))


_LEVELS = "(SELECT r_name region, n_name nation, s_name supplier, CASE WHEN s_suppkey%5=0 THEN '' ELSE 'seg'||(s_suppkey%3) END grade FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"


def _levels(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("s_name").alias("supplier"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("seg"), (F.col("s_suppkey") % 3).cast("string"))).alias("grade"))


@query(f"WITH l AS {_LEVELS} SELECT region source_name, nation target_name, 'region-nation' relation_type FROM l UNION SELECT nation, supplier, 'nation-supplier' FROM l UNION SELECT supplier, grade, 'supplier-grade' FROM l WHERE grade<>''")
def csv_hierarchy_graph(spark, sf_dir):
    return graph.hierarchy_graph(_levels(spark, sf_dir), ["region", "nation", "supplier", "grade"])[1]


@query(f"WITH l AS {_LEVELS} SELECT region AS name, 'region' entity_type FROM l UNION SELECT nation, 'nation' FROM l UNION SELECT supplier, 'supplier' FROM l UNION SELECT grade, 'grade' FROM l WHERE grade<>''")
def csv_hierarchy_nodes(spark, sf_dir):
    return graph.hierarchy_graph(_levels(spark, sf_dir), ["region", "nation", "supplier", "grade"])[0]


@query("SELECT (SELECT count(DISTINCT p_name) FROM part)-(SELECT count(DISTINCT p_name) FROM part WHERE p_partkey<=20) nodes_created, (SELECT count(DISTINCT p_name) FROM part WHERE p_partkey<=20) nodes_merged, (SELECT count(*) FROM (SELECT DISTINCT a.p_name, b.p_name FROM part a JOIN part b ON b.p_partkey=a.p_partkey+1 WHERE a.p_partkey%10<>0)) edges_created, (SELECT count(*) FROM part)-(SELECT count(*) FROM (SELECT DISTINCT a.p_name, b.p_name FROM part a JOIN part b ON b.p_partkey=a.p_partkey+1 WHERE a.p_partkey%10<>0)) edges_skipped, 0::BIGINT undeclared_nodes, (SELECT count(*) FROM (SELECT DISTINCT a.p_name, b.p_name FROM part a JOIN part b ON b.p_partkey=a.p_partkey+1 WHERE a.p_partkey%10<>0)) undeclared_edges")
def graph_import(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_name").alias("name"), F.lit("Part").alias("entity_type"), F.to_json(F.struct("p_brand")).alias("properties"), F.col("p_partkey").alias("seq"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    edges = part.join(after, "p_partkey", "left").select(F.col("p_name").alias("source_name"), F.when(F.col("p_partkey") % 10 == 0, "nobody").otherwise(F.col("next")).alias("target_name"), F.lit("before").alias("relation_type"), F.col("p_partkey").alias("seq"))
    old = part.where("p_partkey <= 20").select(node_id(F.lit("Part"), "p_name").alias("id")).distinct()
    return graph.import_graph(nodes, edges, old, *fx.ontology(spark))[2]


# ---- filters, schema and validation ------------------------------------------------------------------------------


@query(f"WITH {fx.SQL_NODES} SELECT id, name, entity_type FROM star_nodes WHERE contains(lower(name), 'er#00000000') ORDER BY name, id LIMIT 20")
def name_search(spark, sf_dir):
    return graph.search(fx.star_nodes(spark, sf_dir), "ER#00000000").select("id", "name", "entity_type")


@query(f"WITH {fx.SQL_NODES} SELECT entity_type, name, r::INT rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY seq) r FROM star_nodes) WHERE r<=5")
def type_samples(spark, sf_dir):
    return evolution.of_kind(fx.star_nodes(spark, sf_dir), "entity_type", 5).select("entity_type", "name", "rank")


@query(f"WITH {fx.sql_edges('in_region','in_nation')}, {fx.SQL_NODES} SELECT e.id, e.relation_type FROM star_edges e WHERE source_id IN (SELECT id FROM star_nodes WHERE seq%3<>0) AND target_id IN (SELECT id FROM star_nodes WHERE seq%3<>0)")
def graph_view(spark, sf_dir):
    nodes = fx.star_nodes(spark, sf_dir).where("seq % 3 <> 0")
    return graph.view(nodes, fx.star_edges(spark, sf_dir, ("in_region", "in_nation")))[1].select("id", "relation_type")


@query(f"WITH {fx.sql_edges('supplies','ordered')} SELECT source_id, target_id, max_by(relation_type, seq) relation_type, max(seq) seq FROM (SELECT source_id, target_id, relation_type, seq FROM star_edges UNION ALL SELECT source_id, target_id, 'near', seq+1 FROM star_edges WHERE seq%3=0) GROUP BY 1, 2")
def parallel_collapse(spark, sf_dir):
    rows = fx.star_edges(spark, sf_dir, ("supplies", "ordered"))
    near = F.struct(F.lit("near").alias("relation_type"), (F.col("seq") + 1).alias("seq"))
    copies = F.array(F.struct("relation_type", "seq"), F.when(F.col("seq") % 3 == 0, near))  # in one reading of the edges
    both = rows.select("source_id", "target_id", F.explode(F.filter(copies, lambda e: e.isNotNull())).alias("e"))
    return graph.last_parallel(both.select("source_id", "target_id", "e.relation_type", "e.seq"))


@query("SELECT * FROM (VALUES ('in_nation'), ('supplies')) t(name)")
def schema_prune(spark, sf_dir):
    return prune(*fx.ontology(spark), ["Supplier", "Part", "Nation"])[1].select("name")


@query("SELECT * FROM (VALUES ('ordered','source','Customer'), ('in_nation','source','Customer')) t(relation, side, type)")
def schema_consistency(spark, sf_dir):
    entities, relations = fx.ontology(spark)
    return undeclared_ends(relations, entities.where("name <> 'Customer'"))


@query("SELECT * FROM (VALUES ('in_region','Nation','Region'), ('in_nation','Customer/Supplier','Nation'), ('supplies','Supplier','Part'), ('ordered','Customer','Part'), ('near','*','*')) t(name, sources, targets)")
def constraint_format(spark, sf_dir):
    return fx.ontology(spark)[1].select("name", format_constraint(F.col("source_types")).alias("sources"), format_constraint(F.col("target_types")).alias("targets"))


@query("SELECT r.name relation, t.name AS type, r.name='near' OR list_contains(CASE r.name WHEN 'in_region' THEN ['Nation'] WHEN 'in_nation' THEN ['Customer','Supplier'] WHEN 'supplies' THEN ['Supplier'] ELSE ['Customer'] END, t.name) ok FROM (VALUES ('in_region'),('in_nation'),('supplies'),('ordered'),('near')) r(name), (VALUES ('Region'),('Nation'),('Customer'),('Supplier'),('Part')) t(name)")
def constraint_check(spark, sf_dir):
    entities, relations = fx.ontology(spark)
    pairs = relations.join(F.broadcast(entities.select(F.col("name").alias("type"))), F.lit(True))  # two declared lists
    return pairs.select(F.col("name").alias("relation"), "type", allows(F.col("source_types"), F.col("type")).alias("ok"))


@query("SELECT * FROM (VALUES ('Region','known'), ('Part','known'), ('Zone','added')) t(name, definition)")
def schema_merge(spark, sf_dir):
    known = spark.createDataFrame([("Region", "known"), ("Part", "known")], "name string, definition string")
    return merge_schema(known, spark.createDataFrame([("Part", "changed"), ("Zone", "added"), ("Zone", "added")], "name string, definition string"))


_ENTITY_PROPOSALS = "(SELECT event_id seq, CASE WHEN event_id%13=0 THEN '  ' ELSE 'user'||user_id END AS name, event_type entity_type FROM events)"


def _entity_proposals(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 13 == 0, "  ").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("name"), F.col("event_type").alias("entity_type"))


@query(f"SELECT seq, name, entity_type, CASE WHEN trim(name)='' THEN 'missing_name' WHEN entity_type NOT IN ('click','purchase','view') THEN 'entity_type_not_in_schema' END reason FROM {_ENTITY_PROPOSALS}")
def entity_validate(spark, sf_dir):
    kinds = spark.createDataFrame([("click",), ("purchase",), ("view",)], "name string")
    return fusion.validate_entities(_entity_proposals(spark, sf_dir), kinds).select("seq", "name", "entity_type", "reason")


@query(f"SELECT name, entity_type, min(seq) seq FROM {_ENTITY_PROPOSALS} WHERE trim(name)<>'' AND entity_type IN ('click','purchase') GROUP BY 1, 2")
def rule_correct(spark, sf_dir):
    rows = _entity_proposals(spark, sf_dir)
    none = spark.createDataFrame([], "source_name string, target_name string, relation_type string")
    return fusion.rule_correction(rows, none, ["click", "purchase"], [])[0].select("name", "entity_type", "seq")


_RELATION_PROPOSALS = "(SELECT l_orderkey*1000000+l_partkey*10+l_linenumber seq, s_name source_name, CASE WHEN l_orderkey%11=0 THEN 'nobody' WHEN l_orderkey%13=0 THEN s_name ELSE p_name||'#'||p_partkey END target_name, CASE WHEN l_orderkey%17=0 THEN 'sells' WHEN l_orderkey%19=0 THEN 'ordered' ELSE 'supplies' END relation_type FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey)"


@query(f"WITH {fx.SQL_NODES}, kinds AS (SELECT name, min_by(entity_type, seq) k FROM star_nodes GROUP BY 1) SELECT p.seq, p.relation_type, CASE WHEN p.relation_type='sells' THEN 'relation_type_not_in_schema' WHEN a.k IS NULL OR b.k IS NULL THEN 'endpoint_not_found' WHEN a.k<>CASE p.relation_type WHEN 'ordered' THEN 'Customer' ELSE 'Supplier' END THEN 'source_type_mismatch' WHEN b.k<>'Part' THEN 'target_type_mismatch' END reason FROM {_RELATION_PROPOSALS} p LEFT JOIN kinds a ON p.source_name=a.name LEFT JOIN kinds b ON p.target_name=b.name")
def relation_validate(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key = F.col("l_orderkey")
    rows = line.select(
        (key * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("s_name").alias("source_name"),
        F.when(key % 11 == 0, "nobody").when(key % 13 == 0, F.col("s_name")).otherwise(fx.part_name()).alias("target_name"),
        F.when(key % 17 == 0, "sells").when(key % 19 == 0, "ordered").otherwise("supplies").alias("relation_type"),
    )
    return fusion.validate_relations(rows, fx.star_nodes(spark, sf_dir), fx.ontology(spark)[1]).select("seq", "relation_type", "reason")


@query("WITH n AS (SELECT p_partkey, p_name||'/'||(p_partkey//128) nm, 'c'||(p_partkey%3) chunk, CASE WHEN p_partkey%2=0 THEN 'A' ELSE 'B' END k FROM part), m AS (SELECT p_partkey seq, p_name||'/'||(p_partkey//128) nm, 'c'||(p_partkey%5) chunk FROM part), j AS (SELECT m.seq, n.p_partkey, n.chunk=m.chunk here, n.k='A' fit FROM m LEFT JOIN n USING (nm)) SELECT seq, CASE WHEN count(p_partkey)=1 THEN min(p_partkey) WHEN count(*) FILTER (WHERE here)>0 THEN min(p_partkey) FILTER (WHERE here) WHEN count(*) FILTER (WHERE fit)=1 THEN min(p_partkey) FILTER (WHERE fit) END node FROM j GROUP BY seq")
def name_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit("/"), F.expr("p_partkey div 128").cast("string")))
    chunk = lambda n: F.concat(F.lit("c"), (F.col("p_partkey") % n).cast("string"))
    nodes = part.select("name", F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("entity_type"), F.array(chunk(3)).alias("source_chunk_ids"))
    wanted = part.select(F.col("p_partkey").alias("seq"), chunk(5).alias("chunk_id"), "name", F.array(F.lit("A")).alias("wanted_types"))
    return fusion.resolve_names(wanted, nodes).select("seq", F.col("node_id").alias("node"))


@query("SELECT event_id, (k IS NULL OR length(k)<2) missing_k, (v IS NULL OR length(v)<2) missing_v FROM (SELECT event_id, json_extract_string(props, '$.k') k, CASE WHEN event_id%3=0 THEN 'x' ELSE event_type END v FROM events)")
def structure_validate(spark, sf_dir):
    given = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("v"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_type")))
    rows = governance.structure_problems(table(spark, sf_dir, "events").select("event_id", given.alias("properties")), ["k", "v"])
    return rows.select("event_id", F.array_contains("missing", "k").alias("missing_k"), F.array_contains("missing", "v").alias("missing_v"))


_WITHOUT = r"regexp_replace({}, '\s+', '', 'g')"


@query(f"SELECT d.doc_id, b.item_id, contains({_WITHOUT.format('d.text')}, {_WITHOUT.format('substr(trim(b.text),1,300)')}) verified FROM documents d JOIN benchmark b ON d.doc_id%(SELECT count(*) FROM benchmark)=b.item_id")
def evidence_verify(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    pairs = table(spark, sf_dir, "documents").join(items.withColumnRenamed("text", "quote"), F.col("doc_id") % n == F.col("item_id"))
    stored = resolution.evidence(F.col("doc_id").cast("string"), F.array("quote"), F.col("text"), resolution.evidence_mode(F.lit("surface")))
    return pairs.select("doc_id", "item_id", F.get(stored, F.lit(0))["verified"].alias("verified"))


@query(f"WITH {fx.SQL_DRAFT_NODES} SELECT id, has_quote AND coalesce(verified, true) ok FROM draft_nodes")
def evidence_has_verified(spark, sf_dir):
    return fx.draft_nodes(spark, sf_dir).select("id", graph.has_verified(F.col("evidence_quotes")).alias("ok"))


# ---- gate, publishing and review ---------------------------------------------------------------------------------


def _gated(spark, sf_dir):
    return graph.gate(fx.draft_nodes(spark, sf_dir), fx.draft_edges(spark, sf_dir), *fx.ontology(spark), require_evidence=True)


@query(f"WITH {fx.SQL_GATE} SELECT id, seq, violation FROM judged_edges")
def publish_gate(spark, sf_dir):
    return _gated(spark, sf_dir)[1].select("id", "seq", "violation")


@query(f"WITH {fx.SQL_GATE} SELECT 'node' kind, coalesce(violation,'ok') violation, count(*) n FROM judged_nodes GROUP BY ALL UNION ALL SELECT 'edge', coalesce(violation,'ok'), count(*) FROM judged_edges GROUP BY ALL")
def gate_report(spark, sf_dir):
    return graph.gate_report(*_gated(spark, sf_dir))


@query(f"WITH {fx.SQL_DRAFT_NODES}, {fx.SQL_DRAFT_EDGES} SELECT id, seq FROM draft_edges WHERE source_id IN (SELECT id FROM draft_nodes) AND target_id IN (SELECT id FROM draft_nodes)")
def publish_copy(spark, sf_dir):
    return graph.publish(fx.draft_nodes(spark, sf_dir), fx.draft_edges(spark, sf_dir))[1].select("id", "seq")


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region','in_nation','supplies')}, gone AS (SELECT id FROM star_nodes WHERE seq%10=3) SELECT id FROM star_edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def cascade_delete(spark, sf_dir):
    nodes = fx.star_nodes(spark, sf_dir)
    return graph.remove_nodes(nodes, fx.star_edges(spark, sf_dir, ("in_region", "in_nation", "supplies")), nodes.where("seq % 10 = 3"))[1].select("id")


@query(f"WITH {fx.SQL_DRAFT_NODES} SELECT d.id, CASE WHEN p.id IS NULL THEN 'new' WHEN p.entity_type<>d.entity_type THEN 'changed' ELSE 'unchanged' END change FROM draft_nodes d LEFT JOIN (SELECT * FROM star_nodes WHERE seq%4<>0) p ON d.id=p.id")
def draft_diff(spark, sf_dir):
    return governance.draft_diff(fx.draft_nodes(spark, sf_dir), fx.star_nodes(spark, sf_dir).where("seq % 4 <> 0"), ["name", "entity_type"]).select("id", "change")


_QUEUE = f"""WITH {fx.SQL_GATE}, queue AS (SELECT d.id, d.entity_type, d.violation, d.confidence, NOT d.has_quote OR coalesce(d.verified, true) verified, len(list_filter(d.source_chunk_ids, lambda x: x<>'cold_start'))::INT n_support,
 CASE WHEN p.id IS NULL THEN 'new' WHEN p.entity_type<>d.entity_type THEN 'changed' ELSE 'unchanged' END change FROM judged_nodes d LEFT JOIN (SELECT * FROM star_nodes WHERE seq%4<>0) p ON d.id=p.id)"""


def _queue(spark, sf_dir):
    return governance.review_queue(_gated(spark, sf_dir)[0], fx.star_nodes(spark, sf_dir).where("seq % 4 <> 0"))


@query(f"{_QUEUE} SELECT id, change, violation, verified, confidence, n_support FROM queue WHERE change<>'unchanged'")
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("id", "change", "violation", "verified", "confidence", "n_support")


@query(f"{_QUEUE} SELECT count(*) total, count(*) pending, count(*) FILTER (WHERE violation IS NOT NULL) with_violations, count(*) FILTER (WHERE NOT verified) unverified FROM queue WHERE change<>'unchanged'")
def review_stats(spark, sf_dir):
    return governance.review_totals(_queue(spark, sf_dir))


@query(f"{_QUEUE} SELECT id, violation IS NOT NULL OR (entity_type='Part' AND n_support<2) OR NOT verified OR confidence<0.8 high_risk FROM queue WHERE change<>'unchanged'")
def high_risk(spark, sf_dir):
    return governance.high_risk(_queue(spark, sf_dir), ["Part"]).select("id", "high_risk")


@query(f"WITH {fx.SQL_DRAFT_EDGES} SELECT relation_type, count(*) n FROM draft_edges GROUP BY 1")
def predicate_freq(spark, sf_dir):
    return fusion.predicate_frequency(fx.draft_edges(spark, sf_dir))


@query(f"WITH {fx.SQL_DRAFT_NODES}, u AS (SELECT entity_type, name FROM draft_nodes UNION ALL SELECT event_type, 'user'||user_id FROM events WHERE event_id%9=0), m AS (SELECT * FROM u WHERE entity_type NOT IN ('Region','Nation','Customer','Supplier','Part')), d AS (SELECT DISTINCT entity_type, name FROM m), e AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY name) r FROM d) SELECT m.entity_type, count(*) n, (SELECT string_agg(name, '|' ORDER BY name) FROM e WHERE e.entity_type=m.entity_type AND r<=5) examples FROM m GROUP BY 1")
def schema_gaps(spark, sf_dir):
    rejected = table(spark, sf_dir, "events").where("event_id % 9 = 0").select(F.col("event_type").alias("entity_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))
    return governance.schema_gaps(fx.draft_nodes(spark, sf_dir), rejected, fx.ontology(spark)[0])


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges()}, c AS (SELECT e.relation_type, a.entity_type source_type, b.entity_type target_type, count(*) n FROM star_edges e JOIN star_nodes a ON e.source_id=a.id JOIN star_nodes b ON e.target_id=b.id GROUP BY ALL) SELECT relation_type, source_type, target_type, n FROM (SELECT *, row_number() OVER (PARTITION BY relation_type ORDER BY n DESC, source_type, target_type) r FROM c) WHERE r=1")
def relation_mode_pairs(spark, sf_dir):
    return governance.relation_ends(fx.star_edges(spark, sf_dir), fx.star_nodes(spark, sf_dir)).select("relation_type", "source_type", "target_type", "n")


@query("SELECT CASE WHEN grouping(reason)=0 THEN 'reason' WHEN grouping(kind)=0 THEN 'type' ELSE 'total' END \"level\", reason, kind, item_type, count(*) n FROM (SELECT event_type reason, CASE WHEN event_id%2=0 THEN 'entity' ELSE 'relation' END kind, 't'||(user_id%7) item_type FROM events) GROUP BY GROUPING SETS ((), (reason), (kind, item_type))")
def rejected_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), F.when(F.col("event_id") % 2 == 0, "entity").otherwise("relation").alias("kind"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("item_type"))
    return governance.rejected_stats(rows)


_SUPPORT = "(SELECT source, count(quality)::BIGINT n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)"


def _support(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("quality").alias("n"))


@query(f"SELECT source, n, CASE WHEN n<=0 THEN 1.0 ELSE round(least(0.95, 1-0.5/n), 3) END::DOUBLE confidence FROM {_SUPPORT}")
def support_confidence_i(spark, sf_dir):
    return _support(spark, sf_dir).select("source", "n", governance.confidence_one(F.lit(1.0), F.col("n")).alias("confidence"))


@query(f"SELECT source, n, CASE WHEN n=0 THEN 1.0 ELSE round(least(1.0, n/3), 3) END::DOUBLE confidence FROM {_SUPPORT}")
def support_confidence_ii(spark, sf_dir):
    return _support(spark, sf_dir).select("source", "n", governance.confidence_two(F.lit(1.0), F.col("n")).alias("confidence"))


@query("WITH p AS (SELECT DISTINCT lower(s_name) s, lower(p_name) t FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey WHERE l_linenumber<=3), g AS (SELECT DISTINCT lower(s_name) s, lower(p_name) t FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey WHERE l_linenumber>=3), c AS (SELECT (SELECT count(*) FROM p) np, (SELECT count(*) FROM g) ng, (SELECT count(*) FROM p JOIN g USING (s,t)) nh) SELECT np n_predicted, ng n_gold, nh n_hit, round(nh/np,4) AS precision, round(nh/ng,4) recall, round(2*nh/(np+ng),4) f1 FROM c")
def factextract_f1(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    triple = lambda df: df.select(F.concat(F.lit(" "), F.col("s_name")).alias("source"), F.lit("Supplies").alias("relation"), F.upper("p_name").alias("target"))
    return governance.f1(triple(line.where("l_linenumber <= 3")), triple(line.where("l_linenumber >= 3")))


@query("SELECT source, count(*) facts, sum(CASE WHEN quality=1 THEN 1 ELSE 0 END)::BIGINT supported, round(least(1, sum(CASE WHEN quality=1 THEN 1 ELSE 0 END)/count(*)), 4)::DOUBLE retention FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def retention(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return governance.retention(joined.withColumn("supported", F.coalesce(F.col("quality") == 1, F.lit(False))), "source")


@query(f"WITH {fx.SQL_DRAFT_NODES} SELECT t.name entity_type FROM (VALUES ('Region'),('Nation'),('Customer'),('Supplier'),('Part'),('Zone'),('Gadget')) t(name) WHERE t.name NOT IN (SELECT entity_type FROM draft_nodes)")
def underused_types(spark, sf_dir):
    declared = spark.createDataFrame([(n,) for n in ("Region", "Nation", "Customer", "Supplier", "Part", "Zone", "Gadget")], "name string")
    return governance.type_usage(fx.draft_nodes(spark, sf_dir), declared).where("n = 0").select("entity_type")


@query("SELECT event_type project_id, user_id%10 run_id, sum(event_id%100)::BIGINT prompt_tokens, sum(event_id%7)::BIGINT completion_tokens, sum(event_id%100+event_id%7)::BIGINT total_tokens, count(*) calls FROM events GROUP BY ALL")
def token_usage(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("project_id"), (F.col("user_id") % 10).alias("run_id"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))
    return governance.token_usage(calls)


@query("SELECT source, sum((length(text)-1)//400+1)::BIGINT n_chunks, sum((length(text)-1)//400+1)::BIGINT*4 calls, sum((length(text)-1)//400+1)::BIGINT*4*2125 input_tokens, sum((length(text)-1)//400+1)::BIGINT*4*600 output_tokens FROM documents WHERE text<>'' GROUP BY 1")
def run_cost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    profile = docs.groupBy("source").agg(F.sum(F.expr("(length(text) - 1) div 400 + 1")).alias("n_chunks"))
    return governance.run_cost(profile, extras=1, inductive=True)


@query("SELECT * FROM (SELECT user_id run_id, event_id seq, event_id%50 tokens, coalesce(sum(event_id%50) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT spent FROM events) WHERE spent<500")
def budget_cutoff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("tokens"))
    return governance.within_budget(rows, 500)


@query("WITH n AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id)-1)::INT position, count(*) OVER (PARTITION BY source) len FROM documents) SELECT source, doc_id, position FROM n WHERE len<=7 OR position IN (SELECT floor(i*len/7)::INT FROM range(7) t(i))")
def stride_sample(spark, sf_dir):
    return governance.stride_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 7).select("source", "doc_id", "position")


@query("WITH n AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id)-1)::INT position, count(*) OVER (PARTITION BY source) len FROM documents) SELECT source, doc_id, position FROM n WHERE position IN (SELECT round_even(i*(len-1)/4, 0)::INT FROM range(5) t(i))")
def within_file_sample(spark, sf_dir):
    return governance.even_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5).select("source", "doc_id", "position")


@query("WITH s AS (SELECT lang, count(*) len, sum(count(*)) OVER () a, count(*) OVER () g FROM documents GROUP BY 1), q AS (SELECT lang, len, 2+round_even((60-2*g)*len/a, 0)::INT quota FROM s), n AS (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id)-1)::INT position FROM documents) SELECT lang, doc_id, position FROM n JOIN q USING (lang) WHERE len<=quota OR list_contains(list_transform(range(quota), lambda i: round_even(i*((len-1)/greatest(1, quota-1)), 0)::INT), position)")
def stratified_sample(spark, sf_dir):
    return governance.stratified_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 60).select("lang", "doc_id", "position")


# ---- structure and bridge layers ---------------------------------------------------------------------------------


def _chunks(spark, sf_dir):
    cut = chunking.windows(table(spark, sf_dir, "documents")).select("doc_id", "idx", chunk_id(F.col("doc_id"), F.col("idx")).alias("chunk_id"))
    path = F.when(F.col("idx") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Top"), F.concat(F.lit("Part "), F.expr("idx div 4").cast("string"))))
    return cut.withColumn("heading_path", path)


_CHUNK_ID = "'c_'||substr(sha1(doc_id||chr(9247)||idx),1,24)"
_CHUNKS = f"chunks AS (SELECT doc_id, idx, {_CHUNK_ID} chunk_id, CASE WHEN idx%3<>0 THEN 'sec_'||substr(sha1(doc_id||chr(9247)||'Top'||chr(9247)||'Part '||(idx//4)),1,24) END sec FROM (SELECT doc_id, unnest(range(0, (length(text)-1)//400+1)) idx FROM documents WHERE trim(text)<>''))"
_EDGE = "'e_'||substr(sha1(source_id||chr(9247)||relation_type||chr(9247)||target_id),1,24) id, source_id, target_id, relation_type"


@query(f"WITH {_CHUNKS} SELECT {_EDGE} FROM (SELECT chunk_id source_id, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY idx) target_id, '下一段' relation_type FROM chunks) WHERE target_id IS NOT NULL")
def next_segment(spark, sf_dir):
    return structure.next_segments(_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT DISTINCT {_EDGE} FROM (SELECT lag(sec) OVER (PARTITION BY doc_id ORDER BY idx) source_id, sec target_id, '下一节' relation_type FROM chunks WHERE sec IS NOT NULL) WHERE source_id<>target_id")
def section_chain(spark, sf_dir):
    return structure.section_chain(_chunks(spark, sf_dir))


_SECTION = "'sec_'||substr(sha1(doc_id||chr(9247)||{}),1,24)"


@query(
    f"WITH {_CHUNKS}, s AS (SELECT DISTINCT doc_id, idx//4 k FROM chunks WHERE sec IS NOT NULL), d AS (SELECT *, 'doc_'||substr(doc_id::VARCHAR,1,24) doc FROM chunks) SELECT {_EDGE} FROM (SELECT chunk_id source_id, doc target_id, '属于文档' relation_type FROM d WHERE sec IS NULL UNION ALL SELECT chunk_id, sec, '属于章节' FROM d WHERE sec IS NOT NULL UNION ALL SELECT DISTINCT {_SECTION.format("'Top'")}, doc, '属于文档' FROM d WHERE sec IS NOT NULL UNION ALL SELECT {_SECTION.format("'Top'||chr(9247)||'Part '||k")}, {_SECTION.format("'Top'")}, '属于章节' FROM s)"
)
def chunk_membership(spark, sf_dir):
    return structure.membership(_chunks(spark, sf_dir))


_BRIDGE = f"WITH {fx.SQL_DRAFT_NODES}, u AS (SELECT id, unnest(list_distinct(['k'||(seq//4), CASE WHEN seq%5=0 THEN 'k'||(seq//4+1) ELSE 'cold_start' END])) chunk_id FROM draft_nodes), bridge_chunks AS (SELECT DISTINCT 'k'||(seq//4) chunk_id, seq//4 k FROM draft_nodes)"


def _bridge_nodes(spark, sf_dir):
    """Draft nodes, four to a chunk and some in the next one too, however many there are."""
    quarter = F.expr("seq div 4")
    more = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("k"), (quarter + 1).cast("string"))).otherwise(F.lit("cold_start"))
    return fx.draft_nodes(spark, sf_dir).withColumn("source_chunk_ids", F.array_distinct(F.array(F.concat(F.lit("k"), quarter.cast("string")), more)))


def _bridge_chunks(spark, sf_dir):
    k = F.expr("seq div 4")
    return fx.draft_nodes(spark, sf_dir).select(F.concat(F.lit("k"), k.cast("string")).alias("chunk_id"), (k % 97).alias("doc_id"), k.alias("idx")).distinct()


@query(f"{_BRIDGE} SELECT {_EDGE} FROM (SELECT DISTINCT id source_id, CASE WHEN k%7=0 THEN chunk_id ELSE chunk_id||'_seg' END target_id, '提及于' relation_type FROM u JOIN bridge_chunks USING (chunk_id))")
def mention_edges(spark, sf_dir):
    nodes = _bridge_nodes(spark, sf_dir)
    named = nodes.withColumn("source_chunk_ids", F.filter("source_chunk_ids", lambda c: F.coalesce(F.substring(c, 2, 20).try_cast("bigint") % 7 != 0, F.lit(True))))
    return structure.mentions(nodes, structure.anchors(_bridge_chunks(spark, sf_dir), named)).select("id", "source_id", "target_id", "relation_type")


@query(f"{_BRIDGE}, d AS (SELECT DISTINCT id, chunk_id FROM u), k AS (SELECT chunk_id FROM d GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10), {fx.sql_edges('in_region','in_nation')}, p AS (SELECT a.id source_id, b.id target_id, '共现' relation_type, min(a.chunk_id) chunk FROM d a JOIN d b ON a.chunk_id=b.chunk_id AND a.id<b.id WHERE a.chunk_id IN (SELECT chunk_id FROM k) GROUP BY 1, 2) SELECT {_EDGE}, chunk, 0.3::DOUBLE confidence FROM p WHERE NOT EXISTS (SELECT 1 FROM star_edges e WHERE e.source_id=p.source_id AND e.target_id=p.target_id) AND NOT EXISTS (SELECT 1 FROM star_edges e WHERE e.source_id=p.target_id AND e.target_id=p.source_id)")
def cooccur_edges(spark, sf_dir):
    found = structure.co_occurrences(_bridge_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, ("in_region", "in_nation")))
    return found.select("id", "source_id", "target_id", "relation_type", F.col("source_chunk_ids")[0].alias("chunk"), "confidence")


# ---- similarity, clustering and vectors --------------------------------------------------------------------------


@query()
def name_similarity_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"), F.lit("Part").alias("entity_type"))
    return fusion.fuzzy_candidates(queries, fx.star_nodes(spark, sf_dir))


@query()
def chunk_similarity_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = chunking.windows(table(spark, sf_dir, "documents")).select(chunk_id(F.col("doc_id"), F.col("idx")).alias("id"), "chunk")
    return retrieval.chunk_top(queries, chunks)


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT query_id, id, score, rank::INT rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM (SELECT a.vec_id query_id, b.vec_id id, round({_COS}, 6) score FROM embeddings a, embeddings b WHERE a.vec_id%50=0)) WHERE rank<=20 AND score>=0.5")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.vector_top(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), rows)


@query(f'SELECT a.label "group", a.vec_id a, b.vec_id b, round({_COS}, 6) score FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<b.vec_id WHERE round({_COS}, 6)>=0.35')
def vector_self_join(spark, sf_dir):
    """At a cosine that unrelated vectors of the tables sometimes have."""
    return fusion.vector_pairs(table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "embedding"), 0.35)


@query()
def name_clusters(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("entity_type"), F.col("p_name").alias("name")).distinct()
    return fusion.name_clusters(names)


@query()
def predicate_clusters(spark, sf_dir):
    return merging.predicate_clusters(fx.draft_edges(spark, sf_dir))


@query(f"WITH {fx.sql_edges('supplies')}, m AS (SELECT 'n_'||substr(sha1('Part'||chr(9247)||p_name||'#'||p_partkey),1,24) id, min('n_'||substr(sha1('Part'||chr(9247)||p_name||'#'||p_partkey),1,24)) OVER (PARTITION BY p_name) g FROM part) SELECT source_id, g target_id, relation_type, min(seq) seq, min_by(star_edges.id, seq) id FROM star_edges JOIN m ON target_id=m.id GROUP BY source_id, g, relation_type")
def edge_redirect(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select("p_name", node_id(F.lit("Part"), fx.part_name()).alias("id"))
    into = ids.groupBy("p_name").agg(F.min("id").alias("into"))
    return fusion.redirect(fx.star_edges(spark, sf_dir, ("supplies",)), ids.join(into, "p_name").select("id", "into")).select("source_id", "target_id", "relation_type", "seq", "id")


# ---- traversal ---------------------------------------------------------------------------------------------------


def _seed(spark, sf_dir, kind: str, n: int = 2):
    return fx.star_nodes(spark, sf_dir).where(F.col("entity_type") == kind).orderBy("seq").limit(n)


def _reach(direction: str, kind: str, depth: int) -> str:
    move = {"down": "e.source_id=w.id", "up": "e.target_id=w.id", "both": "(e.source_id=w.id OR e.target_id=w.id)"}[direction]
    to = {"down": "e.target_id", "up": "e.source_id", "both": "CASE WHEN e.source_id=w.id THEN e.target_id ELSE e.source_id END"}[direction]
    return f"WITH RECURSIVE {fx.SQL_NODES}, {fx.sql_edges('in_region', 'in_nation', 'supplies')}, w AS (SELECT id, 0 depth FROM (SELECT id FROM star_nodes WHERE entity_type='{kind}' ORDER BY seq LIMIT 2) UNION SELECT {to}, w.depth+1 FROM w JOIN star_edges e ON {move} WHERE w.depth<{depth})"


_KINDS = ("in_region", "in_nation", "supplies")


@query(f"{_reach('down', 'Supplier', 2)} SELECT id, min(depth)::INT depth FROM w GROUP BY 1")
def subgraph_down(spark, sf_dir):
    return traversal.neighbourhood(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, _KINDS), _seed(spark, sf_dir, "Supplier"), 2, "down")


@query(f"{_reach('up', 'Region', 2)} SELECT id, min(depth)::INT depth FROM w GROUP BY 1")
def subgraph_up(spark, sf_dir):
    return traversal.neighbourhood(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, _KINDS), _seed(spark, sf_dir, "Region"), 2, "up")


@query(f"{_reach('both', 'Supplier', 2)} SELECT id, min(depth)::INT depth FROM w GROUP BY 1")
def subgraph_both(spark, sf_dir):
    return traversal.neighbourhood(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, _KINDS), _seed(spark, sf_dir, "Supplier"), 2, "both")


@query(f"{_reach('up', 'Region', 2)}, v AS (SELECT DISTINCT id FROM w) SELECT e.id FROM star_edges e WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)")
def induced_edges(spark, sf_dir):
    edges = fx.star_edges(spark, sf_dir, _KINDS)
    return traversal.induced(edges, traversal.neighbourhood(fx.star_nodes(spark, sf_dir), edges, _seed(spark, sf_dir, "Region"), 2, "up")).select("id")


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region', 'in_nation', 'supplies')}, s AS (SELECT id FROM star_nodes WHERE entity_type='Supplier' ORDER BY seq LIMIT 2), d AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) n FROM star_edges), u AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq) n FROM star_edges) SELECT DISTINCT source_id, target_id, relation_type, 1 AS \"level\" FROM (SELECT * FROM d WHERE source_id IN (SELECT id FROM s) UNION ALL SELECT * FROM u WHERE target_id IN (SELECT id FROM s)) WHERE n<=15")
def bfs_fanout(spark, sf_dir):
    return traversal.fan_out_bfs(fx.star_edges(spark, sf_dir, _KINDS), _seed(spark, sf_dir, "Supplier"), 1)


@query()
def directional_bfs(spark, sf_dir):
    return traversal.fan_out_bfs(fx.star_edges(spark, sf_dir, _KINDS), _seed(spark, sf_dir, "Nation"), 3, directed=True)


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region', 'in_nation')} SELECT a.source_id||'>'||a.target_id||'>'||b.target_id AS path FROM star_edges a JOIN star_edges b ON a.target_id=b.source_id WHERE a.source_id IN (SELECT id FROM star_nodes WHERE entity_type='Supplier' ORDER BY seq LIMIT 5) AND b.target_id IN (SELECT id FROM star_nodes WHERE entity_type='Region' ORDER BY seq LIMIT 3)")
def simple_paths(spark, sf_dir):
    found = traversal.simple_paths(fx.star_edges(spark, sf_dir, ("in_region", "in_nation")), _seed(spark, sf_dir, "Supplier", 5), _seed(spark, sf_dir, "Region", 3), 3)
    return found.select(F.array_join("path", ">").alias("path"))


def _rank_sql(rounds: int) -> str:
    out = [f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region', 'in_nation', 'supplies')}, e AS MATERIALIZED (SELECT DISTINCT source_id s, target_id t, count(*) OVER (PARTITION BY source_id) n FROM (SELECT DISTINCT source_id, target_id FROM star_edges)), b AS MATERIALIZED (SELECT id, CASE WHEN id IN (SELECT id FROM star_nodes WHERE entity_type='Supplier' ORDER BY seq LIMIT 4) THEN 0.25 ELSE 0 END::DOUBLE p FROM star_nodes), r0 AS MATERIALIZED (SELECT id, p r FROM b)"]
    for i in range(rounds):
        out.append(f"f{i} AS MATERIALIZED (SELECT t, sum(r/n) f FROM e JOIN r{i} ON s=id GROUP BY t), r{i + 1} AS MATERIALIZED (SELECT b.id, 0.85*(coalesce(f,0)+(1-(SELECT coalesce(sum(f),0) FROM f{i}))*p)+0.15*p r FROM b LEFT JOIN f{i} ON b.id=t)")
    return ", ".join(out) + f" SELECT id, round(r, 9) AS rank FROM r{rounds} WHERE r>0"


@query(_rank_sql(8))
def ppr(spark, sf_dir):
    """A fixed number of rounds, as SQL can follow it; ``ppr_quotas`` runs until ranks settle."""
    ranks = traversal.personalised_pagerank(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, _KINDS), _seed(spark, sf_dir, "Supplier", 4), iterations=8, tolerance=0)
    return ranks.where("rank > 0").select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH {fx.SQL_NODES}, {fx.sql_edges('in_region', 'in_nation')}, up AS (SELECT source_id s, target_id t FROM star_edges), r AS (SELECT n.id, coalesce(b.t, a.t, CASE WHEN n.entity_type='Region' THEN n.id END, n.id) root FROM star_nodes n LEFT JOIN up a ON n.id=a.s LEFT JOIN up b ON a.t=b.s) SELECT id, min(id) OVER (PARTITION BY root) component FROM r")
def connected_components(spark, sf_dir):
    return traversal.connected_components(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, ("in_region", "in_nation")))


@query()
def communities(spark, sf_dir):
    return traversal.communities(fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, ("in_region", "in_nation")))


@query()
def community_summary(spark, sf_dir):
    nodes = fx.star_nodes(spark, sf_dir)
    return traversal.community_summary(traversal.communities(nodes, fx.star_edges(spark, sf_dir, ("in_region", "in_nation"))), nodes)


# ---- retrieval, sessions and increments --------------------------------------------------------------------------


def _hint_sql(hints: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(text,'{h}')" for h in hints) + ")"


@query(f"SELECT item_id, mode, CASE mode WHEN 'hippo' THEN 6 WHEN 'graph_flow' THEN 5 ELSE 0 END::INT entity_k, CASE mode WHEN 'global' THEN 3 ELSE 6 END::INT max_chunks FROM (SELECT item_id, CASE WHEN {_hint_sql(retrieval.GLOBAL_HINTS)} THEN 'global' WHEN {_hint_sql(retrieval.MULTI_HOP_HINTS)} AND item_id%3>0 THEN 'hippo' WHEN item_id%3>0 THEN 'graph_flow' ELSE 'text_only' END mode FROM (SELECT item_id, CASE item_id%4 WHEN 0 THEN text||' overview' WHEN 1 THEN text||'之间' ELSE text END text FROM benchmark))")
def route_query(spark, sf_dir):
    asked = F.concat("text", F.when(F.col("item_id") % 4 == 0, " overview").when(F.col("item_id") % 4 == 1, "之间").otherwise(""))
    queries = table(spark, sf_dir, "benchmark").select("item_id", asked.alias("query"), (F.col("item_id") % 3).alias("n_entities"))
    return retrieval.route(queries, has_communities=True).select("item_id", "mode", "entity_k", "max_chunks")


@query()
def graph_context(spark, sf_dir):
    nodes, edges = fx.star_nodes(spark, sf_dir), fx.star_edges(spark, sf_dir, _KINDS)
    seeds = nodes.where("entity_type = 'Supplier' AND seq % 50 = 0").select(F.col("seq").alias("seed"), "id")
    walked = traversal.fan_out_bfs(edges, seeds, 2, by=("seed",))
    queries = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = chunking.windows(table(spark, sf_dir, "documents")).select(chunk_id(F.col("doc_id"), F.col("idx")).alias("id"), "chunk")
    top = chunks.join(small(materialize(retrieval.chunk_top(queries, chunks))), "id")
    return retrieval.context(walked, nodes, top, 20, 6)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations WHERE role<>'system') WHERE r<=10")
def history_window(spark, sf_dir):
    return governance.history(table(spark, sf_dir, "conversations"))


@query(r"SELECT page_id, CASE WHEN s='' THEN 'default' ELSE s END session FROM (SELECT page_id, substr(regexp_replace(url, '[^\p{L}\p{N}_-]', '', 'g'), 1, 64) s FROM pages)")
def session_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.safe_session(F.col("url")).alias("session"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delta_docs(spark, sf_dir):
    return unprocessed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"))


@query("SELECT user_id, max_by(event_type, event_id) event_type, max(event_id) seq FROM events GROUP BY 1")
def incremental_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    return upsert_batch(rows.where("seq % 3 > 0"), rows.where("seq % 3 = 0"), ["user_id"])


@query("SELECT c_custkey, substr(c_name,1,4)||repeat('*', length(c_name)-8)||substr(c_name, length(c_name)-3) masked FROM customer")
def secret_mask(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.mask_secret(F.col("c_name")).alias("masked"))


@query(f"WITH {fx.sql_edges('in_region')}, {fx.SQL_NODES} SELECT '['||a.name||'] --('||relation_type||')--> ['||b.name||']' line FROM star_edges JOIN star_nodes a ON source_id=a.id JOIN star_nodes b ON target_id=b.id")
def triple_format(spark, sf_dir):
    name = fx.star_nodes(spark, sf_dir).select("id", "name")
    rows = fx.star_edges(spark, sf_dir, ("in_region",)).join(name.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(name.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
    return rows.select(fn.format_triple(F.col("s"), F.col("relation_type"), F.col("t")).alias("line"))


@query("SELECT event_id, props FROM events WHERE json_valid(props)")
def json_salvage(spark, sf_dir):
    wrapped = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise(F.col("props")).alias("said"))
    return wrapped.select("event_id", F.trim(fn.salvage_json(F.regexp_replace("said", "\n", " "))).alias("props"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_newest(spark, sf_dir):
    return governance.newest(table(spark, sf_dir, "events"), 50, "ts", "event_id").select("event_id", "event_type", "user_id")


@query(f"WITH {fx.sql_edges('in_region','in_nation')} SELECT id, count(*) degree FROM (SELECT source_id id FROM star_edges UNION ALL SELECT target_id FROM star_edges) GROUP BY 1")
def node_degree(spark, sf_dir):
    return governance.degrees(fx.star_edges(spark, sf_dir, ("in_region", "in_nation")))


# ---- flagship ----------------------------------------------------------------------------------------------------

_WORDS = ("the", "that", "und", "der", "que", "les", "con", "los")
_WORD_LIST = ", ".join(f"('{w}')" for w in _WORDS)


@query(
    f"WITH c AS (SELECT doc_id, s//400 idx, substr(text, s+1, 500) chunk, lang FROM (SELECT doc_id, lang, text, unnest(range(0, length(text), 400)) s FROM documents WHERE trim(text)<>'')), p AS (SELECT DISTINCT doc_id, idx, w AS name, upper(lang) entity_type FROM (SELECT *, unnest(list_distinct(string_split(lower(chunk), ' '))) w FROM c) WHERE w IN (VALUES {_WORD_LIST})), v AS (SELECT * FROM p WHERE entity_type<>'ES'), n AS (SELECT name, entity_type, count(*) n_chunks FROM v GROUP BY ALL) SELECT entity_type, count(*) n_nodes, sum(n_chunks)::BIGINT n_mentions FROM n GROUP BY 1"
)
def flagship(spark, sf_dir):
    """documents -> window chunks -> rule proposals -> validation -> nodes by key, counted -> gate -> counts by type.

    A proposed word is cut out of its chunk, so there is no evidence to check; only counts are asked for, so neither quotes
    nor chunk lists are gathered, which ``upsert_nodes`` does for drafts that are stored."""
    chunks = chunking.windows(table(spark, sf_dir, "documents"), keep=("lang",))
    words = F.array_intersect(F.array_distinct(F.split(F.lower("chunk"), " ")), F.array(*map(F.lit, _WORDS)))
    proposed = chunks.select("doc_id", "idx", F.upper("lang").alias("entity_type"), F.explode(words).alias("name"))
    kinds = spark.createDataFrame([("EN",), ("DE",), ("FR",)], "name string")
    valid = fusion.validate_entities(proposed, kinds).where("reason IS NULL")
    nodes = valid.groupBy("name", "entity_type").agg(F.count("*").alias("n_chunks")).withColumn("id", node_id("entity_type", "name"))
    gated = graph.judge_nodes(nodes, kinds).where("violation IS NULL")
    return gated.groupBy("entity_type").agg(F.count("*").alias("n_nodes"), F.sum("n_chunks").alias("n_mentions"))
