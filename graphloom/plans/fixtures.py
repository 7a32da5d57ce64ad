"""The star schema as a property graph, and drafts with defects by key; the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import QUOTES, edge_id, node_id
from graphloom.session import dealt, table

ENTITIES = [("Region", "surface"), ("Nation", "surface"), ("Customer", "surface"), ("Supplier", "normalized"), ("Part", "inductive")]
RELATIONS = [("in_region", ["Nation"], ["Region"]), ("in_nation", ["Customer", "Supplier"], ["Nation"]), ("supplies", ["Supplier"], ["Part"]), ("ordered", ["Customer"], ["Part"]), ("near", [], [])]


def ontology(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(ENTITIES, "name string, abstractness string"), spark.createDataFrame(RELATIONS, "name string, source_types array<string>, target_types array<string>")


def part_name() -> Column:
    return F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, entity_type, seq."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, name, kind, seq: df.select(name.alias("name"), F.lit(kind).alias("entity_type"), seq.cast("bigint").alias("seq"))
    rows = row(t("region"), F.col("r_name"), "Region", F.col("r_regionkey"))
    rows = rows.union(row(t("nation"), F.col("n_name"), "Nation", 100 + F.col("n_nationkey")))
    rows = rows.union(row(t("customer"), F.col("c_name"), "Customer", 1_000_000_000 + F.col("c_custkey")))
    rows = rows.union(row(t("supplier"), F.col("s_name"), "Supplier", 2_000_000_000 + F.col("s_suppkey")))
    rows = rows.union(row(t("part"), part_name(), "Part", 3_000_000_000 + F.col("p_partkey")))
    return rows.select(node_id("entity_type", "name").alias("id"), "name", "entity_type", "seq")


def star_edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("in_region", "in_nation", "supplies", "ordered")) -> DataFrame:
    """id, source_id, target_id, relation_type, seq.

    Ids of nodes are made once a node, before they meet the edges; edges are dealt by one of their ends before copies go,
    so that the join with this end needs no further shuffle."""
    t = lambda n: table(spark, sf_dir, n)
    of = lambda kind, name: node_id(F.lit(kind), name)
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    nation, customer, supplier, part = t("nation"), t("customer"), t("supplier"), t("part")
    suppliers = supplier.select("s_suppkey", of("Supplier", F.col("s_name")).alias("s"))
    customers = customer.select("c_custkey", of("Customer", F.col("c_name")).alias("s"))
    parts = part.select("p_partkey", of("Part", part_name()).alias("t"))
    made = {
        "in_region": lambda: nation.join(t("region"), nation["n_regionkey"] == F.col("r_regionkey")).select(of("Nation", F.col("n_name")).alias("s"), of("Region", F.col("r_name")).alias("t"), F.col("n_nationkey").cast("bigint").alias("seq")),
        "in_nation": lambda: customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(of("Customer", F.col("c_name")).alias("s"), of("Nation", F.col("n_name")).alias("t"), (1_000_000_000 + F.col("c_custkey")).alias("seq")).union(
            supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(of("Supplier", F.col("s_name")), of("Nation", F.col("n_name")), 2_000_000_000 + F.col("s_suppkey"))
        ),
        "supplies": lambda: dealt(line.select("l_suppkey", "l_partkey"), "l_partkey", source=line).distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("s", "t", (F.lit(10**15) + F.col("l_suppkey") * 10**7 + F.col("l_partkey")).alias("seq")),
        "ordered": lambda: dealt(line.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey"), "l_partkey", source=line).distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("s", "t", (F.lit(2 * 10**15) + F.col("o_custkey") * 10**7 + F.col("l_partkey")).alias("seq")),
    }
    rows = None
    for kind in kinds:
        part_rows = made[kind]().withColumn("relation_type", F.lit(kind))
        rows = part_rows if rows is None else rows.union(part_rows)
    return rows.select(edge_id("s", "relation_type", "t").alias("id"), F.col("s").alias("source_id"), F.col("t").alias("target_id"), "relation_type", "seq")


def _no_quotes() -> Column:
    return F.array().cast(QUOTES)


def draft_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star nodes with provenance: sources by seq, a quote on every third, some types undeclared."""
    seq = F.col("seq")
    quote = F.array(F.struct(F.concat(F.lit("chunk_"), (seq % 50).cast("string")).alias("chunk_id"), F.col("name").alias("quote"), F.when(seq % 4 == 0, False).when(seq % 4 == 1, True).alias("verified"))).cast(QUOTES)
    return star_nodes(spark, sf_dir).select(
        "id",
        "name",
        F.when((F.col("entity_type") == "Part") & (seq % 97 == 0), "Gadget").otherwise(F.col("entity_type")).alias("entity_type"),
        F.array_distinct(F.array(F.concat(F.lit("chunk_"), (seq % 50).cast("string")), F.when(seq % 7 == 0, F.lit("cold_start")).otherwise(F.concat(F.lit("chunk_"), (seq % 11).cast("string"))))).alias("source_chunk_ids"),
        F.when(seq % 3 == 0, quote).otherwise(_no_quotes()).alias("evidence_quotes"),
        F.round(0.5 + (seq % 50) / 100, 2).alias("confidence"),
        "seq",
    )


def draft_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star edges without orders, with defects by seq: missing ends, misspelt relations, swapped ends, copies, quotes."""
    seq = F.col("seq")
    rows = star_edges(spark, sf_dir, ("in_region", "in_nation", "supplies"))
    swapped = seq % 107 == 0
    bad = rows.select(
        F.when(swapped, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(seq % 101 == 0, F.lit("n_missing")).when(swapped, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"),
        F.when(seq % 103 == 0, F.lit("suplies")).otherwise(F.col("relation_type")).alias("relation_type"),
        "seq",
    )
    bad = bad.union(bad.where(seq % 109 == 0).withColumn("seq", seq + 5 * 10**15))
    one = lambda v: F.array(F.struct(F.lit("chunk_1").alias("chunk_id"), F.lit("q").alias("quote"), F.lit(v).cast("boolean").alias("verified"))).cast(QUOTES)
    kind = seq % 5
    return bad.select(
        edge_id("source_id", "relation_type", "target_id").alias("id"), "source_id", "target_id", "relation_type", "seq",
        F.when(kind == 0, one(True)).when(kind == 1, one(False)).when(kind == 2, one(None)).otherwise(_no_quotes()).alias("evidence_quotes"),
        F.when(kind == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("chunk_1"))).alias("source_chunk_ids"),
    )


def _sql_edge(source: str, kind_s: str, target: str, kind_t: str, relation: str, seq: str, tables: str) -> str:
    node = lambda kind, name: f"'n_'||substr(sha1('{kind}'||chr(9247)||{name}),1,24)"
    return f"SELECT {node(kind_s, source)} s, {node(kind_t, target)} t, '{relation}' relation_type, ({seq})::BIGINT seq FROM {tables}"


SQL_NODES = """star_nodes AS (SELECT 'n_'||substr(sha1(entity_type||chr(9247)||name),1,24) id, name, entity_type, seq::BIGINT seq FROM (
 SELECT r_name name, 'Region' entity_type, r_regionkey seq FROM region UNION ALL SELECT n_name, 'Nation', 100+n_nationkey FROM nation
 UNION ALL SELECT c_name, 'Customer', 1000000000+c_custkey FROM customer UNION ALL SELECT s_name, 'Supplier', 2000000000+s_suppkey FROM supplier
 UNION ALL SELECT p_name||'#'||p_partkey, 'Part', 3000000000+p_partkey FROM part))"""

_PARTS = {
    "in_region": _sql_edge("n_name", "Nation", "r_name", "Region", "in_region", "n_nationkey", "nation JOIN region ON n_regionkey=r_regionkey"),
    "in_nation": _sql_edge("c_name", "Customer", "n_name", "Nation", "in_nation", "1000000000+c_custkey", "customer JOIN nation ON c_nationkey=n_nationkey") + " UNION ALL " + _sql_edge("s_name", "Supplier", "n_name", "Nation", "in_nation", "2000000000+s_suppkey", "supplier JOIN nation ON s_nationkey=n_nationkey"),
    "supplies": _sql_edge("s_name", "Supplier", "(p_name||'#'||p_partkey)", "Part", "supplies", "1000000000000000+l_suppkey*10000000+l_partkey", "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey"),
    "ordered": _sql_edge("c_name", "Customer", "(p_name||'#'||p_partkey)", "Part", "ordered", "2000000000000000+o_custkey*10000000+l_partkey", "(SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey) JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey"),
}


def sql_edges(*kinds: str) -> str:
    rows = " UNION ALL ".join(_PARTS[k] for k in kinds or _PARTS)
    return f"star_edges AS (SELECT 'e_'||substr(sha1(s||chr(9247)||relation_type||chr(9247)||t),1,24) id, s source_id, t target_id, relation_type, seq FROM ({rows}))"


SQL_DRAFT_NODES = f"""{SQL_NODES}, draft_nodes AS (SELECT id, name, CASE WHEN entity_type='Part' AND seq%97=0 THEN 'Gadget' ELSE entity_type END entity_type,
 list_distinct(['chunk_'||(seq%50), CASE WHEN seq%7=0 THEN 'cold_start' ELSE 'chunk_'||(seq%11) END]) source_chunk_ids,
 seq%3=0 has_quote, CASE WHEN seq%4=0 THEN false WHEN seq%4=1 THEN true END verified, round(0.5+(seq%50)/100, 2) confidence, seq FROM star_nodes)"""

SQL_DRAFT_EDGES = f"""{sql_edges("in_region", "in_nation", "supplies")}, bad_edges AS (SELECT CASE WHEN seq%107=0 THEN target_id ELSE source_id END source_id,
 CASE WHEN seq%101=0 THEN 'n_missing' WHEN seq%107=0 THEN source_id ELSE target_id END target_id, CASE WHEN seq%103=0 THEN 'suplies' ELSE relation_type END relation_type, seq FROM star_edges),
 draft_edges AS (SELECT 'e_'||substr(sha1(source_id||chr(9247)||relation_type||chr(9247)||target_id),1,24) id, * FROM (SELECT * FROM bad_edges UNION ALL SELECT source_id, target_id, relation_type, seq+5000000000000000 FROM bad_edges WHERE seq%109=0))"""

SQL_RULES = """rules(name, source_types, target_types) AS (VALUES ('in_region', ['Nation'], ['Region']), ('in_nation', ['Customer','Supplier'], ['Nation']), ('supplies', ['Supplier'], ['Part']), ('ordered', ['Customer'], ['Part']), ('near', []::VARCHAR[], []::VARCHAR[])),
 types(name, abstractness) AS (VALUES ('Region','surface'), ('Nation','surface'), ('Customer','surface'), ('Supplier','normalized'), ('Part','inductive'))"""

SQL_GATE = f"""{SQL_DRAFT_NODES}, {SQL_DRAFT_EDGES}, {SQL_RULES},
 judged_nodes AS (SELECT *, CASE WHEN entity_type NOT IN (SELECT name FROM types) THEN 'entity_type_not_in_schema' END violation FROM draft_nodes),
 ends AS (SELECT e.*, a.entity_type f, b.entity_type g, r.name rule, r.source_types, r.target_types FROM draft_edges e
  LEFT JOIN (SELECT * FROM judged_nodes WHERE violation IS NULL) a ON e.source_id=a.id LEFT JOIN (SELECT * FROM judged_nodes WHERE violation IS NULL) b ON e.target_id=b.id LEFT JOIN rules r ON e.relation_type=r.name),
 first_rules AS (SELECT *, CASE WHEN f IS NULL OR g IS NULL THEN 'dangling_edge' WHEN rule IS NULL THEN 'relation_type_not_in_schema' WHEN len(source_types)>0 AND NOT list_contains(source_types, f) THEN 'source_type_mismatch' WHEN len(target_types)>0 AND NOT list_contains(target_types, g) THEN 'target_type_mismatch' END v FROM ends),
 copies AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN row_number() OVER (PARTITION BY source_id, target_id, relation_type, v IS NULL ORDER BY seq)>1 THEN 'duplicate_edge' END v2 FROM first_rules),
 judged_edges AS (SELECT *, CASE WHEN v2 IS NOT NULL THEN v2 WHEN seq%5=1 THEN 'unverified_evidence' WHEN seq%5=4 THEN 'missing_evidence' END violation FROM copies)"""
