"""Ids are half as long in shuffles, and edges that are as published leave before the gate."""

from pyspark.sql import functions as F

from graphloom.operators import governance, graph
from graphloom.operators.store import Store
from graphloom.schema import QUOTES, edge_id, packed, unpacked


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ids_of_any_kind_come_back(spark):
    told = ["n_" + "0a" * 12, "e_" + "f9" * 12, "n_missing", "", "a", "n_" + "0A" * 12, "n_" + "0a" * 12 + "\n", "\0_" + "0a" * 12, "é_" + "0a" * 12, "nn_" + "0" * 23, "中", None]
    rows = spark.createDataFrame([(t,) for t in told], "x string").select("x", packed("x").alias("p"), unpacked(packed("x")).alias("u")).collect()
    assert [r.u for r in rows] == told and len({bytes(r.p) for r in rows if r.p is not None}) == len(told) - 1
    assert [len(r.p) for r in rows[:2]] == [13, 13]


def test_parallel_edges_are_dealt_by_packed_ids(spark):
    a, b = "n_" + "0a" * 12, "n_" + "0b" * 12
    edges = spark.createDataFrame([(a, b, "r", 1), (a, b, "s", 2), (b, a, "r", 3), ("x", b, "r", 4), ("x", b, "q", 3)], "source_id string, target_id string, relation_type string, seq int")
    last = graph.last_parallel(edges)
    assert sorted(map(tuple, last.collect())) == [(a, b, "s", 2), (b, a, "r", 3), ("x", b, "r", 4)]
    assert "unhex" in plan(last).split("Aggregate")[-1]


def draft(spark):
    ends = [("a", "b", "r", 1), ("a", "b", "r", 2), ("b", "a", "r", 3), ("b", "c", "r", 4), ("c", "a", "u", 5), ("a", "a", "r", 6), ("a", "a", "r", 7)]
    rows = spark.createDataFrame(ends, "source_id string, target_id string, relation_type string, seq int").withColumn("id", edge_id("source_id", "relation_type", "target_id"))
    quote = F.array(F.struct(F.lit("c").alias("chunk_id"), F.lit("q").alias("quote"), (F.col("seq") != 4).alias("verified"))).cast(QUOTES)
    rows = rows.withColumns({"evidence_quotes": quote, "source_chunk_ids": F.array(F.lit("c")), "confidence": F.lit(1.0)})
    nodes = spark.createDataFrame([("a", "Anna", "A"), ("b", "Bert", "A"), ("c", "Carl", "A")], "id string, name string, entity_type string")
    rules = spark.createDataFrame([("A",)], "name string"), spark.createDataFrame([("r", [], [])], "name string, source_types array<string>, target_types array<string>")
    return nodes, rows, rules


def test_edges_as_published_leave_before_the_gate(spark):
    nodes, edges, rules = draft(spark)
    # published: one as it is, one twice, once under another relation
    old = edges.where("seq IN (1, 3)").select("id", "relation_type").union(edges.where("seq = 6").select("id", "relation_type")).union(edges.where("seq = 6").select("id", F.lit("other")))
    judged = graph.gate(nodes, edges, *rules, require_evidence=True)[1]
    shown = lambda df: sorted(map(str, df.select("id", "seq", "change", "violation", "title", "verified").collect()))
    want = shown(governance.review_edges(judged, old, nodes))
    fresh = governance.fresh_edges(graph.lacking(edges), old)
    assert {r.seq for r in fresh.collect()} == {4, 5, 6, 7}
    assert shown(governance.review_edges(graph.gate(nodes, fresh, *rules, require_evidence=True)[1], old, nodes)) == want and len(want) == 4


def test_ids_that_follow_from_an_edge_are_made_again(spark):
    nodes, edges, rules = draft(spark)
    own = edges.withColumn("id", F.when(F.col("seq") == 5, "my own").when(F.col("seq") != 6, F.col("id")))
    judged = graph.gate(nodes, own, *rules)[1]
    assert judged.columns == [*own.columns, "violation"]
    assert sorted(map(str, judged.select("seq", "id", "source_id", "target_id").collect())) == sorted(map(str, own.select("seq", "id", "source_id", "target_id").collect()))
    assert "unhex" in plan(judged).split("Join")[-1]


def test_rows_go_to_buckets_with_packed_ids(spark, tmp_path):
    nodes, edges, _ = draft(spark)
    kept = Store(spark, str(tmp_path / "s"), buckets=4)
    kept.replace_draft(nodes, edges.withColumn("seq", F.col("seq").cast("bigint")))
    kept.publish()
    assert sorted(r.id for r in kept.graph("draft")[1].collect()) == sorted(r.id for r in edges.collect())
    assert kept.graph("published")[1].count() == 7 and list(tmp_path.rglob("*.zstd.parquet"))
