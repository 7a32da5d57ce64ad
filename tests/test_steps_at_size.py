"""Shared steps of the graph queries: what is read once, dealt by rows, kept out of shuffles and sent on in parts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunking, evolution, graph, merging, traversal
from graphloom.schema import QUOTES
from graphloom.session import dealt


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_predicates_are_counted_in_one_reading_of_the_edges(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def counted(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([(n, "supplies" if n % 3 else "supplies to") for n in range(30)], "id int, relation_type string")
    edges = edges.withColumn("relation_type", counted.asNondeterministic()("relation_type"))
    found = {(r.relation_type, r.canonical) for r in merging.predicate_mapping(edges).collect()}
    assert found == {("supplies to", "supplies")} and seen.value == 30


def test_rows_of_a_task_have_a_bound(spark):
    rows = spark.range(1000)
    assert dealt(rows, "id", source=rows, size=10).rdd.getNumPartitions() == 100
    assert dealt(rows, "id", source=rows).distinct().count() == 1000


def test_ends_are_counted_between_the_joins(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "id string, entity_type string")
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "b", "r"), ("b", "a", "r"), ("a", "x", "gone"), ("a", "c", "none"), ("a", "b", " ")], "source_id string, target_id string, relation_type string").withColumn("seq", F.lit(1))
    of = {(r.relation_type, r.source_type, r.target_type, r.n) for r in evolution.most_frequent_ends(evolution.end_types(edges, nodes).where("_from AND _to")).collect()}
    assert of == {("r", "A", "B", 2), ("none", "A", None, 1), (" ", "A", "B", 1)}
    types, relations = evolution.reverse_schema(nodes.withColumns({"name": F.col("id"), "seq": F.lit(1)}), edges)
    assert {(r.name, r.source_type, r.target_type) for r in relations.collect()} == {("r", "A", "B"), ("gone", "", ""), ("none", "A", "")}


@pytest.fixture
def draft(spark):
    quote = lambda v: [("c", "q", v)]
    nodes = spark.createDataFrame([("a", "a", "A", 1), ("b", "b", "B", 2), ("g", "g", "Off", 3), ("h", "h", "Off", 4)], "id string, name string, entity_type string, seq int")
    rows = [("e1", "a", "b", "r", 1, quote(True), ["c"]), ("e2", "a", "b", "r", 2, quote(True), ["c"]), ("e3", "b", "a", "r", 3, [], []), ("e4", "a", "b", "u", 4, quote(False), []), ("e5", "a", "g", "r", 5, [], ["c"]), ("e6", "a", "b", "v", 6, [], []), ("e7", "a", "h", "r", 7, [], []), ("e8", "b", "b", "w", 8, quote(False), [])]
    edges = spark.createDataFrame(rows, f"id string, source_id string, target_id string, relation_type string, seq int, evidence_quotes {QUOTES}, source_chunk_ids array<string>")
    return nodes, edges, spark.createDataFrame([("A",), ("B",)], "name string"), spark.createDataFrame([("r", ["A"], ["B"]), ("w", [], [])], "name string, source_types array<string>, target_types array<string>")


def test_quotes_stay_out_of_the_gates_joins(spark, draft):
    judged = graph.gate(*draft, require_evidence=True)[1].select("id", "violation")
    got = dict(judged.collect())
    assert got == {"e1": None, "e2": "duplicate_edge", "e3": "source_type_mismatch", "e4": "relation_type_not_in_schema", "e5": "dangling_edge", "e6": "relation_type_not_in_schema", "e7": "dangling_edge", "e8": "unverified_evidence"}
    above = plan(judged).split("Join")[:3]  # rules, sources, targets
    assert "evidence_quotes" not in "".join(above)


def test_correction_asks_for_undeclared_relations_only(spark, draft):
    said = spark.createDataFrame([("g", "remove", "B"), ("h", "remap", "B")], "name string, action string, new_type string")
    fixes = spark.createDataFrame([("e4", "remap", "r"), ("e1", "remap", "w")], "id string, action string, new_type string")
    left, kept = merging.post_correct(*draft, said, fixes)
    assert dict(left.select("id", "entity_type").collect()) == {"a": "A", "b": "B", "h": "B"}
    assert dict(kept.select("id", "relation_type").collect()) == {"e1": "r", "e2": "r", "e4": "r", "e7": "r", "e8": "w"}
    assert plan(kept.select("id")).count("LeftAnti") == 1  # the undeclared ones; nodes that go are looked up with the ends


def test_only_nodes_with_rank_meet_their_moves(spark, monkeypatch):
    monkeypatch.setattr(traversal, "NARROW_ROWS", 3)
    asked = []
    monkeypatch.setattr(traversal, "small", lambda df, rows: asked.append(df.count()) or df)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(50)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "source_id string, target_id string")
    ranks = dict(traversal.personalised_pagerank(nodes, edges, nodes.where("id = 'n0'"), iterations=3, tolerance=0).collect())
    assert asked == [1, 2, 3] and abs(sum(ranks.values()) - 1) < 1e-9 and ranks["n2"] > 0 == ranks["n9"]


def test_chunks_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SENT", 1000)
    real = pa.RecordBatch.from_arrays
    text = "word " * 100
    docs = spark.createDataFrame([(i, text if i % 4 else None) for i in range(40)], "doc_id int, text string").coalesce(1)
    run = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: run.update(f=f) or df)
    chunking.split_documents(docs, "recursive_character", 100, 0)
    batch = real([pa.array(range(40), pa.int32()), pa.array([text if i % 4 else None for i in range(40)])], names=["id", "text"])
    made = list(run["f"](iter([batch])))
    assert len(made) >= 10 and max(sum(len(c.as_py()) for c in b.column("chunk")) for b in made) < 1600
    assert sum(b.num_rows for b in made) == 30 * len(chunking._recursive(text, 100, 0))


def test_only_words_that_begin_a_term_make_runs(spark, monkeypatch):
    chunks = spark.createDataFrame([("c", "Red car, red car park; the car"), ("d", ""), ("e", None)], "chunk_id string, chunk string")
    terms = spark.createDataFrame([("red car", "A"), ("Red car park", "B"), ("car", "C")], "term string, entity_type string")
    want = {(1, "red car"), (2, "car"), (3, "Red car park"), (4, "car"), (7, "car")}
    shown = evolution.dictionary_mentions(chunks, terms)
    assert {(r.at, r.term) for r in shown.collect()} == want and "red" in plan(shown)
    monkeypatch.setattr(evolution, "FIRST_WORDS", 1)
    assert {(r.at, r.term) for r in evolution.dictionary_mentions(chunks, terms).collect()} == want
