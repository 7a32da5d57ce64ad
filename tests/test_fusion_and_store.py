"""Resolution, fusion, storage and ranks on small fixtures, where a registered query shows one side only."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import governance, merging, resolution, retrieval, store, traversal
from graphloom.schema import QUOTES

NODE = f"id string, name string, entity_type string, properties map<string,string>, source_chunk_ids array<string>, evidence_quotes {QUOTES}, confidence double, seq bigint"


def node(i, name, kind="A", chunks=("c1",), seq=None, **props):
    return i, name, kind, props or None, list(chunks), [], 0.5, seq if seq is not None else int(i[1:])


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [node("n1", "Acme Ltd", chunks=("c1",), brand="x"), node("n2", "Acme Ltd.", chunks=("c2", "c3"), brand="", size="9"), node("n3", "Zebra"), node("n4", "Acme Ltd", kind="B"), node("n5", "Region", kind="Off")]
    return spark.createDataFrame(rows, NODE)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("e1", "n1", "n3", "knows", 1), ("e2", "n2", "n3", "knows", 2), ("e3", "n1", "n2", "knows", 3), ("e4", "n3", "n5", "odd", 4)]
    return spark.createDataFrame(rows, "id string, source_id string, target_id string, relation_type string, seq bigint").withColumns({"evidence_quotes": F.array().cast(QUOTES), "source_chunk_ids": F.array(F.lit("c1"))})


def test_names_alike_become_one_node_and_edges_follow(nodes, edges):
    merged, moved = merging.cluster_entities(nodes, edges)
    got = {r.id: r for r in merged.collect()}
    assert set(got) == {"n2", "n3", "n4", "n5"}  # the member with most sources leads
    assert got["n2"].name == "Acme Ltd." and got["n2"].properties == {"brand": "x", "size": "9"} and got["n2"].source_chunk_ids == ["c1", "c2", "c3"]
    assert {(r.id, r.source_id, r.target_id) for r in moved.collect()} == {("e1", "n2", "n3"), ("e4", "n3", "n5")}


def test_fusion_reports_what_is_left(spark, nodes, edges):
    entities = spark.createDataFrame([("A",), ("B",)], "name string")
    relations = spark.createDataFrame([("knows", [], [])], "name string, source_types array<string>, target_types array<string>")
    fixes = spark.createDataFrame([("Region", "remap", "B")], "name string, action string, new_type string")
    left, rest, report = merging.fuse(nodes, edges, entities, relations, entity_fixes=fixes)
    assert {(r.kind, r.violation, r.n) for r in report.collect()} == {("node", "ok", 4), ("edge", "ok", 1), ("edge", "relation_type_not_in_schema", 1)}  # e4 hung on an invalid node when it was judged
    assert {r.id: r.entity_type for r in left.collect()}["n5"] == "B" and {r.id for r in rest.collect()} == {"e1", "e4"}


def test_semantic_clusters_of_two_to_twelve(spark):
    near = [(1, i, [1.0, 0.01 * i, 0.0]) for i in range(3)] + [(1, 9, [0.0, 0.0, 1.0])] + [(2, 100 + i, [0.0, 1.0, 0.001 * i]) for i in range(13)]
    rows = spark.createDataFrame(near, "group int, id bigint, embedding array<double>")
    assert {(r.group, r.id) for r in merging.semantic_clusters(rows).collect()} == {(1, 0), (1, 1), (1, 2)}


def test_query_words_match_in_three_tiers(spark, nodes):
    words = spark.createDataFrame([(1, "ACME LTD"), (2, "Acme Limited"), (3, "zebr"), (4, "q"), (5, "a very long question about zebra and such")], "query_id int, word string")
    got = {}
    for r in resolution.match_words(words, nodes).collect():
        got.setdefault(r.query_id, set()).add((r.id, r.tier))
    assert got[1] == {("n1", "exact"), ("n4", "exact")} and {t for _, t in got[2]} == {"fuzzy"} and ("n3", "fuzzy") in got[3] and 4 not in got
    assert got[5] and {t for _, t in got[5]} <= {"fuzzy", "part"}


def test_resolution_says_how(spark, nodes):
    rows = spark.createDataFrame([("c9", "Acme Ltd", "A", 0.9, 1), ("c9", "Acme Ltd", "A", 0.9, 2), ("c9", "acme  ltd", "A", 0.9, 3), ("c9", "Fresh", "A", 0.9, 4), ("c9", "", "A", 0.9, 5), ("c9", "Zeb", "A", 0.9, 6)], "chunk_id string, name string, entity_type string, confidence double, seq bigint")
    said = spark.createDataFrame([("Zeb", "n3", True)], "name string, match_id string, is_same boolean")
    got = {r.seq: (r.how, r.node_id) for r in resolution.resolve(rows, nodes, said).collect()}
    assert got[1] == ("known", "n1") and got[3][0] == "fast_path" and got[4][0] == "new" and got[6] == ("judged", "n3") and set(got) == {1, 3, 4, 6}


def test_store_keeps_versions(spark, nodes, edges, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    assert kept.read("chunks") is None and kept.version("chunks") == 0
    with pytest.raises(ValueError):
        kept.publish()
    kept.replace_draft(nodes, edges)
    rules = spark.createDataFrame([("A",), ("B",)], "name string"), spark.createDataFrame([("knows", [], [])], "name string, source_types array<string>, target_types array<string>")
    with pytest.raises(ValueError):
        kept.publish(rules, block=True)
    assert kept.publish(rules) == 1 and kept.publish() == 2
    assert kept.read("published_nodes", 1).count() == 4 and kept.read("published_nodes").count() == 5
    kept.add_to_draft(nodes.limit(1), edges.limit(1))
    assert kept.graph("draft")[0].count() == 5
    kept.restart()
    assert kept.graph("draft")[0].count() == 0 and kept.export()[0].count() == 5


def test_uploads_refuse_copies(spark, tmp_path):
    for name, text in (("a.txt", "one\n\ntwo"), ("b.txt", "one\n\ntwo"), ("c.md", "# T\nbody"), ("d.xyz", "?")):
        (tmp_path / name).write_text(text)
    chunks, documents = store.upload(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.status) for r in documents.collect()) == [("a.txt", "parsed"), ("b.txt", "duplicate"), ("c.md", "parsed"), ("d.xyz", "error")]
    assert {r.status for r in documents.collect()} == {"parsed", "duplicate", "error"} and chunks.count() == 2


def test_ranks_settle_and_quotas_hold(spark):
    pairs = [("s", "a"), ("a", "b"), ("b", "s"), ("s", "x"), ("x", "s")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    nodes = spark.createDataFrame([(n, "文档片段" if n == "x" else "A") for n in "sabxz"], "id string, entity_type string")
    seeds = nodes.where("id = 's'")
    ranks = {r.id: r.rank for r in traversal.personalised_pagerank(nodes, edges, seeds).collect()}
    exact = {r.id: r.rank for r in traversal.personalised_pagerank(nodes, edges, seeds, iterations=60, tolerance=0).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and all(abs(ranks[k] - exact[k]) < 1e-4 for k in exact) and ranks["z"] == 0
    got = {(r.id, r.kind) for r in retrieval.rank_quotas(spark.createDataFrame(list(ranks.items()), "id string, rank double"), nodes, seeds, 2).collect()}
    assert got == {("s", "entity"), ("a", "entity"), ("x", "anchor")}


def test_plan_and_review_edges_of_empty_tables(spark, nodes, edges):
    none = edges.limit(0).withColumns({"violation": F.lit(None).cast("string"), "confidence": F.lit(1.0)})
    assert governance.review_edges(none, edges, nodes).count() == 0
    assert governance.plan_lane(spark.createDataFrame([(1, None)], "plan_id int, abstractness string")).first().lane == "mixed"
