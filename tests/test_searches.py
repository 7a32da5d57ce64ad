"""The searches take every row whose id is divisible by 50 as a query, and score it against all rows."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import chunk_similarity, name_similarity
from graphloom.operators import chunking, fusion, traversal
from graphloom.plans import fixtures as fx
from graphloom.plans.catalog import QUERIES
from graphloom.schema import chunk_id
from graphloom.session import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def best(rows, k, least):
    """(query, id, score) of the k best of each query among all of its scores."""
    of = {}
    for q, i, s in rows:
        of.setdefault(q, []).append((-s, i))
    return {(q, i, -s) for q, found in of.items() for s, i in sorted(found)[:k] if -s >= least}


def test_names(spark):
    asked = table(spark, SF, "part").where("p_partkey % 50 = 0")
    bonus = F.when(F.col("entity_type") == "Part", 0.03).otherwise(0.0)
    pairs = asked.crossJoin(fx.star_nodes(spark, SF)).select("p_partkey", "id", F.round(name_similarity(F.col("p_name"), F.col("name")) + bonus, 9).alias("s"))
    got = QUERIES["name_similarity_topk"](spark, SF).collect()
    assert {r.query_id for r in got} == {r.p_partkey for r in asked.collect()} and len({r.query_id for r in got}) == 4
    k = max(r["rank"] for r in got)
    assert {(r.query_id, r.id, r.score) for r in got} == best(map(tuple, pairs.collect()), k, 0.25)


def test_equal_names_are_queries_of_their_own(spark):
    from graphloom.operators.fusion import fuzzy_candidates

    nodes = spark.createDataFrame([("a", "red plate", "Part"), ("b", "red plates", "Part")], "id string, name string, entity_type string")
    queries = spark.createDataFrame([(1, "red plate", "Part"), (2, "red plate", "Part"), (3, "red plate", None)], "query_id int, query string, entity_type string")
    assert sorted((r.query_id, r.id, r["rank"]) for r in fuzzy_candidates(queries, nodes).collect()) == [(q, i, n) for q in (1, 2, 3) for n, i in enumerate("ab", 1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The driver's tables with benchmark items that the documents hold."""
    folder = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF):
        if name not in ("benchmark.parquet", "documents.parquet"):
            os.symlink(f"{SF}/{name}", folder / name)
    say = lambda i: f"item {i} tells of river{i} and stone{i} under a sky of glass{i}"
    spark.createDataFrame([(i, say(i)) for i in range(120)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = [(i, f"{say(50 * (i % 3))} {'and so on ' * i}", "en", "s", 0) for i in range(30)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_chunks(spark, tables):
    asked = table(spark, tables, "benchmark").where("item_id % 50 = 0")
    chunks = chunking.windows(table(spark, tables, "documents")).select(chunk_id(F.col("doc_id"), F.col("idx")).alias("id"), "chunk")
    pairs = asked.crossJoin(chunks).select("item_id", "id", F.round(chunk_similarity(F.col("text"), F.col("chunk")), 9).alias("s"))
    got = QUERIES["chunk_similarity_topk"](spark, tables).collect()
    assert {r.query_id for r in got} == {0, 50, 100}
    assert {(r.query_id, r.id, r.score) for r in got} == best(map(tuple, pairs.collect()), 6, 0.25)


def test_context(spark, tables):
    rows = QUERIES["graph_context"](spark, tables).collect()
    seeds = {2_000_000_000 + r.s_suppkey for r in table(spark, tables, "supplier").where("s_suppkey % 50 = 0").collect()}
    assert {r.of for r in rows if r.kind == "triple"} == set(map(str, seeds))
    assert {(r.of, r.number) for r in rows if r.kind == "source"} == {(str(i), n) for i in (0, 50, 100) for n in range(1, 7)}


def test_seeds_are_walked_each_on_its_own(spark):
    edges = spark.createDataFrame([("a", "b", "r", 1), ("b", "c", "r", 2), ("c", "d", "r", 3)], "source_id string, target_id string, relation_type string, seq int")
    seeds = spark.createDataFrame([(1, "a"), (2, "c")], "seed int, id string")
    walked = traversal.fan_out_bfs(edges, seeds, 2, by=("seed",)).collect()
    for seed, start in ((1, "a"), (2, "c")):
        alone = traversal.fan_out_bfs(edges, seeds.where(F.col("id") == start), 2).collect()
        assert sorted((r.source_id, r.target_id, r.level) for r in walked if r.seed == seed) == sorted((r.source_id, r.target_id, r.level) for r in alone)


def test_many_queries_are_taken_in_blocks(spark):
    from graphloom.session import against_all

    queries, rows = spark.range(23).withColumnRenamed("id", "q"), spark.range(7)
    got = sorted(tuple(r) for r in against_all(queries, rows, 5).select("q", "id").collect())
    assert got == [(q, i) for q in range(23) for i in range(7)]


def test_vectors_without_direction_have_no_pairs(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [2.0, 0.1]), (1, 3, [0.0, 0.0]), (1, 4, None), (1, 5, []), (1, 6, [None, 1.0]), (2, 7, [1.0, 0.0]), (None, 8, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "`group` int, id int, embedding array<double>")
    assert [(r.group, r.a, r.b) for r in fusion.vector_pairs(df).collect()] == [(1, 1, 2)]


def test_texts_are_scored_by_batches_as_the_expression_scores_them(spark):
    from graphloom.operators import retrieval

    texts = ["", "a", "ab", "The river. The stone", "the river, the stone!", "中文，中文 abc", "😀b ab", "x" * 900, "ab" * 400, None, "a b c d e f g", "riverstone", "RIVER stone " * 30]
    rows = spark.createDataFrame([(f"{i}-{n}", t) for n in range(3) for i, t in enumerate(texts)], "id string, chunk string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query string")
    for least in (0.25, 0.0):
        pairs = asked.crossJoin(rows).select("query_id", "id", F.round(chunk_similarity(F.col("query"), F.col("chunk")), 9).alias("s"), "query", "chunk")
        pairs = pairs.where("query IS NOT NULL AND chunk IS NOT NULL").select("query_id", "id", "s")  # no text, no score
        got = retrieval.chunk_top(asked, rows, 5, least).collect()
        assert {(r.query_id, r.id, r.score) for r in got} == best(map(tuple, pairs.collect()), 5, least)


def test_queries_go_to_the_texts_in_blocks_and_a_cell_has_a_bound(spark, tables, monkeypatch):
    from graphloom.operators import passages, retrieval

    want = sorted(map(str, QUERIES["chunk_similarity_topk"](spark, tables).collect()))
    monkeypatch.setattr(retrieval, "ASKED", 2)
    monkeypatch.setattr(passages, "CELLS", 50)
    assert sorted(map(str, QUERIES["chunk_similarity_topk"](spark, tables).collect())) == want
    assert passages.shared_grams(["abab", "b", "", "cab"], [passages._gram_codes(["ab", "ca", "zz"]), passages._gram_codes(["b"])])[1].tolist() == [[1, 0, 0, 2], [0, 1, 0, 0]]


def test_all_chunks_are_read_for_all_queries(spark, tables, monkeypatch):
    from graphloom.operators import retrieval

    seen = []
    whole = retrieval.chunk_top
    monkeypatch.setattr(retrieval, "chunk_top", lambda queries, chunks, *a: seen.append((queries.count(), chunks.count())) or whole(queries, chunks, *a))
    QUERIES["chunk_similarity_topk"](spark, tables)
    every = chunking.windows(table(spark, tables, "documents")).count()
    assert seen == [(table(spark, tables, "benchmark").where("item_id % 50 = 0").count(), every)] and seen[0][0] == 3


def test_a_walk_ranks_no_edge_away_from_its_nodes(spark, monkeypatch):
    asked, real = [], traversal.small
    monkeypatch.setattr(traversal, "small", lambda df, rows: asked.append(df.count()) or real(df, rows))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "r", i) for i in range(200)], "source_id string, target_id string, relation_type string, seq int")
    walked = traversal.fan_out_bfs(edges, spark.createDataFrame([("n1",)], "id string"), 2).collect()
    assert asked == [1, 2] and {(r.source_id, r.target_id, r.level) for r in walked} == {("n1", "n2", 1), ("n0", "n1", 1), ("n2", "n3", 2)}
