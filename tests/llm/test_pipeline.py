"""The whole pipeline on small tables, and who owns its working tables."""

import os
import random

import pytest

import corpus_pipeline
from graphloom.llm import decontaminate, fm_dedup, quality_rules, sa_dedup, simhash_dedup
from graphloom.llm.common import Scope
from graphloom.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SCOPES = ("row", "row_key", "key", "__row_key", "tokens", "first", "item_id", "k")


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = say(60), say(24)
    texts = {i: say(200) for i in range(40)}
    texts |= {100 + i: f"{say(40)} {passage} {say(30)}" for i in range(4)}
    texts |= {200: texts[3], 201: texts[4] + " tail", 300: f"{say(50)} {item[20:]} {say(30)}", 400: "spam " * 80, 401: "too short", 402: None, 403: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return [*rows, rows[5], (None, say(70), None, None, 9)], [(1, item), (2, None)], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items, _ = corpus()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/none/benchmark.parquet")
    return path


def stashes(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {f for f in os.listdir(root) if f.startswith("stash-")}


def test_stages_keep_columns_and_drop_what_they_should(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {name: set(texts) for name, texts in seen.items()}
    assert ids["quality_rules"] == set(range(40)) | {100, 101, 102, 103, 200, 201, 300, None}
    assert ids["near_duplicates"] == ids["quality_rules"] - {200, 201}
    passage = corpus()[2]
    assert ids["substring_dedup"] == ids["near_duplicates"] and not any(passage[:200] in (t or "") for t in seen["substring_dedup"].values())
    assert ids["decontamination"] == ids["substring_dedup"] - {300}
    assert len(QUERIES) == 13 and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "segmentation"]


def test_run_leaves_lazy_results_of_others_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lazy = [fm_dedup.removal_report(docs), sa_dedup.removal_report(docs), simhash_dedup.near_duplicates(docs), quality_rules.quality_report(docs)]
    before = stashes(spark)
    result = corpus_pipeline.run(spark, folder)
    assert stashes(spark) == before  # the stages' own tables are gone
    assert {r.doc_id for r in result.collect()} == set(range(40)) | {100, 101, 102, 103, None}
    assert [df.count() for df in lazy] == [docs.count()] * 4


def test_stages_called_apart_release_each_other(spark, folder):
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), stashes(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect() or [], docs.schema) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, folder)
    assert stashes(spark) == before


def test_scopes_nest(spark):
    from graphloom.llm.common import stashed

    outer, inner = Scope(), Scope()
    with outer:
        one = stashed(spark.range(3))
        with inner:
            two = stashed(spark.range(4))
    inner.close()
    assert one.count() == 3 and [t.stash for t in outer.tables] == [one.stash]
    assert not os.path.exists(two.stash.removeprefix("file:"))
    outer.close()
    assert not os.path.exists(one.stash.removeprefix("file:"))


def test_empty_tables_pass_through(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_clashing_columns_are_handed_on(spark):
    rows, items, _ = corpus()
    extra = ", ".join(f"{c} string" for c in SCOPES)
    docs = spark.createDataFrame([(*r, *SCOPES) for r in rows], f"{SCHEMA}, {extra}")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    for left in (decontaminate.drop_contaminated(docs, items), fm_dedup.remove_repeats(docs), simhash_dedup.keep_first(docs), quality_rules.keep_good(docs)):
        found = left.collect()
        assert left.columns == docs.columns and found
        assert all(r[c] == c for r in found for c in SCOPES)
