"""A corpus pipeline over ``documents``: every stage works on all rows that its predecessor kept.

Quality rules drop documents, near-dedup keeps one document of each group, substring dedup cuts repeated passages,
decontamination drops documents that hold benchmark windows, and the last stage segments what is left.

A stage owns the working tables it makes. ``run`` deletes them as soon as the stage's result is written. Where somebody
else calls the stages, each written and read again before the next is called, a stage deletes the tables of those before
it over the same folder; tables of other queries are never touched.

Null and empty texts fail the quality rules. Texts of any length are whole. Of repeated rows one stays. An empty table
gives empty results. Columns besides ``doc_id``, ``text``, ``lang`` and ``source`` are handed on whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, fm_dedup, quality_rules, shingle_dedup, sp_codec
from graphloom.llm.common import Scope
from graphloom.session import ensure_checkpoint_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_dedup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_codec.segmentations(docs)


_STEPS = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("segmentation", segmentations),
]
#: Working tables of stages whose results are not known to be written yet, by folder and place of the stage.
_HELD: dict[tuple[str, int], Scope] = {}


def _owning(place: int, step: Stage) -> Stage:
    """``step`` with its working tables kept until a later stage over the same folder has its written result."""

    @wraps(step)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for earlier in [key for key in _HELD if key[0] == sf_dir and key[1] < place]:
            _HELD.pop(earlier).close()
        with _HELD.setdefault((sf_dir, place), Scope()):
            return step(spark, docs, sf_dir)

    return stage


STAGES = [(name, _owning(place, step)) for place, (name, step) in enumerate(_STEPS)]

#: The last stages have no SQL form; the tests hold the operators of the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written as Parquet into the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, step in _STEPS[:-1]:
        scope = Scope()
        with scope:
            step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        scope.close()
        docs = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
    return _STEPS[-1][1](spark, docs, sf_dir)
