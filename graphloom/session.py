"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: The same for rows of a key and two numbers, some 10 MB.
NARROW_ROWS = 200_000
#: Rows of a task where narrow rows are dealt before they become wide.
DEALT_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark's own reader so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str, source: DataFrame, size: int | None = None) -> DataFrame:
    """``rows`` dealt by keys over as many tasks as ``source``, the table they come from, has blocks of ``size`` rows.

    Spark puts partitions together by their compressed bytes; of narrow rows that later meet wide ones a task then gets
    millions. A number that is asked for is kept, so the rows of a task have a bound at every size."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-source.count() // (size or DEALT_ROWS)))
    return rows.repartition(tasks, *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own, on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared checkpoint folder and cut the lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have few rows; otherwise left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(rows: DataFrame, tasks_a_core: int = 4) -> DataFrame:
    """``rows`` dealt evenly over all cores: a small file is one task otherwise, however much is computed for each row."""
    return rows.repartition(tasks_a_core * rows.sparkSession.sparkContext.defaultParallelism)


def against_all(queries: DataFrame, rows: DataFrame, size: int = BROADCAST_ROWS) -> DataFrame:
    """Every query beside every row: for a stated query set, broadcast in blocks of about ``size`` queries.

    However many queries there are, a block has a bound, and the rows are read once for each."""
    blocks = max(1, -(-queries.count() // size))
    if blocks == 1:
        return rows.join(F.broadcast(queries), F.lit(True))
    dealt = materialize(queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))))
    return reduce(DataFrame.union, [rows.join(F.broadcast(dealt.where(F.col("_block") == n).drop("_block")), F.lit(True)) for n in range(blocks)])


def promising(pairs: DataFrame, query: list[str], item: str, k: int, least: float, cells: int = 64) -> DataFrame:
    """The pairs that can be among the ``k`` best of their query: those whose ``high`` reaches ``least`` and a floor.

    pairs: query columns, item, low and high, which a score cannot pass. Of each query the items are dealt into cells; the
    best lows of ``k`` cells are of different items, so the k-th best of them is a floor. Ties with the floor stay."""
    of = [F.col(c).alias(f"_{c}") for c in query]
    cell = F.pmod(F.xxhash64(item), F.lit(max(cells, 4 * k)))
    best = pairs.select(*of, cell.alias("cell"), "low").groupBy(*[f"_{c}" for c in query], "cell").agg(F.max("low").alias("low"))
    floor = best.groupBy(*[f"_{c}" for c in query]).agg(F.get(F.sort_array(F.collect_list("low"), asc=False), F.lit(k - 1)).alias("_floor"))
    same = reduce(lambda x, y: x & y, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in query])
    met = pairs.join(small(materialize(floor)), same, "left")
    return met.where(F.col("high") >= F.greatest(F.lit(least), F.col("_floor")) - 1e-6).drop("_floor", *[f"_{c}" for c in query])
