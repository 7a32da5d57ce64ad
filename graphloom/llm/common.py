"""Shared column expressions of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import ensure_checkpoint_dir

#: ASCII white space, as the contracts' word pattern has it.
SPACE = r"[\x20\x09-\x0D]+"
#: What separates lower-cased alphanumeric (or non-ASCII) words.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def narrow(df: DataFrame) -> DataFrame:
    """``small`` for tables of a key and two numbers at most."""
    return small(df, NARROW_ROWS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; an inlined expression would run per array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, separators: str = SPACE) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def positions(first: int | Column, last: Column) -> Column:
    """first..last, or an empty array where last < first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def covered(spans: Column) -> Column:
    """Number of positions in the union of half-open (first, last) spans, sorted by first."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["end"]))).cast("bigint").alias("n"),
            F.greatest(acc["end"], s["last"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text: rows that agree on both share it, and every result here is a function of both."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col(text_col), F.lit(""))]
    return F.unhex(F.left(F.sha2(F.concat(*parts), 256), F.lit(32)))


#: Most rows of two numbers and a key that may be broadcast, some 10 MB.
NARROW_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have few rows; otherwise left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def paired(values: Column, step: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(values[i], values[i + step]) for every i that has both."""

    def zipped(x: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(x) - step)
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + step), n), combine)

    return let(values, zipped)


def gram_hashes(tokens: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words, by doubling: a run of 2m words is a pair of runs of m words.

    The left-most bits of k join runs of different lengths, as in exponentiation by squaring."""

    def build(ones: Column) -> Column:
        hashes, length = ones, 1
        for bit in bin(k)[3:]:
            hashes, length = paired(hashes, length, lambda a, b: F.xxhash64(a, b)), 2 * length
            if bit == "1":
                hashes = _joined(hashes, ones, length)
                length += 1
        return hashes

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), build)


def _joined(runs: Column, ones: Column, length: int) -> Column:
    """Each run with the one word that follows it."""

    def zipped(x: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(ones) - length)
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(ones, F.lit(1 + length), n), lambda a, b: F.xxhash64(a, b))

    return let(runs, zipped)


#: The scope that owns the tables which are stashed now, if any.
_OPEN: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """Owner of working tables: those stashed inside ``with scope:`` belong to it until ``close`` deletes them.

    Whoever opens a scope closes it once every result that reads its tables is written elsewhere. Tables stashed outside
    of any scope stay with the session. Scopes nest; a table belongs to the innermost."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scope:
        self._token = _OPEN.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        _OPEN.reset(self._token)

    def close(self) -> None:
        forget(*self.tables)
        self.tables = []


def stashed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` written once as a compressed table into the shared checkpoint folder and read from there; cuts lineage.

    ``parts``: files it is gathered in, for tables whose number of rows is known to be small."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stash-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stash = path
    if _OPEN.get() is not None:
        _OPEN.get().tables.append(found)
    return found


def forget(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stash)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
