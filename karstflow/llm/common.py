"""What several operators of this subpackage share.

Inputs are the tables as they lie in storage. Every operator takes only the
columns it names, so other columns, whatever their names, never clash with
its own. A null text is an empty text.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstflow.session import drop_written, shared_dir, written

__all__ = ["drop_written", "shared_dir", "written"]  # tables in the shared folder, for the operators

#: A word is a run without ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_workers_import(spark: SparkSession) -> None:
    """Python workers on this machine look for this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (paths := [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]):
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later, so that an idle worker doesn't hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """`run`, a function for mapInArrow, which gives memory back when its task ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) and nothing else; a null text becomes the empty text."""
    let_workers_import(docs.sparkSession)
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )


def settled(df: DataFrame) -> DataFrame:
    """`df`, with its columns computed once.

    The optimiser would put the expressions of columns into each filter over
    them, again and again where columns build on each other. It doesn't do so
    through a generator, here of one row for each row.
    """
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The words of a text in order, as an array."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != F.lit(""))


def dense_rank_in_groups(rows: DataFrame, group: list[str], order: list[Column], salt: Column, name: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, though one group may hold most rows.

    A window over the group would put a hot group in one task. Rows are dealt
    to `buckets` by `salt`; a small table of counts by (group, bucket) gives
    each bucket its first number, and a window numbers the rows inside it.
    """
    from pyspark.sql import Window as W

    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(salt, F.lit(977)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_b").alias("_sb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
    )
    inside = W.partitionBy(*group, "_b").orderBy(*order)
    placed = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = F.col("_b") == F.col("_sb")
    for s in same:
        on = on & s
    return placed.join(starts, on, "left").withColumn(name, (F.col("_first") + F.col("_r")).cast("long")).drop(*[f"_g{i}" for i in range(len(group))], "_sb", "_b", "_r", "_first")


def beside_least(rows: DataFrame, group: str, value: str, name: str, salt: Column, salts: int = 16) -> DataFrame:
    """`rows` with `name`: the least `value` of the row's group, though one group may hold most rows.

    Rows are dealt over `salts` by `salt`; each group's least is computed by
    salt first and then meets every salt. Rows with a null group go.
    """
    dealt = rows.filter(F.col(group).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(salt, F.lit(31)), F.lit(salts)).cast("int"))
    least = dealt.groupBy(group, "_salt").agg(F.min(value).alias(name)).groupBy(group).agg(F.min(name).alias(name))
    return dealt.join(least.select(group, name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")), [group, "_salt"]).drop("_salt")
