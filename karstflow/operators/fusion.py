"""Merging ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion.
K = 60


def reciprocal_rank(rank: Column) -> Column:
    """1 / (60 + rank); a rank below 1 is an error."""
    return F.when(rank < 1, F.raise_error(F.lit("ranks begin at 1"))).otherwise(1.0 / (K + rank))


def rrf(lists: list[DataFrame], k: int | None = None, titles: DataFrame | None = None, places: int = 10) -> DataFrame:
    """(query_id, item_id, score, rank) of ranked lists (query_id, item_id, rank).

    Ties go to what is seen first: earlier list, then earlier rank. With
    titles (item_id, title) only the best item of a title stays.
    """
    tagged = [x.select("query_id", "item_id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    every = reduce(DataFrame.unionByName, tagged)
    merged = every.groupBy("query_id", "item_id").agg(F.round(F.sum(reciprocal_rank(F.col("rank"))), places).alias("score"), F.min(F.struct("list", F.col("rank").alias("at"))).alias("seen"))
    order = F.col("score").desc(), F.col("seen.list"), F.col("seen.at"), F.col("item_id")
    if titles is not None:
        merged = merged.join(titles, "item_id")
        merged = merged.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "title").orderBy(*order))).filter("_r = 1").drop("_r", "title")
    out = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).drop("seen")
    return out.filter(F.col("rank") <= k) if k else out


def service_boost(ranked: DataFrame, services: list[str], k: int | None = None, places: int = 10) -> DataFrame:
    """Rank anew by the reciprocal rank over all plus, for items of `services`, that among them.

    ranked: query_id, item_id, source, score, rank. Sources are compared in lower
    case. Ties go to the higher old score.
    """
    boosted = F.lower("source").isin([s.lower() for s in services])
    among = F.row_number().over(W.partitionBy("query_id", boosted).orderBy("rank"))
    both = ranked.withColumn("boost_score", F.round(reciprocal_rank(F.col("rank")) + F.when(boosted, reciprocal_rank(among)).otherwise(0.0), places))
    w = W.partitionBy("query_id").orderBy(F.col("boost_score").desc(), F.col("score").desc(), F.col("rank"))
    out = both.withColumn("new_rank", F.row_number().over(w))
    return out.filter(F.col("new_rank") <= k) if k else out


def overfetch(k: int) -> int:
    """Rows to fetch before a boost."""
    return min(3 * k, 60)


def diverse(ranked: DataFrame, most: int, by: str = "document_id") -> DataFrame:
    """The first `most` rows of each document in rank order, ranked anew."""
    first = ranked.withColumn("_r", F.row_number().over(W.partitionBy("query_id", by).orderBy("rank"))).filter(F.col("_r") <= most).drop("_r")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def round_robin(items: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """Items by turns from each group, best first in each; groups by best score, size and name."""
    inside = W.partitionBy(group).orderBy(*order)
    whole = W.partitionBy(group)
    turns = items.withColumn("round", F.row_number().over(inside)).withColumn("_best", F.max("score").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    return turns.orderBy("round", F.col("_best").desc(), F.col("_n").desc(), group).limit(most).drop("_best", "_n")
