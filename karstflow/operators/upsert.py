"""Snapshots in place of a mutable store: each function gives the next state of a table.

Write a state to a new folder, never over the one it was read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key by `order`; one aggregate that combines before its exchange."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_x"))
    return best.select(*key, *[F.col(f"_x.{c}").alias(c) for c in others]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows in place of old ones with their key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert_keeping(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """As `upsert`, but of a key on both sides `keep` columns stay old and `fill` columns stay old where new is null."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = a.join(b, on, "full_outer")
    mine, theirs = F.col(f"a.{key[0]}").isNotNull(), F.col(f"b.{key[0]}").isNotNull()

    def pick(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in key:
            return F.coalesce(x, y)
        if c in keep:
            return F.when(mine, x).otherwise(y)
        if c in fill:
            return F.coalesce(y, x)
        return F.when(theirs, y).otherwise(x)

    return both.select(*[pick(c).alias(c) for c in old.columns])


def replace_documents(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the new chunks' documents go, and the new ones come."""
    ids = ["document_id", "retrieval_corpus"]
    return chunks.join(new.select(*ids).distinct(), ids, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(keys, key, "left_anti")


def carry_over(existing: DataFrame, present: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what of `existing` is still present, what of `present` is new)."""
    return existing.join(present, key, "left_semi"), present.join(existing, key, "left_anti")


def refreshed(old: DataFrame, current: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next state, one row of counts) of a table that is to hold exactly `current`: all put in, others deleted.

    The counts alone are a dry run: nothing is written by either.
    """
    now, before = current.select(*key), old.select(*key)
    mark = [now.withColumn("_n", F.lit(1)), before.withColumn("_o", F.lit(1))]
    both = mark[0].join(mark[1], key, "full_outer")
    counts = both.agg(F.count_if(F.col("_o").isNull()).alias("inserted"), F.count_if(F.col("_n").isNotNull() & F.col("_o").isNotNull()).alias("updated"), F.count_if(F.col("_n").isNull()).alias("deleted"))
    return current.select(*old.columns), counts


def put_conversation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations (id, title, messages, created_at, updated_at) after new ones: of a known id only messages and updated_at change."""
    return upsert_keeping(old, new, ["id"], keep=["title", "created_at"])


def drop_conversations(old: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the conversations left, (id, found) of the ids)."""
    known = old.select("id").distinct().withColumn("_k", F.lit(True))
    return delete(old, ids, ["id"]), ids.join(known, "id", "left").select("id", F.coalesce("_k", F.lit(False)).alias("found"))


def newest_first(conversations: DataFrame) -> DataFrame:
    """Conversations by their last change, and of equals by id."""
    return conversations.orderBy(F.col("updated_at").desc(), "id")


def last_messages(messages: DataFrame, most: int = 6) -> DataFrame:
    """The last messages of each conversation: (conv_id, turn, ...)."""
    w = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def assembled(messages: DataFrame) -> DataFrame:
    """(conv_id, title, n_messages, messages): each conversation's first 80 characters and its messages in order."""
    text = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    g = messages.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"), F.count(F.lit(1)).alias("n_messages"), F.sort_array(F.collect_list(F.struct("turn", text.alias("m")))).alias("x"))
    return g.select("conv_id", F.left("t", F.lit(80)).alias("title"), "n_messages", F.array_join(F.transform("x", lambda y: y["m"]), "\n").alias("messages"))
