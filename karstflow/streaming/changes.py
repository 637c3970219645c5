"""A feed of changed files, merged into a snapshot."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from karstflow.operators.upsert import latest


def merge(state: DataFrame, changes: DataFrame, key: list[str], at: str = "ts", deleted: str = "deleted") -> DataFrame:
    """The state after a batch of changes: the last change of a key wins, and deletions drop it."""
    last = latest(changes, key, F.col(at))
    return state.join(last.select(*key), key, "left_anti").unionByName(last.filter(~F.col(deleted)).select(*state.columns))


def follow(feed: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: list[str], checkpoint: str, at: str = "ts", deleted: str = "deleted") -> StreamingQuery:
    """Run `merge` on each batch of a stream until what is there is used up.

    read gives the current snapshot; write stores the next one under the
    batch's number, so a batch that is run again overwrites its own output.
    """

    def batch(changes: DataFrame, number: int) -> None:
        write(merge(read(), changes, key, at, deleted), number)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed(body: bytes, secret: str, signature: str | None) -> bool:
    """Whether `sha256=<hex>` is the HMAC of a notice's body; without a secret nothing is."""
    expected = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return bool(secret) and hmac.compare_digest(expected, signature or "")


def merged_requests(notices: DataFrame, repositories: list[str]) -> DataFrame:
    """(repository, number, base) of notices (event, body) that a pull request of one of the repositories was merged."""
    body = F.from_json("body", "action string, number long, repository struct<name:string>, pull_request struct<number:long,merged:boolean,base:struct<ref:string>>")
    rows = notices.filter("event = 'pull_request'").select(body.alias("b"))
    merged = rows.filter((F.col("b.action") == "closed") & F.coalesce("b.pull_request.merged", F.lit(False)) & F.col("b.repository.name").isin(list(repositories)))
    return merged.select(F.col("b.repository.name").alias("repository"), F.coalesce("b.pull_request.number", "b.number").alias("number"), F.coalesce("b.pull_request.base.ref", F.lit("main")).alias("base"))


def changes_of(entries: DataFrame) -> DataFrame:
    """(repository, file_path, deleted, ts) of a request's files (repository, filename, previous_filename, status, ts).

    A renamed file goes under its old name and comes under its new one; a
    removed one only goes.
    """
    gone = F.when(F.col("status").isin("removed", "renamed"), F.coalesce("previous_filename", F.when(F.col("status") == "removed", F.col("filename"))))
    come = F.when(F.col("status") != "removed", F.nullif(F.col("filename"), F.lit("")))
    both = F.array(F.struct(gone.alias("file_path"), F.lit(True).alias("deleted")), F.struct(come.alias("file_path"), F.lit(False).alias("deleted")))
    return entries.select("repository", F.explode(F.filter(both, lambda x: x["file_path"].isNotNull())).alias("x"), "ts").select("repository", "x.*", "ts")
