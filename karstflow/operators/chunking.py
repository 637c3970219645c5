"""Documents and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.functions import text as T


def document_id(source: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("::", source, path), 256)


def build_documents(files: DataFrame, corpus: str = "summaries") -> DataFrame:
    """Documents from (repository, file_path, url, last_modified, source_code, summary).

    The summaries corpus holds a summary's body and its references, the code
    corpus the code alone. An unreadable date becomes null; an empty text goes.
    """
    body = T.summary_body(F.col("summary")) if corpus == "summaries" else F.col("source_code")
    out = files.select(
        document_id(F.col("repository"), F.col("file_path")).alias("document_id"),
        F.col("file_path").alias("title"),
        F.coalesce(body, F.lit("")).alias("text"),
        F.col("repository").alias("source"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("source_code", F.lit("")).alias("source_code"),
        F.try_to_timestamp(F.regexp_replace("last_modified", "Z$", "+00:00")).alias("last_modified"),
        (T.summary_references(F.col("summary")) if corpus == "summaries" else F.lit("")).alias("source_refs"),
        F.lit(corpus).alias("retrieval_corpus"),
    )
    return out.filter(F.length(F.trim("text")) > 0)


def chunk(docs: DataFrame, size: int = 1500, overlap: float = 0.15) -> DataFrame:
    """Windows of `size` words that overlap by a share, one row for each, after `docs`' columns.

    docs: document_id, title, text, source, retrieval_corpus and others. A
    window starts at every step before the end, even if it lies inside the one
    before. A text without words has no chunk. Nothing is shuffled.
    """
    step = size - int(size * overlap)
    words = docs.withColumn("_words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step)))
    rows = words.withColumn("total_chunks", F.size(starts)).select("*", F.posexplode(starts).alias("_at", "_start"))
    rows = rows.withColumn("chunk_index", F.col("_at") + 1)
    content = F.array_join(F.slice("_words", F.col("_start") + 1, F.lit(size)), " ")
    prefix = F.format_string("TITLE: %s | SOURCE: %s | CORPUS: %s | PART: %d of %d | CONTENT: ", "title", "source", "retrieval_corpus", "chunk_index", "total_chunks")
    return rows.select(
        F.sha2(F.concat_ws("::", "document_id", "retrieval_corpus", F.col("_at").cast("string")), 256).alias("chunk_id"),
        *[F.col(c) for c in docs.columns if c != "text"],
        "chunk_index", "total_chunks", content.alias("content"), F.replace(F.concat(prefix, content), F.lit("\x00"), F.lit("")).alias("text"),
    )


def changed_only(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents that aren't older than their last indexing; without either date they count as changed."""
    seen = indexed.select(F.col("document_id").alias("_d"), F.col("retrieval_corpus").alias("_c"), F.col("last_indexed_at").alias("_at"))
    both = docs.join(seen, (F.col("document_id") == F.col("_d")) & (F.col("retrieval_corpus") == F.col("_c")), "left")
    return both.filter(~F.coalesce(F.col("last_modified") <= F.col("_at"), F.lit(False))).drop("_d", "_c", "_at")
