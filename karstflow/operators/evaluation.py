"""Retrieval metrics over whole runs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karstflow.functions import text as T


def unique_in_order(retrieved: DataFrame, *by: str) -> DataFrame:
    """Documents in the order first seen: (query_id, doc_id, rank) with repeats dropped and ranks closed up; `by` are further keys."""
    key = [*by, "query_id"]
    first = retrieved.groupBy(*key, "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("rank", "doc_id")))


def metrics(retrieved: DataFrame, qrels: DataFrame, k: int = 15, places: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each query of `qrels`: recall, precision, F1, MRR, nDCG, ceilings and group recall at k.

    qrels: query_id, doc_id, evidence_group; `by`: further keys of both. A
    query that retrieved nothing scores 0.
    """
    key = [*by, "query_id"]
    relevant = qrels.select(*key, "doc_id", "evidence_group").dropDuplicates([*key, "doc_id"])
    size = qrels.groupBy(*key).agg(F.countDistinct("doc_id").alias("relevant_count"), F.countDistinct("evidence_group").alias("evidence_group_count"))
    top = unique_in_order(retrieved, *by).filter(F.col("rank") <= k)
    hits = top.join(relevant, [*key, "doc_id"]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("hit_count"), F.min("rank").alias("_first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("_dcg"), F.countDistinct("evidence_group").alias("evidence_group_hit_count")
    )
    got = top.groupBy(*key).agg(F.count(F.lit(1)).alias("retrieved_count"))
    all_ = size.join(hits, key, "left").join(got, key, "left").fillna(0, ["hit_count", "evidence_group_hit_count", "retrieved_count"])
    rel, hit = F.col("relevant_count"), F.col("hit_count")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(rel, F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    recall, precision, ceiling = hit / rel, hit / F.lit(k), F.least(F.lit(k), rel) / rel
    f1 = F.when((recall > 0) & (precision > 0), 2 * recall * precision / (recall + precision)).otherwise(0.0)
    groups = F.when(F.col("evidence_group_count") > 0, F.col("evidence_group_hit_count") / F.col("evidence_group_count")).otherwise(0.0)
    rounded = {"recall": recall, "precision": precision, "f1": f1, "mrr": F.coalesce(1 / F.col("_first"), F.lit(0.0)), "ndcg": F.coalesce(F.col("_dcg"), F.lit(0.0)) / ideal, "recall_ceiling": ceiling, "ceiling_adjusted_recall": recall / ceiling, "evidence_group_recall": groups}
    counts = ["relevant_count", "retrieved_count", "hit_count", "evidence_group_count", "evidence_group_hit_count"]
    return all_.select(*key, *[F.round(v, places).alias(n) for n, v in rounded.items()], *[F.col(c).cast("long").alias(c) for c in counts])


METRICS = ("recall", "precision", "f1", "mrr", "ndcg", "recall_ceiling", "ceiling_adjusted_recall", "evidence_group_recall")
#: Means that the result tables have beside METRICS.
MORE = ("hit_count", "evidence_group_hit_count", "latency_ms")


def grouped(results: DataFrame, *by: str, places: int = 6) -> DataFrame:
    """Number of queries and mean of every metric that `results` has, in each group."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), places).alias(m) for m in (*METRICS, *MORE) if m in results.columns])


def evaluate(retrieved: DataFrame, qrels: DataFrame, strategies: list[str], ks: list[int], places: int = 6) -> DataFrame:
    """A row for each strategy, k and query of `qrels`.

    retrieved: strategy, query_id, doc_id, rank. A strategy that failed, or
    found nothing, has rows of 0.
    """
    asked = qrels.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    rows = [metrics(retrieved, asked, k, places, ("strategy",)).withColumn("k", F.lit(k)) for k in sorted(set(ks))]
    return reduce(DataFrame.unionByName, rows)


def result_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run: its rows, and their means by strategy, k and category or difficulty.

    Difficulties sort by number where they are numbers, else by name after them.
    """
    number = F.try_to_number("difficulty", F.lit("999999999"))
    by = lambda c: grouped(results.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(""))), "strategy", "k", c)
    return {
        "results": results,
        "category_results": by("category").orderBy("strategy", "k", "category"),
        "difficulty_results": by("difficulty").orderBy("strategy", "k", number.isNull(), number, "difficulty"),
    }


def write_results(results: DataFrame, meta: dict, folder: str) -> None:
    """The tables of a run as CSV with headings, and run_meta as JSON; an existing run is an error."""
    for name, df in result_tables(results).items():
        df.coalesce(1).write.mode("errorifexists").csv(f"{folder}/{name}", header=True)
    results.sparkSession.createDataFrame([(json.dumps(meta, indent=2),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/run_meta")


def dropped(golden: DataFrame) -> DataFrame:
    """One row: how many golden queries there are, and how many go as unanswerable, without text, or without a source."""
    answerable = F.coalesce(F.lower(F.trim("answerable")) == "true", F.lit(False))
    named = (F.trim(F.coalesce("query_id", F.lit(""))) != "") & (F.trim(F.coalesce("query", F.lit(""))) != "")
    sources = F.trim(F.coalesce("gold_source_files", F.lit(""))) != ""
    return golden.agg(F.count(F.lit(1)).alias("queries"), F.count_if(~answerable).alias("unanswerable"), F.count_if(answerable & ~named).alias("unnamed"), F.count_if(answerable & named & ~sources).alias("without_sources"), F.count_if(answerable & named & sources).alias("kept"))


def frozen_queries(golden: DataFrame) -> DataFrame:
    """query_id, query_text, category, difficulty, wording_type, services of the golden queries that have qrels, by query_id."""
    services = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("services", F.lit("")), ";"), lambda x: F.trim(x)), lambda s: s != "")))
    rows = golden.join(qrels_of(golden).select("query_id").distinct(), "query_id", "left_semi").filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    number = F.coalesce(F.try_to_number(F.trim(F.col("difficulty").cast("string")), F.lit("999999999")).cast("int"), F.lit(0))
    return rows.select("query_id", F.trim("query").alias("query_text"), F.coalesce("category", F.lit("")).alias("category"), number.alias("difficulty"), F.coalesce("wording_type", F.lit("")).alias("wording_type"), services.alias("services")).orderBy("query_id")


def qrels_of(golden: DataFrame) -> DataFrame:
    """(query_id, doc_id, service, file_path, relevance) of answerable golden queries.

    golden: query_id, answerable, services (`;` between two), gold_source_files
    (line ends or `;` between two, `service::path` or a path of the only
    service). Paths are made canonical, repeats dropped.
    """
    services = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("services", F.lit("")), ";"), lambda x: F.trim(x)), lambda s: s != "")))
    rows = golden.filter(F.lower(F.trim("answerable")) == "true").select("query_id", services.alias("_s"), F.explode(F.split("gold_source_files", r"[\n;]")).alias("_f"))
    rows = rows.filter(F.trim("_f") != "")
    named = F.contains("_f", F.lit("::"))
    service = F.when(named, F.trim(F.split_part("_f", F.lit("::"), F.lit(1)))).when(F.size("_s") == 1, F.get("_s", F.lit(0)))
    path = F.when(named, F.substring_index("_f", "::", -1)).otherwise(F.col("_f"))
    pairs = rows.select("query_id", service.alias("service"), path.alias("_p")).filter(F.col("service").isNotNull())
    pairs = pairs.select("query_id", "service", T.repository_path(F.col("_p"), F.col("service")).alias("file_path"))
    return pairs.select("query_id", F.sha2(F.concat_ws("::", "service", "file_path"), 256).alias("doc_id"), "service", "file_path", F.lit(1).alias("relevance")).dropDuplicates(["query_id", "doc_id"])
