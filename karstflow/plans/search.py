"""One entry for all kinds of search."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstflow.operators import fusion, keyword, vector
from karstflow.plans import graph_search, routing

CORPORA = {"summary": "summaries", "summaries": "summaries", "source_code": "code", "code": "code", "all": "all", "": "summaries"}


def corpus_of(name: str | None) -> str:
    key = (name or "").strip().lower()
    if key not in CORPORA:
        raise ValueError(f"unknown corpus: {name}")
    return CORPORA[key]


@dataclass(frozen=True)
class SearchRequest:
    """strategy: keyword, vector, graph or hybrid, with `-service-aware` after it or the field set."""

    query: str
    strategy: str = "hybrid"
    k: int = 5
    sources: tuple[str, ...] = ()
    corpus: str = "summaries"
    ranker: str = "fts"
    match_all: bool = False
    per_document: int | None = 3
    service_aware: bool = False
    embedding: tuple[float, ...] | None = None


def search(spark: SparkSession, request: SearchRequest, chunks: DataFrame, services: list[routing.Service] = (), graph: graph_search.Graph | None = None, index: keyword.Index | None = None) -> DataFrame:
    """(query_id, item_id, score, rank, graph_error) of the best chunks.

    chunks: chunk_id, document_id, title, text, source, retrieval_corpus, embedding.
    index: a stored one of the chunks, in English for `fts`. In a hybrid search
    a graph that fails is left out and its error named; any other error is the
    caller's.
    """
    base, aware = routing.strategy_of(request.strategy)
    corpus, sources = corpus_of(request.corpus), list(request.sources)
    decision = routing.plan(request.query, list(services), request.k) if aware or request.service_aware else routing.Decision(k=request.k)
    if decision.mode == routing.HARD_FILTER:
        sources = list(decision.services)
    queries = spark.createDataFrame([("q", request.query)], "query_id string, query string")
    lists, error = [], None
    if base in ("vector", "hybrid") and request.embedding is not None:
        asked = spark.createDataFrame([("q", list(map(float, request.embedding)))], "query_id string, query_embedding array<float>")
        items = keyword.in_scope(chunks, sources, corpus).select(F.col("chunk_id").alias("item_id"), "embedding")
        lists.append(vector.nearest(items, asked, decision.k).select("query_id", "item_id", "rank", "score"))
    if base in ("keyword", "hybrid"):
        found = keyword.search(index or chunks, queries, request.ranker, k=decision.k, sources=sources, corpus=corpus, match_all=request.match_all, per_document=request.per_document)
        lists.append(found.withColumnRenamed("chunk_id", "item_id").select("query_id", "item_id", "rank", "score"))
    if base in ("graph", "hybrid") and graph is not None:
        try:
            walked = graph_search.search(queries, graph, _aliases(spark, services), decision.k, sources, corpus, request.per_document)[0]
            lists.append(walked.select("query_id", F.col("resolved_chunk_id").alias("item_id"), "rank", "score"))
        except Exception as e:
            if base == "graph":
                raise
            error = f"{type(e).__name__}: {e}"
    if not lists:
        raise ValueError(f"nothing to search by: {request.strategy}")
    ranked = fusion.rrf(lists, titles=chunks.select(F.col("chunk_id").alias("item_id"), "title")) if base == "hybrid" else lists[0]
    if decision.mode == routing.BOOST:
        where = chunks.select(F.col("chunk_id").alias("item_id"), "source")
        fetched = ranked.filter(F.col("rank") <= decision.k)
        boosted = fusion.service_boost(fetched.join(where, "item_id"), list(decision.services), request.k)
        ranked = boosted.select("query_id", "item_id", F.col("boost_score").alias("score"), F.col("new_rank").alias("rank"))
    return ranked.filter(F.col("rank") <= request.k).select("query_id", "item_id", "score", "rank", F.lit(error).cast("string").alias("graph_error"))


def _aliases(spark: SparkSession, services: list[routing.Service]) -> DataFrame | None:
    rows = sorted({(a, s.source) for s in services for a in (s.short_form, s.long_form) if a and s.source})
    return spark.createDataFrame(rows, "alias string, source string") if rows else None


def evaluate(spark: SparkSession, queries: list[tuple[str, SearchRequest]], strategies: list[str], run) -> DataFrame:
    """(strategy, query_id, item_id, rank, error) of every query by every strategy, as run(request) finds it.

    A search that fails with a plain error gives one row that names it.
    """
    rows = []
    for name, request in queries:
        for strategy in strategies:
            try:
                found = run(replace(request, strategy=strategy)).select("item_id", "rank").collect()  # at most k
                rows += [(strategy, name, r.item_id, r.rank, "") for r in found]
            except (RuntimeError, ValueError) as e:
                rows.append((strategy, name, None, None, str(e)))
    return spark.createDataFrame(rows, "strategy string, query_id string, item_id string, rank int, error string")
