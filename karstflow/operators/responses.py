"""Ranked chunks as the rows that a caller gets, and such rows read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "chunk_id string, text string, source_code string, document_id string, document_title string, url string, last_modified_date string, metadata map<string,string>, source string, score double"
RESPONSE = f"array<struct<model_used:string,search_duration_ms:double,chunks:array<struct<{', '.join(x.replace(' ', ':', 1) for x in CHUNK.split(', '))}>>>>"

# What strategies are called, and the keyword ranker of each.
RANKERS = {
    "keyword": "bm25", "keyword-fts": "fts", "keyword-bm25": "bm25", "vector": "", "hybrid": "bm25", "hybrid-fts": "fts", "hybrid-bm25": "bm25",
    "hybrid-service-aware": "bm25", "hybrid-bm25-service-aware": "bm25", "graph": "",
}


def plan_of(strategy: str) -> tuple[str, str, bool]:
    """(kind of search, keyword ranker, whether services decide) of a strategy; an unknown one is an error."""
    if strategy not in RANKERS:
        raise ValueError(f"unknown strategy: {strategy}")
    return strategy.split("-")[0], RANKERS[strategy], strategy.endswith("-service-aware")


def as_chunks(ranked: DataFrame, wide: DataFrame) -> DataFrame:
    """Ranked rows (query_id, chunk_id, score, rank) as whole chunks without nulls, their metadata with the source.

    wide: chunk_id, text, source_code, document_id, name, url, last_modified_date,
    metadata (map), source.
    """
    rows = ranked.select("query_id", "chunk_id", "score", "rank").join(wide, "chunk_id")
    own = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "source"), F.create_map(F.lit("source"), F.col("source")))
    blank = lambda c: F.coalesce(c, F.lit("")).alias("document_title" if c == "name" else c)
    return rows.select("query_id", "chunk_id", "text", blank("source_code"), "document_id", blank("name"), blank("url"), F.coalesce(F.col("last_modified_date").cast("string"), F.lit("None")).alias("last_modified_date"), own.alias("metadata"), "source", F.col("score").cast("double").alias("score"), "rank")


def with_metadata(chunks: DataFrame, **more: Column | str) -> DataFrame:
    """Chunks with entries put into their metadata, in place of any of the same name; a null entry is left out."""
    names = list(more)
    added = F.create_map(*[x for k, v in more.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))])
    kept = F.map_filter("metadata", lambda k, _: ~k.isin(*names))
    return chunks.withColumn("metadata", F.map_concat(kept, F.map_filter(added, lambda _, v: v.isNotNull())))


def keyword_metadata(chunks: DataFrame, ranker: str, match_all: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """What a keyword search notes on its chunks; with match_all, columns term_count and base_score if they are there."""
    notes: dict[str, Column | str] = {"search_type": "keyword", "keyword_ranker": "bm25" if ranker == "bm25" else "fts_ts_rank_cd"}
    if ranker == "bm25":
        notes |= {"bm25_k1": str(k1), "bm25_b": str(b)}
    if match_all:
        block = [F.lit(True).alias("document_qualifies"), F.lit("cross_chunk_filter_only" if ranker == "bm25" else "cross_chunk").alias("match_mode")]
        if ranker != "bm25" and "term_count" in chunks.columns:
            block.append(F.struct(F.col("term_count").alias("terms_in_chunk"), F.col("base_score"), F.col("score").alias("boosted_score")).alias("term_coverage"))
        notes["match_all"] = F.to_json(F.struct(*block))
    return with_metadata(chunks, **notes)


def graph_metadata(chunks: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """What a graph search notes on its chunks: its score's parts and its walk."""
    debug = F.to_json(F.struct(*[c for c in ("node_key", "node_label", "max_confidence", "evidence_count", "score") if c in chunks.columns]))
    walks = diagnostics.select("query_id", F.to_json(F.struct(*[c for c in diagnostics.columns if c != "query_id"])).alias("_walk"))
    return with_metadata(chunks.join(walks, "query_id", "left"), graph_score_debug=debug, graph_traversal_meta=F.col("_walk")).drop("_walk")


#: What a citation has.
CITED = ("title", "url", "score", "chunk_text", "source_code", "metadata")


def citations(chunks: DataFrame, fields: tuple[str, ...] = CITED) -> DataFrame:
    """(query_id, citations): each query's chunks in rank order as what an answer cites; only the fields asked for are gathered."""
    of = {
        "title": F.coalesce("document_title", F.lit("")), "url": F.coalesce("url", F.lit("")), "score": F.coalesce("score", F.lit(0.0)), "chunk_text": F.coalesce("text", F.lit("")),
        "source_code": F.coalesce("source_code", F.lit("")), "metadata": F.map_entries("metadata"),  # a map can't be sorted by
    }
    rows = chunks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", *[of[f].alias(f) for f in fields]))).alias("_c"))
    one = lambda c: F.struct(*[(F.map_from_entries(c[f]) if f == "metadata" else c[f]).alias(f) for f in fields])
    return rows.select("query_id", F.transform("_c", one).alias("citations"))


def flatten(responses: DataFrame) -> DataFrame:
    """The chunks of nested responses (query_id, responses), each with its response's model and duration."""
    each = responses.select("query_id", F.posexplode("responses").alias("_r", "r")).select("query_id", "_r", F.col("r.model_used").alias("model_used"), F.col("r.search_duration_ms").alias("search_duration_ms"), F.posexplode("r.chunks").alias("_c", "c"))
    return each.select("query_id", "_r", "_c", "model_used", "search_duration_ms", "c.*")


def parse(texts: DataFrame, strategy: str) -> DataFrame:
    """The chunks of responses written as JSON (query_id, json), in order, with defaults.

    A chunk without an id or a document goes; one without a keyword ranker in
    its metadata has that of its strategy.
    """
    rows = flatten(texts.select("query_id", F.from_json("json", RESPONSE).alias("responses")))
    good = rows.filter((F.trim(F.coalesce("chunk_id", F.lit(""))) != "") & (F.trim(F.coalesce("document_id", F.lit(""))) != ""))
    ranker = F.coalesce(F.nullif(F.trim(F.element_at("metadata", "keyword_ranker")), F.lit("")), F.lit(RANKERS.get(strategy, "")))
    return good.select(
        "query_id", "_r", "_c", F.trim("chunk_id").alias("chunk_id"), F.trim("document_id").alias("document_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.trim(F.coalesce("source", F.lit(""))).alias("source"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.coalesce("model_used", F.lit("")).alias("model_used"), ranker.alias("keyword_ranker"), F.coalesce("search_duration_ms", F.lit(0.0)).alias("search_duration_ms"),
    )
