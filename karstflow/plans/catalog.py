"""The registered queries on the driver's tables, each with its SQL for comparison.

benchmark items are queries, labels are judgements, the star schema is a
property graph. No query takes a part of its tables: scopes and top-k are
those of the operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.operators import chunking, evaluation, fusion, graph, keyword, upsert, vector
from karstflow.plans import graph_search
from karstflow.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """documents as chunks."""
    t = _table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    return t.select(key.alias("chunk_id"), key.alias("document_id"), F.concat(F.col("source"), F.lit("/doc_"), key).alias("title"), "text", "source", F.col("lang").alias("retrieval_corpus"))


_INDEXES: dict[tuple, keyword.Index] = {}


def _index(spark: SparkSession, d: str, in_english: bool = False) -> keyword.Index:
    """The stored index of documents, built by the first search of a session that asks for it."""
    key = spark.sparkContext.applicationId, d, in_english
    if key not in _INDEXES:
        _INDEXES[key] = keyword.build(_chunks(spark, d), f"{shared_dir(spark)}/karstflow-indexes/{uuid.uuid4().hex}", in_english)
    return _INDEXES[key]


def _ask(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts, 1)], "query_id string, query string")


#: RE2's \w is ASCII; this is the same term in its dialect.
_TERM = r"[\p{L}\p{M}\p{N}_]+(?:-[\p{L}\p{M}\p{N}_]+)*"
_ASK = ("the patient river of the north", "de la ley", "über die und")
_CHUNKS = "chunks AS (SELECT CAST(doc_id AS VARCHAR) chunk_id, source || '/doc_' || doc_id title, text, source, lang FROM documents)"


def _toks(scope: str = "TRUE") -> str:
    return f"{_CHUNKS}, scope AS (SELECT *, list_transform(regexp_extract_all(text || chr(10) || title, '{_TERM}'), lambda x: lower(x)) toks FROM chunks WHERE {scope})"


def _terms_sql(queries: tuple[str, ...] = _ASK) -> str:
    rows = ", ".join(f"('q{i}', '{q}')" for i, q in enumerate(queries, 1))
    return f"q(query_id, query) AS (VALUES {rows}), qt AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest(list_transform(regexp_extract_all(query, '{_TERM}'), lambda x: lower(x))) term FROM q) GROUP BY ALL)"


def _bm25_sql(scope: str = "TRUE", k: int = 10, match_all: bool = False, queries: tuple[str, ...] = _ASK) -> str:
    cover = "JOIN (SELECT query_id, chunk_id FROM m JOIN (SELECT query_id, count(*) need FROM qt GROUP BY query_id) USING (query_id) GROUP BY query_id, chunk_id HAVING count(*) = max(need)) USING (query_id, chunk_id)" if match_all else ""
    return f"""WITH {_toks(scope)}, {_terms_sql(queries)},
st AS (SELECT count(*) n, avg(len(toks)) avgdl FROM scope),
m AS (SELECT query_id, term, qtf, chunk_id, len(toks) dl, count(*) f FROM (SELECT chunk_id, toks, unnest(toks) term FROM scope) JOIN qt USING (term) GROUP BY query_id, term, qtf, chunk_id, len(toks)),
df AS (SELECT query_id, term, count(*) df FROM m GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score FROM m {cover} JOIN df USING (query_id, term), st GROUP BY query_id, chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS INTEGER) "rank" FROM s WHERE score > 0)
SELECT query_id, chunk_id, score, "rank" FROM r WHERE "rank" <= {k}"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "score", "rank")


@registered("bm25_topk", _bm25_sql())
def bm25_topk(spark, d):
    return _ranked(keyword.bm25(_index(spark, d), _ask(spark, *_ASK), places=6))


@registered("bm25_scoped_source", _bm25_sql("source IN ('src0', 'src1', 'src2')", 20))
def bm25_scoped_source(spark, d):
    return _ranked(keyword.bm25(_index(spark, d), _ask(spark, *_ASK), 20, sources=["src0", "src1", "src2"], places=6))


@registered("bm25_scoped_corpus", _bm25_sql("lang = 'es'"))
def bm25_scoped_corpus(spark, d):
    return _ranked(keyword.bm25(_index(spark, d), _ask(spark, *_ASK), corpus="es", places=6))


@registered("bm25_match_all", _bm25_sql(match_all=True))
def bm25_match_all(spark, d):
    return _ranked(keyword.bm25(_index(spark, d), _ask(spark, *_ASK), match_all=True, places=6))


@registered("batch_bm25_benchmark", f"""WITH {_toks()},
q AS (SELECT CAST(item_id AS VARCHAR) query_id, text query FROM benchmark),
qt AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest(list_transform(regexp_extract_all(query, '{_TERM}'), lambda x: lower(x))) term FROM q) GROUP BY ALL),
st AS (SELECT count(*) n, avg(len(toks)) avgdl FROM scope),
tf AS (SELECT chunk_id, term, len(toks) dl, count(*) f FROM (SELECT chunk_id, toks, unnest(toks) term FROM scope) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM tf GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score FROM tf JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS INTEGER) "rank" FROM s WHERE score > 0)
SELECT query_id, chunk_id, score, "rank" FROM r WHERE "rank" <= 5""")
def batch_bm25_benchmark(spark, d):
    q = _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return _ranked(keyword.bm25(_index(spark, d), q, 5, places=6))


_FTS = f"""WITH {_CHUNKS}, {_terms_sql()}, tot AS (SELECT query_id, count(*) total FROM qt GROUP BY ALL),
w AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(text, '{_TERM}'), lambda x: lower(x))) term, 1.0e0 w FROM chunks UNION ALL SELECT chunk_id, unnest(list_transform(regexp_extract_all(title, '{_TERM}'), lambda x: lower(x))), 0.4e0 FROM chunks),
m AS (SELECT query_id, term, chunk_id, sum(w) w FROM w JOIN qt USING (term) GROUP BY ALL),
g AS (SELECT query_id, chunk_id, sum(w) r, count(*) tc, any_value(total) total FROM m JOIN tot USING (query_id) GROUP BY query_id, chunk_id)"""
_FTS_END = """, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) "rank" FROM s) SELECT query_id, chunk_id, score, "rank" FROM r WHERE "rank" <= 10"""


@registered("fts_any", _FTS + ", s AS (SELECT query_id, chunk_id, round(r / (r + 1), 6) score FROM g)" + _FTS_END)
def fts_any(spark, d):
    return _ranked(keyword.fts(_index(spark, d), _ask(spark, *_ASK), places=6))


@registered("fts_match_all_intersect", _FTS + ", s AS (SELECT query_id, chunk_id, round(r / (r + 1) * (1 + 0.5 * tc / total), 6) score FROM g WHERE tc = total)" + _FTS_END)
def fts_match_all(spark, d):
    return _ranked(keyword.fts(_index(spark, d), _ask(spark, *_ASK), match_all=True, places=6))


@registered("fts_english")
def fts_english(spark, d):
    """Stems, which DuckDB can't give offline; tests compare the rows with a brute-force search."""
    return _ranked(keyword.fts(_index(spark, d, True), _ask(spark, "the patient rivers of the northern lands", "erased theories", "running thinned"), places=6))


@registered("bm25_unstored", _bm25_sql("source IN ('src1', 'src4')", 5))
def bm25_unstored(spark, d):
    return _ranked(keyword.bm25(_chunks(spark, d), _ask(spark, *_ASK), 5, sources=["src1", "src4"], places=6))


@registered("tokenize_stats", f"""SELECT lang, CAST(count(*) AS BIGINT) n_docs, CAST(sum(len(t)) AS BIGINT) n_terms, CAST(max(len(t)) AS BIGINT) longest FROM (SELECT lang, regexp_extract_all(text, '{_TERM}') t FROM documents) GROUP BY lang""")
def tokenize_stats(spark, d):
    t = _table(spark, d, "documents").select("lang", F.size(T.terms(F.col("text"))).cast("long").alias("n"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms"), F.max("n").alias("longest"))


@registered("document_ids", "SELECT doc_id, sha256(source || '::' || doc_id) document_id FROM documents")
def document_ids(spark, d):
    return _table(spark, d, "documents").select("doc_id", chunking.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("document_id"))


@registered("chunk_windows", """WITH w AS (SELECT doc_id, source, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w FROM documents),
s AS (SELECT *, unnest(range(0, len(w), 170)) st, len(range(0, len(w), 170)) total FROM w WHERE len(w) > 0)
SELECT doc_id, sha256(sha256(source || '::' || doc_id) || '::' || lang || '::' || (st // 170)) chunk_id, CAST(st // 170 + 1 AS INTEGER) chunk_index, CAST(total AS INTEGER) total_chunks,
md5('TITLE: doc ' || doc_id || ' | SOURCE: ' || source || ' | CORPUS: ' || lang || ' | PART: ' || (st // 170 + 1) || ' of ' || total || ' | CONTENT: ' || array_to_string(w[st + 1 : st + 200], ' ')) text_md5 FROM s""")
def chunk_windows(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", chunking.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("document_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "text", "source", F.col("lang").alias("retrieval_corpus"))
    return chunking.chunk(docs, 200).select("doc_id", "chunk_id", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


@registered("distinct_sources", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_sources(spark, d):
    return _table(spark, d, "documents").select("source").filter("source IS NOT NULL").distinct()


@registered("entity_filter", f"""SELECT CAST(doc_id AS VARCHAR) chunk_id FROM documents WHERE contains(lower(source || '/doc_' || doc_id), 'de la') OR len(list_filter(['de', 'la'], lambda t: NOT list_contains(list_transform(regexp_extract_all(text, '{_TERM}'), lambda x: lower(x)), t))) = 0""")
def entity_filter(spark, d):
    return keyword.entity_filter(_chunks(spark, d), "de la").select("chunk_id")


@registered("doc_diversity", f"""WITH c AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '{_TERM}')) AS INTEGER) score FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) r FROM c)
SELECT doc_id, source, score FROM a WHERE r <= 3""")
def doc_diversity(spark, d):
    c = _table(spark, d, "documents").select(F.lit("q").alias("query_id"), "doc_id", F.col("source").alias("document_id"), F.size(T.terms(F.col("text"))).alias("score"))
    return keyword.capped(c, 3, F.col("score").desc(), F.col("doc_id")).select("doc_id", F.col("document_id").alias("source"), "score")


# Vectors


def _vectors(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def _asked(items):
    """The stated query set: every vector whose id is divisible by 100."""
    return items.filter(F.col("item_id") % 100 == 0).select(F.col("item_id").cast("string").alias("query_id"), F.col("embedding").alias("query_embedding"))


_NEAR = """WITH q AS (SELECT CAST(vec_id AS VARCHAR) query_id, CAST(embedding AS DOUBLE[]) qe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id item_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe), 6) score FROM embeddings, q WHERE {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, item_id) AS INTEGER) "rank" FROM s)
SELECT query_id, item_id, label, score, "rank" FROM r WHERE "rank" <= {k} {floor}"""


@registered("cosine_topk", _NEAR.format(where="TRUE", by="query_id", k=10, floor=""))
def cosine_topk(spark, d):
    v = _vectors(spark, d)
    return vector.nearest(v, _asked(v)).select("query_id", "item_id", "label", "score", "rank")


@registered("cosine_filtered_label", _NEAR.format(where="label IN (1, 2)", by="query_id", k=10, floor=""))
def cosine_filtered_label(spark, d):
    v = _vectors(spark, d)
    return vector.nearest(v, _asked(v), where=F.col("label").isin(1, 2)).select("query_id", "item_id", "label", "score", "rank")


@registered("cosine_per_label_topk_floor", _NEAR.format(where="TRUE", by="query_id, label", k=10, floor="AND score >= 0.11"))
def cosine_per_label(spark, d):
    v = _vectors(spark, d)
    return vector.nearest_by_label(v, _asked(v)).select("query_id", "item_id", "label", "score", "rank")


@registered("nearest_with_rows", _NEAR.format(where="TRUE", by="query_id", k=3, floor="").replace("SELECT query_id, item_id, label, score, \"rank\" FROM r", "SELECT query_id, item_id, \"rank\", lang, source, md5(text) text_md5 FROM r JOIN documents ON doc_id = item_id"))
def nearest_with_rows(spark, d):
    v = _vectors(spark, d)
    wide = _table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source", F.md5("text").alias("text_md5"))
    return vector.with_rows(vector.nearest(v, _asked(v), 3).select("query_id", "item_id", "rank"), wide, "item_id")


# Fusion: two ranked lists of documents, one by length and one by similarity

_LISTS = f"""qs AS (SELECT CAST(vec_id AS VARCHAR) query_id, vec_id, CAST(embedding AS DOUBLE[]) qe FROM embeddings WHERE vec_id % 100 = 0),
a AS (SELECT query_id, doc_id item_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(len(regexp_extract_all(text, '{_TERM}')) - vec_id), doc_id) rk FROM documents, qs),
b AS (SELECT query_id, e.vec_id item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe), 6) DESC, e.vec_id) rk FROM embeddings e, qs),
u AS (SELECT *, 0 lo FROM a WHERE rk <= 100 UNION ALL SELECT *, 1 FROM b WHERE rk <= 100),
g AS (SELECT query_id, item_id, round(sum(1.0e0 / (60 + rk)), 10) score, min(lo * 100000 + rk) fr FROM u GROUP BY ALL)"""


def _lists(spark, d):
    """Of each query the documents whose length is nearest to its number, and the vectors nearest to it."""
    docs, v = _table(spark, d, "documents"), _vectors(spark, d)
    sizes = docs.select(F.col("doc_id").alias("item_id"), F.regexp_count("text", F.lit(T.TERM)).alias("n"))
    asked = _asked(v).select("query_id", F.col("query_id").cast("long").alias("at"))
    return [vector.nearest_numbers(sizes, asked, 100), vector.nearest(v, _asked(v), 100)]


@registered("rrf_two_lists", f"WITH {_LISTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, item_id) AS INTEGER) \"rank\" FROM g) SELECT query_id, item_id, score, \"rank\" FROM r WHERE \"rank\" <= 50")
def rrf_two_lists(spark, d):
    return fusion.rrf(_lists(spark, d), 50).select("query_id", "item_id", "score", "rank")


@registered("rrf_title_dedupe", f"""WITH {_LISTS}, t AS (SELECT g.*, source title FROM g JOIN documents ON item_id = doc_id), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY score DESC, fr, item_id) tr FROM t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, item_id) AS INTEGER) "rank" FROM x WHERE tr = 1) SELECT query_id, item_id, score, "rank" FROM r""")
def rrf_title_dedupe(spark, d):
    titles = _table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("title"))
    return fusion.rrf(_lists(spark, d), titles=titles).select("query_id", "item_id", "score", "rank")


@registered("service_boost", f"""WITH {_LISTS}, r AS (SELECT g.*, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, item_id) rk FROM g JOIN documents ON item_id = doc_id), k AS (SELECT * FROM r WHERE rk <= {fusion.overfetch(15)}),
bb AS (SELECT *, CASE WHEN source IN ('src1', 'src2') THEN 1.0e0 / (60 + row_number() OVER (PARTITION BY query_id, source IN ('src1', 'src2') ORDER BY rk)) ELSE 0 END + 1.0e0 / (60 + rk) bs FROM k),
n AS (SELECT query_id, item_id, source, round(bs, 10) boost_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bs, 10) DESC, score DESC, rk) AS INTEGER) new_rank FROM bb) SELECT * FROM n WHERE new_rank <= 15""")
def service_boost(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source")
    ranked = fusion.rrf(_lists(spark, d)).join(docs, "item_id")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= fusion.overfetch(15))
    return fusion.service_boost(ranked, ["SRC1", "src2"], 15).select("query_id", "item_id", "source", "boost_score", "new_rank")


@registered("overfetched_diversity", f"""WITH {_LISTS}, r AS (SELECT g.*, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, item_id) rk FROM g JOIN documents ON item_id = doc_id), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rk) cr FROM r)
SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rk) AS INTEGER) "rank" FROM c WHERE cr <= 2""")
def overfetched_diversity(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("document_id"))
    return fusion.diverse(fusion.rrf(_lists(spark, d)).join(docs, "item_id"), 2).select("query_id", "item_id", "rank")


# Evaluation: a query for each source, judged by labels

_RUN = """run AS (SELECT source query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) rk FROM documents),
rel AS (SELECT DISTINCT source query_id, doc_id, lang g FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
sz AS (SELECT query_id, count(*) n, count(DISTINCT g) ng FROM rel GROUP BY ALL), got AS (SELECT query_id, count(*) got FROM run WHERE rk <= 15 GROUP BY ALL),
h AS (SELECT query_id, count(*) hits, min(rk) f, sum(1.0e0 / log2(rk + 1)) dcg, count(DISTINCT g) gh FROM run JOIN rel USING (query_id, doc_id) WHERE rk <= 15 GROUP BY ALL),
a AS (SELECT query_id, n, ng, coalesce(got, 0) got, coalesce(hits, 0) hits, f, coalesce(dcg, 0) dcg, coalesce(gh, 0) gh, (SELECT sum(1.0e0 / log2(i + 1)) FROM range(1, CAST(least(n, 15) AS BIGINT) + 1) t(i)) idcg FROM sz LEFT JOIN h USING (query_id) LEFT JOIN got USING (query_id)),
e AS (SELECT query_id, round(hits / n, 6) recall, round(hits / 15, 6) "precision", round(CASE WHEN hits > 0 THEN 2 * (hits / n) * (hits / 15) / (hits / n + hits / 15) ELSE 0 END, 6) f1, round(coalesce(1.0e0 / f, 0), 6) mrr, round(dcg / idcg, 6) ndcg,
round(least(15, n) / n, 6) recall_ceiling, round((hits / n) / (least(15, n) / n), 6) ceiling_adjusted_recall, round(gh / ng, 6) evidence_group_recall, n relevant_count, got retrieved_count, hits hit_count, ng evidence_group_count, gh evidence_group_hit_count FROM a)"""


def _evaluated(spark, d, places=6):
    docs = _table(spark, d, "documents")
    w = W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    run = docs.select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(w).alias("rank"))
    rel = docs.join(_table(spark, d, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("query_id"), "doc_id", F.col("lang").alias("evidence_group"))
    return evaluation.metrics(run, rel, 15, places)


@registered("retrieval_metrics", f"WITH {_RUN} SELECT * FROM e")
def retrieval_metrics(spark, d):
    return _evaluated(spark, d)


@registered("metrics_by_category", f"WITH {_RUN.replace(', 6)', ', 12)')}, c AS (SELECT *, right(query_id, 1) category FROM e) SELECT category, count(*) n, " + ", ".join(f'round(avg("{m}"), 6) "{m}"' for m in (*evaluation.METRICS, *evaluation.MORE[:2])) + " FROM c GROUP BY category")
def metrics_by_category(spark, d):
    return evaluation.grouped(_evaluated(spark, d, 12).withColumn("category", F.right("query_id", F.lit(1))), "category")


# Graph: entities are nodes, foreign keys edges, line items the evidence of part - supplier edges


@registered("graph_nodes", """SELECT 'REGION::' || r_regionkey node_key, 'REGION' "label", r_name "name" FROM region UNION ALL SELECT 'NATION::' || n_nationkey, 'NATION', n_name FROM nation UNION ALL SELECT 'CUSTOMER::' || c_custkey, 'CUSTOMER', c_name FROM customer
UNION ALL SELECT 'SUPPLIER::' || s_suppkey, 'SUPPLIER', s_name FROM supplier UNION ALL SELECT 'PART::' || p_partkey, 'PART', p_name FROM part""")
def graph_nodes(spark, d):
    out = None
    for label, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        one = _table(spark, d, label).select(F.concat(F.lit(label.upper() + "::"), F.col(key).cast("string")).alias("node_key"), F.lit(label.upper()).alias("label"), F.col(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


_EDGES = """edges AS (SELECT s || '::' || p || '::' || o edge_key, s subject_key, p predicate, o object_key FROM (SELECT 'NATION::' || n_nationkey s, 'IN_REGION' p, 'REGION::' || n_regionkey o FROM nation UNION ALL SELECT 'CUSTOMER::' || c_custkey, 'OF_NATION', 'NATION::' || c_nationkey FROM customer UNION ALL SELECT 'SUPPLIER::' || s_suppkey, 'OF_NATION', 'NATION::' || s_nationkey FROM supplier))"""


def _edges(spark, d):
    out = None
    for table, label, key, predicate, other, fk in (("nation", "NATION", "n_nationkey", "IN_REGION", "REGION", "n_regionkey"), ("customer", "CUSTOMER", "c_custkey", "OF_NATION", "NATION", "c_nationkey"), ("supplier", "SUPPLIER", "s_suppkey", "OF_NATION", "NATION", "s_nationkey")):
        one = _table(spark, d, table).select(F.concat(F.lit(label + "::"), F.col(key).cast("string")).alias("subject_key"), F.lit(predicate).alias("predicate"), F.concat(F.lit(other + "::"), F.col(fk).cast("string")).alias("object_key"))
        out = one if out is None else out.unionByName(one)
    return out.select(graph.edge_key(F.col("subject_key"), F.col("predicate"), F.col("object_key")).alias("edge_key"), "*")


@registered("graph_edges", f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d)


def _evidence(spark, d):
    return _table(spark, d, "lineitem").select(F.concat_ws("::", F.col("l_partkey").cast("string"), F.lit("SUPPLIED_BY"), F.col("l_suppkey").cast("string")).alias("edge_key"), F.concat(F.lit("PART::"), F.col("l_partkey").cast("string")).alias("node_key"), F.col("l_returnflag").alias("source_kind"), (1 - F.col("l_discount")).alias("confidence"), "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("observed_at"))


@registered("edge_stats_maxby", "SELECT l_partkey || '::SUPPLIED_BY::' || l_suppkey edge_key, max(1 - l_discount) confidence, arg_max(l_returnflag, row(1 - l_discount, l_orderkey, l_linenumber)) source_kind, count(*) evidence_count FROM lineitem GROUP BY ALL")
def edge_stats(spark, d):
    return graph.edge_stats(_evidence(spark, d), "l_orderkey", "l_linenumber")


@registered("node_evidence_stats", """SELECT 'PART::' || p_partkey node_key, 'PART' "label", p_name "name", coalesce(c, 1.0) confidence, coalesce(n, 0) evidence_count, coalesce(k, '') source_kinds FROM part LEFT JOIN (SELECT l_partkey, max(1 - l_discount) c, count(*) n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) k FROM lineitem GROUP BY ALL) ON p_partkey = l_partkey""")
def node_evidence_stats(spark, d):
    nodes = _table(spark, d, "part").select(F.concat(F.lit("PART::"), F.col("p_partkey").cast("string")).alias("node_key"), F.lit("PART").alias("label"), F.col("p_name").alias("name"))
    return graph.node_stats(nodes, _evidence(spark, d)).withColumn("source_kinds", F.array_join("source_kinds", ","))


@registered("evidence_top5_priority", """WITH e AS (SELECT 'PART::' || l_partkey node_key, l_returnflag source_kind, 1 - l_discount confidence, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_discount, l_shipdate DESC, l_orderkey, l_linenumber) r FROM lineitem)
SELECT node_key, source_kind, confidence, l_orderkey, l_linenumber, CAST(r AS INTEGER) evidence_rank FROM e WHERE r <= 5""")
def evidence_top5(spark, d):
    priority = F.when(F.col("source_kind") == "A", 0).when(F.col("source_kind") == "R", 1).otherwise(2)
    best = graph.best_evidence(_evidence(spark, d), "node_key", 5, priority, F.col("confidence").desc(), F.col("observed_at").desc(), F.col("l_orderkey"), F.col("l_linenumber"))
    return best.select("node_key", "source_kind", "confidence", "l_orderkey", "l_linenumber", "evidence_rank")


@registered("distinct_on_best_evidence", "SELECT DISTINCT ON (l_partkey) l_partkey, l_suppkey, l_orderkey, l_discount FROM lineitem ORDER BY l_partkey, l_discount, l_orderkey, l_linenumber")
def distinct_on(spark, d):
    return graph.best_of_each(_table(spark, d, "lineitem"), "l_partkey", ["l_discount", "l_orderkey", "l_linenumber"], "l_suppkey", "l_orderkey", "l_discount")


@registered("representative_chunk_lateral", "SELECT source, lang, min(CAST(doc_id AS VARCHAR)) chunk_id FROM documents GROUP BY ALL")
def representative(spark, d):
    return graph.representative_chunks(_table(spark, d, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("chunk_id")), "source", "lang")


@registered("stale_keys_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 30) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def stale_keys(spark, d):
    line = _table(spark, d, "lineitem")
    return graph.stale(_table(spark, d, "part").select("p_partkey"), (line.filter("l_returnflag = 'R' AND l_quantity > 30"), "l_partkey"), (line.filter("l_quantity > 49"), "l_partkey"), key="p_partkey")


_HOP = "SELECT DISTINCT edge_key, subject_key, predicate, object_key FROM edges WHERE subject_key IN ({0}) OR object_key IN ({0})"


@registered("frontier_1hop", f"WITH {_EDGES} " + _HOP.format("'REGION::1', 'NATION::3'"))
def frontier_1hop(spark, d):
    frontier = spark.createDataFrame([("q", "REGION::1"), ("q", "NATION::3")], "query_id string, node_key string")
    return graph.neighbours(_edges(spark, d), frontier).select("edge_key", "subject_key", "predicate", "object_key")


@registered("frontier_2hop", f"WITH {_EDGES}, one AS ({_HOP.format(chr(39) + 'REGION::1' + chr(39))}), f AS (SELECT subject_key k FROM one UNION SELECT object_key FROM one) " + _HOP.format("SELECT k FROM f"))
def frontier_2hop(spark, d):
    edges = _edges(spark, d)
    one = graph.neighbours(edges, spark.createDataFrame([("q", "REGION::1")], "query_id string, node_key string"))
    reached = one.select("query_id", F.explode(F.array("subject_key", "object_key")).alias("node_key")).distinct()
    return graph.neighbours(edges, reached).select("edge_key", "subject_key", "predicate", "object_key")


@registered("seed_lookup_contains", """WITH n AS (SELECT 'PART::' || p_partkey node_key, p_name "name", p_retailprice c FROM part), m(mention, mc) AS (VALUES ('red', 0.86e0), ('bolt', 0.58e0), ('small_ring', 0.58e0)),
h AS (SELECT mention, node_key, "name", round(1.0e0 * mc, 6) score, row_number() OVER (PARTITION BY mention ORDER BY node_key) r FROM n JOIN m ON contains(replace(replace(lower("name"), '_', '-'), '.', ''), mention)) SELECT mention, node_key, "name", score FROM h WHERE r <= 15""")
def seed_lookup(spark, d):
    nodes = _table(spark, d, "part").select(F.concat(F.lit("PART::"), F.col("p_partkey").cast("string")).alias("node_key"), F.lit("PART").alias("label"), F.col("p_name").alias("name"), F.lit(1.0).alias("confidence"), F.lit(0).alias("evidence_count"))
    mentions = spark.createDataFrame([("q", m, m, None, c) for m, c in (("red", 0.86), ("bolt", 0.58), ("small_ring", 0.58))], "query_id string, text string, normalized string, label string, confidence double")
    return graph_search.seed_matches(nodes, mentions).select(F.col("text").alias("mention"), "node_key", "name", F.round("score", 6).alias("score"))


@registered("seed_round_robin", """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) rnd, max(c_acctbal) OVER (PARTITION BY c_mktsegment) b, count(*) OVER (PARTITION BY c_mktsegment) n FROM customer)
SELECT c_custkey, c_mktsegment, CAST(rnd AS INTEGER) round FROM r ORDER BY rnd, b DESC, n DESC, c_mktsegment LIMIT 25""")
def seed_round_robin(spark, d):
    c = _table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("score"))
    return fusion.round_robin(c, "c_mktsegment", [F.col("score").desc(), F.col("c_custkey")], 25).select("c_custkey", "c_mktsegment", "round")


@registered("path_scores", """SELECT l_orderkey, l_linenumber, round((1 - l_discount) * exp(-0.35 * (l_linenumber - 1)) * least(1.3, 1 + least(l_quantity, 5) / 20 + CASE WHEN l_returnflag = 'R' THEN 0.05 ELSE 0 END), 6) score FROM lineitem""")
def path_scores(spark, d):
    t = _table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.round(graph.path_score(1 - F.col("l_discount"), F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag") == "R"), 6).alias("score"))


@registered("candidate_scores", """WITH b AS (SELECT doc_id, lower(text) b, source FROM documents) SELECT doc_id, round(1 + 0.3 * len(list_filter(['the', 'src1', 'ley'], lambda t: contains(b, t))) / 3 + CASE WHEN source IN ('the', 'src1', 'ley') THEN 0.2 ELSE 0 END, 6) relevance FROM b""")
def candidate_scores(spark, d):
    t = _table(spark, d, "documents")
    return t.select("doc_id", F.round(graph.relevance(F.lower("text"), F.col("source"), F.array(*map(F.lit, ("the", "src1", "ley")))), 6).alias("relevance"))


# Data management


@registered("upsert_latest", "SELECT DISTINCT ON (user_id) user_id, event_id, ts, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def upsert_latest(spark, d):
    t = _table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return upsert.latest(t, ["user_id"], F.col("ts"), F.col("event_id"))


@registered("skip_unchanged", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(n_chars <= quality * 2000, FALSE)")
def skip_unchanged(spark, d):
    at = lambda c: F.timestamp_seconds(c.cast("long"))  # noqa: E731  lengths stand for times
    docs = _table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("document_id"), F.lit("c").alias("retrieval_corpus"), at(F.col("n_chars")).alias("last_modified"))
    seen = _table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.lit("c").alias("retrieval_corpus"), at(F.col("quality") * 2000).alias("last_indexed_at"))
    return chunking.changed_only(docs, seen).select("doc_id")


@registered("replace_document", "SELECT doc_id, lang, 0 AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'new', 1 FROM labels WHERE toxic = 1")
def replace_document(spark, d):
    old = _table(spark, d, "documents").select("doc_id", "lang", F.lit(0).alias("v"))
    new = _table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit("new").alias("lang"), F.lit(1).alias("v"))
    named = lambda x: x.withColumn("document_id", F.col("doc_id")).withColumn("retrieval_corpus", F.lit("c"))
    return upsert.replace_documents(named(old), named(new)).drop("document_id", "retrieval_corpus")


@registered("metadata_upsert_keep_source", "SELECT coalesce(a.doc_id, b.doc_id) doc_id, CASE WHEN a.doc_id IS NOT NULL THEN a.source ELSE 'src-new' END source, coalesce(b.quality, a.q) q FROM (SELECT doc_id, source, CAST(n_chars AS INTEGER) q FROM documents) a FULL JOIN labels b ON a.doc_id = b.doc_id")
def metadata_upsert(spark, d):
    old = _table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("int").alias("q"))
    new = _table(spark, d, "labels").select("doc_id", F.lit("src-new").alias("source"), F.col("quality").alias("q"))
    return upsert.upsert_keeping(old, new, ["doc_id"], keep=["source"], fill=["q"])


@registered("conversation_last6", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations) WHERE r <= 6")
def conversation_last6(spark, d):
    return upsert.last_messages(_table(spark, d, "conversations"), 6)


@registered("conversation_assemble", "SELECT conv_id, left(arg_min(text, turn), 80) title, count(*) n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) messages FROM conversations GROUP BY conv_id")
def conversation_assemble(spark, d):
    return upsert.assembled(_table(spark, d, "conversations"))


@registered("url_host_path", "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) host FROM pages")
def url_host(spark, d):
    return _table(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@registered("json_props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events")
def json_props(spark, d):
    return _table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@registered("label_histogram", "SELECT label, count(*) n FROM embeddings GROUP BY ALL")
def label_histogram(spark, d):
    return graph.label_counts(_table(spark, d, "embeddings"))


@registered("intersect_sources", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def intersect_sources(spark, d):
    t = _table(spark, d, "documents")
    return t.filter("lang = 'en'").select("source").intersect(t.filter("lang = 'fr'").select("source"))
