"""Keyword search: a stored index, BM25 and weighted any-term or all-terms matching.

Chunks have chunk_id, document_id, title, text, source and retrieval_corpus.
`build` tokenises them once and, given a folder, stores the postings in the
order of their terms' hashes, so that a search reads the pages of its own terms;
given chunks in place of an index, a search tokenises them. Statistics are those of the scope
that a search names: scope first, then count. Queries are tables (query_id,
query), so a batch is one plan; a single query is a batch of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.functions.stemming import lexeme

#: Weights of an occurrence in the text and in the title.
IN_TEXT, IN_TITLE = 1.0, 0.4
#: Chunks whose postings are put in order by one task and are one file.
SLICE = 6_000
#: Terms of a batch of queries up to which the postings are read for them alone, and up to which they are named to the reader one by one.
FEW, NAMED = 2_000, 50
#: Terms of queries that are sent to every task when their postings are read alone; of more, Spark chooses.
SENT = 100_000
#: Terms whose stems a worker remembers, and chunks whose terms it holds.
KNOWN, PYTHON = 200_000, 200


@dataclass(frozen=True)
class Index:
    """postings: term, chunk_id, document_id, source, retrieval_corpus, tf, w, dl (and key, the term's hash, if stored); lengths: a row for each chunk."""

    postings: DataFrame
    lengths: DataFrame
    english: bool = False
    stored: bool = False


def in_scope(chunks: DataFrame, sources: list[str] | None = None, corpus: str | None = None) -> DataFrame:
    """Rows of the sources and the corpus; None or `all` is no restriction."""
    if sources:
        chunks = chunks.filter(F.col("source").isin(list(sources)))
    if corpus and corpus != "all":
        chunks = chunks.filter(F.col("retrieval_corpus") == corpus)
    return chunks


def in_any_scope(chunks: DataFrame, sources: list[str]) -> DataFrame:
    """The graph's source filter: sources in any case; none is no restriction."""
    return chunks.filter(F.lower("source").isin([s.lower() for s in sources])) if sources else chunks


def entity_filter(chunks: DataFrame, entity: str) -> DataFrame:
    """Chunks whose title holds the entity or whose text has all of its terms."""
    wanted = T.terms(F.lit(entity))
    return chunks.filter(F.contains(F.lower("title"), F.lit(entity.lower())) | (F.size(F.array_except(wanted, T.terms(F.col("text")))) == 0))


def with_titles(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Chunks with the title they carry, else their document's name, else nothing.

    metadata: document_id, retrieval_corpus, name.
    """
    names = metadata.select("document_id", "retrieval_corpus", F.col("name").alias("_name"))
    both = chunks.join(names, ["document_id", "retrieval_corpus"], "left")
    return both.withColumn("title", F.coalesce("title", "_name", F.lit(""))).drop("_name").select(*chunks.columns)


_KEYS = ("chunk_id", "document_id", "source", "retrieval_corpus")


def _counted(chunks: DataFrame) -> DataFrame:
    """A row for each chunk with dl and its terms as an array of struct(term, tf, in_title).

    Counted inside the row: the sorted terms are cut where they change, so
    nothing is exchanged and no token becomes a row.
    """
    toks = chunks.select(*_KEYS, F.coalesce(T.terms(F.col("text")), F.array().cast("array<string>")).alias("_a"), F.coalesce(T.terms(F.col("title")), F.array().cast("array<string>")).alias("_b"))
    toks = _once(toks.select(*_KEYS, "_b", F.sort_array(F.concat("_a", "_b")).alias("_t")))
    n = F.size("_t")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (F.get(F.col("_t"), i) != F.get(F.col("_t"), i - 1))))
    cut = _once(toks.withColumn("_i", starts))

    def term(i: Column, k: Column) -> Column:
        t = F.get(F.col("_t"), i)
        return F.struct(t.alias("term"), (F.coalesce(F.get(F.col("_i"), k + 1), n) - i).alias("tf"), F.size(F.filter("_b", lambda b: b == t)).alias("in_title"))

    return cut.select(*_KEYS, n.alias("dl"), F.transform("_i", term).alias("terms"))


def _once(df: DataFrame) -> DataFrame:
    """`df` with its columns computed once: the optimiser doesn't copy expressions through a generator."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def _lexemes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([lexeme(x) for x in batch.column(0).to_pylist()], pa.string())], ["term", "lexeme"])


def english(rows: DataFrame) -> DataFrame:
    """(term, lexeme) of the distinct terms of `rows`; stop words have none.

    Stems aren't expressible in built-in functions, so each distinct term meets
    Python once.
    """
    found = rows.select("term").distinct().mapInArrow(_lexemes, "term string, lexeme string")
    return found.filter("lexeme <> ''")


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their counted terms (the last column) put together by stem; stop words go."""
    stem = lru_cache(KNOWN)(lexeme)
    for batch in (b.slice(at, PYTHON) for b in batches for at in range(0, b.num_rows, PYTHON)):
        column, kind = batch.columns[-1], batch.schema.field(batch.num_columns - 1).type
        names, tf, in_title = (column.flatten().field(x).to_pylist() for x in ("term", "tf", "in_title"))
        ends, out = column.offsets.to_pylist(), []
        ends = [x - ends[0] for x in ends]
        for first, after in zip(ends, ends[1:]):
            found: dict[str, list[int]] = {}
            for i in range(first, after):
                if x := stem(names[i]):
                    sums = found.setdefault(x, [0, 0])
                    sums[0] += tf[i]
                    sums[1] += in_title[i]
            out.append([{"term": x, "tf": a, "in_title": b} for x, (a, b) in found.items()])
        yield pa.record_batch([*batch.columns[:-1], pa.array(out, kind)], schema=batch.schema)


def build(chunks: DataFrame, folder: str | None = None, in_english: bool = False, size: int = SLICE) -> Index:
    """The index of chunks; stored in `folder` if one is given, to be opened again with `open_index`.

    in_english: terms become stems and stop words go. An existing folder is an
    error: a new state of the chunks gets a new folder. Chunks are dealt to
    slices of about `size` before they become postings, so postings are never
    exchanged, and a term of most chunks isn't one task's.
    """
    dealt = chunks.repartition(-(-max(1, chunks.count()) // size), "chunk_id") if folder else chunks
    counted = _counted(dealt)
    if in_english:
        counted = counted.mapInArrow(_stemmed, counted.schema)
    n = lambda c: F.coalesce(F.regexp_count(c, F.lit(T.TERM)), F.lit(0))
    lengths = chunks.select(*_KEYS, (n("text") + n("title")).alias("dl"))
    w = (F.col("tf") - F.col("in_title")) * IN_TEXT + F.col("in_title") * IN_TITLE
    rows = counted.select(*_KEYS, "dl", F.explode("terms").alias("x")).select("x.term", *_KEYS, F.col("x.tf").alias("tf"), F.col("x.in_title").alias("in_title"), "dl").withColumn("w", w).drop("in_title")
    if folder is None:
        return Index(rows, lengths, in_english)
    # One number to sort by: equal terms lie together, and pages tell by it what they hold.
    rows.withColumn("key", F.xxhash64("term")).sortWithinPartitions("key").write.parquet(f"{folder}/postings")
    lengths.write.parquet(f"{folder}/lengths")
    return open_index(chunks.sparkSession, folder, in_english)


def open_index(spark: SparkSession, folder: str, in_english: bool = False) -> Index:
    """An index that `build` stored, with the same setting."""
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"), in_english, True)


def _index(chunks: DataFrame | Index, in_english: bool = False) -> Index:
    return chunks if isinstance(chunks, Index) else build(chunks, in_english=in_english)


def query_terms(queries: DataFrame, in_english: bool = False) -> DataFrame:
    """(query_id, term, qtf): terms with the number of times the query has them."""
    rows = queries.select("query_id", F.explode(T.terms(F.col("query"))).alias("term"))
    if in_english:
        rows = rows.join(english(rows), "term").select("query_id", F.col("lexeme").alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def phrase(text: Column, words: Column) -> Column:
    """Whether a text has the terms of a phrase one after the other."""

    def follows(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(x["own"]) - F.size(x["asked"]) + 1, F.lit(1)))
        return (F.size(x["asked"]) > 0) & F.exists(at, lambda i: F.slice(x["own"], i, F.size(x["asked"])) == x["asked"])

    return T.let(F.struct(T.terms(text).alias("own"), T.terms(words).alias("asked")), follows)


def _postings_of(index: Index, wanted: DataFrame, sources: list[str] | None, corpus: str | None) -> tuple[DataFrame, bool]:
    """The postings of the queries' terms inside the scope, and whether the terms are few."""
    scoped = in_scope(index.postings, sources, corpus)
    terms = wanted.select("term").distinct()
    if index.stored:
        # Few terms: read the pages that have them alone.
        few = terms.select("term", F.xxhash64("term").alias("key")).limit(FEW + 1).collect()
        if len(few) <= FEW:
            keys = [F.col("key") == r.key for r in few] if len(few) <= NAMED else [F.col("key").isin([r.key for r in few])]
            return scoped.filter(reduce(Column.__or__, keys, F.lit(False))).filter(F.col("term").isin([r.term for r in few])).drop("key"), True
        scoped = scoped.drop("key")
    return scoped.join(terms, "term", "left_semi"), False


def _sent(wanted: DataFrame, few: bool) -> DataFrame:
    """Few terms as they are sent to the tasks that have their postings."""
    return F.broadcast(wanted) if few and wanted.limit(SENT + 1).count() <= SENT else wanted


def capped(ranked: DataFrame, most: int | None, *order: Column) -> DataFrame:
    """At most `most` chunks of a document for each query, best first."""
    if not most:
        return ranked
    w = W.partitionBy("query_id", "document_id").orderBy(*order)
    return ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def top(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query with their rank."""
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def covering(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, document_id) of documents whose chunks together have every term of the query."""
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("_need"))
    have = postings.select("document_id", "term").distinct().join(wanted, "term").groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("_have"))
    return have.join(need, "query_id").filter("_have = _need").select("query_id", "document_id")


def bm25(chunks: DataFrame | Index, queries: DataFrame, k: int = 10, sources: list[str] | None = None, corpus: str | None = None, match_all: bool = False, per_document: int | None = None, k1: float = 1.2, b: float = 0.75, places: int = 10) -> DataFrame:
    """(query_id, chunk_id, document_id, score, rank) by Okapi BM25 inside the scope.

    A repeated query term counts as often as it is repeated. Ties go to the
    greater chunk_id. Only positive scores are kept. A posting's weight is
    computed once for all queries, and postings are dealt by chunk before they
    meet the queries, so what a batch multiplies is never exchanged. Scores are
    rounded to `places` so that order doesn't hang on the order of sums.
    """
    index = _index(chunks)
    wanted = query_terms(queries)
    found, few = _postings_of(index, wanted, sources, corpus)
    wanted = _sent(wanted, few)
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = F.broadcast(df) if few else df
    stats = in_scope(index.lengths, sources, corpus).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = found.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    weighed = weighed.select("chunk_id", "document_id", "term", (idf * weight).alias("s")).repartition("chunk_id", "document_id")
    matched = weighed.join(wanted, "term")
    if match_all:
        matched = matched.join(covering(found, wanted), ["query_id", "document_id"], "left_semi")
    scored = matched.groupBy("query_id", "chunk_id", "document_id").agg(F.round(F.sum(F.col("qtf") * F.col("s")), places).alias("score")).filter("score > 0")
    order = F.col("score").desc(), F.col("chunk_id").desc()
    return top(capped(scored, per_document, *order), k, *order)


def fts(chunks: DataFrame | Index, queries: DataFrame, k: int = 10, sources: list[str] | None = None, corpus: str | None = None, match_all: bool = False, per_document: int | None = None, places: int = 10, in_english: bool = True) -> DataFrame:
    """(query_id, chunk_id, document_id, score, rank) by weighted occurrences of any query term.

    r sums 1.0 for each occurrence in the text and 0.4 for each in the title;
    the score is r / (r + 1). match_all: only documents that have all terms
    across their chunks, and the score grows by half the share of the terms
    that the chunk itself has. Terms are compared as English stems without
    stop words, or as they are; an index decides by how it was built.
    """
    index = _index(chunks, in_english)
    wanted = query_terms(queries, index.english).select("query_id", "term")
    found, few = _postings_of(index, wanted, sources, corpus)
    wanted = _sent(wanted, few)
    matched = found.select("chunk_id", "document_id", "term", "w").repartition("chunk_id", "document_id").join(wanted, "term")
    if match_all:
        matched = matched.join(covering(found, wanted), ["query_id", "document_id"], "left_semi")
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    r = matched.groupBy("query_id", "chunk_id", "document_id").agg(F.sum("w").alias("r"), F.count(F.lit(1)).alias("term_count")).join(total, "query_id")
    base = F.col("r") / (F.col("r") + 1)
    score = base * (1 + 0.5 * F.col("term_count") / F.col("total")) if match_all else base
    scored = r.select("query_id", "chunk_id", "document_id", F.round(score, places).alias("score"))
    order = F.col("score").desc(), F.col("chunk_id").asc()
    return top(capped(scored, per_document, *order), k, *order)


def search(chunks: DataFrame | Index, queries: DataFrame, ranker: str = "fts", **options) -> DataFrame:
    """The named ranker: `bm25` or `fts`. An index for `bm25` is one of terms as they are."""
    return {"bm25": bm25, "fts": fts}[ranker](chunks, queries, **options)
