"""Registered queries on names, routing, ingestion, evaluation and whole searches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.operators import chunking, evaluation, fusion, graph, keyword, responses, upsert, vector
from karstflow.plans import graph_catalog as C
from karstflow.plans import graph_search, routing
from karstflow.plans.catalog import _NEAR, _RUN, _bm25_sql, _chunks, _index, _table, _vectors, registered

# Names

_API = "[a-z0-9]+api(v[0-9]+)?"


def _named(x: str) -> str:
    """An interface's name in a path segment or a host's label, in SQL."""
    return f"CASE WHEN regexp_matches({x}, '{_API}') THEN regexp_extract({x}, '{_API}') WHEN regexp_replace({x}, '[_-]+', '', 'g') LIKE '%api' THEN regexp_replace({x}, '[_-]+', '', 'g') ELSE {x} || 'api' END"


@registered("api_names", f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) host, regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1) path FROM pages),
s AS (SELECT *, list_filter(list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '[^a-z0-9_-]+', '', 'g')), lambda x: x <> '' AND x NOT IN ('api', 'health', 'live', 'oauth2', 'swagger') AND (regexp_matches(x, '{_API}') OR NOT regexp_matches(x, '^v[0-9]+$'))) seg, list_filter(string_split(host, '.'), lambda x: x <> '') lab FROM u),
h AS (SELECT *, regexp_replace(CASE WHEN lab[1] IN ('api', 'dev', 'prod', 'staging', 'localhost', 'default', 'hooks') AND len(lab) > 1 THEN lab[2] ELSE lab[1] END, '[^a-z0-9_-]+', '', 'g') head FROM s)
SELECT page_id, {_named("coalesce(seg[1], head)")} api FROM h""")
def api_names(spark, d):
    return _table(spark, d, "pages").select("page_id", T.api_name(F.col("url")).alias("api"))


_V = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@registered("table_variants", f"""WITH v AS (SELECT p_partkey, {_V.format("p_name || 's'")} x FROM part)
SELECT p_partkey, array_to_string(list_distinct(list_filter([x, CASE WHEN x LIKE '%ies' THEN left(x, len(x) - 3) || 'y' END, CASE WHEN x LIKE '%es' THEN left(x, len(x) - 2) END, left(x, len(x) - 1)], lambda y: y IS NOT NULL)).list_sort(), ',') variants FROM v""")
def table_variants(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(T.table_variants(F.concat("p_name", F.lit("s")))), ",").alias("variants"))


@registered("topic_names", """WITH t AS (SELECT event_id, lower(event_type || CASE WHEN event_id % 3 = 0 THEN '/v' || event_id WHEN event_id % 3 = 1 THEN '.v1 ' ELSE '' END) x FROM events), c AS (SELECT event_id, trim(split_part(regexp_replace(x, '\\s+', '', 'g'), '/', 1), '._-') x FROM t)
SELECT event_id, CASE WHEN regexp_full_match(x, '[a-z0-9._-]{3,120}') AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('status', 'result', 'type', 'post', 'get') THEN x END topic FROM c""")
def topic_names(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    raw = F.concat(kind, F.when(n % 3 == 0, F.concat(F.lit("/v"), n.cast("string"))).when(n % 3 == 1, F.lit(".v1 ")).otherwise(""))
    return _table(spark, d, "events").select("event_id", T.topic_name(raw).alias("topic"))


@registered("flag_names", """WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'IFeatureFlags.Enable' || event_type WHEN 1 THEN 'use-' || upper(event_type) || ':on' WHEN 2 THEN event_type || '()' ELSE 'sdk-' || event_type END x, event_type FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Enable' || event_type WHEN 1 THEN 'use-' || lower(event_type) END flag FROM f""")
def flag_names(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    raw = F.when(n % 4 == 0, F.concat(F.lit("IFeatureFlags.Enable"), kind)).when(n % 4 == 1, F.concat(F.lit("use-"), F.upper(kind), F.lit(":on"))).when(n % 4 == 2, F.concat(kind, F.lit("()"))).otherwise(F.concat(F.lit("sdk-"), kind))
    return _table(spark, d, "events").select("event_id", T.flag_name(raw).alias("flag"))


@registered("title_keys", f"""WITH t AS (SELECT doc_id, 'src/' || upper(source) || '.Core.Api/Doc_' || doc_id || ' x' title, source FROM documents)
SELECT doc_id, {C._key('title')} "key", 'src:' || source bucket, 'src/' || source || '.core.api/doc_' || lpad(CAST(doc_id AS VARCHAR), 18, '0') || ' x' sort_key, CASE WHEN doc_id % 5 = 0 THEN 'text' WHEN doc_id % 5 = 1 THEN 'csharp' ELSE 'yaml' END language, 'a/' || source || '/b.cs' path FROM (SELECT doc_id, title, regexp_replace(source, '([0-9]+)', '') || lpad(regexp_extract(source, '[0-9]+'), 18, '0') source0, source FROM t)""".replace("'src/' || source || '.core.api/doc_'", "'src/' || source0 || '.core.api/doc_'"))
def title_keys(spark, d):
    n, source = F.col("doc_id"), F.col("source")
    title = F.concat(F.lit("src/"), F.upper(source), F.lit(".Core.Api/Doc_"), n.cast("string"), F.lit(" x"))
    file = F.when(n % 5 == 0, "a.b.txt").when(n % 5 == 1, "x/B.CS").otherwise("k8s/c.yml")
    path = F.concat(F.lit("./summaries/"), source, F.lit("\\a//"), source, F.lit("/b.cs"))
    return _table(spark, d, "documents").select("doc_id", T.token_key(title).alias("key"), T.service_bucket(title).alias("bucket"), T.natural_key(title).alias("sort_key"), T.language_of(file).alias("language"), T.repository_path(path, source).alias("path"))


@registered("numbered_lines", "SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || ': ' || x), chr(10)) numbered FROM conversations")
def numbered_lines(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", T.numbered_lines(F.col("text")).alias("numbered"))


@registered("query_terms", f"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.-]+'), lambda x: len(x) > 2 AND x NOT IN ({C._LIST}) AND NOT regexp_full_match(x, '[0-9]+')) t FROM benchmark)
SELECT item_id, array_to_string(list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 20), ' ') terms FROM t""")
def query_terms(spark, d):
    return _table(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@registered("phrase_match", "SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_-]+', ' ', 'g'), '(^| )of the( |$)')")
def phrase_match(spark, d):
    return _table(spark, d, "documents").filter(keyword.phrase(F.col("text"), F.lit("of the"))).select("doc_id")


# Routing: suppliers are services, with names short and long

_SERVICES = "sv AS (SELECT lower(replace(s_name, '#', '-')) source, 'SV' || (s_suppkey % 7) short_form, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Supplier Nr ' || s_suppkey END long_form FROM supplier)"
_ROUTED = """q AS (SELECT 's' || s_suppkey query_id, CASE s_suppkey % 6 WHEN 0 THEN 'which downstream services call Supplier Nr ' || s_suppkey WHEN 1 THEN 'what does supplier nr ' || s_suppkey || ' send' WHEN 2 THEN 'errors of supplier-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' and SV' || (s_suppkey % 7) WHEN 3 THEN 'what is in SV' || (s_suppkey % 7) WHEN 4 THEN 'Supplier Nr ' || s_suppkey || '''s orders' ELSE 'all services of the north' END query FROM supplier UNION ALL SELECT 'b' || item_id, text FROM benchmark)"""


def _services(spark, d):
    n = F.col("s_suppkey")
    return _table(spark, d, "supplier").select(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("source"), F.concat(F.lit("SV"), (n % 7).cast("string")).alias("short_form"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("Supplier Nr "), n.cast("string"))).alias("long_form"))


def _questions(spark, d):
    n, name, group = F.col("s_suppkey"), F.col("s_suppkey").cast("string"), F.concat(F.lit("SV"), (F.col("s_suppkey") % 7).cast("string"))
    words = [F.concat(F.lit("which downstream services call Supplier Nr "), name), F.concat(F.lit("what does supplier nr "), name, F.lit(" send")), F.concat(F.lit("errors of supplier-"), F.lpad(name, 9, "0"), F.lit(" and "), group), F.concat(F.lit("what is in "), group), F.concat(F.lit("Supplier Nr "), name, F.lit("'s orders"))]
    query = F.lit("all services of the north")
    for i, x in enumerate(words):
        query = F.when(n % 6 == i, x).otherwise(query)
    own = _table(spark, d, "supplier").select(F.concat(F.lit("s"), name).alias("query_id"), query.alias("query"))
    return own.unionByName(_table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query")))


def _stands(phrase: str, text: str) -> str:
    return f"({C._key(phrase)} <> '' AND ({C._bounded(C._key(text), C._key(phrase))} OR {C._bounded(f'lower({text})', f'lower({phrase})')}))"


_FORMS = "fm AS (SELECT DISTINCT source, own, other FROM (SELECT source, short_form own, long_form other FROM sv UNION ALL SELECT source, long_form, short_form FROM sv) WHERE own <> '')"
_EXPANDED = f"ex AS (SELECT q.query_id, query || coalesce(' ' || m, '') query FROM q LEFT JOIN (SELECT query_id, string_agg(DISTINCT x, ' ' ORDER BY x) m FROM (SELECT query_id, unnest([other, source]) x FROM q JOIN fm ON {_stands('own', 'query')}) WHERE x <> '' GROUP BY ALL) mm ON mm.query_id = q.query_id)"


@registered("expanded_queries", f"WITH {_SERVICES}, {_ROUTED}, {_FORMS}, {_EXPANDED} SELECT * FROM ex")
def expanded_queries(spark, d):
    return routing.expand_all(_questions(spark, d), _services(spark, d))


def _matched(name: str, queries: str) -> str:
    """CTEs of the services that queries name: {name} has services, ambiguous aliases and the alias of the only one."""
    return f"""{name}h AS (SELECT query_id, alias, n, source FROM {queries} JOIN ka ON {_stands('alias', 'query')}), {name}o AS (SELECT query_id, source, arg_max(alias, row(len(alias), alias)) alias FROM {name}h WHERE n = 1 GROUP BY ALL),
{name} AS (SELECT q.query_id, coalesce(any_value(s.v), []) services, coalesce(any_value(b.v), []) ambiguous, any_value(s.alias) alias FROM q LEFT JOIN (SELECT query_id, list_sort(list(DISTINCT source)) v, min(alias) alias FROM {name}o GROUP BY ALL) s ON s.query_id = q.query_id LEFT JOIN (SELECT query_id, list_sort(list(DISTINCT alias)) v FROM {name}h WHERE n > 1 GROUP BY ALL) b ON b.query_id = q.query_id GROUP BY q.query_id)"""


def _tied(alias: str) -> str:
    name = f"replace({alias}, '-', '[\\s-]+')"
    return f"coalesce(regexp_matches(lower(query), '\\b(?:in|within|inside)\\s+' || {name} || '\\b|\\b' || {name} || '\\s*''s\\b|\\b(?:what|which|how)\\b.+\\bdoes\\s+' || {name} || '\\b'), FALSE)"


@registered("routing_plans", f"""WITH {_SERVICES}, {_ROUTED}, {_FORMS}, {_EXPANDED}, ks AS (SELECT DISTINCT {C._key('a')} alias, source FROM (SELECT source, unnest([source, short_form, long_form]) a FROM sv) WHERE {C._key('a')} <> ''), ka AS (SELECT alias, count(*) n, min(source) source FROM ks GROUP BY ALL),
{_matched('m1', 'q')}, {_matched('m2', 'ex')}, pk AS (SELECT q.query_id, query, len(m1.services) = 1 AND len(m1.ambiguous) = 0 AND {_tied('m1.alias')} one, m1.services s1, m1.ambiguous a1, m1.alias l1, m2.services s2, m2.ambiguous a2, m2.alias l2 FROM q JOIN m1 ON m1.query_id = q.query_id JOIN m2 ON m2.query_id = q.query_id),
fi AS (SELECT query_id, query, CASE WHEN one THEN s1 ELSE s2 END services, CASE WHEN one THEN a1 ELSE a2 END ambiguous, CASE WHEN one THEN l1 ELSE l2 END alias FROM pk)
SELECT query_id, CASE WHEN len(services) = 0 OR contains(lower(query), 'all services') OR contains(lower(query), 'across services') OR regexp_matches(lower(query), '\\b(?:which|what)\\s+(?:(?:{'|'.join(routing.BEFORE_SERVICES)})\\s+){{0,3}}services?\\b') THEN 'GLOBAL' WHEN len(services) = 1 AND len(ambiguous) = 0 AND {_tied('alias')} THEN 'HARD_FILTER' ELSE 'BOOST' END "mode", array_to_string(services, ',') services, array_to_string(ambiguous, ',') ambiguous FROM fi""")
def routing_plans(spark, d):
    rows = routing.plan_all(_questions(spark, d), _services(spark, d))
    return rows.select("query_id", "mode", F.array_join("services", ",").alias("services"), F.array_join("ambiguous", ",").alias("ambiguous"))


# Ingestion


@registered("build_documents", """SELECT sha256(source || '::' || 'd' || doc_id) document_id, 'd' || doc_id title, md5(regexp_replace('## Purpose' || chr(10) || lang || ' (a.cs:L1-L2) of ' || source, '\\s*\\([^()\\s]*:?L[0-9]+(-L?[0-9]+)?\\)', '', 'g')) text_md5, source, 'ref ' || doc_id source_refs FROM documents WHERE doc_id % 9 > 0""")
def build_documents(spark, d):
    n = F.col("doc_id").cast("string")
    summary = F.when(F.col("doc_id") % 9 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("## Purpose\n"), "lang", F.lit(" (a.cs:L1-L2) of "), "source", F.lit("\n## Reasoning\nhidden\n## Source References\nref "), n))
    files = _table(spark, d, "documents").select(F.col("source").alias("repository"), F.concat(F.lit("d"), n).alias("file_path"), F.lit(None).cast("string").alias("url"), F.lit("2024-01-02T03:04:05Z").alias("last_modified"), F.lit("x").alias("source_code"), summary.alias("summary"))
    return chunking.build_documents(files).select("document_id", "title", F.md5("text").alias("text_md5"), "source", "source_refs")


@registered("summary_faults", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'without ## Key Business Logic' WHEN 2 THEN 'ends with a heading' ELSE 'empty' END fault FROM documents")
def summary_faults(spark, d):
    n = F.col("doc_id")
    summary = F.when(n % 4 == 0, F.concat(F.lit("## Purpose\n"), "text", F.lit("\n## Key Business Logic\nx"))).when(n % 4 == 1, F.concat(F.lit("## Purpose\nx "), "lang")).when(n % 4 == 2, F.concat(F.lit("## Purpose\n"), "lang", F.lit("\n## Key Business Logic\n\n"))).otherwise(" \n ")
    return _table(spark, d, "documents").select("doc_id", T.summary_fault(summary).alias("fault"))


@registered("carry_over", "SELECT o_orderkey, 'kept' what FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_orderkey IN (SELECT o_orderkey FROM orders)".replace("FROM orders WHERE o_orderkey IN", "FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN"))
def carry_over(spark, d):
    existing = _table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    present = _table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    present = present.join(_table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    kept, new = upsert.carry_over(existing, present, ["o_orderkey"])
    return kept.withColumn("what", F.lit("kept")).unionByName(new.withColumn("what", F.lit("new")))


@registered("replace_source", """WITH ee AS (SELECT l_partkey || '::' || l_suppkey edge_key, 'P' || l_partkey subject_key, 'S' || l_suppkey object_key, l_returnflag repo, l_linestatus path FROM lineitem), kept AS (SELECT * FROM ee WHERE NOT (repo = 'A' AND path = 'F'))
SELECT 'edge' what, edge_key "key" FROM (SELECT DISTINCT edge_key FROM ee WHERE edge_key IN (SELECT edge_key FROM kept)) UNION ALL SELECT 'node', k FROM (SELECT DISTINCT k FROM (SELECT subject_key k FROM ee UNION SELECT object_key FROM ee) WHERE k IN (SELECT subject_key FROM kept UNION SELECT object_key FROM kept UNION SELECT 'P' || p_partkey FROM part WHERE p_size > 40))""")
def replace_source(spark, d):
    key = lambda c, x: F.concat(F.lit(x), F.col(c).cast("string"))
    ee = _table(spark, d, "lineitem").select(F.concat_ws("::", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("edge_key"), key("l_partkey", "P").alias("subject_key"), key("l_suppkey", "S").alias("object_key"), F.col("l_returnflag").alias("source_repo"), F.col("l_linestatus").alias("source_path"))
    ne = _table(spark, d, "part").filter("p_size > 40").select(key("p_partkey", "P").alias("node_key"), F.lit("own").alias("source_repo"), F.lit("x").alias("source_path"))
    nodes = ee.select(F.explode(F.array("subject_key", "object_key")).alias("node_key")).distinct()
    _, _, edges, left = graph.replace_source(ne, ee, ee.select("edge_key").distinct(), nodes, ne.limit(0), ee.limit(0), "A", "F")
    return edges.select(F.lit("edge").alias("what"), F.col("edge_key").alias("key")).unionByName(left.select(F.lit("node").alias("what"), F.col("node_key").alias("key")))


@registered("delete_keys", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def delete_keys(spark, d):
    return upsert.delete(_table(spark, d, "part").select("p_partkey"), _table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@registered("refresh_counts", "SELECT count_if(o IS NULL) inserted, count_if(n IS NOT NULL AND o IS NOT NULL) updated, count_if(n IS NULL) deleted FROM (SELECT p_partkey n FROM part WHERE p_size > 10) a FULL JOIN (SELECT p_partkey o FROM part WHERE p_size < 30) b ON n = o")
def refresh_counts(spark, d):
    part = _table(spark, d, "part").select("p_partkey", "p_size")
    return upsert.refreshed(part.filter("p_size < 30"), part.filter("p_size > 10"), ["p_partkey"])[1]


@registered("conversation_upsert", "SELECT id, coalesce(o, 'new') title, messages FROM (SELECT conv_id id, max('t' || turn) n, count(*) messages FROM conversations GROUP BY ALL) LEFT JOIN (SELECT DISTINCT conv_id, 'old' o FROM conversations WHERE conv_id % 2 = 0) ON id = conv_id")
def conversation_upsert(spark, d):
    ids = _table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("messages"))
    row = lambda x, title, at: x.select("id", F.lit(title).alias("title"), "messages", F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))
    old = row(ids.filter("id % 2 = 0").withColumn("messages", F.lit(0).cast("long")), "old", 1)
    return upsert.put_conversation(old, row(ids, "new", 2)).select("id", "title", "messages")


@registered("conversation_drop", "SELECT i.id, d.conv_id IS NOT NULL found FROM (SELECT DISTINCT conv_id * 2 id FROM conversations) i LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) d ON d.conv_id = i.id")
def conversation_drop(spark, d):
    known = _table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return upsert.drop_conversations(known, known.select((F.col("id") * 2).alias("id")))[1]


# Evaluation of two strategies at two cutoffs

_TWO = " UNION ALL ".join(
    f"SELECT '{strategy}' strategy, {k} k, x.* FROM (WITH {_RUN.replace('n_chars DESC', order).replace('rk <= 15', f'rk <= {k}').replace('least(n, 15)', f'least(n, {k})').replace('least(15, n)', f'least({k}, n)').replace('hits / 15', f'hits / {k}')} SELECT * FROM e) x"
    for strategy, order in (("long", "n_chars DESC"), ("short", "n_chars")) for k in (5, 15)
)


def _strategies(spark, d):
    docs = _table(spark, d, "documents")
    runs = None
    for strategy, order in (("long", F.col("n_chars").desc()), ("short", F.col("n_chars"))):
        one = keyword.top(docs.select(F.col("source").alias("query_id"), "doc_id", "n_chars"), 1 << 30, order, F.col("doc_id")).select(F.lit(strategy).alias("strategy"), "query_id", "doc_id", "rank")
        runs = one if runs is None else runs.unionByName(one)
    rel = docs.join(_table(spark, d, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("query_id"), "doc_id", F.col("lang").alias("evidence_group"))
    return evaluation.evaluate(runs, rel, ["long", "short"], [5, 15])


@registered("evaluation_run", _TWO)
def evaluation_run(spark, d):
    return _strategies(spark, d)


@registered("evaluation_by_difficulty", f"SELECT strategy, k, right(query_id, 1) difficulty, count(*) n, round(avg(recall), 5) recall, round(avg(hit_count), 5) hit_count FROM ({_TWO}) GROUP BY ALL")
def evaluation_by_difficulty(spark, d):
    rows = _strategies(spark, d).withColumn("difficulty", F.right("query_id", F.lit(1))).withColumn("category", F.lit("c"))
    table = evaluation.result_tables(rows)["difficulty_results"]
    return table.select("strategy", "k", "difficulty", "n", F.round("recall", 5).alias("recall"), F.round("hit_count", 5).alias("hit_count"))


# Whole searches

_QUESTION = "the patient river of the north"
_HYBRID = f"""WITH v AS ({_NEAR.format(where='TRUE', by='query_id', k=10, floor='').replace('vec_id % 100 = 0', 'vec_id = 0')}), k AS ({_bm25_sql(k=10, queries=(_QUESTION,))}),
u AS (SELECT CAST(item_id AS BIGINT) item_id, "rank" rk, 0 lo FROM v UNION ALL SELECT CAST(chunk_id AS BIGINT), "rank", 1 FROM k), g AS (SELECT item_id, round(sum(1.0e0 / (60 + rk)), 10) score, min(lo * 100000 + rk) fr FROM u GROUP BY ALL), t AS (SELECT g.*, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, fr) tr FROM g JOIN documents ON doc_id = item_id)"""


@registered("hybrid_search", _HYBRID + ", r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, fr) AS INTEGER) \"rank\" FROM t WHERE tr = 1) SELECT CAST(item_id AS VARCHAR) item_id, score, \"rank\" FROM r WHERE \"rank\" <= 8")
def hybrid_search(spark, d):
    """Vectors and BM25 merged by reciprocal ranks, the best of each title (here the source)."""
    v = _vectors(spark, d)
    asked = v.filter("item_id = 0").select(F.lit("q").alias("query_id"), F.col("embedding").alias("query_embedding"))
    near = vector.nearest(v.withColumn("item_id", F.col("item_id").cast("string")), asked, 10)
    words = keyword.bm25(_index(spark, d), spark.createDataFrame([("q", _QUESTION)], "query_id string, query string"), 10, places=6).withColumnRenamed("chunk_id", "item_id")
    titles = _chunks(spark, d).select(F.col("chunk_id").alias("item_id"), F.col("source").alias("title"))
    return fusion.rrf([near, words], 8, titles).select("item_id", "score", "rank")


@registered("chunk_rows", """SELECT CAST(doc_id AS VARCHAR) chunk_id, source document_id, '' document_title, CASE WHEN doc_id % 2 = 0 THEN 'u' ELSE '' END url, source metadata_source, 'bm25' ranker, CAST(n_chars AS DOUBLE) score FROM documents""")
def chunk_rows(spark, d):
    n = F.col("doc_id")
    wide = _table(spark, d, "documents").select(n.cast("string").alias("chunk_id"), "text", F.lit(None).cast("string").alias("source_code"), F.col("source").alias("document_id"), F.lit(None).cast("string").alias("name"), F.when(n % 2 == 0, "u").alias("url"), F.lit(None).cast("timestamp").alias("last_modified_date"), F.create_map(F.lit("source"), F.lit("old")).alias("metadata"), "source", "n_chars")
    ranked = wide.select(F.lit("q").alias("query_id"), "chunk_id", F.col("n_chars").alias("score"), F.lit(1).alias("rank"))
    rows = responses.keyword_metadata(responses.as_chunks(ranked, wide.drop("n_chars")), "bm25")
    return rows.select("chunk_id", "document_id", "document_title", "url", F.col("metadata.source").alias("metadata_source"), F.col("metadata.keyword_ranker").alias("ranker"), "score")


@registered("titles_from_metadata", "SELECT CAST(doc_id AS VARCHAR) chunk_id, CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id WHEN source LIKE '%1' OR source LIKE '%2' THEN CASE WHEN source LIKE '%1' THEN '' ELSE 'src/' || source || '.Api/readme' END ELSE '' END title FROM documents WHERE lang <> 'fr'")
def titles_from_metadata(spark, d):
    rows = C.chunks(spark, d).filter("retrieval_corpus = 'summaries'").withColumn("title", F.when(F.col("chunk_id").cast("int") % 2 == 0, F.concat(F.lit("t"), "chunk_id")))
    return keyword.with_titles(rows, C.metadata(spark, d)).select("chunk_id", "title")


@registered("sources_in_any_case", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def sources_in_any_case(spark, d):
    return keyword.in_any_scope(_table(spark, d, "documents").select("doc_id", F.upper("source").alias("source")), ["Src1", "sRC2"]).select("doc_id")


# Facts by predicate

_FACTS = """fe AS (SELECT o_orderstatus source_repo, 'p' || (o_orderkey % 10) source_path, 'HANDLES_EVENT' predicate, 'C' || c_nationkey object_key, 'N' || c_nationkey object_name, (50 + o_orderkey % 50) / 100.0e0 confidence, 'src' || (o_orderkey % 20) document_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 150 AS VARCHAR) END chunk_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') evidence_hash FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _fact_evidence(spark, d):
    n, nation = F.col("o_orderkey"), F.col("c_nationkey").cast("string")
    rows = _table(spark, d, "orders").join(_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return rows.select(F.col("o_orderstatus").alias("source_repo"), F.concat(F.lit("p"), (n % 10).cast("string")).alias("source_path"), F.lit("HANDLES_EVENT").alias("predicate"), F.concat(F.lit("C"), nation).alias("object_key"), F.concat(F.lit("N"), nation).alias("object_name"), ((50 + n % 50) / 100.0).alias("confidence"), F.concat(F.lit("src"), (n % 20).cast("string")).alias("document_id"), F.when(n % 3 == 0, (n % 150).cast("string")).alias("chunk_id"), F.lpad(n.cast("string"), 12, "0").alias("evidence_hash"))


@registered("known_repositories", "SELECT DISTINCT source FROM documents WHERE source LIKE '%1' OR source LIKE '%2'")
def known_repositories(spark, d):
    return graph_search.known_repositories(C.metadata(spark, d).withColumn("source", F.col("document_id")))


@registered("fact_pairs", f"WITH {_FACTS} SELECT DISTINCT source_repo, object_key, object_name FROM fe WHERE object_key IN ('C1', 'C2', 'C3') AND source_repo IN ('F', 'O')")
def fact_pairs(spark, d):
    return graph_search.fact_pairs(_fact_evidence(spark, d), "HANDLES_EVENT", ["C1", "C2", "C3"], ["F", "O"])


@registered("fact_rows", f"""WITH {_FACTS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_repo, source_path ORDER BY confidence DESC, object_key, evidence_hash) r FROM fe) WHERE r = 1), fc AS (SELECT source, min(CAST(doc_id AS VARCHAR)) f FROM documents WHERE lang <> 'fr' GROUP BY ALL)
SELECT b.source_repo, b.source_path, object_name, confidence, coalesce(b.chunk_id, f) resolved_chunk_id, d.source FROM b LEFT JOIN fc ON fc.source = b.document_id JOIN documents d ON CAST(d.doc_id AS VARCHAR) = coalesce(b.chunk_id, f) AND lang <> 'fr'""")
def fact_rows(spark, d):
    return graph_search.fact_rows(_fact_evidence(spark, d), C.chunks(spark, d), "HANDLES_EVENT", "summaries").drop("document_id", "text")


@registered("representative_documents", """WITH fc AS (SELECT source, min(CAST(doc_id AS VARCHAR)) chunk_id FROM documents WHERE lang <> 'fr' GROUP BY ALL)
SELECT source source_repo, CASE WHEN source LIKE '%1' THEN 'src/' || source || '/doc_' || chunk_id ELSE 'src/' || source || '.Api/readme' END source_path, source document_id, chunk_id FROM fc WHERE source IN ('src1', 'src2', 'src12')""")
def representative_documents(spark, d):
    named = C.metadata(spark, d).withColumn("source", F.col("document_id"))
    return graph_search.representative_documents(named, C.chunks(spark, d), ["src1", "src2", "src3", "src12"], "summaries")
