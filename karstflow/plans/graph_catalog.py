"""Registered queries of graph search, each stage on its own, with SQL.

Regions are frameworks, nations topics, suppliers repositories, customers
handlers and parts APIs; orders are the evidence of edges and documents, both
their chunks and what nodes have evidence in. Every nation is a query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.operators import graph
from karstflow.plans import graph_search as G
from karstflow.plans.catalog import _table, registered

_LIST = ", ".join(f"'{x}'" for x in T.STOPWORDS)


def _values(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _key(x: str) -> str:
    """`token_key` in SQL."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"


# Tables

NODES = """nodes AS (SELECT 'FRAMEWORK::' || r_regionkey node_key, 'FRAMEWORK' "label", r_name "name" FROM region UNION ALL SELECT 'KAFKA_TOPIC::' || n_nationkey, 'KAFKA_TOPIC', n_name FROM nation
UNION ALL SELECT 'HANDLER::' || c_custkey, 'HANDLER', c_name FROM customer UNION ALL SELECT 'REPO::' || s_suppkey, 'REPO', s_name FROM supplier UNION ALL SELECT 'API::' || p_partkey, 'API', p_name FROM part)"""
EDGES = """edges AS (SELECT s || '::' || p || '::' || o edge_key, s subject_key, p predicate, o object_key FROM (SELECT 'KAFKA_TOPIC::' || n_nationkey s, 'TARGETS_FRAMEWORK' p, 'FRAMEWORK::' || n_regionkey o FROM nation
UNION ALL SELECT 'HANDLER::' || c_custkey, 'HANDLES_EVENT', 'KAFKA_TOPIC::' || c_nationkey FROM customer UNION ALL SELECT 'REPO::' || s_suppkey, 'CONSUMES_TOPIC', 'KAFKA_TOPIC::' || s_nationkey FROM supplier))"""
EDGE_EVIDENCE = """ee AS (SELECT 'HANDLER::' || o_custkey || '::HANDLES_EVENT::KAFKA_TOPIC::' || c_nationkey edge_key, (50 + o_orderkey % 50) / 100.0e0 confidence, 'T' || o_orderstatus tier, o_orderpriority source_kind, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS INTEGER) END line_start, CASE WHEN o_orderkey % 2 > 0 THEN CAST(o_orderkey + 1 AS INTEGER) END line_end, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"""
STATS = """st AS (SELECT e.edge_key, e.subject_key, e.predicate, e.object_key, coalesce(max(x.confidence), 1.0e0) confidence, coalesce(arg_max(x.tier, row(x.confidence, x.o_orderkey)), 'CONTRACT_GLOBAL') tier, coalesce(arg_max(x.source_kind, row(x.confidence, x.o_orderkey)), 'unknown') source_kind, arg_max(struct_pack(v := x.line_start), row(x.confidence, x.o_orderkey)).v line_start, arg_max(struct_pack(v := x.line_end), row(x.confidence, x.o_orderkey)).v line_end FROM edges e LEFT JOIN ee x ON e.edge_key = x.edge_key GROUP BY ALL)"""
KINDS = ("contract", "ast", "asyncapi", "configmap")
NODE_EVIDENCE = """ne AS (SELECT 'KAFKA_TOPIC::' || (doc_id % 25) node_key, 'KAFKA_TOPIC' node_label, 'NATION_' || (doc_id % 25) node_name, CASE WHEN lang = 'en' THEN 'AST_LOCAL' ELSE 'CONTRACT_GLOBAL' END tier, CASE lang WHEN 'en' THEN 'contract' WHEN 'de' THEN 'ast' WHEN 'es' THEN 'asyncapi' ELSE 'configmap' END source_kind, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS INTEGER) END line_start, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS INTEGER) END line_end, CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id AS VARCHAR) END document_id, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id AS VARCHAR) END chunk_id, (50 + doc_id % 50) / 100.0e0 confidence, n_chars observed_at, lpad(CAST(doc_id AS VARCHAR), 12, '0') evidence_hash FROM documents)"""
RESOLVED = """own AS (SELECT * FROM ne WHERE document_id IS NOT NULL), es AS (SELECT node_key, max(confidence) max_confidence, CAST(count(*) AS INTEGER) evidence_count, string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) source_kinds, string_agg(DISTINCT tier, ',' ORDER BY tier) tiers FROM own GROUP BY ALL),
be AS (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY CASE source_kind WHEN 'asyncapi' THEN 0 WHEN 'configmap' THEN 1 WHEN 'contract' THEN 4 ELSE 6 END, confidence DESC, observed_at DESC, evidence_hash) evidence_rank FROM own),
fc AS (SELECT source document_id, min(CAST(doc_id AS VARCHAR)) first_chunk FROM documents WHERE lang <> 'fr' GROUP BY ALL),
rs AS (SELECT be.node_key, be.node_label, be.node_name, CAST(be.evidence_rank AS INTEGER) evidence_rank, es.max_confidence, es.evidence_count, es.source_kinds, es.tiers, be.line_start IS NOT NULL AND be.line_end IS NOT NULL has_line_bounds, coalesce(be.chunk_id, fc.first_chunk) resolved_chunk_id, d.text, d.source document_id, coalesce(m.nm, 'src/' || d.source || '/doc_' || d.doc_id) document_title, coalesce(m.url, '') url, d.source
FROM be JOIN documents o ON CAST(o.doc_id AS VARCHAR) = be.document_id LEFT JOIN fc ON fc.document_id = o.source JOIN documents d ON CAST(d.doc_id AS VARCHAR) = coalesce(be.chunk_id, fc.first_chunk) AND d.lang <> 'fr' JOIN es ON es.node_key = be.node_key
LEFT JOIN (SELECT DISTINCT source, CASE WHEN source LIKE '%1' THEN NULL ELSE 'src/' || source || '.Api/readme' END nm, 'u/' || source url FROM documents WHERE source LIKE '%1' OR source LIKE '%2') m ON m.source = d.source WHERE be.evidence_rank <= 5)"""
ASKED = "q AS (SELECT 'q' || n_nationkey query_id, 'Which topics of ' || n_name || ' does the handler Customer#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') || ' read in services?' query, CASE n_nationkey % 3 WHEN 0 THEN 'TOPOLOGY' WHEN 1 THEN 'GENERAL' ELSE 'LOCAL_LOGIC' END intent FROM nation)"


def nodes(spark, d):
    out = None
    for table, label, key, name in (("region", "FRAMEWORK", "r_regionkey", "r_name"), ("nation", "KAFKA_TOPIC", "n_nationkey", "n_name"), ("customer", "HANDLER", "c_custkey", "c_name"), ("supplier", "REPO", "s_suppkey", "s_name"), ("part", "API", "p_partkey", "p_name")):
        one = _table(spark, d, table).select(F.concat(F.lit(label + "::"), F.col(key).cast("string")).alias("node_key"), F.lit(label).alias("label"), F.col(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark, d):
    out = None
    for table, label, key, predicate, other, fk in (("nation", "KAFKA_TOPIC", "n_nationkey", "TARGETS_FRAMEWORK", "FRAMEWORK", "n_regionkey"), ("customer", "HANDLER", "c_custkey", "HANDLES_EVENT", "KAFKA_TOPIC", "c_nationkey"), ("supplier", "REPO", "s_suppkey", "CONSUMES_TOPIC", "KAFKA_TOPIC", "s_nationkey")):
        one = _table(spark, d, table).select(F.concat(F.lit(label + "::"), F.col(key).cast("string")).alias("subject_key"), F.lit(predicate).alias("predicate"), F.concat(F.lit(other + "::"), F.col(fk).cast("string")).alias("object_key"))
        out = one if out is None else out.unionByName(one)
    return out.select(graph.edge_key(F.col("subject_key"), F.col("predicate"), F.col("object_key")).alias("edge_key"), "*")


def edge_evidence(spark, d):
    rows = _table(spark, d, "orders").join(_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    key, n = F.concat(F.lit("HANDLER::"), F.col("o_custkey").cast("string"), F.lit("::HANDLES_EVENT::KAFKA_TOPIC::"), F.col("c_nationkey").cast("string")), F.col("o_orderkey")
    return rows.select(key.alias("edge_key"), ((50 + n % 50) / 100.0).alias("confidence"), F.concat(F.lit("T"), "o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("source_kind"), F.when(n % 3 > 0, n.cast("int")).alias("line_start"), F.when(n % 2 > 0, (n + 1).cast("int")).alias("line_end"), "o_orderkey")


def with_stats(spark, d):
    return graph.with_stats(edges(spark, d), edge_evidence(spark, d), "o_orderkey")


def node_evidence(spark, d):
    n, text = F.col("doc_id"), F.col("doc_id").cast("string")
    kind = F.element_at(F.create_map(*map(F.lit, ("en", "contract", "de", "ast", "es", "asyncapi", "fr", "configmap"))), F.col("lang"))
    place = (n % 25).cast("string")
    return _table(spark, d, "documents").select(
        F.concat(F.lit("KAFKA_TOPIC::"), place).alias("node_key"), F.lit("KAFKA_TOPIC").alias("node_label"), F.concat(F.lit("NATION_"), place).alias("node_name"), F.when(F.col("lang") == "en", "AST_LOCAL").otherwise("CONTRACT_GLOBAL").alias("tier"), kind.alias("source_kind"),
        F.when(n % 2 == 0, n.cast("int")).alias("line_start"), F.when(n % 2 == 0, n.cast("int")).alias("line_end"), F.when(n % 7 > 0, F.col("source")).alias("document_id"), F.when(n % 3 > 0, text).alias("chunk_id"), ((50 + n % 50) / 100.0).alias("confidence"), F.col("n_chars").alias("observed_at"), F.lpad(text, 12, "0").alias("evidence_hash"),
    )


def chunks(spark, d):
    """documents as chunks of their source; one corpus has all but the French."""
    text = F.col("doc_id").cast("string")
    return _table(spark, d, "documents").select(text.alias("chunk_id"), F.col("source").alias("document_id"), F.concat(F.lit("src/"), "source", F.lit("/doc_"), text).alias("document_title"), F.when(F.col("lang") == "fr", "code").otherwise("summaries").alias("retrieval_corpus"), "text", F.lit(None).cast("string").alias("source_code"), "source")


def metadata(spark, d):
    some = _table(spark, d, "documents").select("source").distinct().filter("source LIKE '%1' OR source LIKE '%2'")
    return some.select(F.col("source").alias("document_id"), F.lit("summaries").alias("retrieval_corpus"), F.when(~F.col("source").endswith("1"), F.concat(F.lit("src/"), "source", F.lit(".Api/readme"))).alias("name"), F.concat(F.lit("u/"), "source").alias("url"))


def asked(spark, d):
    n, name = F.col("n_nationkey"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")
    query = F.concat(F.lit("Which topics of "), "n_name", F.lit(" does the handler Customer#"), name, F.lit(" read in services?"))
    return _table(spark, d, "nation").select(F.concat(F.lit("q"), n.cast("string")).alias("query_id"), query.alias("query"), F.when(n % 3 == 0, "TOPOLOGY").when(n % 3 == 1, "GENERAL").otherwise("LOCAL_LOGIC").alias("intent"))


@registered("nodes_by_label", f"WITH {NODES} SELECT * FROM nodes WHERE \"label\" IN ('REPO', 'API')")
def nodes_by_label(spark, d):
    return graph.nodes_of(nodes(spark, d), ["REPO", "API"])


# Mentions

_HINTS = ", ".join(f"('{part}', '{label}')" for part, labels in sorted(G._hints().items()) for label in labels)
_MENTIONS = f"""hint(h, l) AS (VALUES {_HINTS}), tk AS (SELECT query_id, unnest(t) w, generate_subscripts(t, 1) i FROM (SELECT query_id, regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9_.-]*') t FROM q)),
nm AS (SELECT query_id, i, 0 j, {_key('w')} n FROM tk UNION ALL SELECT query_id, i, 1, left(n, len(n) - 1) FROM (SELECT query_id, i, {_key('w')} n FROM tk) WHERE n LIKE '%s' AND n NOT LIKE '%ss' AND left(n, len(n) - 1) IN (SELECT h FROM hint)),
ok AS (SELECT query_id, n, min(i * 2 + j) pos_ FROM nm WHERE len(n) > 2 AND n NOT IN ({_LIST}) AND NOT regexp_full_match(n, '[0-9]+') GROUP BY ALL), fw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos_) r FROM ok),
mn AS (SELECT query_id, n "text", n normalized, l "label", CASE WHEN l IS NULL THEN 0.58e0 ELSE 0.86e0 END confidence FROM fw LEFT JOIN hint ON h = n WHERE r <= 12)"""


@registered("graph_mentions", f"WITH q AS (SELECT CAST(item_id AS VARCHAR) query_id, text query FROM benchmark UNION ALL SELECT query_id, query FROM (WITH {ASKED} SELECT * FROM q)), {_MENTIONS} SELECT * FROM mn")
def graph_mentions(spark, d):
    items = _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return G.mentions(items.unionByName(asked(spark, d).select("query_id", "query")))


_ALIASES = "sv AS (SELECT s_name source, CASE s_suppkey % 2 WHEN 0 THEN 'NATION ' || s_nationkey ELSE 'topics' END alias FROM supplier)"


def _services(spark, d):
    return _table(spark, d, "supplier").select(F.col("s_name").alias("source"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("NATION "), F.col("s_nationkey").cast("string"))).otherwise("topics").alias("alias"))


def _bounded(text: str, phrase: str) -> str:
    """Whether a phrase of letters, digits and hyphens stands in a text with no letter or digit beside it, without lookaround."""
    return f"regexp_matches({text}, '(^|[^a-z0-9])' || regexp_escape({phrase}) || '($|[^a-z0-9])')"


@registered("graph_alias_mentions", f"""WITH q0 AS (WITH {ASKED} SELECT query_id, query FROM q), {_ALIASES},
ad AS (SELECT query_id, string_agg(DISTINCT source, ' ' ORDER BY source) s FROM q0, sv WHERE {_bounded(_key('query'), _key('alias'))} OR {_bounded('lower(query)', 'lower(alias)')} GROUP BY ALL),
q AS (SELECT q0.query_id, query || coalesce(' ' || s, '') query FROM q0 LEFT JOIN ad ON ad.query_id = q0.query_id), {_MENTIONS},
ky AS (SELECT {_key('alias')} k, source FROM sv UNION SELECT {_key('source')}, source FROM sv), one AS (SELECT k, max(source) source FROM ky GROUP BY ALL),
al AS (SELECT "text", query_id, normalized, "label", confidence FROM mn UNION ALL SELECT source, query_id, {_key('source')}, 'REPO', 0.95e0 FROM mn JOIN one ON normalized = k UNION ALL SELECT source, query_id, {_key('source')}, 'REPO', 0.96e0 FROM q, ky WHERE contains({_key('query')}, k))
SELECT query_id, normalized, "label", max(confidence) confidence, arg_max("text", row(confidence, "text")) "text" FROM al GROUP BY ALL""")
def graph_alias_mentions(spark, d):
    return G.mentions(asked(spark, d).select("query_id", "query"), _services(spark, d))


def _in(xs) -> str:
    return f"count_if(\"label\" IN ({_values(xs)})) > 0"


@registered("graph_intents", f"WITH q AS (SELECT CAST(item_id AS VARCHAR) query_id, text query FROM benchmark UNION ALL SELECT query_id, query FROM (WITH {ASKED} SELECT * FROM q)), {_MENTIONS} SELECT q.query_id, CASE WHEN {_in(G.GLOBAL)} THEN 'TOPOLOGY' WHEN {_in(G.LOCAL)} THEN 'LOCAL_LOGIC' ELSE 'GENERAL' END intent FROM q LEFT JOIN mn ON mn.query_id = q.query_id GROUP BY q.query_id")
def graph_intents(spark, d):
    items = _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    queries = items.unionByName(asked(spark, d).select("query_id", "query"))
    return G.intents(queries, G.mentions(queries))


# Seeds

_FLAT = "replace(replace(lower({0}), '_', '-'), '.', '')"
_NAMED = "nd AS (SELECT n.node_key, n.\"label\" node_label, n.\"name\", coalesce(max(ne.confidence), 1.0e0) confidence, count(ne.node_key) evidence_count FROM nodes n LEFT JOIN ne ON ne.node_key = n.node_key GROUP BY ALL)"
_MATCHES = f"""am AS (SELECT DISTINCT "text", normalized, "label", "label" IS NULL OR "label" NOT IN ({_values(G.SEEDABLE)}) any_ FROM mn WHERE NOT (coalesce("label", '') = 'KAFKA_TOPIC' AND normalized IN ('kafka', 'topic', 'topics'))),
di AS (SELECT am.*, nd.*, CASE WHEN any_ THEN 'ANY-label lookup' ELSE "label" || '-direct' END reason FROM am JOIN nd ON (any_ AND (contains({_FLAT.format('"name"')}, {_FLAT.format('"text"')}) OR contains({_FLAT.format('node_key')}, {_FLAT.format('"text"')}))) OR (NOT any_ AND node_label = "label" AND contains({_FLAT.format('"name"')}, {_FLAT.format('"text"')}))),
sc AS (SELECT am.*, nd.*, "label" || '-label-scan' reason FROM am JOIN nd ON node_label = "label" WHERE NOT any_ AND NOT EXISTS (SELECT 1 FROM di WHERE di."text" = am."text" AND di."label" = am."label")),
ev AS (SELECT *, row_number() OVER (PARTITION BY "text", normalized, "label" ORDER BY confidence DESC, evidence_count DESC, node_key) r FROM (SELECT * FROM di UNION ALL SELECT * FROM sc)),
ma AS (SELECT mn.query_id, mn.normalized, mn."label", ev.node_key, ev.node_label, ev."name", ev.evidence_count, mn.confidence * ev.confidence score, ev.reason FROM mn JOIN ev ON mn."text" = ev."text" AND mn."label" IS NOT DISTINCT FROM ev."label" AND r <= 15),
ob AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_key ORDER BY score DESC, coalesce("label", ''), normalized) r FROM ma),
tu AS (SELECT *, row_number() OVER (PARTITION BY query_id, normalized, "label" ORDER BY score DESC, evidence_count DESC, node_key) turn, max(score) OVER (PARTITION BY query_id, normalized, "label") best, count(*) OVER (PARTITION BY query_id, normalized, "label") size FROM ob WHERE r = 1),
se AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "label" IS NULL, turn, best DESC, size DESC, normalized, coalesce("label", '')) place FROM tu)"""


def _seeds(spark, d):
    queries = asked(spark, d).select("query_id", "query")
    known = graph.node_stats(nodes(spark, d), node_evidence(spark, d))
    return queries, G.mentions(queries), known


@registered("graph_seeds", f"WITH {ASKED}, {_MENTIONS}, {NODES}, {NODE_EVIDENCE}, {_NAMED}, {_MATCHES} SELECT query_id, normalized, \"label\", node_key, node_label, round(score, 9) score, reason, CAST(place AS INTEGER) place FROM se WHERE place <= 25")
def graph_seeds(spark, d):
    _, found, known = _seeds(spark, d)
    return G.select_seeds(G.seed_matches(known, found)).select("query_id", "normalized", "label", "node_key", "node_label", F.round("score", 9).alias("score"), "reason", "place")


@registered("graph_scopes", f"""WITH q AS (SELECT query_id, query FROM (WITH {ASKED} SELECT * FROM q) UNION ALL SELECT 'r' || s_suppkey, 'what does repo ' || s_name || CASE WHEN s_suppkey % 4 = 0 THEN ' share across services' ELSE ' do' END FROM supplier), {_MENTIONS}, {NODES}, {NODE_EVIDENCE}, {_NAMED}, {_MATCHES},
mt AS (SELECT query_id, list_sort(list(DISTINCT "name")) s FROM se WHERE place <= 25 AND reason = 'REPO-direct' GROUP BY ALL), sd AS (SELECT query_id, list_sort(list(DISTINCT trim("text"))) s FROM mn WHERE "label" = 'REPO' GROUP BY ALL),
ef AS (SELECT q.query_id, CASE WHEN {' OR '.join(f"contains(lower(query), '{x}')" for x in G.CROSS_SERVICE)} THEN [] ELSE coalesce(sd.s, mt.s, []) END s FROM q LEFT JOIN mt ON mt.query_id = q.query_id LEFT JOIN sd ON sd.query_id = q.query_id)
SELECT query_id, CASE len(s) WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'SERVICE_SCOPED' ELSE 'TARGETED_MULTI_SERVICE' END scope, array_to_string(s, ',') sources FROM ef""")
def graph_scopes(spark, d):
    s = _table(spark, d, "supplier")
    more = s.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("query_id"), F.concat(F.lit("what does repo "), "s_name", F.when(F.col("s_suppkey") % 4 == 0, " share across services").otherwise(" do")).alias("query"))
    queries = asked(spark, d).select("query_id", "query").unionByName(more)
    found = G.mentions(queries)
    seeds = G.select_seeds(G.seed_matches(graph.node_stats(nodes(spark, d), node_evidence(spark, d)), found))
    return G.scopes(queries, found, seeds).withColumn("sources", F.array_join("sources", ","))


# Walks: a walk of each nation starts at its topic

_GLOBAL, _LOCAL = _values(graph.GLOBAL_PREDICATES), _values(graph.LOCAL_PREDICATES)


def _hop(hop: int, before: str) -> str:
    """CTEs of a hop: frontier f{hop}, edges h{hop}, visited v{hop + 1}; `before`: the edges of earlier hops."""
    found = f"(SELECT query_id, count(*) n FROM ({before}) GROUP BY ALL)" if before else "(SELECT '' query_id, 0 n WHERE FALSE)"
    seen = f"AND NOT EXISTS (SELECT 1 FROM ({before}) z WHERE z.query_id = t.query_id AND z.edge_key = t.edge_key)" if before else ""
    return f"""z{hop} AS (SELECT f.query_id, p.intent, p.epn, p.paths - coalesce(any_value(b.n), 0) room, count(*) size FROM f{hop} f JOIN pl p ON p.query_id = f.query_id AND p.hops >= {hop} LEFT JOIN {found} b ON b.query_id = f.query_id GROUP BY f.query_id, p.intent, p.epn, p.paths HAVING room > 0),
n{hop} AS (SELECT z.query_id, z.room, z.size, z.epn, st.*, bool_or(f.node_key = st.subject_key) s_, bool_or(f.node_key = st.object_key) o_ FROM f{hop} f JOIN z{hop} z ON z.query_id = f.query_id JOIN st ON (st.subject_key = f.node_key OR st.object_key = f.node_key) AND (z.intent = 'GENERAL' OR (z.intent = 'TOPOLOGY' AND st.predicate IN ({_GLOBAL})) OR (z.intent = 'LOCAL_LOGIC' AND st.predicate IN ({_LOCAL}))) GROUP BY ALL),
t{hop} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, subject_key, object_key, edge_key) r FROM n{hop}),
h{hop} AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, subject_key, object_key, edge_key) r2 FROM t{hop} t WHERE r <= greatest(10, least(room, size * epn)) {seen}) WHERE r2 <= room),
f{hop + 1} AS (SELECT DISTINCT query_id, node_key FROM (SELECT query_id, object_key node_key FROM h{hop} WHERE s_ UNION SELECT query_id, subject_key FROM h{hop} WHERE o_) x WHERE NOT EXISTS (SELECT 1 FROM v{hop} v WHERE v.query_id = x.query_id AND v.node_key = x.node_key)),
v{hop + 1} AS (SELECT * FROM v{hop} UNION SELECT * FROM f{hop + 1})"""


_COLUMNS = "query_id, edge_key, subject_key, predicate, object_key, confidence, tier, source_kind, line_start, line_end"
_PLAN = "pl AS (SELECT query_id, intent, CASE intent WHEN 'LOCAL_LOGIC' THEN 3 ELSE 2 END hops, CASE intent WHEN 'TOPOLOGY' THEN 60 WHEN 'LOCAL_LOGIC' THEN 34 ELSE 48 END per_hop, CASE intent WHEN 'TOPOLOGY' THEN 8 WHEN 'LOCAL_LOGIC' THEN 5 ELSE 6 END epn, CASE intent WHEN 'TOPOLOGY' THEN 320 WHEN 'LOCAL_LOGIC' THEN 220 ELSE 240 END paths FROM q)"
_UP_TO = [" UNION ALL ".join(f"SELECT {_COLUMNS}, {h} hop FROM h{h}" for h in range(1, n + 1)) for n in range(4)]
_WALK = f"{ASKED}, {EDGES}, {EDGE_EVIDENCE}, {STATS}, {_PLAN}, f1 AS (SELECT query_id, 'KAFKA_TOPIC::' || substr(query_id, 2) node_key FROM q), v1 AS (SELECT * FROM f1), {_hop(1, '')}, {_hop(2, _UP_TO[1])}, {_hop(3, _UP_TO[2])}, pa AS ({_UP_TO[3]})"


def _starts(queries):
    return queries.select("query_id", F.concat(F.lit("KAFKA_TOPIC::"), F.substring("query_id", 2, 99)).alias("node_key"))


def _walked(spark, d):
    wanted = asked(spark, d).select("query_id", "intent")
    seeds = _starts(wanted)
    return wanted, seeds, G.expand(with_stats(spark, d), seeds, wanted)


@registered("edge_stats_defaults", f"WITH {EDGES}, {EDGE_EVIDENCE}, {STATS} SELECT * FROM st")
def edge_stats_defaults(spark, d):
    return with_stats(spark, d)


@registered("frontier_expand", f"WITH {_WALK} SELECT * FROM pa")
def frontier_expand(spark, d):
    return _walked(spark, d)[2]


# A path is taken or not by what was taken before it: a recursion over the ordered paths of each query.
_PRUNE = f"""WITH RECURSIVE {_WALK}, so AS (SELECT pa.*, pl.per_hop, pl.epn, pl.paths, row_number() OVER (PARTITION BY pa.query_id ORDER BY hop, confidence DESC, subject_key, object_key, edge_key) i FROM pa JOIN pl ON pl.query_id = pa.query_id),
wk AS (SELECT query_id, 0::BIGINT i, ['KAFKA_TOPIC::' || substr(query_id, 2)] nodes, []::VARCHAR[] at_, 0 hop, []::VARCHAR[] subjects, []::BIGINT[] taken FROM q
UNION ALL SELECT query_id, i, CASE WHEN fits THEN list_distinct(nodes || ends) ELSE nodes END, CASE WHEN fits THEN list_distinct(here || ends) ELSE here END, hop, CASE WHEN fits THEN subjects || [subject_key] ELSE subjects END, CASE WHEN fits THEN taken || [i] ELSE taken END
FROM (SELECT *, len(taken) < paths AND len(list_filter(subjects, lambda x: x = subject_key)) < epn AND (list_has_all(nodes, ends) OR len(nodes) < paths) AND (list_has_all(here, ends) OR len(here) + len(list_filter(ends, lambda x: NOT list_contains(here, x))) <= per_hop) fits
FROM (SELECT wk.query_id, so.i, wk.nodes, CASE WHEN so.hop = wk.hop THEN wk.at_ ELSE [] END here, so.hop, wk.subjects, wk.taken, [so.subject_key, so.object_key] ends, so.subject_key, so.per_hop, so.epn, so.paths FROM wk JOIN so ON so.query_id = wk.query_id AND so.i = wk.i + 1))),
en AS (SELECT query_id, arg_max(taken, i) taken FROM wk GROUP BY ALL), kp AS (SELECT so.*, list_position(taken, so.i) place FROM so JOIN en ON en.query_id = so.query_id WHERE list_contains(taken, so.i))"""


@registered("frontier_budget_prune", f"{_PRUNE} SELECT query_id, edge_key, hop, CAST(place AS INTEGER) place FROM kp")
def frontier_budget_prune(spark, d):
    wanted, seeds, paths = _walked(spark, d)
    return G.prune(paths, seeds, wanted).select("query_id", "edge_key", "hop", "place")


@registered("graph_diagnostics", f"""{_PRUNE}, nn AS (SELECT query_id, count(DISTINCT k) nodes FROM (SELECT query_id, subject_key k FROM kp UNION SELECT query_id, object_key FROM kp UNION SELECT query_id, 'KAFKA_TOPIC::' || substr(query_id, 2) FROM q) GROUP BY ALL), hh AS (SELECT query_id, max(hop) hops, count(*) n FROM kp GROUP BY ALL)
SELECT pl.query_id, pl.intent, coalesce(hh.hops, 0) hops, nodes, coalesce(n, 0) paths, CASE WHEN n IS NULL THEN 'no_paths_found' WHEN n >= pl.paths THEN 'path_budget_reached' WHEN hh.hops >= pl.hops THEN 'hop_limit_reached' ELSE 'budget_complete' END stop_reason FROM pl JOIN nn ON nn.query_id = pl.query_id LEFT JOIN hh ON hh.query_id = pl.query_id""")
def graph_diagnostics(spark, d):
    wanted, seeds, paths = _walked(spark, d)
    return G.diagnostics(wanted.select("query_id"), wanted, seeds, G.prune(paths, seeds, wanted)).drop("paths_by_hop")


@registered("graph_candidate_keys", f"""{_PRUNE}, cu AS (SELECT query_id, place, count(DISTINCT k) OVER (PARTITION BY query_id ORDER BY place) so FROM (SELECT query_id, 0 place, 'KAFKA_TOPIC::' || substr(query_id, 2) k FROM q UNION ALL SELECT query_id, place, subject_key FROM kp UNION ALL SELECT query_id, place, object_key FROM kp)),
fu AS (SELECT cu.query_id, min(place) last_ FROM cu JOIN pl ON pl.query_id = cu.query_id WHERE so >= pl.paths AND place > 0 GROUP BY ALL)
SELECT DISTINCT x.query_id, k node_key FROM (SELECT query_id, 0 place, 'KAFKA_TOPIC::' || substr(query_id, 2) k FROM q UNION ALL SELECT query_id, place, subject_key FROM kp UNION ALL SELECT query_id, place, object_key FROM kp) x LEFT JOIN fu ON fu.query_id = x.query_id WHERE last_ IS NULL OR place <= last_""")
def graph_candidate_keys(spark, d):
    wanted, seeds, paths = _walked(spark, d)
    return G.candidate_keys(seeds, G.prune(paths, seeds, wanted), wanted)


# Evidence and ranking

_SHOWN = "node_key, node_label, node_name, evidence_rank, max_confidence, evidence_count, source_kinds, tiers, has_line_bounds, resolved_chunk_id, document_id, document_title, url, source"


def _resolved(spark, d):
    keys = nodes(spark, d).select("node_key")
    return G.resolve_evidence(keys, node_evidence(spark, d), chunks(spark, d), metadata(spark, d), "summaries")


_EVIDENCE = NODE_EVIDENCE.replace("CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id AS VARCHAR) END document_id", "CASE WHEN doc_id % 7 > 0 THEN source END document_id")
_RESOLVED = RESOLVED.replace("JOIN documents o ON CAST(o.doc_id AS VARCHAR) = be.document_id LEFT JOIN fc ON fc.document_id = o.source", "LEFT JOIN fc ON fc.document_id = be.document_id")


@registered("evidence_resolution", f"WITH {_EVIDENCE}, {_RESOLVED} SELECT {_SHOWN} FROM rs")
def evidence_resolution(spark, d):
    return _resolved(spark, d).withColumns({c: F.array_join(c, ",") for c in ("source_kinds", "tiers")}).select(*_SHOWN.split(", "))


_TERMS = f"tq AS (SELECT query_id, list_slice(list_distinct_ordered, 1, 20) terms FROM (SELECT query_id, list_filter(t, lambda x, i: list_position(t, x) = i) list_distinct_ordered FROM (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9_.-]+'), lambda x: len(x) > 2 AND x NOT IN ({_LIST}) AND NOT regexp_full_match(x, '[0-9]+')) t FROM q)))"
_RANKED = f"""sp AS (SELECT query_id, 'KAFKA_TOPIC::' || substr(query_id, 2) subject_key, 0.8e0 score FROM q), pc AS (SELECT query_id, node_key, max(path) path FROM (SELECT pa.query_id, unnest([pa.subject_key, pa.object_key]) node_key, greatest(confidence, coalesce(sp.score, 0)) * exp(-0.35 * (greatest(hop, 1) - 1)) * least(1.3, 1 + 1 / 20 + CASE WHEN line_start IS NOT NULL AND line_end IS NOT NULL THEN 0.05 ELSE 0 END) path FROM pa LEFT JOIN sp ON sp.query_id = pa.query_id AND sp.subject_key = pa.subject_key) GROUP BY ALL),
ck AS (SELECT DISTINCT query_id, node_key FROM (SELECT query_id, unnest([subject_key, object_key]) node_key FROM pa)), {_TERMS},
cs AS (SELECT ck.query_id, rs.*, round(coalesce(path, max_confidence) * least(1.3, 1 + least(evidence_count, 5) / 20 + CASE WHEN has_line_bounds THEN 0.05 ELSE 0 END) * (1 + 0.3 * len(list_filter(terms, lambda t: contains(lower(node_name || ' ' || document_title || ' ' || left(text, 800)), t))) / greatest(len(terms), 1) + CASE WHEN list_contains(terms, lower(node_name)) THEN 0.2 ELSE 0 END), 9) score
FROM ck JOIN rs ON rs.node_key = ck.node_key LEFT JOIN pc ON pc.query_id = ck.query_id AND pc.node_key = ck.node_key JOIN tq ON tq.query_id = ck.query_id),
oc AS (SELECT *, row_number() OVER (PARTITION BY query_id, resolved_chunk_id ORDER BY score DESC, node_key, evidence_rank) r FROM cs),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, resolved_chunk_id) rk FROM oc WHERE r = 1)"""


def _scored(spark, d):
    queries = asked(spark, d)
    _, seeds, paths = _walked(spark, d)
    keys = paths.select("query_id", F.explode(F.array("subject_key", "object_key")).alias("node_key")).distinct()
    components = G.path_components(paths, seeds.withColumn("score", F.lit(0.8)))
    return G.rank(keys.join(_resolved(spark, d), "node_key"), components, queries, 9)


@registered("graph_candidate_scores", f"WITH {_WALK}, {_EVIDENCE}, {_RESOLVED}, {_RANKED} SELECT query_id, node_key, resolved_chunk_id, document_id, document_title, score, CAST(rk AS INTEGER) \"rank\" FROM rk")
def graph_candidate_scores(spark, d):
    return _scored(spark, d).select("query_id", "node_key", "resolved_chunk_id", "document_id", "document_title", "score", "rank")


_BUCKET = "CASE WHEN document_title LIKE 'src/%' THEN 'src:' || regexp_replace(lower(split_part(document_title, '/', 2)), '(\\.(api|core|di|messages|service|svc|webapi|worker))+$', '') ELSE 'path:' || lower(document_title) END"


@registered("service_diversity", f"WITH {_WALK}, {_EVIDENCE}, {_RESOLVED}, {_RANKED}, bu AS (SELECT *, {_BUCKET} b FROM rk), fb AS (SELECT *, row_number() OVER (PARTITION BY query_id, b ORDER BY rk) br FROM bu), nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk) k FROM fb WHERE br = 1) SELECT query_id, resolved_chunk_id, b bucket, score, CAST(k AS INTEGER) \"rank\" FROM nr WHERE k <= 5")
def service_diversity(spark, d):
    rows = G.diverse_services(_scored(spark, d), 5)
    return rows.select("query_id", "resolved_chunk_id", T.service_bucket(F.col("document_title")).alias("bucket"), "score", "rank")


@registered("graph_search")
def graph_search(spark, d):
    """The whole search; its stages have SQL of their own."""
    tables = G.Graph(nodes(spark, d), edges(spark, d), edge_evidence(spark, d), node_evidence(spark, d), chunks(spark, d), metadata(spark, d))
    return G.search(asked(spark, d).select("query_id", "query"), tables)[0].select("query_id", "rank", "score", "node_key", "resolved_chunk_id", "document_title", "intent", "scope")
