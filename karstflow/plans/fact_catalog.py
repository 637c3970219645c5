"""Registered queries on files, their facts and the graph made of them, on sources written out of the driver's tables.

Each document stands for a file of its source's repository, whose code,
configuration or summary is put together from the document's columns, so that
SQL can state what must be found.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.operators import chunking, evaluation, extract, graph, responses, sections
from karstflow.plans.catalog import _TERM, _table, registered
from karstflow.session import shared_dir
from karstflow.sources import files


def _docs(spark, d):
    return _table(spark, d, "documents").select("doc_id", "lang", "source", F.col("doc_id").cast("string").alias("n"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/karstflow/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


_PATHS = "CASE doc_id % 8 WHEN 0 THEN 'db/schema_state_' || doc_id || '.md' WHEN 1 THEN 'api/AsyncAPI' || doc_id || '.yaml' WHEN 2 THEN 'k8s/configmap' || doc_id || '.yaml' WHEN 3 THEN 'src/bin/x' || doc_id || '.cs' WHEN 4 THEN 'src/a/appsettings.prod.json' WHEN 5 THEN 'src/a/appsettings.json' WHEN 6 THEN 'k8s/ingress' || doc_id || '.yml' ELSE 'docs/' || doc_id || '_index.md' END"


def _paths(spark, d):
    n, m = F.col("n"), F.col("doc_id") % 8
    forms = [F.concat(F.lit("db/schema_state_"), n, F.lit(".md")), F.concat(F.lit("api/AsyncAPI"), n, F.lit(".yaml")), F.concat(F.lit("k8s/configmap"), n, F.lit(".yaml")), F.concat(F.lit("src/bin/x"), n, F.lit(".cs")), F.lit("src/a/appsettings.prod.json"), F.lit("src/a/appsettings.json"), F.concat(F.lit("k8s/ingress"), n, F.lit(".yml"))]
    path = F.concat(F.lit("docs/"), n, F.lit("_index.md"))
    for i, x in enumerate(forms):
        path = F.when(m == i, x).otherwise(path)
    return _docs(spark, d).withColumn("file_path", path)


@registered("file_kinds", f"""SELECT doc_id, CASE doc_id % 8 WHEN 3 THEN 'AST' WHEN 7 THEN 'SKIP' ELSE 'CONTRACT' END document_kind, CASE doc_id % 8 WHEN 0 THEN 'contract' WHEN 1 THEN 'asyncapi' WHEN 2 THEN 'configmap' WHEN 3 THEN 'contract' WHEN 4 THEN 'appsettings_prod' WHEN 5 THEN 'appsettings_base' WHEN 6 THEN 'ingress' ELSE 'contract' END source_kind, CASE doc_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 6 ELSE 10 END priority, {_PATHS} file_path FROM documents""")
def file_kinds(spark, d):
    path = F.col("file_path")
    return _paths(spark, d).select("doc_id", extract.document_kind(path).alias("document_kind"), extract.source_kind(path).alias("source_kind"), files.extraction_priority(path).alias("priority"), "file_path")


@registered("wanted_files", f"SELECT doc_id FROM (SELECT doc_id, {_PATHS} p FROM documents) WHERE (p LIKE '%.cs' OR p LIKE '%.yaml' OR p LIKE '%.yml') AND p NOT LIKE '%configmap%' AND (p LIKE 'api/%' OR p NOT LIKE 'k8s/%') AND (p LIKE 'src/bin/x1%' OR p NOT LIKE '%/bin/%')")
def wanted_files(spark, d):
    return files.wanted_files(_paths(spark, d), [".cs", ".yaml", ".yml"], ["configmap*"], ["api/", "src/bin/x1"], ["bin", "k8s/"]).select("doc_id")


@registered("migration_files", "WITH m AS (SELECT source, lang, doc_id, CASE lang WHEN 'en' THEN 'db/en' WHEN 'de' THEN 'db/de' ELSE 'other' END dir FROM documents), f AS (SELECT source, min(CASE dir WHEN 'db/de' THEN 0 WHEN 'db/en' THEN 1 END) r FROM m GROUP BY ALL) SELECT m.source repository, dir || '/V' || doc_id || '.SQL' file_path FROM m JOIN f ON f.source = m.source AND CASE dir WHEN 'db/de' THEN 0 WHEN 'db/en' THEN 1 END = r")
def migration_files(spark, d):
    folder = F.when(F.col("lang") == "en", "db/en").when(F.col("lang") == "de", "db/de").otherwise("other")
    rows = _docs(spark, d).select(F.col("source").alias("repository"), F.concat(folder, F.lit("/V"), "n", F.lit(".SQL")).alias("file_path"))
    return files.migration_files(rows, ["none", "db/de/", "db/en"])


# Facts

_FACT = "subject, subject_label, predicate, object, object_label, confidence"


def _facts(df):
    return df.select("repo", "path", "kind", *_FACT.split(", "))


@registered("code_facts", """WITH c AS (SELECT source repo, 'src/F' || doc_id || '.cs' path, doc_id, doc_id % 3 t FROM documents), own AS (SELECT DISTINCT source repo, 'schema_state_' || source || '.md' path FROM documents)
SELECT repo, path, 'ast' kind, repo subject, 'REPO' subject_label, 'OWNS_HANDLER' predicate, 'Do' || doc_id || 'Handler' object, 'HANDLER' object_label, 0.97e0 confidence FROM c UNION ALL SELECT repo, path, 'ast', 'Do' || doc_id || 'Handler', 'HANDLER', 'HANDLES_EVENT', 'Paid' || doc_id || 'Event', 'EVENT', 0.95e0 FROM c
UNION ALL SELECT repo, path, 'ast', 'Do' || doc_id || 'Handler', 'HANDLER', 'WRITES_TABLE', CASE t WHEN 0 THEN 'Orders' WHEN 1 THEN 'order_lines' ELSE 'Categories' END, 'TABLE', 0.95e0 FROM c UNION ALL SELECT repo, path, 'ast', 'Do' || doc_id || 'Handler', 'HANDLER', 'READS_TABLE', 'Orders', 'TABLE', 0.95e0 FROM c
UNION ALL SELECT repo, path, 'ast', repo, 'REPO', 'USES_FEATURE_FLAG', 'EnableF' || doc_id, 'FEATURE_FLAG', 0.93e0 FROM c UNION ALL SELECT repo, path, 'ast', repo, 'REPO', 'CALLS_API', 'stock' || doc_id % 4 || 'api', 'API', 0.95e0 FROM c WHERE FALSE
UNION ALL SELECT repo, path, 'contract', repo, 'REPO', 'OWNS_TABLE', unnest(['Orders', 'order_lines', 'Categories']), 'TABLE', 0.96e0 FROM own""")
def code_facts(spark, d):
    save = F.when(F.col("doc_id") % 3 == 0, "SaveOrderRecord(x)").when(F.col("doc_id") % 3 == 1, "UpsertOrderLine(x)").otherwise("DeleteCategory(x)")
    code = F.concat(F.lit("public class Do"), "n", F.lit("Handler : IHandleMessages<A.Paid"), "n", F.lit('Event>\n{\n  void F(IFeatureFlags flags) { if (flags.EnableF'), "n", F.lit(') { '), save, F.lit('; var q = "select 1 from Orders"; } }\n}\nclass Plain { void G() { DeleteOrders(); } }'))
    own = _docs(spark, d).select(F.col("source").alias("repo"), F.concat(F.lit("src/F"), "n", F.lit(".cs")).alias("path"), code.alias("text"))
    schema = F.lit("### `Orders`\n**Table: `order_lines`**\ntext `Nothing`\ncreate table if not exists [dbo].[Categories](id int)")
    tables = _docs(spark, d).select(F.col("source").alias("repo"), F.concat(F.lit("schema_state_"), "source", F.lit(".md")).alias("path"), schema.alias("text")).distinct()
    return _facts(extract.extract(own.unionByName(tables)))


@registered("configuration_facts", """WITH c AS (SELECT source repo, doc_id, CASE doc_id % 5 WHEN 0 THEN 'asyncapi' WHEN 1 THEN 'configmap' WHEN 2 THEN 'appsettings_base' WHEN 3 THEN 'csproj' ELSE 'ingress' END kind, CASE doc_id % 5 WHEN 0 THEN 'a/asyncapi' || doc_id || '.yaml' WHEN 1 THEN 'k/configmap' || doc_id || '.yaml' WHEN 2 THEN 's/' || doc_id || 'appsettings.json' WHEN 3 THEN 'p/' || doc_id || '.csproj' ELSE 'k/ingress' || doc_id || '.yaml' END path FROM documents),
f AS (SELECT repo, path, kind, unnest(CASE kind WHEN 'asyncapi' THEN [('PRODUCES_TOPIC', 'out.v' || doc_id, 'KAFKA_TOPIC', 0.98e0), ('CONSUMES_TOPIC', 'in.v' || doc_id, 'KAFKA_TOPIC', 0.98e0)] WHEN 'configmap' THEN [('CONSUMES_TOPIC', 'read.v' || doc_id, 'KAFKA_TOPIC', 0.98e0)]
WHEN 'appsettings_base' THEN [('PRODUCES_TOPIC', 'sent.v' || doc_id, 'KAFKA_TOPIC', 0.98e0), ('CALLS_API', 'rates' || doc_id || 'api', 'API', 0.95e0), ('USES_FEATURE_FLAG', 'EnableX' || doc_id, 'FEATURE_FLAG', 0.9e0), ('USES_FEATURE_FLAG', 'use-x' || doc_id, 'FEATURE_FLAG', 0.9e0)]
WHEN 'csproj' THEN [('TARGETS_FRAMEWORK', 'net8.0', 'FRAMEWORK', 0.96e0), ('TARGETS_FRAMEWORK', 'net9.0', 'FRAMEWORK', 0.96e0), ('CONTAINS_PACKAGE', 'P' || doc_id, 'NUGET_PACKAGE', 0.96e0)] ELSE [('EXPOSES_API', 'shop' || doc_id || 'api', 'API', 0.92e0), ('EXPOSES_API', 'orders' || doc_id || 'api', 'API', 0.92e0)] END) x FROM c)
SELECT repo, path, kind, repo subject, 'REPO' subject_label, x[1] predicate, x[2] object, x[3] object_label, x[4] confidence FROM f""")
def configuration_facts(spark, d):
    n, m = F.col("n"), F.col("doc_id") % 5
    say = lambda *parts: F.concat(*[n if x is None else F.lit(x) for x in parts])
    rows = (
        (say("a/asyncapi", None, ".yaml"), say("channels:\n  o:\n    address: out.v", None, "\n  i:\n    address: in.v", None, "\noperations:\n  a:\n    action: send\n    channel:\n      $ref: '#/channels/o'\n  b:\n    action: receive\n    channel:\n      $ref: '#/channels/i'\n")),
        (say("k/configmap", None, ".yaml"), say("data:\n  Kafka__Consumers__Topics: read.v", None, "\n  Other: x\n")),
        (say("s/", None, "appsettings.json"), say('{"Producer": {"Topics": "sent.v', None, '"}, "RatesApiUrl": "https://rates', None, '.example.org/v1", "OktaApiUrl": "https://okta.example.org", "LaunchDarkly": {"EnableX', None, '": {"FlagName": "use-x', None, '"}}}')),
        (say("p/", None, ".csproj"), say('<Project xmlns="urn:x"><!-- <PackageReference Include="No" /> --><PropertyGroup><TargetFrameworks>net8.0; net9.0</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include="P', None, '" /></ItemGroup></Project>')),
        (say("k/ingress", None, ".yaml"), say("spec:\n  rules:\n    - host: shop", None, ".example.org\n      http:\n        paths:\n          - path: /orders", None, "\n")),
    )
    path, text = rows[-1]
    for i, (p, t) in enumerate(rows[:-1]):
        path, text = F.when(m == i, p).otherwise(path), F.when(m == i, t).otherwise(text)
    return _facts(extract.extract(_docs(spark, d).select(F.col("source").alias("repo"), path.alias("path"), text.alias("text"))))


_SUMMARY = "Intro ## Purpose | {0}\nx\n## Topics Produced\n| Topic | Key |\n|---|---|\n| shop.t{1}.v1 | k |\n- `shop.u{1}.v1` — key k\n## External API Calls All clients\n- `Stock{1}Api`\n### Feature Flags\n- use-{1}\n"


@registered("summary_facts", """WITH c AS (SELECT source repo, doc_id, 'src/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/Startup.cs' ELSE '/Other.cs' END path FROM documents), f AS (SELECT repo, path, unnest([('PRODUCES_TOPIC', 'topic', 'KAFKA_TOPIC', 0.98e0), ('PRODUCES_TOPIC', 'shop.t' || doc_id || '.v1', 'KAFKA_TOPIC', 0.98e0), ('PRODUCES_TOPIC', 'shop.u' || doc_id || '.v1', 'KAFKA_TOPIC', 0.98e0), ('CALLS_API', 'stock' || doc_id || 'api', 'API', 0.95e0), ('USES_FEATURE_FLAG', 'use-' || doc_id, 'FEATURE_FLAG', 0.9e0)]) x FROM c WHERE doc_id % 2 = 0)
SELECT repo, path, 'contract' kind, repo subject, 'REPO' subject_label, x[1] predicate, x[2] object, x[3] object_label, x[4] confidence FROM f""")
def summary_facts(spark, d):
    """Only files that set a service up are asked for their contracts; they come from the summary, as the code has none."""
    parts = [x for x in _SUMMARY.replace("{0}", "\0l").replace("{1}", "\0n").split("\0")]
    text = F.concat(F.lit(parts[0]), *[F.concat(F.col("lang" if x[0] == "l" else "n"), F.lit(x[1:])) for x in parts[1:]])
    path = F.concat(F.lit("src/"), "n", F.when(F.col("doc_id") % 2 == 0, "/Startup.cs").otherwise("/Other.cs"))
    return _facts(extract.extract(_docs(spark, d).select(F.col("source").alias("repo"), path.alias("path"), F.lit("class A { }").alias("text"), text.alias("summary"))))


@registered("summary_sections", "SELECT source repo, CAST(doc_id AS VARCHAR) path, unnest([('purpose', lang || chr(10) || 'x'), ('topics produced', '| Topic | Key |' || chr(10) || '|---|---|' || chr(10) || '| shop.t' || doc_id || '.v1 | k |' || chr(10) || '- `shop.u' || doc_id || '.v1` — key k'), ('external api calls', 'all clients' || chr(10) || '- `Stock' || doc_id || 'Api`'), ('feature flags', '- use-' || doc_id)], recursive := true) FROM documents".replace("unnest([", "x[1] section, x[2] body FROM (SELECT doc_id, source, unnest([").replace(", recursive := true) FROM documents", ") x FROM documents)"))
def summary_sections(spark, d):
    parts = [x for x in _SUMMARY.replace("{0}", "\0l").replace("{1}", "\0n").split("\0")]
    text = F.concat(F.lit(parts[0]), *[F.concat(F.col("lang" if x[0] == "l" else "n"), F.lit(x[1:])) for x in parts[1:]])
    return sections.parse(_docs(spark, d).select(F.col("source").alias("repo"), F.col("n").alias("path"), text.alias("summary"))).drop("at")


# The graph of triples: orders say which customers handle which priority

_TRIPLES = """t AS (SELECT 'H' || o_custkey subject, 'E' || o_orderpriority object, 'r' || (o_custkey % 5) repo, 'p' || (o_orderkey % 3) path, CASE WHEN o_orderstatus = 'F' THEN 'HANDLES_EVENT' WHEN o_orderstatus = 'O' THEN 'EMITS_EVENT' ELSE 'LIKES' END predicate, (50 + o_orderkey % 50) / 100.0e0 confidence FROM orders),
k AS (SELECT *, 'HANDLER::' || repo || '::' || subject sk, 'EVENT::' || repo || '::' || object ok FROM t WHERE predicate <> 'LIKES')"""


def _triples(spark, d):
    o = _table(spark, d, "orders")
    predicate = F.when(F.col("o_orderstatus") == "F", "HANDLES_EVENT").when(F.col("o_orderstatus") == "O", "EMITS_EVENT").otherwise("LIKES")
    return o.select(F.concat(F.lit("H"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("HANDLER").alias("subject_label"), predicate.alias("predicate"), F.concat(F.lit("E"), "o_orderpriority").alias("object"), F.lit("EVENT").alias("object_label"), F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("repo"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("path"), F.lit("ast").alias("kind"), ((50 + F.col("o_orderkey") % 50) / 100.0).alias("confidence"), F.col("o_orderkey").alias("observed_at"))


@registered("canonical_nodes", f"WITH {_TRIPLES} SELECT DISTINCT sk node_key, 'HANDLER' \"label\", subject \"name\" FROM k UNION SELECT DISTINCT ok, 'EVENT', object FROM k UNION SELECT 'REPO::r' || i, 'REPO', 'r' || i FROM range(7) x(i)")
def canonical_nodes(spark, d):
    repos = spark.range(7).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo"))
    return graph.with_repositories(graph.canonical(_triples(spark, d))[0], repos)


@registered("canonical_edges", f"WITH {_TRIPLES} SELECT sk || '::' || predicate || '::' || ok edge_key, sk subject_key, predicate, ok object_key, count(DISTINCT (path, confidence)) evidence FROM k GROUP BY ALL")
def canonical_edges(spark, d):
    _, edges, evidence = graph.canonical(_triples(spark, d))
    n = evidence.groupBy("edge_key").agg(F.count(F.lit(1)).alias("evidence"))
    return edges.join(n, "edge_key")


@registered("node_evidence_of_edges", f"WITH {_TRIPLES.replace('confidence FROM orders', 'confidence, o_orderkey FROM orders')}, e AS (SELECT *, row_number() OVER (PARTITION BY sk, predicate, ok, repo, path, confidence ORDER BY o_orderkey) d FROM k), n AS (SELECT unnest([sk, ok]) node_key, repo, path, confidence, o_orderkey FROM e) SELECT node_key, repo, path, count(*) > 0 known FROM n GROUP BY ALL")
def node_evidence_of_edges(spark, d):
    rows = graph.node_evidence(graph.canonical(_triples(spark, d))[2])
    return rows.groupBy("node_key", "repo", "path").agg((F.count(F.lit(1)) > 0).alias("known"))


# Judgements

_GOLDEN = """g AS (SELECT CAST(doc_id AS VARCHAR) query_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'q' || doc_id END query, CASE WHEN doc_id % 4 = 0 THEN 'false' WHEN doc_id % 4 = 1 THEN ' TRUE' ELSE 'true' END answerable, CASE WHEN doc_id % 3 = 0 THEN source || ';' || lang ELSE source END services, CASE WHEN doc_id % 7 = 0 THEN '' ELSE './f' || doc_id || '.cs' || chr(10) || lang || '::summaries/' || lang || '/g.cs;' || lang || '::g.cs' END gold_source_files, source, lang, doc_id FROM documents)"""


def _golden(spark, d):
    n, text = F.col("doc_id"), F.col("n")
    gold = F.concat(F.lit("./f"), text, F.lit(".cs\n"), "lang", F.lit("::summaries/"), "lang", F.lit("/g.cs;"), "lang", F.lit("::g.cs"))
    return _docs(spark, d).select(text.alias("query_id"), F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("q"), text)).alias("query"), F.when(n % 4 == 0, "false").when(n % 4 == 1, " TRUE").otherwise("true").alias("answerable"), F.when(n % 3 == 0, F.concat("source", F.lit(";"), "lang")).otherwise(F.col("source")).alias("services"), F.when(n % 7 == 0, "").otherwise(gold).alias("gold_source_files"), F.lit(None).cast("string").alias("category"), text.alias("difficulty"), F.lit("w").alias("wording_type"))


@registered("golden_qrels", f"WITH {_GOLDEN}, p AS (SELECT query_id, source service, 'f' || doc_id || '.cs' file_path FROM g WHERE doc_id % 4 > 0 AND doc_id % 7 > 0 AND doc_id % 3 > 0 UNION SELECT query_id, lang, 'g.cs' FROM g WHERE doc_id % 4 > 0 AND doc_id % 7 > 0) SELECT query_id, sha256(service || '::' || file_path) doc_id, service, file_path, 1 relevance FROM p")
def golden_qrels(spark, d):
    return evaluation.qrels_of(_golden(spark, d))


@registered("golden_drops", f"WITH {_GOLDEN} SELECT count(*) queries, count_if(doc_id % 4 = 0) unanswerable, count_if(doc_id % 4 > 0 AND doc_id % 11 = 0) unnamed, count_if(doc_id % 4 > 0 AND doc_id % 11 > 0 AND doc_id % 7 = 0) without_sources, count_if(doc_id % 4 > 0 AND doc_id % 11 > 0 AND doc_id % 7 > 0) kept FROM g")
def golden_drops(spark, d):
    return evaluation.dropped(_golden(spark, d))


@registered("frozen_queries", f"WITH {_GOLDEN} SELECT query_id, query query_text, '' category, CAST(doc_id AS INTEGER) difficulty, 'w' wording_type, CASE WHEN doc_id % 3 = 0 THEN least(lang, source) || ';' || greatest(lang, source) ELSE source END services FROM g WHERE doc_id % 4 > 0 AND doc_id % 7 > 0 AND doc_id % 11 > 0")
def frozen_queries(spark, d):
    return evaluation.frozen_queries(_golden(spark, d)).withColumn("services", F.array_join("services", ";"))


# Texts


@registered("clean_labels", "SELECT doc_id, 'T ' || source || ' ' || lang label_, 'tbl_' || doc_id table_name FROM documents")
def clean_labels(spark, d):
    raw = F.concat(F.lit(" **T**  "), "source", F.lit("\n"), "lang", F.lit(" (L12-34)"))
    table = F.concat(F.lit("Table: [dbo].`tbl_"), "n", F.lit("`;"))
    return _docs(spark, d).select("doc_id", T.clean_label(raw).alias("label_"), T.table_name(table).alias("table_name"))


@registered("without_reasoning", "SELECT doc_id, '## A' || chr(10) || lang || chr(10) || '## B' || chr(10) || source text FROM documents")
def without_reasoning(spark, d):
    raw = F.concat(F.lit("## A\n"), "lang", F.lit("\n### Reasoning steps\nhidden "), "source", F.lit("\n## B\n"), "source", F.lit("\n**Reasoning:** more\nlines"))
    return _docs(spark, d).select("doc_id", T.without_reasoning(raw).alias("text"))


@registered("chunk_default", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w FROM documents), s AS (SELECT *, unnest(range(0, len(w), 1275)) st, len(range(0, len(w), 1275)) total FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(st // 1275 + 1 AS INTEGER) chunk_index, CAST(total AS INTEGER) total_chunks, md5(array_to_string(w[st + 1 : st + 1500], ' ')) content_md5 FROM s""")
def chunk_default(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.lit("t").alias("title"), "text", "source", F.lit("summaries").alias("retrieval_corpus"))
    return chunking.chunk(docs).select("doc_id", "chunk_index", "total_chunks", F.md5("content").alias("content_md5"))


@registered("cased_terms", f"SELECT doc_id, len(regexp_extract_all(text, '{_TERM}')) n, md5(array_to_string(regexp_extract_all(text, '{_TERM}'), ' ')) terms_md5 FROM documents")
def cased_terms(spark, d):
    terms = T.cased_terms(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.size(terms).alias("n"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


# Files written and read again


@registered("graph_csv", "SELECT 'n' || p_partkey id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'n' || p_partkey END \"label\", CASE WHEN p_partkey % 3 = 0 THEN 'UNKNOWN' ELSE p_type END node_type, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END evidence_count, round(10 + least(45, sqrt(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END) * 3.5), 2) size FROM part")
def graph_csv(spark, d):
    n = F.col("p_partkey")
    rows = _table(spark, d, "part").select(F.concat(F.lit("n"), n.cast("string")).alias("id"), F.when(n % 2 == 0, F.col("p_name")).otherwise(" ").alias("label"), F.when(n % 3 > 0, F.col("p_type")).alias("node_type"), F.when(n % 5 == 0, "many").otherwise(F.col("p_size").cast("string")).alias("evidence_count"), F.lit("").alias("last_seen"))
    folder = _folder(spark)
    rows.unionByName(rows.limit(1).withColumn("id", F.lit(""))).write.csv(f"{folder}/nodes", header=True)
    rows.limit(1).select("id", F.col("id").alias("source"), F.col("id").alias("target"), F.lit("").alias("edge_type"), F.lit("1").alias("evidence_count"), "last_seen").write.csv(f"{folder}/edges", header=True)
    nodes, _ = files.read_graph_csv(spark, f"{folder}/nodes", f"{folder}/edges")
    return files.drawn_nodes(nodes).select("id", "label", "node_type", "evidence_count", "size")


@registered("summaries_read", "SELECT 'shop' repository, CAST(doc_id AS VARCHAR) file_path, md5(text) text_md5 FROM documents UNION ALL SELECT 'known', CAST(doc_id AS VARCHAR), md5(text) FROM documents")
def summaries_read(spark, d):
    """Summaries written for a repository, then scanned, and loaded as what is known already."""
    rows = _table(spark, d, "documents").select(F.lit("shop").alias("repository"), F.col("doc_id").cast("string").alias("file_path"), F.lit("u").alias("url"), F.lit("2024-01-01").alias("last_modified"), F.lit("").alias("source_code"), F.col("text").alias("summary"))
    folder = _folder(spark)
    files.write_summaries(rows, spark.createDataFrame([], "repository string, file_path string, error string"), f"{folder}/shop")
    scanned = files.read_summaries(spark, folder, ["shop"], "summaries")
    known = files.existing_summaries(spark, f"{folder}/shop/summaries").withColumn("repository", F.lit("known"))
    return scanned.select("repository", "file_path", "summary").unionByName(known.select("repository", "file_path", "summary")).select("repository", "file_path", F.md5("summary").alias("text_md5"))


@registered("json_lines", "SELECT conv_id, turn, md5(text) text_md5 FROM conversations")
def json_lines(spark, d):
    """Rows written as JSON lines, with blank lines between, and read again; the manifest has a digest for each file."""
    folder = _folder(spark)
    rows = _table(spark, d, "conversations")
    lines = rows.select(F.concat(F.to_json(F.struct(*rows.columns)), F.lit("\n \n")).alias("value"))
    lines.write.text(f"{folder}/lines")
    read = files.read_json_lines(spark, f"{folder}/lines", "conv_id long, turn long, role string, text string")
    return read.select("conv_id", "turn", F.md5("text").alias("text_md5"))


# Responses


@registered("parsed_responses", "SELECT CAST(doc_id AS VARCHAR) chunk_id, source document_id, CAST(n_chars AS DOUBLE) score, CASE WHEN doc_id % 2 = 0 THEN 'fts' ELSE 'bm25' END keyword_ranker, 'm' model_used FROM documents WHERE doc_id % 5 > 0")
def parsed_responses(spark, d):
    t = _table(spark, d, "documents").withColumn("n", F.col("doc_id").cast("string"))
    meta = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("keyword_ranker"), F.lit("fts"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    chunk = F.struct(F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit(" "), "n")).otherwise(" ").alias("chunk_id"), F.col("source").alias("document_id"), F.col("n_chars").cast("double").alias("score"), meta.alias("metadata"))
    nested = t.groupBy(F.col("source").alias("query_id")).agg(F.to_json(F.array(F.struct(F.lit("m").alias("model_used"), F.lit(1.5).alias("search_duration_ms"), F.collect_list(chunk).alias("chunks")))).alias("json"))
    return responses.parse(nested, "hybrid-bm25").select("chunk_id", "document_id", "score", "keyword_ranker", "model_used")


@registered("cited_chunks", "SELECT source query_id, string_agg(CASE WHEN doc_id % 2 = 0 THEN '' ELSE 't' || doc_id END || ':' || n_chars, ',' ORDER BY n_chars DESC, doc_id) cited FROM documents GROUP BY source")
def cited_chunks(spark, d):
    from karstflow.operators.keyword import top

    t = _table(spark, d, "documents").withColumn("n", F.col("doc_id").cast("string"))
    rows = t.select(F.col("source").alias("query_id"), F.col("n").alias("chunk_id"), F.when(F.col("doc_id") % 2 > 0, F.concat(F.lit("t"), "n")).alias("document_title"), F.lit(None).cast("string").alias("url"), F.col("n_chars").alias("score"), "text", F.lit(None).cast("string").alias("source_code"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), "doc_id")
    ranked = top(rows, 1 << 30, F.col("score").desc(), F.col("doc_id"))
    return responses.citations(ranked, ("title", "score")).select("query_id", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["title"], c["score"].cast("long").cast("string"))), ",").alias("cited"))
