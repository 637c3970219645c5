"""Sources, snapshots, streams and routing on small tables."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from karstflow.functions import text as T
from karstflow.operators import chunking, evaluation, graph, upsert
from karstflow.plans import routing
from karstflow.sources import files
from karstflow.streaming import changes


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"] and df.count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_summaries_to_chunks(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    summary = "## Purpose\nSells things (a.cs:L1-L2).\n## Reasoning\nhidden\n## Key Business Logic\nrules\n## Source References\na.cs"
    (tmp_path / "shop" / "summaries.json").write_text(json.dumps({"repository": "shop", "files": [{"file_path": "a.cs", "url": "", "last_modified": "2024-01-02T03:04:05Z", "source_code": "class A {}", "summary": summary}, {"file_path": "b.cs", "summary": " "}]}))
    docs = chunking.build_documents(files.read_summaries(spark, str(tmp_path)))
    row = docs.collect()[0]
    assert docs.count() == 1 and "hidden" not in row.text and "L1" not in row.text and row.source_refs == "a.cs"
    pieces = chunking.chunk(docs, 4, 0.5)
    assert rows(pieces, "chunk_index")[0] == (1,) and pieces.first().text.startswith("TITLE: a.cs | SOURCE: shop | CORPUS: summaries | PART: 1 of ")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "summaries.json").write_text(json.dumps({"repository": " ", "files": [{"file_path": "x"}]}))
    with pytest.raises(Exception, match="without a repository"):
        files.read_summaries(spark, str(tmp_path)).collect()


def test_file_rules(spark):
    df = spark.createDataFrame([("r", p) for p in ("src/a.cs", "src/a.test.cs", "bin/b.cs", "keep/bin/c.cs", "d.txt", "db/2.sql", "db/10.sql", "old/1.sql")], "repository string, file_path string")
    kept = files.wanted_files(df, [".cs"], ["*.test.cs"], ["keep/"], ["bin"])
    assert rows(kept, "file_path") == [("keep/bin/c.cs",), ("src/a.cs",)]
    assert [r.file_path for r in files.migration_files(df, ["none", "db", "old"]).collect()] == ["db/2.sql", "db/10.sql"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, source string, v string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", None)], "k int, source string, v string")
    assert rows(upsert.upsert(old, new, ["k"]), "k", "source") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(upsert.upsert_keeping(old, new, ["k"], keep=["source"]), "k", "source", "v")[1] == (2, "b", "y")


def test_follow_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    spark.createDataFrame([(1, "n", 1, False), (2, "gone", 2, True), (1, "newer", 3, False)], "k int, v string, ts int, deleted boolean").write.json(str(feed))
    base = spark.createDataFrame([(1, "o"), (2, "o"), (3, "o")], "k int, v string")
    out = str(tmp_path / "state")
    stream = spark.readStream.schema("k int, v string, ts int, deleted boolean").json(str(feed))
    changes.follow(stream, lambda: base, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), ["k"], str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(f"{out}/0"), "k", "v") == [(1, "newer"), (3, "o")]


def test_replace_source(spark):
    evidence = "edge_key string, subject_key string, object_key string, source_repo string, source_path string"
    ee = spark.createDataFrame([("e1", "a", "b", "r", "p"), ("e2", "b", "c", "r", "q")], evidence)
    ne = spark.createDataFrame([("d", "r", "q")], "node_key string, source_repo string, source_path string")
    edges = spark.createDataFrame([("e1",), ("e2",)], "edge_key string")
    nodes = spark.createDataFrame([(k,) for k in "abcd"], "node_key string")
    _, _, kept, left = graph.replace_source(ne, ee, edges, nodes, ne.limit(0), ee.limit(0), "r", "p")
    assert rows(kept, "edge_key") == [("e2",)] and rows(left, "node_key") == [("b",), ("c",), ("d",)]


def test_routing():
    services = routing.catalogue(json.dumps([{"source": "billing-service", "short_form": "BS", "long_form": "Billing Service"}, {"source": "mail", "short_form": "", "long_form": ""}]))
    assert len(services) == 1
    assert routing.plan("how are invoices made in billing service", services).mode == routing.HARD_FILTER
    assert routing.plan("which services use billing service", services).mode == routing.GLOBAL
    assert routing.plan("billing service invoices", services).mode == routing.BOOST
    assert routing.plan("invoices", services).services == ()
    assert routing.expand("what does BS do", services) == "what does BS do Billing Service billing-service"


def test_qrels(spark):
    golden = spark.createDataFrame([("q1", "TRUE", "a", "./x.cs\na::summaries/a/y.cs"), ("q2", "false", "a", "z.cs"), ("q3", "true", "a;b", "lost.cs")], "query_id string, answerable string, services string, gold_source_files string")
    assert rows(evaluation.qrels_of(golden), "query_id", "service", "file_path") == [("q1", "a", "x.cs"), ("q1", "a", "y.cs")]


def test_names(spark):
    def one(f, x):
        return spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]

    assert one(T.token_key, "  My_Big  Service! ") == "my-big-service"
    assert one(T.topic_name, "application/json") is None and one(T.topic_name, "a.b.c/x") == "a.b.c"
    assert one(T.table_name, "[dbo].[Orders]") == "Orders" and one(T.table_name, "schema") is None
    assert one(T.service_bucket, "src/Shop.Orders.Api/a.cs") == "src:shop.orders" and one(T.service_bucket, "x/y") == "path:x/y" and one(T.service_bucket, " ") == "unknown"
    assert one(T.query_terms, "The river of 12 rivers river") == ["river", "rivers"]


def test_notices(spark):
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"k", b"x", hashlib.sha256).hexdigest()
    assert changes.signed(b"x", "k", good) and not changes.signed(b"y", "k", good) and not changes.signed(b"x", "", good) and not changes.signed(b"x", "k", None)
    body = lambda **x: json.dumps({"action": "closed", "repository": {"name": "r"}, "pull_request": {"number": 4, "merged": True}, **x})
    notices = [("pull_request", body()), ("push", body()), ("pull_request", body(action="opened")), ("pull_request", body(repository={"name": "other"})), ("pull_request", body(pull_request={"number": 5, "merged": False})), ("pull_request", "{")]
    assert rows(changes.merged_requests(spark.createDataFrame(notices, "event string, body string"), ["r"]), "repository", "number", "base") == [("r", 4, "main")]
    entries = [("r", "new.cs", "old.cs", "renamed", 1), ("r", "gone.cs", None, "removed", 1), ("r", "a.cs", None, "modified", 1), ("r", "", None, "added", 1)]
    got = changes.changes_of(spark.createDataFrame(entries, "repository string, filename string, previous_filename string, status string, ts int"))
    assert rows(got, "file_path", "deleted") == [("a.cs", False), ("gone.cs", True), ("new.cs", False), ("old.cs", True)]


def test_shared_folder(spark, monkeypatch):
    """Without a shared folder a cluster is an error, not a driver's own disk."""
    from karstflow import session

    made = []
    context = {"master": "spark://x:7077", "getCheckpointDir": lambda self: made[0] if made else None, "setCheckpointDir": lambda self, path: made.append(path)}
    fake = lambda **more: type("S", (), {"conf": type("K", (), {"get": lambda self, *a: None})(), "sparkContext": type("C", (), context | more)()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake())
    assert session.shared_dir(fake(master="local[2]")) == made[0]
    kept = session.written(spark.range(3), "x")
    assert kept.count() == 3 and spark.sparkContext.applicationId in kept.inputFiles()[0]


def test_names_of_things(spark):
    def one(f, *x):
        return spark.createDataFrame([x], ", ".join(f"x{i} string" for i in range(len(x)))).select(f(*[F.col(f"x{i}") for i in range(len(x))])).first()[0]

    for raw, name in (
        ("https://shop.example.org/orders/v2", "ordersapi"), ("https://api.rates.example.org/", "ratesapi"), ("https://dps-operations-api.example.org", "dpsoperationsapi"), ("http://x.okta.com/a", "oktaapi"), ("https://h.org/v1/stockApiV2/x", "stockapiv2"),
        ("ApiUrls__PaymentsApiBaseUrl", "paymentsapi"), ("IStockApi", "stockapi"), ("internalApi", "internalapi"), ("#{BillingApi.Url}", "billingapi"), ("HttpClientHandlerApi", None), ("just words", None), ("", None), (None, None), ("api", None),
    ):
        assert one(T.api_name, raw) == name, raw
    for raw, name in (("Shop.Orders.V1", "shop.orders.v1"), ("`a b.c`", "ab.c"), ("Constants.Kafka.X", None), ("12345", None), ("status", None), ("#{my-topic}", "my-topic"), ("ab", None)):
        assert one(T.topic_name, raw) == name, raw
    for raw, name in (("enableTea: on", "EnableTea"), ("IFeatureFlags.EnableMilk()", "EnableMilk"), ("Use-It", "use-it"), ("sdk-key", None), ("plain", None), ("A__B", None), ("two words", None)):
        assert one(T.flag_name, raw) == name, raw
    assert one(T.table_variants, "order_lines") == ["orderlines", "orderlin", "orderline"] and one(T.table_variants, "Categories") == ["categories", "category", "categori", "categorie"]
    assert one(T.clean_label, "**A**  b (L3-9)") == "A b" and one(T.clean_label, "x.;") == "x" and one(T.has_phrase, "see BS-now", "bs") is True and one(T.has_phrase, "BSX", "bs") is False
    assert one(T.without_reasoning, "a\n## Reasoning\nx\n## B\nc") == "a\n## B\nc" and one(T.cased_terms, "A b-C d") == ["A", "b-C", "d"]
    assert one(T.summary_fault, "## Purpose\n## Key Business Logic\n## End") == "ends with a heading"


def test_drop_written(tmp_path):
    """Only what the application itself has written goes."""
    import subprocess
    import sys

    code = f"""
from karstflow import session
spark = session.session("drop", spark__master="local[1]", spark__ui__enabled="false", spark__checkpoint__dir="file://{tmp_path}")
session.written(spark.range(2), "x").count()
spark.range(1).write.parquet("file://{tmp_path}/karstflow/other/y")
session.drop_written(spark)
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    assert [p.name for p in (tmp_path / "karstflow").iterdir()] == ["other"]
