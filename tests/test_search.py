"""Full text with stems, vectors, routing and graph search against plain Python."""

import collections
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from karstflow.functions import stemming
from karstflow.operators import graph, keyword, responses, vector
from karstflow.plans import graph_catalog, graph_search, routing, search
from karstflow.sources import files
from karstflow.operators import evaluation, upsert

SF = "/root/testdata/sf0.001"
STEMS = {
    "consigned": "consign", "consistency": "consist", "consolations": "consol", "knackeries": "knackeri", "knightly": "knight", "invoices": "invoic", "invoice": "invoic", "running": "run", "hopping": "hop", "hoping": "hope",
    "generously": "generous", "generate": "generat", "communities": "communiti", "relational": "relat", "rational": "ration", "happy": "happi", "say": "say", "cries": "cri", "ties": "tie", "gas": "gas", "gaps": "gap",
    "luxuriated": "luxuri", "agreed": "agre", "bed": "bed", "controlled": "control", "organization": "organ", "probabilities": "probabl", "goodness": "good", "adoption": "adopt", "cease": "ceas", "dying": "die", "succeed": "succeed", "syzygy": "syzygi",
}


def test_stems():
    assert {w: stemming.stem(w) for w in STEMS} == STEMS and stemming.lexeme("the") == ""


def terms(text):
    return [t.lower() for t in re.findall(r"\w+(?:-\w+)*", text)]


@pytest.mark.parametrize("stored", [False, True])
def test_english_search(spark, tmp_path, stored):
    rng = random.Random(3)
    words = ["invoices", "invoice", "running", "runs", "the", "of", "river", "rivers", "controlled", "control", "über"]
    rows = [(f"c{i}", f"d{i % 7}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(words), f"s{i % 3}", "summaries") for i in range(40)] + [("none", "d1", None, None, "s1", "summaries")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, text string, title string, source string, retrieval_corpus string")
    index = keyword.build(chunks, str(tmp_path / "index"), True, 4) if stored else chunks
    asked = {"q1": "Invoices of the river", "q2": "running control", "q3": "the of"}
    got = keyword.fts(index, spark.createDataFrame(list(asked.items()), "query_id string, query string"), 10, ["s0", "s1"], "summaries").collect()
    for name, text in asked.items():
        wanted = {x for x in map(stemming.lexeme, terms(text)) if x}
        scores = {}
        for c, _, t, title, source, _ in rows:
            r = sum(1.0 for x in terms(t or "") if stemming.lexeme(x) in wanted) + sum(0.4 for x in terms(title or "") if stemming.lexeme(x) in wanted)
            if r and source != "s2":
                scores[c] = round(r / (r + 1), 10)
        best = sorted(scores, key=lambda c: (-scores[c], c))[:10]
        assert [(r.chunk_id, r.score) for r in sorted((r for r in got if r.query_id == name), key=lambda r: r.rank)] == [(c, pytest.approx(scores[c])) for c in best]


def test_vector_blocks(spark, monkeypatch):
    """Queries in several blocks, ties, null vectors and vectors without length."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)], i % 2) for i in range(60)] + [(90, None, 0), (91, [0.0, 0.0, 0.0], 1)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<float>, label int").repartition(3)
    asked = items.filter("item_id < 7").select(F.col("item_id").cast("string").alias("query_id"), F.col("embedding").alias("query_embedding"))
    one = {(r.query_id, r["rank"]): (r.item_id, r.score, r.label) for r in vector.nearest(items, asked, 5).collect()}
    monkeypatch.setattr(vector, "BLOCK", 2)
    assert {(r.query_id, r["rank"]): (r.item_id, r.score, r.label) for r in vector.nearest(items, asked, 5).collect()} == one
    by = {i: (e, x) for i, e, x in rows}
    norm = lambda e: sum(x * x for x in e) ** 0.5
    for q in range(7):
        e = by[q][0]
        if norm(e):
            scores = {i: round(sum(a * b for a, b in zip(e, v)) / norm(e) / norm(v), 6) for i, (v, _) in by.items() if v and norm(v)}
            assert [one[str(q), k][0] for k in range(1, 6)] == sorted(scores, key=lambda i: (-scores[i], i))[:5]
        else:
            assert (str(q), 1) not in one
    assert vector.nearest(items, asked.limit(0)).columns == ["query_id", "item_id", "label", "score", "rank"]


SERVICES = routing.catalogue(json.dumps([{"source": "billing-service", "short_form": ["BS"], "long_form": "Billing Service"}, {"source": "mail", "short_form": "ML", "long_form": ["Mail Hub", "Post"]}, {"source": "mail-two", "short_form": "ML", "long_form": ""}]))


@pytest.mark.parametrize(("query", "mode", "found"), [
    ("what does billing service do", routing.HARD_FILTER, ("billing-service",)),
    ("how are errors in the queue handled by billing service", routing.BOOST, ("billing-service",)),
    ("how are invoices made in Billing-Service", routing.HARD_FILTER, ("billing-service",)),
    ("billing service's invoices", routing.HARD_FILTER, ("billing-service",)),
    ("which downstream services use BS", routing.GLOBAL, ("billing-service",)),
    ("invoices across services of BS", routing.GLOBAL, ("billing-service",)),
    ("what is ML for", routing.BOOST, ("mail", "mail-two")),
    ("invoices", routing.GLOBAL, ()),
])
def test_plans(spark, query, mode, found):
    plan = routing.plan(query, SERVICES)
    assert (plan.mode, plan.services) == (mode, found)
    table = spark.createDataFrame([(s.source, s.short_form, s.long_form) for s in SERVICES], "source string, short_form string, long_form string")
    row = routing.plan_all(spark.createDataFrame([("q", query)], "query_id string, query string"), table).first()
    assert (row["mode"], tuple(row.services)) == (mode, found)


def test_within_budget():
    budget = graph.Budget(hops=2, nodes_per_hop=3, edges_per_node=9, paths=9, nodes=9)
    star = [(1, 1.0, "s", f"n{i}", f"e{i}") for i in range(5)]
    assert graph.within_budget(star, ["s"], budget) == [0, 1]
    # Nodes known from an earlier hop count toward a hop's cap all the same.
    assert graph.within_budget([(1, 1.0, "a", "b", "x"), (2, 1.0, "a", "b", "y"), (2, 1.0, "a", "c", "z"), (2, 1.0, "a", "d", "w")], ["a"], budget) == [0, 1, 2]
    assert graph.within_budget([(1, 1.0, "a", "b", "x"), (1, 0.9, "b", "a", "y"), (1, 0.8, "a", "c", "z")], ["a"], graph.Budget(1, 9, 9, 9, 2)) == [0, 1]
    assert graph.within_budget([(3, 1.0, "a", "b", "x"), (0, 1.0, "a", "b", "x"), (1, 1.0, "", "b", "x")], ["a"], budget) == []


def test_hybrid_without_graph(spark):
    """A graph that fails is left out of a hybrid search, and fails a graph search."""
    d = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    chunks = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.concat("source", F.col("doc_id").cast("string")).alias("title"), "text", "source", F.lit("summaries").alias("retrieval_corpus"), "embedding")
    broken = graph_search.Graph(*[chunks] * 6)
    request = search.SearchRequest("the river", "hybrid", 4, ranker="bm25", embedding=tuple([0.1] * 64))
    rows = search.search(spark, request, chunks, graph=broken).collect()
    assert len(rows) == 4 and all(r.graph_error for r in rows)
    assert [r.item_id for r in rows] == [r.item_id for r in search.search(spark, request, chunks).collect()]
    with pytest.raises(Exception):
        search.search(spark, search.SearchRequest("the river", "graph"), chunks, graph=broken)
    whole = graph_search.Graph(*[f(spark, SF) for f in (graph_catalog.nodes, graph_catalog.edges, graph_catalog.edge_evidence, graph_catalog.node_evidence, graph_catalog.chunks, graph_catalog.metadata)])
    found = search.search(spark, search.SearchRequest("which topics has NATION_3", "graph", 4), chunks, graph=whole).collect()
    assert len(found) == 4 and [r["rank"] for r in sorted(found, key=lambda r: -r.score)] == [1, 2, 3, 4]


def test_responses(spark):
    text = json.dumps([{"model_used": "m", "search_duration_ms": 2.5, "chunks": [{"chunk_id": " a ", "document_id": "d", "score": 0.5, "metadata": {"keyword_ranker": "fts"}}, {"chunk_id": "", "document_id": "d"}, {"chunk_id": "b", "document_id": "e"}]}])
    rows = responses.parse(spark.createDataFrame([("q", text)], "query_id string, json string"), "hybrid").collect()
    assert [(r.chunk_id, r.score, r.keyword_ranker, r.model_used) for r in sorted(rows, key=lambda r: r._c)] == [("a", 0.5, "fts", "m"), ("b", 0.0, "bm25", "m")]
    assert responses.plan_of("hybrid-bm25-service-aware") == ("hybrid", "bm25", True)
    with pytest.raises(ValueError, match="unknown strategy"):
        responses.plan_of("none")
    chunks = spark.createDataFrame([("q", "a", None, "u", 0.5, "t", None, {"x": "1"}, 2), ("q", "b", "T", None, 0.9, "t", "c", {}, 1)], "query_id string, chunk_id string, document_title string, url string, score double, text string, source_code string, metadata map<string,string>, rank int")
    cited = responses.citations(chunks).first().citations
    assert [(c.title, c.url, c.score) for c in cited] == [("T", "", 0.9), ("", "u", 0.5)]
    noted = responses.keyword_metadata(chunks.withColumn("term_count", F.lit(2)).withColumn("base_score", F.lit(0.3)), "fts", match_all=True).filter("chunk_id = 'a'").first().metadata
    assert noted["x"] == "1" and json.loads(noted["match_all"])["term_coverage"] == {"terms_in_chunk": 2, "base_score": 0.3, "boosted_score": 0.5}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a.cs", "u", "t", "c", "s1"), ("r", "b.cs", "u", "t", "c", "s2")], "repository string, file_path string, url string, last_modified string, source_code string, summary string")
    errors = spark.createDataFrame([("r", "c.cs", "broken")], "repository string, file_path string, error string")
    out = f"file://{tmp_path}/out"
    files.write_summaries(rows, errors, out)
    assert {r.file_path for r in files.existing_summaries(spark, f"{out}/summaries").collect()} == {"a.cs", "b.cs"} and (tmp_path / "out" / "failed_files").exists()
    files.write_summaries(rows, errors.limit(0), out)
    assert not (tmp_path / "out" / "failed_files").exists()
    assert files.existing_summaries(spark, f"{out}/nothing").count() == 0
    files.write_markdown(rows, f"{out}/pages")
    pages = {r.page: r.value for r in spark.read.text(f"{out}/pages", wholetext=True).collect()}
    assert pages == {f"r/{x}.cs.md": f"<!-- r/{x}.cs | u -->\n\n{s}\n" for x, s in (("a", "s1"), ("b", "s2"))}
    import hashlib

    files.write_with_manifest({"t": rows}, f"{out}/frozen")
    for r in spark.read.json(f"{out}/frozen/manifest").collect():
        assert hashlib.sha256((tmp_path / "out" / "frozen" / "t" / r.file).read_bytes()).hexdigest() == r.sha256
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert [r.a for r in files.read_json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()] == [1, 2]
    assert files.paged(spark, lambda page, size: [(page, i) for i in range(size if page < 3 else 1)], "p int, i int", 4).count() == 9
    nodes = spark.createDataFrame([("a", "A", "T1", 4, ""), ("b", "B", "T2", 0, "")], "id string, label string, node_type string, evidence_count int, last_seen string")
    assert [(r.size, r.color) for r in files.drawn_nodes(nodes).orderBy("id").collect()] == [(17.0, files.PALETTE[0]), (10.0, files.PALETTE[1])]
    files.write_graph_html(nodes, spark.createDataFrame([("e", "a", "b")], "id string, source string, target string"), f"{out}/page")
    assert "T1" in spark.read.text(f"{out}/page").first().value
    with pytest.raises(ValueError, match="at most 1"):
        files.write_graph_html(nodes, nodes, f"{out}/none", 1)
    (tmp_path / "n.csv").write_text("id,label,node_type,evidence_count,last_seen\na,,,x,\n,z,z,1,z\n")
    (tmp_path / "e.csv").write_text("id,source,target,edge_type,evidence_count,last_seen\n1,a,b,,2,\n2,,b,x,1,\n")
    n, e = files.read_graph_csv(spark, f"file://{tmp_path}/n.csv", f"file://{tmp_path}/e.csv")
    assert [tuple(r) for r in n.collect()] == [("a", "a", "UNKNOWN", 0, "")] and [tuple(r) for r in e.collect()] == [("1", "a", "b", "RELATED", 2, "")]


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("s", "q1", 5, "c", "10", 1.0, 2), ("s", "q2", 5, "c", "9", 0.0, 0), ("s", "q3", 5, "d", "hard", 0.5, 1)], "strategy string, query_id string, k int, category string, difficulty string, recall double, hit_count long")
    tables = evaluation.result_tables(rows)
    assert [r.difficulty for r in tables["difficulty_results"].collect()] == ["9", "10", "hard"]
    assert [(r.category, r.n, r.recall, r.hit_count) for r in tables["category_results"].collect()] == [("c", 2, 0.5, 1.0), ("d", 1, 0.5, 1.0)]
    evaluation.write_results(rows, {"run_id": "r"}, f"file://{tmp_path}/run")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/run/run_meta").collect())) == {"run_id": "r"}
    golden = spark.createDataFrame([("q1", "t", "TRUE", "a", "x.cs", "3"), ("q2", "t", "false", "a", "x.cs", "1"), ("q3", " ", "true", "a", "x.cs", None), ("q4", "t", "true", "a", "", "x")], "query_id string, query string, answerable string, services string, gold_source_files string, difficulty string").withColumn("category", F.lit(None).cast("string")).withColumn("wording_type", F.lit("w"))
    assert tuple(evaluation.dropped(golden).first()) == (4, 1, 1, 1, 1)
    assert [(r.query_id, r.difficulty, r.category, r.services) for r in evaluation.frozen_queries(golden).collect()] == [("q1", 3, "", ["a"])]


def test_refreshed(spark):
    old, now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    state, counts = upsert.refreshed(old, now, ["k"])
    assert sorted(map(tuple, state.collect())) == [(2, "c"), (3, "d")] and tuple(counts.first()) == (1, 1, 1)
    newest = upsert.newest_first(spark.createDataFrame([("a", 1), ("c", 2), ("b", 2)], "id string, updated_at int"))
    assert [r.id for r in newest.collect()] == ["b", "c", "a"]


def test_strategies_in_turn(spark):
    def run(request):
        if request.strategy == "graph":
            raise ValueError("no graph")
        return spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, rank int")

    rows = search.evaluate(spark, [("q", search.SearchRequest("x"))], ["vector", "graph"], run).collect()
    assert collections.Counter((r.strategy, r.error) for r in rows) == {("vector", ""): 2, ("graph", "no graph"): 1}


def test_corpora():
    assert [search.corpus_of(x) for x in ("summary", "source_code", "ALL", None, " code ")] == ["summaries", "code", "all", "summaries", "code"]
    with pytest.raises(ValueError, match="unknown corpus"):
        search.corpus_of("books")
