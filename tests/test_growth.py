"""Work that grows with its input and not with the square of it, and memory that doesn't follow one group."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from karstflow.operators import keyword, responses, vector
from karstflow.plans import graph_search, routing
from karstflow.sources import files


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def services_and_queries(spark):
    services = [routing.Service(f"svc-{i}", f"SV{i % 3}", "" if i % 4 == 0 else f"Service Nr {i}") for i in range(1, 25)] + [routing.Service("", "GONE", "Gone"), routing.Service("x#1", " a.b ", "über-nr 5")]
    texts = ["what is in SV1", "errors of svc-12 and SV2?", "Service Nr 7's orders", "what does service nr 9 send", "all services: SV0", "nothing here", "svc-1x xsvc-1 svc-1-", "a.b or x1", "in (über-nr 5)", "", "which services call SV1 svc", "svc_3  Service   Nr 3", "SV1-gone GONE"]
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")
    return services, spark.createDataFrame([(s.source, s.short_form, s.long_form) for s in services], "source string, short_form string, long_form string"), texts, queries


def test_names_are_expanded_without_trying_every_pair(spark):
    services, table, texts, queries = services_and_queries(spark)
    found = routing.expand_all(queries, table)
    assert not re.search("NestedLoop|Cartesian", plan_of(found))
    own = [s for s in services if routing.token_key(s.short_form) or routing.token_key(s.long_form)]
    assert {r.query_id: r.query for r in found.collect()} == {f"q{i}": routing.expand(t, own) for i, t in enumerate(texts)}


def test_plans_of_many_queries_are_those_of_each(spark):
    services, table, texts, queries = services_and_queries(spark)
    found = routing.plan_all(queries, table)
    assert not re.search("NestedLoop|Cartesian", plan_of(found)) and not re.search("NestedLoop|Cartesian", plan_of(routing.match_all(queries, table)))
    for r in found.collect():
        one = routing.plan(texts[int(r.query_id[1:])], services)
        assert (r.mode, tuple(r.services), tuple(r.ambiguous) if one.mode != routing.HARD_FILTER else ()) == (one.mode, one.services, one.ambiguous), texts[int(r.query_id[1:])]
    for r in routing.match_all(queries, table).collect():
        sure, shared = routing.matches(texts[int(r.query_id[1:])], services)
        assert (set(r.services), set(r.ambiguous)) == (set(sure), shared) and (len(sure) != 1 or len(r.alias) == len(next(iter(sure.values()))))


def test_aliases_are_mentioned_without_trying_every_pair(spark):
    queries = [("a", "Which topics of  nation_3 does it read?"), ("b", "orders of repo-11x and xrepo-2"), ("c", "nothing"), ("d", "???")]
    services = [("topics", f"Repo #{i}") for i in range(30)] + [("NATION 3", "Repo 7"), ("rep", "lone repo"), ("", "repo-11"), ("north", ""), ("nation", "read-nothing")]
    found = graph_search.mentions(spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(services, "alias string, source string"))
    assert not re.search("NestedLoop|Cartesian", plan_of(found))
    expected = set()
    for key, query in queries:
        plain = re.sub(r"\s+", " ", query).strip()
        own = sorted({s for a, s in services if s and routing.token_key(a) and (routing.stands_in(routing.token_key(a), routing.token_key(plain)) or routing.stands_in(a.lower(), plain.lower()))})
        whole = routing.token_key(" ".join([plain, *own]))
        expected |= {(key, routing.token_key(s)) for a, s in services if s for k in (routing.token_key(a), routing.token_key(s)) if k and k in whole}
    rows = found.collect()
    assert {(r.query_id, r.normalized) for r in rows if r.confidence == graph_search.SUBSTRING} == expected and len(rows) == len({(r.query_id, r.normalized, r.label) for r in rows})


def test_citations_are_put_in_order_by_one_sort(spark):
    n = 3000
    chunks = spark.range(n).selectExpr("'q' query_id", f"cast({n} - id as int) rank", "cast(id as string) chunk_id", "if(id % 2 = 0, null, concat('t', id)) document_title", "cast(null as string) url", "cast(id as double) score", "concat('x', id) text", "cast(null as string) source_code", "map('a', cast(id as string)) metadata")
    found = responses.citations(chunks)
    assert "element_at" not in plan_of(found)
    cited = found.first().citations
    assert [int(c.metadata["a"]) for c in cited] == list(range(n))[::-1]
    assert cited[0].asDict() == {"title": f"t{n - 1}", "url": "", "score": n - 1.0, "chunk_text": f"x{n - 1}", "source_code": "", "metadata": {"a": str(n - 1)}}
    some = responses.citations(chunks, ("title", "score"))
    assert [tuple(c) for c in some.first().citations] == [(c.title, c.score) for c in cited] and "concat(x" not in plan_of(some)


def test_a_large_repository_is_written_in_parts_and_every_one_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART", 2000, raising=False)
    rows = spark.createDataFrame([("shop", f"f{i}", "u", "2024-01-01", "", f"{i} " + "x" * 100) for i in range(200)] + [(f"small{i}", "f", None, None, None, "s") for i in range(9)], "repository string, file_path string, url string, last_modified string, source_code string, summary string")
    files.write_summaries(rows.coalesce(1), spark.createDataFrame([], "repository string, file_path string, error string"), f"{tmp_path}/all")
    written = spark.read.json(f"{tmp_path}/all/summaries")
    assert written.selectExpr("max(size(files))").first()[0] <= 60 and written.filter("repository LIKE 'small%'").count() == 9
    read = files.read_summaries(spark, str(tmp_path), name="summaries")
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_nearest_numbers_are_found_without_trying_every_pair(spark):
    numbers = [(i * 7919 % 1000, (i * i) % 97 if i % 50 else None) for i in range(1000)]
    items = spark.createDataFrame(numbers, "item_id long, n int")
    queries = [("a", 0), ("b", 50), ("c", 51), ("d", 96), ("e", 5000), ("f", -3), ("g", 13)]
    for k in (1, 7, 100):
        found = vector.nearest_numbers(items, spark.createDataFrame(queries, "query_id string, at long"), k)
        assert not re.search("NestedLoop|Cartesian", plan_of(found))
        got = {(r.query_id, r["rank"]): r.item_id for r in found.collect()}
        far = lambda n, at: 1 << 50 if n is None else abs(n - at)
        assert got == {(q, r + 1): x for q, at in queries for r, (x, _) in enumerate(sorted(numbers, key=lambda y: (far(y[1], at), y[0]))[:k])}
    few = vector.nearest_numbers(items.filter("item_id < 30"), spark.createDataFrame(queries, "query_id string, at long"), 100)
    assert few.count() == 30 * len(queries)


def test_a_task_of_vector_search_holds_few_scores(monkeypatch):
    rng = np.random.default_rng(7)
    items = np.round(rng.normal(size=(4000, 8)), 1)
    items[::400] = 0
    questions = vector._unit(np.round(rng.normal(size=(300, 8)), 1))
    labels = (np.arange(4000) % 3).tolist()
    batches = [pa.record_batch([pa.array(range(4000 - a - 500, 4000 - a)), pa.array(items[4000 - a - 500 : 4000 - a].tolist(), pa.list_(pa.float32())), pa.array(labels[4000 - a - 500 : 4000 - a])], ["item_id", "embedding", "label"]) for a in range(0, 4000, 500)]
    with np.errstate(invalid="ignore"):
        scores = np.round(vector._unit(items.astype(np.float32).astype(float)) @ questions.T, 3)
    monkeypatch.setattr(vector, "SCORES", 5000, raising=False)
    for by_label, floor in ((False, -np.inf), (True, 0.11)):
        expected = set()
        for q in range(300):
            for group in (0, 1, 2) if by_label else (None,):
                rows = [i for i in range(4000) if scores[i, q] >= floor and group in (None, labels[i])]
                expected |= {(q, i) for i in sorted(rows, key=lambda i: (-scores[i, q], i))[:5]}
        tracemalloc.start()
        out = list(vector._leaders(list(range(300)), questions, 5, floor, by_label, 3)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {(q, i) for b in out for q, i in zip(b["query_id"].to_pylist(), b["item_id"].to_pylist(), strict=True)} == expected
        assert peak < 1_500_000, peak


def test_a_stored_index_is_made_without_exchanging_postings(spark, tmp_path):
    rows = [(f"c{i}", f"d{i // 3}", f"Title {i % 5}", " ".join(f"w{(i * j) % 23}" for j in range(i % 40)) + " running the runs", f"s{i % 2}", "x") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, title string, text string, source string, retrieval_corpus string")
    asked = spark.createDataFrame([("a", "w1 w2 title"), ("b", "runs w5"), ("c", " ".join(f"w{i}" for i in range(60)))], "query_id string, query string")
    for english in (False, True):
        index = keyword.build(chunks, str(tmp_path / f"index-{english}"), english, 1000 if english else 100)
        stored = [pq.read_table(f) for f in sorted((tmp_path / f"index-{english}" / "postings").glob("*.parquet"))]
        assert len(stored) <= 3 and all(t["key"].to_pylist() == sorted(t["key"].to_pylist()) for t in stored)
        for match_all in (False, True):
            searches = [lambda x, all_=match_all: keyword.fts(x, asked, match_all=all_, in_english=english)] + ([] if english else [lambda x, all_=match_all: keyword.bm25(x, asked, match_all=all_)])
            for search in searches:
                found = search(index)
                assert "SortMergeJoin" not in plan_of(found) or match_all or english
                assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search(chunks).collect()))
        lengths = {r.chunk_id: r.dl for r in index.lengths.collect()}
        assert lengths == {r[0]: len((r[3] + " " + r[2]).split()) for r in rows}


def test_mentions_are_spelt_once_and_not_for_every_node(spark):
    nodes = spark.createDataFrame([(f"API::{i}", "API", f"My_Api.{i}", 1.0, i) for i in range(40)] + [("REPO::x", "REPO", "My_repo.", 0.5, 1)], "node_key string, label string, name string, confidence double, evidence_count int")
    found = spark.createDataFrame([("q", "my_api", "my-api", None, 0.58), ("q", "M.Y_repo", "my-repo", "REPO", 0.86), ("q", "none", "none", "API", 0.86)], "query_id string, text string, normalized string, label string, confidence double")
    matches = graph_search.seed_matches(nodes, found)
    pairs = [x for x in plan_of(matches).splitlines() if "NestedLoopJoin" in x]
    assert pairs and not any(re.search("translate|regexp_replace|lower", x) for x in pairs)
    rows = [(r.text, r.node_key, r.reason) for r in matches.collect()]
    assert sorted(r for r in rows if r[0] != "none")[:2] == [("M.Y_repo", "REPO::x", "REPO-direct"), ("my_api", "API::25", "ANY-label lookup")]
    assert len([r for r in rows if r[0] == "my_api"]) == 15 and {r[2] for r in rows if r[0] == "none"} == {"API-label-scan"}
