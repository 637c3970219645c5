"""Graph search for a table of queries, from their words to ranked chunks.

queries: query_id, query. services: alias, source. nodes: node_key, label,
name, confidence, evidence_count. edges: edge_key, subject_key, predicate,
object_key, and what `graph.with_stats` puts beside them. Everything is done
for all queries at once; what a query keeps is bounded by its budget (at most
25 seeds and 320 paths), never the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.operators import graph, phrases
from karstflow.session import written

# Labels, words and confidences.
SEEDABLE = ("KAFKA_TOPIC", "API", "REPO", "FRAMEWORK", "NUGET_PACKAGE", "HANDLER", "COMMAND", "EVENT", "SAGA")
LOCAL = ("HANDLER", "COMMAND", "EVENT", "SAGA", "FEATURE_FLAG", "BUSINESS_RULE", "STATUS_CODE", "TABLE")
GLOBAL = ("REPO", "KAFKA_TOPIC", "API", "NUGET_PACKAGE", "FRAMEWORK")
CODE = ("SAGA", "HANDLER", "COMMAND", "EVENT")
CROSS_SERVICE = ("across services", "which services", "cross service", "cross-service", "all services")
GENERIC = {"KAFKA_TOPIC": ("kafka", "topic", "topics")}
NAMED, PLAIN, ALIAS, SUBSTRING = 0.86, 0.58, 0.95, 0.96
MENTIONS, LOOKUP, SEEDS, EVIDENCE = 12, 15, 25, 5
#: Mentions up to which they are sent to every task; beyond, Spark chooses.
FEW = 10_000

_WORD = "[A-Za-z0-9][A-Za-z0-9_.-]*"


def _hints() -> dict[str, list[str]]:
    """Part of a label's name -> the labels that have it."""
    parts = {(part.lower(), label) for label in SEEDABLE for part in label.split("_") if len(part) > 2}
    return {part: sorted(label for p, label in parts if p == part) for part, _ in parts}


def _hint_map() -> Column:
    return F.create_map(*[x for part, labels in sorted(_hints().items()) for x in (F.lit(part), F.array(*map(F.lit, labels)))])


def _named_sources(queries: DataFrame, services: DataFrame) -> DataFrame:
    """(query_id, query, _s): the queries with blanks closed up, and the sources of aliases that they name, or null."""
    plain = queries.select("query_id", F.trim(F.regexp_replace("query", r"\s+", " ")).alias("query"))
    named = phrases.named(plain.select(F.col("query_id").alias("id"), F.col("query").alias("text")), services.select(F.col("alias").alias("phrase")))
    found = named.join(services.filter("source <> ''"), F.col("phrase") == F.col("alias")).groupBy(F.col("id").alias("query_id")).agg(F.sort_array(F.collect_set("source")).alias("_s"))
    return plain.join(found, "query_id", "left")


def with_sources(queries: DataFrame, services: DataFrame) -> DataFrame:
    """The queries with blanks closed up and, after them, the sources of aliases that they name."""
    return _with_sources(_named_sources(queries, services))


def _with_sources(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.concat_ws(" ", "query", F.array_join("_s", " ")).alias("query"))


def mentions(queries: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """(query_id, text, normalized, label, confidence): what the queries name.

    A word that is part of a label's name asks for that label, and so does its
    singular; other words ask for any. With services, a word that is an alias
    and an alias inside the query ask for the REPO of that name. Of repeats
    the surest stays. A query has at most 12 words.
    """
    named = written(_named_sources(queries, services), "named") if services is not None else None
    asked = queries if named is None else _with_sources(named)
    hints = _hint_map()
    forms = F.flatten(F.transform(F.regexp_extract_all("query", F.lit(_WORD), F.lit(0)), lambda t: _forms(T.token_key(t), hints)))
    telling = F.filter(forms, lambda n: (F.length(n) > 2) & ~n.isin(*T.STOPWORDS) & ~n.rlike("^[0-9]+$"))
    words = F.slice(F.array_distinct(telling), 1, MENTIONS)

    def as_mentions(n: Column) -> Column:
        labels = F.coalesce(F.element_at(hints, n), F.array(F.lit(None).cast("string")))
        return F.transform(labels, lambda x: F.struct(n.alias("text"), n.alias("normalized"), x.alias("label"), F.when(x.isNull(), PLAIN).otherwise(NAMED).alias("confidence")))

    out = asked.select("query_id", F.explode(F.flatten(F.transform(words, as_mentions))).alias("m")).select("query_id", "m.*")
    if services is not None:
        keys = services.filter("source <> ''").select(F.explode(F.array(T.token_key(F.col("alias")), T.token_key(F.col("source")))).alias("_k"), "source").filter("_k <> ''")
        one = keys.groupBy("_k").agg(F.max("source").alias("source"))
        exact = out.join(one, F.col("normalized") == F.col("_k")).select("query_id", "source", F.greatest("confidence", F.lit(ALIAS)).alias("confidence"))
        # The key of the whole is those of its parts, joined.
        parts = F.transform(F.concat(F.array("query"), F.coalesce("_s", F.array().cast("array<string>"))), T.token_key)
        texts = named.select(F.col("query_id").alias("id"), F.filter(parts, lambda x: x != "").alias("parts"))
        held = phrases.inside(texts, keys.select(F.col("_k").alias("string")))
        inside = held.join(keys, F.col("string") == F.col("_k")).select(F.col("id").alias("query_id"), "source", F.lit(SUBSTRING).alias("confidence"))
        repos = exact.unionByName(inside)
        out = out.unionByName(repos.select("query_id", F.trim("source").alias("text"), T.token_key(F.col("source")).alias("normalized"), F.lit("REPO").alias("label"), "confidence"))
    best = out.filter("normalized <> ''").groupBy("query_id", "normalized", "label").agg(F.max("confidence").alias("confidence"), F.max_by("text", F.struct("confidence", "text")).alias("text"))
    return best.select("query_id", "text", "normalized", "label", "confidence")


def _forms(word: Column, hints: Column) -> Column:
    singular = F.left(word, F.length(word) - 1)
    plural = word.endswith("s") & ~word.endswith("ss") & F.map_contains_key(hints, singular)
    return F.when(plural, F.array(word, singular)).otherwise(F.array(word))


def intent_of(labels: Column, otherwise: Column | str = "GENERAL") -> Column:
    """The intent that an array of labels speaks for; where they speak for both, `otherwise` if it decides."""
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    local, wide = (F.arrays_overlap(labels, F.array(*map(F.lit, x))) for x in (LOCAL, GLOBAL))
    both = F.when(other.isin("LOCAL_LOGIC", "TOPOLOGY"), other).otherwise("TOPOLOGY")
    return F.when(local & wide, both).when(local, "LOCAL_LOGIC").when(wide, "TOPOLOGY").otherwise(other)


def intents(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, intent) of every query by the labels of its mentions."""
    labels = found.groupBy("query_id").agg(F.collect_set("label").alias("_l"))
    return queries.select("query_id").join(labels, "query_id", "left").select("query_id", intent_of(F.coalesce("_l", F.array().cast("array<string>"))).alias("intent"))


def seed_matches(nodes: DataFrame, found: DataFrame, most: int = LOOKUP) -> DataFrame:
    """(query_id, text, normalized, label, node columns, score, reason): nodes that mentions lead to.

    A mention with a label finds nodes of that label by name, else all of the
    label; a term too general for its label finds none. A mention without a
    label finds any node by name or key. At most `most` of each, the surest
    first.
    """
    asked = found.select("text", "normalized", "label").distinct()
    for label, words in GENERIC.items():
        asked = asked.filter(~((F.coalesce("label", F.lit("")) == label) & F.col("normalized").isin(*words)))

    def flat(x: Column) -> Column:
        return F.translate(F.lower(x), "_.", "-")

    asked = asked.withColumns({"_any": ~F.coalesce(F.col("label").isin(*SEEDABLE), F.lit(False)), "_w": flat(F.col("text"))})
    if asked.limit(FEW + 1).count() <= FEW:
        # Made once, so that no pair of a node and a mention does it again.
        asked = F.broadcast(written(asked, "asked"))
    named = nodes.withColumnRenamed("label", "node_label").withColumn("_n", flat(F.col("name"))).withColumn("_k", flat(F.col("node_key")))
    hit = named.join(asked, (F.col("_any") & (F.contains("_n", "_w") | F.contains("_k", "_w"))) | (~F.col("_any") & (F.col("node_label") == F.col("label")) & F.contains("_n", "_w")))
    direct = hit.withColumn("reason", F.when(F.col("_any"), "ANY-label lookup").otherwise(F.concat("label", F.lit("-direct"))))
    key = ["text", "normalized", "label"]
    missed = asked.filter(~F.col("_any")).join(hit.filter(~F.col("_any")).select("text", "label").distinct(), ["text", "label"], "left_anti")
    scanned = named.join(missed, F.col("node_label") == F.col("label")).withColumn("reason", F.concat("label", F.lit("-label-scan")))
    w = W.partitionBy(*key).orderBy(F.col("confidence").desc(), F.col("evidence_count").desc(), "node_key")
    every = direct.unionByName(scanned.select(direct.columns)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    every = every.select(*[F.col(k).alias(f"_{k}") for k in key], "node_key", "node_label", "name", "evidence_count", F.col("confidence").alias("_c"), "reason")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return found.join(every, on[0] & on[1] & on[2]).select("query_id", *key, "node_key", "node_label", "name", "evidence_count", (F.col("confidence") * F.col("_c")).alias("score"), "reason")


def select_seeds(matches: DataFrame, most: int = SEEDS) -> DataFrame:
    """The matches that a query starts from, in order (`place`): each node once, mentions by turns, those with a label first."""
    first = W.partitionBy("query_id", "node_key").orderBy(F.col("score").desc(), F.coalesce("label", F.lit("")), "normalized")
    own = matches.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    group = W.partitionBy("query_id", "normalized", "label")
    turns = own.withColumns({
        "_turn": F.row_number().over(group.orderBy(F.col("score").desc(), F.col("evidence_count").desc(), "node_key")),
        "_best": F.max("score").over(group),
        "_size": F.count(F.lit(1)).over(group),
    })
    order = W.partitionBy("query_id").orderBy(F.col("label").isNull(), "_turn", F.col("_best").desc(), F.col("_size").desc(), "normalized", F.coalesce("label", F.lit("")))
    return turns.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("_turn", "_best", "_size")


def scopes(queries: DataFrame, found: DataFrame, seeds: DataFrame, sources: list[str] = ()) -> DataFrame:
    """(query_id, scope, sources): GLOBAL without sources, SERVICE_SCOPED with one, else TARGETED_MULTI_SERVICE.

    Given sources go first. A query for all services is GLOBAL; else the REPOs
    that it mentions count, else those that a mention found by name.
    """
    said = found.filter("label = 'REPO' AND trim(text) <> ''").groupBy("query_id").agg(F.sort_array(F.collect_set(F.trim("text"))).alias("_said"))
    met = seeds.filter("reason = 'REPO-direct' AND name <> ''").groupBy("query_id").agg(F.sort_array(F.collect_set("name")).alias("_met"))
    wide = F.lit(False)
    for x in CROSS_SERVICE:
        wide = wide | F.contains(F.lower("query"), F.lit(x))
    none = F.array().cast("array<string>")
    given = sorted({s for s in sources if s})
    own = F.array(*map(F.lit, given)) if given else F.when(wide, none).otherwise(F.coalesce("_said", "_met", none))
    rows = queries.join(said, "query_id", "left").join(met, "query_id", "left").withColumn("sources", own)
    scope = F.when(F.size("sources") == 0, "GLOBAL").when(F.size("sources") == 1, "SERVICE_SCOPED").otherwise("TARGETED_MULTI_SERVICE")
    return rows.select("query_id", scope.alias("scope"), "sources")


def _budget(name: str) -> Column:
    out = F.lit(None).cast("int")
    for intent, budget in graph.BUDGETS.items():
        out = F.when(F.col("intent") == intent, getattr(budget, name)).otherwise(out)
    return out


def expand(edges: DataFrame, seeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges that each query's walk takes, with their hop.

    seeds: query_id, node_key. wanted: query_id, intent. A hop takes the surest
    edges at its frontier, at most ten or what its nodes and the paths left
    allow; the next frontier is the ends not yet visited.
    """
    plan = wanted.select("query_id", "intent", *[_budget(x).alias(f"_{x}") for x in ("hops", "edges_per_node", "paths")])
    frontier = written(seeds.select("query_id", "node_key").distinct(), "frontier")
    visited, found = frontier, None
    allowed = F.col("intent") == "GENERAL"
    for intent, predicates in graph.PREDICATES.items():
        allowed = allowed | ((F.col("intent") == intent) & F.col("predicate").isin(*predicates))
    order = W.partitionBy("query_id").orderBy(F.col("confidence").desc(), "subject_key", "object_key", "edge_key")
    columns = ["query_id", *edges.columns, "hop"]
    for hop in range(1, max(b.hops for b in graph.BUDGETS.values()) + 1):
        size = frontier.groupBy("query_id").agg(F.count(F.lit(1)).alias("_size")).join(plan, "query_id").filter(F.col("_hops") >= hop)
        if found is not None:
            size = size.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_found")), "query_id", "left")
        left = F.col("_paths") - (F.coalesce("_found", F.lit(0)) if found is not None else 0)
        size = size.withColumn("_left", left).filter("_left > 0")
        at = frontier.join(size.select("query_id", "intent", "_size", "_edges_per_node", "_left"), "query_id")
        ends = [edges.join(at.withColumnRenamed("node_key", end), end).filter(allowed).select("query_id", *edges.columns, "_size", "_edges_per_node", "_left", F.lit(end == "subject_key").alias("_s"), F.lit(end == "object_key").alias("_o")) for end in ("subject_key", "object_key")]
        near = ends[0].unionByName(ends[1])
        near = near.groupBy("query_id", *edges.columns, "_size", "_edges_per_node", "_left").agg(F.bool_or("_s").alias("_s"), F.bool_or("_o").alias("_o"))
        most = F.greatest(F.lit(10), F.least(F.col("_left"), F.col("_size") * F.col("_edges_per_node")))
        taken = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
        if found is not None:
            taken = taken.join(found.select("query_id", "edge_key"), ["query_id", "edge_key"], "left_anti")
        taken = written(taken.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_left")).withColumn("hop", F.lit(hop)), "hop")
        found = taken.select(columns) if found is None else found.unionByName(taken.select(columns))
        reached = F.array_compact(F.array(F.when(F.col("_s"), F.col("object_key")), F.when(F.col("_o"), F.col("subject_key"))))
        fresh = taken.select("query_id", F.explode(reached).alias("node_key")).distinct().join(visited, ["query_id", "node_key"], "left_anti")
        frontier = written(fresh, "frontier")
        visited = visited.unionByName(frontier)
    return found


def prune(paths: DataFrame, seeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """The paths that fit each query's budget, with their `place` among them.

    The caps depend on what was taken before, so a query's rows, at most 320,
    are walked in one group.
    """
    plan = wanted.join(seeds.groupBy("query_id").agg(F.collect_set("node_key").alias("_seeds")), "query_id")
    both = paths.join(plan.select("query_id", "intent", "_seeds"), "query_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema) + ", place int"

    def walk(rows):
        budget = graph.BUDGETS[rows["intent"].iloc[0]]
        places = graph.within_budget(list(zip(rows["hop"], rows["confidence"], rows["subject_key"], rows["object_key"], rows["edge_key"])), rows["_seeds"].iloc[0], budget)
        return rows.iloc[places].drop(columns=["intent", "_seeds"]).assign(place=range(1, len(places) + 1))

    return both.groupBy("query_id").applyInPandas(walk, schema)


def diagnostics(queries: DataFrame, wanted: DataFrame, seeds: DataFrame, kept: DataFrame) -> DataFrame:
    """What each walk did: intent, hops, paths of each hop, nodes with the seeds, all paths and why it stopped."""
    ends = kept.select("query_id", F.explode(F.array("subject_key", "object_key")).alias("node_key")).unionByName(seeds.select("query_id", "node_key"))
    nodes = ends.groupBy("query_id").agg(F.countDistinct("node_key").alias("nodes"))
    hops = kept.groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("hop", "n"))).alias("_h"))
    rows = queries.select("query_id").join(wanted, "query_id").join(nodes, "query_id", "left").join(hops, "query_id", "left")
    last = F.coalesce(F.element_at("_h", -1)["hop"], F.lit(0))
    paths = F.aggregate(F.coalesce("_h", F.array().cast("array<struct<hop:int,n:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    reason = F.when(paths == 0, "no_paths_found").when(paths >= _budget("paths"), "path_budget_reached").when(last >= _budget("hops"), "hop_limit_reached").otherwise("budget_complete")
    return rows.select("query_id", "intent", last.alias("hops"), F.transform("_h", lambda x: x["n"]).alias("paths_by_hop"), F.coalesce("nodes", F.lit(0)).alias("nodes"), paths.alias("paths"), reason.alias("stop_reason"))


def candidate_keys(seeds: DataFrame, kept: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, node_key): seeds and the ends of kept paths, in order, until the budget of nodes is reached."""
    own = seeds.select("query_id", "node_key").distinct()
    ends = kept.select("query_id", "place", F.explode(F.array("subject_key", "object_key")).alias("node_key"))
    first = ends.groupBy("query_id", "node_key").agg(F.min("place").alias("place")).join(own, ["query_id", "node_key"], "left_anti")
    n = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).join(wanted, "query_id").select("query_id", "_n", _budget("nodes").alias("_most"))
    # Every path counts, also one that brings no node.
    steps = kept.select("query_id", "place").join(first.groupBy("query_id", "place").agg(F.count(F.lit(1)).alias("_new")), ["query_id", "place"], "left").join(n, "query_id")
    so_far = F.col("_n") + F.sum(F.coalesce("_new", F.lit(0))).over(W.partitionBy("query_id").orderBy("place"))
    full = steps.withColumn("_so", so_far).filter("_so >= _most").groupBy("query_id").agg(F.min("place").alias("_last"))
    return own.unionByName(first.join(full, "query_id", "left").filter("_last IS NULL OR place <= _last").select("query_id", "node_key"))


def resolve_evidence(keys: DataFrame, evidence: DataFrame, chunks: DataFrame, metadata: DataFrame, corpus: str, most: int = EVIDENCE) -> DataFrame:
    """The chunks of a corpus that the evidence of nodes lies in, at most five rows a node.

    keys: node_key. evidence: node_key, node_label, node_name, tier,
    source_kind, line_start, line_end, document_id, chunk_id, confidence,
    observed_at, evidence_hash. chunks: chunk_id, document_id, document_title,
    retrieval_corpus, text, source_code, source. metadata: document_id,
    retrieval_corpus, name, url. Evidence without a chunk stands for the first
    chunk of its document.
    """
    own = evidence.filter("document_id IS NOT NULL").join(keys.select("node_key").distinct(), "node_key", "left_semi")
    stats = own.groupBy("node_key").agg(F.max("confidence").alias("max_confidence"), F.count(F.lit(1)).cast("int").alias("evidence_count"), F.sort_array(F.collect_set("source_kind")).alias("source_kinds"), F.sort_array(F.collect_set("tier")).alias("tiers"))
    best = graph.best_evidence(own, "node_key", most, graph.kind_priority(F.col("source_kind")), F.col("confidence").desc(), F.col("observed_at").desc(), F.col("evidence_hash"))
    inside = chunks.filter(F.col("retrieval_corpus") == corpus)
    first = graph.representative_chunks(inside).select(F.col("document_id").alias("_d"), F.col("chunk_id").alias("_first"))
    placed = best.join(first, F.col("document_id") == F.col("_d"), "left").withColumn("resolved_chunk_id", F.coalesce("chunk_id", "_first"))
    placed = placed.select("node_key", "node_label", "node_name", "evidence_rank", (F.col("line_start").isNotNull() & F.col("line_end").isNotNull()).alias("has_line_bounds"), "resolved_chunk_id")
    named = metadata.filter(F.col("retrieval_corpus") == corpus).select("document_id", F.col("name").alias("_name"), "url")
    wide = inside.withColumnRenamed("chunk_id", "resolved_chunk_id").join(named, "document_id", "left")
    rows = placed.join(wide, "resolved_chunk_id").join(stats, "node_key")
    return rows.select("node_key", "node_label", "node_name", "evidence_rank", "max_confidence", "evidence_count", "source_kinds", "tiers", "has_line_bounds", "resolved_chunk_id", "text", F.coalesce("source_code", F.lit("")).alias("source_code"), "document_id", F.coalesce("_name", "document_title", "node_name").alias("document_title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("source", F.lit("")).alias("source"))


def candidates(keys: DataFrame, resolved: DataFrame, scope: DataFrame, wanted: DataFrame, found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Resolved chunks beside the queries whose keys they hold, inside the query's sources.

    Sources are compared in lower case. A query for local logic that names a
    kind of code symbol, and has seeds of it, keeps nodes of that kind only.
    """
    rows = keys.join(resolved, "node_key").join(scope.select("query_id", F.transform("sources", F.lower).alias("_s")), "query_id").join(wanted, "query_id")
    rows = rows.filter((F.size("_s") == 0) | F.array_contains("_s", F.lower("source")))
    hinted = found.filter(F.col("label").isin(*CODE)).select("query_id", F.col("label").alias("x")).distinct()
    seeded = seeds.filter(F.col("node_label").isin(*CODE)).select("query_id", F.col("node_label").alias("x")).distinct()
    focus = hinted.join(seeded, ["query_id", "x"], "left_semi").groupBy("query_id").agg(F.collect_set("x").alias("_f"))
    rows = rows.join(focus, "query_id", "left")
    return rows.filter((F.col("intent") != "LOCAL_LOGIC") | F.col("_f").isNull() | F.array_contains("_f", F.col("node_label"))).drop("_s", "_f", "intent")


def path_components(kept: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, node_key, path): the best score of the paths that end at a node, either end.

    A path is as sure as its edge, or as the seed that is its subject.
    """
    scores = seeds.select("query_id", F.col("node_key").alias("subject_key"), F.col("score").alias("_seed"))
    rows = kept.join(scores, ["query_id", "subject_key"], "left")
    sure = F.greatest("confidence", F.coalesce("_seed", F.lit(0.0)))
    lines = F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    scored = rows.withColumn("path", graph.path_score(sure, F.col("hop"), F.lit(1), lines))
    return scored.select("query_id", F.explode(F.array("subject_key", "object_key")).alias("node_key"), "path").groupBy("query_id", "node_key").agg(F.max("path").alias("path"))


def rank(rows: DataFrame, paths: DataFrame, queries: DataFrame, places: int = 10) -> DataFrame:
    """The chunks of each query with score and rank: each chunk once, by its best candidate.

    The score is the best path to the node, or its own confidence, times the
    bonus of its evidence, times its relevance to the query's terms.
    """
    terms = queries.select("query_id", T.query_terms(F.col("query")).alias("_terms"))
    both = rows.join(paths, ["query_id", "node_key"], "left").join(terms, "query_id")
    blob = F.lower(F.concat_ws(" ", "node_name", "document_title", F.left("text", F.lit(800))))
    score = F.coalesce("path", "max_confidence") * graph.provenance_bonus(F.col("evidence_count"), F.col("has_line_bounds")) * graph.relevance(blob, F.col("node_name"), F.col("_terms"))
    scored = both.withColumn("score", F.round(score, places)).drop("_terms", "path")
    once = W.partitionBy("query_id", "resolved_chunk_id").orderBy(F.col("score").desc(), "node_key", "evidence_rank")
    best = scored.withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id", "resolved_chunk_id")
    return best.withColumn("rank", F.row_number().over(order))


def pool(k: int, intent: Column, scope: Column) -> Column:
    """Ranked chunks that a query keeps before diversity."""
    return F.when((intent == "TOPOLOGY") & (scope == "GLOBAL"), min(200, max(6 * k, k))).otherwise(max(k, 0))


def diverse_services(ranked: DataFrame, k: int) -> DataFrame:
    """The best chunk of each part of a system, at most k; only those under src where there are any."""
    if k <= 1:
        return ranked
    rows = ranked.withColumn("_b", T.service_bucket(F.col("document_title")))
    rows = rows.withColumn("_src", F.col("_b").startswith("src:")).withColumn("_any", F.max("_src").over(W.partitionBy("query_id"))).filter("_src OR NOT _any")
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_b").orderBy("rank"))).filter("_r = 1")
    again = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return again.filter(F.col("rank") <= k).drop("_b", "_src", "_any", "_r")


# Facts by predicate, without a walk


def known_repositories(metadata: DataFrame) -> DataFrame:
    """(source) of every repository that has a document."""
    return metadata.select("source").distinct()


def representative_documents(metadata: DataFrame, chunks: DataFrame, sources: list[str], corpus: str) -> DataFrame:
    """(source_repo, source_path, document_id, chunk_id): of each source its first document by name that has a chunk.

    Documents without a name come last. Name, title, id: the first there is.
    """
    own = metadata.filter((F.col("retrieval_corpus") == corpus) & F.col("source").isin(list(sources)))
    inside = chunks.filter(F.col("retrieval_corpus") == corpus)
    first = graph.representative_chunks(inside).join(inside.select("chunk_id", "document_title"), "chunk_id")
    rows = own.join(first, "document_id").select("source", F.coalesce("name", "document_title", "document_id").alias("source_path"), "document_id", "chunk_id", F.col("name").isNull().alias("_last"), F.col("name").alias("_name"))
    return graph.best_of_each(rows, "source", ["_last", "_name", "document_id"], "source_path", "document_id", "chunk_id").withColumnRenamed("source", "source_repo")


def _facts(evidence: DataFrame, predicate: str, objects: list[str] | None, repos: list[str] | None) -> DataFrame:
    rows = evidence.filter(F.col("predicate") == predicate)
    rows = rows if objects is None else rows.filter(F.col("object_key").isin(list(objects)))
    return rows if repos is None else rows.filter(F.col("source_repo").isin(list(repos)))


def fact_pairs(evidence: DataFrame, predicate: str, objects: list[str] | None = None, repos: list[str] | None = None) -> DataFrame:
    """(source_repo, object_key, object_name) that evidence of a predicate states; no list is no restriction."""
    return _facts(evidence, predicate, objects, repos).select("source_repo", "object_key", "object_name").distinct()


def fact_rows(evidence: DataFrame, chunks: DataFrame, predicate: str, corpus: str, objects: list[str] | None = None, repos: list[str] | None = None) -> DataFrame:
    """The surest evidence of a predicate in each file, with the chunk of the corpus that it lies in, or its document's first."""
    rows = _facts(evidence, predicate, objects, repos).withColumn("_file", F.struct("source_repo", "source_path")).withColumn("_less", -F.col("confidence"))
    best = graph.best_of_each(rows, "_file", ["_less", "object_key", "evidence_hash"], "object_name", "confidence", "document_id", "chunk_id")
    inside = chunks.filter(F.col("retrieval_corpus") == corpus)
    first = graph.representative_chunks(inside).select(F.col("document_id").alias("_d"), F.col("chunk_id").alias("_first"))
    placed = best.join(first, F.col("document_id") == F.col("_d"), "left").withColumn("resolved_chunk_id", F.coalesce("chunk_id", "_first")).drop("document_id", "chunk_id")
    wide = inside.withColumnRenamed("chunk_id", "resolved_chunk_id")
    return placed.join(wide, "resolved_chunk_id").select("_file.source_repo", "_file.source_path", "object_name", "confidence", "resolved_chunk_id", "document_id", "text", F.coalesce("source", F.lit("")).alias("source"))


@dataclass(frozen=True)
class Graph:
    """The tables of a graph and of what its evidence lies in."""

    nodes: DataFrame
    edges: DataFrame
    edge_evidence: DataFrame
    node_evidence: DataFrame
    chunks: DataFrame
    metadata: DataFrame


def search(queries: DataFrame, tables: Graph, services: DataFrame | None = None, k: int = 5, sources: list[str] = (), corpus: str = "summaries", per_document: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked chunks, diagnostics) of a table of queries.

    Queries without a mention, a seed or evidence have no chunks.
    """
    found = written(mentions(queries, services), "mentions")
    nodes = graph.node_stats(tables.nodes, tables.node_evidence)
    seeds = written(select_seeds(seed_matches(nodes, found)), "seeds")
    scope = scopes(queries, found, seeds, list(sources))
    labels = seeds.groupBy("query_id").agg(F.collect_set("node_label").alias("_l"))
    wanted = intents(queries, found).join(labels, "query_id", "left")
    wanted = written(wanted.select("query_id", intent_of(F.coalesce("_l", F.array().cast("array<string>")), F.col("intent")).alias("intent")), "intents")
    edges = written(graph.with_stats(tables.edges, tables.edge_evidence), "edges")  # read by every hop from both ends
    kept = written(prune(expand(edges, seeds, wanted), seeds, wanted), "paths")
    keys = written(candidate_keys(seeds, kept, wanted), "keys")
    resolved = resolve_evidence(keys, tables.node_evidence, tables.chunks, tables.metadata, corpus)
    ranked = rank(candidates(keys, resolved, scope, wanted, found, seeds), path_components(kept, seeds), queries)
    ranked = ranked.join(scope.select("query_id", "scope"), "query_id").join(wanted, "query_id")
    ranked = ranked.filter(F.col("rank") <= pool(k, F.col("intent"), F.col("scope")))
    wide = (F.col("intent") == "TOPOLOGY") & (F.col("scope") == "GLOBAL")
    ranked = written(ranked, "ranked")
    ranked = diverse_services(ranked.filter(wide), k).unionByName(ranked.filter(~wide))
    if per_document is not None:
        w = W.partitionBy("query_id", "document_id").orderBy("rank")
        ranked = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_document).drop("_r")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return ranked, diagnostics(queries, wanted, seeds, kept)
