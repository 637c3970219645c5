"""A property graph with evidence, as plain tables.

nodes (node_key, label, name); edges (edge_key, subject_key, predicate,
object_key); node evidence and edge evidence, many rows for each, with
provenance and confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The graph's vocabulary.
LABELS = ("REPO", "FRAMEWORK", "NUGET_PACKAGE", "HANDLER", "COMMAND", "EVENT", "BUSINESS_RULE", "STATUS_CODE", "SAGA", "FEATURE_FLAG", "TABLE", "KAFKA_TOPIC", "API")
LOCAL_LABELS = ("HANDLER", "COMMAND", "EVENT", "SAGA", "FEATURE_FLAG", "TABLE", "BUSINESS_RULE")
LOCAL_PREDICATES = ("OWNS_HANDLER", "OWNS_COMMAND", "OWNS_EVENT", "OWNS_SAGA", "HANDLES_COMMAND", "HANDLES_EVENT", "EMITS_EVENT", "SAGA_ORCHESTRATES_COMMAND", "SAGA_AWAITS_EVENT", "READS_TABLE", "WRITES_TABLE", "ENFORCES_RULE", "USES_FEATURE_FLAG", "TRANSITIONS_STATUS")
GLOBAL_PREDICATES = ("CONTAINS_PACKAGE", "TARGETS_FRAMEWORK", "CONSUMES_TOPIC", "PRODUCES_TOPIC", "CALLS_API", "EXPOSES_API")
#: The predicates that a walk of an intent follows; an intent that isn't listed follows all.
PREDICATES = {"TOPOLOGY": GLOBAL_PREDICATES, "LOCAL_LOGIC": LOCAL_PREDICATES}
#: All predicates an edge may have.
EDGE_PREDICATES = (*LOCAL_PREDICATES, *GLOBAL_PREDICATES, "OWNS_TABLE")
KIND_PRIORITY = ("asyncapi", "configmap", "appsettings_prod", "appsettings_base", "contract", "ingress", "ast")


def node_key(label: Column, name: Column, repo: Column) -> Column:
    return F.when(label.isin(*LOCAL_LABELS), F.concat_ws("::", label, repo, name)).otherwise(F.concat_ws("::", label, name))


def edge_key(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws("::", subject, predicate, object_)


def evidence_hash(*columns: str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted keys; nulls stay in."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def canonical(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, edge evidence) of triples.

    triples: subject, subject_label, predicate, object, object_label, repo,
    path, kind, confidence. Unknown labels and predicates and empty names go; repeats count once.
    """
    good = triples.filter(F.col("predicate").isin(*EDGE_PREDICATES) & F.col("subject_label").isin(*LABELS) & F.col("object_label").isin(*LABELS) & (F.trim("subject") != "") & (F.trim("object") != "") & (F.col("confidence") > 0))
    keyed = good.withColumn("subject_key", node_key(F.col("subject_label"), F.col("subject"), F.col("repo"))).withColumn("object_key", node_key(F.col("object_label"), F.col("object"), F.col("repo")))
    keyed = keyed.withColumn("edge_key", edge_key(F.col("subject_key"), F.col("predicate"), F.col("object_key")))
    ends = keyed.select(F.explode(F.array(F.struct(F.col("subject_key").alias("node_key"), F.col("subject_label").alias("label"), F.col("subject").alias("name")), F.struct(F.col("object_key").alias("node_key"), F.col("object_label").alias("label"), F.col("object").alias("name")))).alias("n")).select("n.*")
    # Local labels hold the repository in their key, others may be spelt differently: the least name is kept.
    nodes = ends.groupBy("node_key").agg(F.min("label").alias("label"), F.min("name").alias("name"))
    edges = keyed.select("edge_key", "subject_key", "predicate", "object_key").dropDuplicates(["edge_key"])
    evidence = keyed.withColumn("evidence_hash", evidence_hash("edge_key", "repo", "path", "kind", "confidence")).dropDuplicates(["edge_key", "evidence_hash"])
    return nodes, edges, evidence


def with_repositories(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """The nodes and a REPO node for every repository (repo), also one without a triple."""
    own = repos.select(F.trim("repo").alias("name")).filter("name <> ''").distinct()
    rows = own.select(node_key(F.lit("REPO"), F.col("name"), F.col("name")).alias("node_key"), F.lit("REPO").alias("label"), "name")
    return nodes.select("node_key", "label", "name").unionByName(rows.join(nodes.select("node_key"), "node_key", "left_anti"))


def node_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence of nodes from that of edges: both ends of each, the last written of equals.

    evidence: the third table of `canonical`, with observed_at.
    """
    ends = [F.struct(F.col(f"{e}_key").alias("node_key"), F.col(f"{e}_label").alias("node_label"), F.col(e).alias("node_name")) for e in ("subject", "object")]
    rows = evidence.select(F.explode(F.array(*ends)).alias("n"), "repo", "path", "kind", "confidence", "observed_at").select("n.*", "repo", "path", "kind", "confidence", "observed_at")
    rows = rows.withColumn("evidence_hash", evidence_hash("node_key", "repo", "path", "kind"))
    best = rows.groupBy("node_key", "evidence_hash").agg(F.max_by(F.struct("node_label", "node_name", "repo", "path", "kind", "confidence", "observed_at"), F.struct("observed_at", "confidence", "node_name")).alias("x"))
    return best.select("node_key", "evidence_hash", "x.*")


def edge_stats(evidence: DataFrame, *ties: str) -> DataFrame:
    """For each edge its greatest confidence and the other columns of the evidence that has it; `ties` order equals.

    Of tier, source_kind, line_start and line_end those are given that the evidence has.
    """
    top = F.struct("confidence", *ties)
    best = [F.max_by(c, top).alias(c) for c in ("tier", "source_kind", "line_start", "line_end") if c in evidence.columns]
    return evidence.groupBy("edge_key").agg(F.max("confidence").alias("confidence"), *best, F.count(F.lit(1)).alias("evidence_count"))


def with_stats(edges: DataFrame, evidence: DataFrame, *ties: str) -> DataFrame:
    """Every edge with confidence, tier, source_kind, line_start and line_end; one without evidence has 1.0 and defaults."""
    both = edges.join(edge_stats(evidence, *ties), "edge_key", "left")
    return both.select(*edges.columns, F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("tier", F.lit("CONTRACT_GLOBAL")).alias("tier"), F.coalesce("source_kind", F.lit("unknown")).alias("source_kind"), "line_start", "line_end")


def representative_chunks(chunks: DataFrame, *by: str) -> DataFrame:
    """The first chunk_id of each document, or of each group of `by`."""
    by = by or ("document_id",)
    return chunks.groupBy(*by).agg(F.min("chunk_id").alias("chunk_id"))


def best_of_each(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Of each key the columns of its least row by `order`; one aggregate that combines before its exchange."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_x"))
    return best.select(key, "_x.*")


def nodes_of(nodes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """All nodes, or those of the labels."""
    return nodes.filter(F.col("label").isin(list(labels))) if labels else nodes


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """How many rows each label has."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def node_stats(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every node with its greatest confidence (1.0 without evidence), evidence count and kinds in order."""
    s = evidence.groupBy("node_key").agg(F.max("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set("source_kind")).alias("_k"))
    both = nodes.join(s, "node_key", "left")
    return both.select(*nodes.columns, F.coalesce("_c", F.lit(1.0)).alias("confidence"), F.coalesce("_n", F.lit(0)).alias("evidence_count"), F.coalesce("_k", F.array().cast("array<string>")).alias("source_kinds"))


def kind_priority(kind: Column) -> Column:
    out = F.lit(len(KIND_PRIORITY))
    for i, k in reversed(list(enumerate(KIND_PRIORITY))):
        out = F.when(kind == k, F.lit(i)).otherwise(out)
    return out


def best_evidence(evidence: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The first rows of each key's evidence."""
    return evidence.withColumn("evidence_rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("evidence_rank") <= most)


def stale(keys: DataFrame, *evidence: tuple[DataFrame, str], key: str) -> DataFrame:
    """Keys without any evidence left."""
    for rows, column in evidence:
        keys = keys.join(rows.select(F.col(column).alias(key)), key, "left_anti")
    return keys


def replace_source(node_evidence: DataFrame, edge_evidence: DataFrame, edges: DataFrame, nodes: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, repo: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables after a file's evidence is replaced.

    Edges that lose all evidence go; nodes go that have neither evidence of
    their own nor an edge's.
    """

    def without(x: DataFrame) -> DataFrame:
        return x.filter(~((F.col("source_repo") == repo) & (F.col("source_path") == path)))

    ne, ee = without(node_evidence).unionByName(new_nodes), without(edge_evidence).unionByName(new_edges)
    kept_edges = edges.join(ee.select("edge_key").distinct(), "edge_key", "left_semi")
    used = ne.select("node_key").union(ee.select("subject_key")).union(ee.select("object_key")).distinct()
    return ne, ee, kept_edges, nodes.join(used, "node_key", "left_semi")


def neighbours(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges at a frontier (query_id, node_key), with the end reached; an edge inside the frontier comes once."""
    out = edges.join(frontier.withColumnRenamed("node_key", "subject_key"), "subject_key").withColumn("reached", F.col("object_key"))
    back = edges.join(frontier.withColumnRenamed("node_key", "object_key"), "object_key").withColumn("reached", F.col("subject_key"))
    return out.unionByName(back).dropDuplicates(["query_id", "edge_key"])


@dataclass(frozen=True)
class Budget:
    hops: int
    nodes_per_hop: int
    edges_per_node: int
    paths: int
    nodes: int


BUDGETS = {"TOPOLOGY": Budget(2, 60, 8, 320, 320), "LOCAL_LOGIC": Budget(3, 34, 5, 220, 220), "GENERAL": Budget(2, 48, 6, 240, 240)}


def within_budget(paths: list[tuple], seeds, budget: Budget) -> list[int]:
    """Places of the paths that fit a budget, taken greedily.

    paths: (hop, confidence, subject, object, edge), at most budget.paths of
    them. Order: hop, confidence downwards, keys. A subject has a cap of paths,
    a hop a cap of nodes (whether or not they are known from before), and once
    there are as many nodes as the budget allows, the seeds among them, no path
    may bring another.
    """
    order = sorted(range(len(paths)), key=lambda i: (paths[i][0], -paths[i][1], *paths[i][2:]))
    nodes, taken = set(seeds), []
    of_subject: dict[str, int] = {}
    of_hop: dict[int, set[str]] = {}
    for i in order:
        hop, _, subject, object_ = paths[i][:4]
        ends, at = {subject, object_}, of_hop.setdefault(hop, set())
        fits = (
            len(taken) < budget.paths and 0 < hop <= budget.hops and subject and object_ and of_subject.get(subject, 0) < budget.edges_per_node
            and (ends <= nodes or len(nodes) < budget.nodes) and (ends <= at or len(at) + len(ends - at) + (subject == object_ and subject not in at) <= budget.nodes_per_hop)
        )
        if fits:
            taken.append(i)
            nodes |= ends
            at |= ends
            of_subject[subject] = of_subject.get(subject, 0) + 1
    return taken


def path_score(confidence: Column, hop: Column, evidence: Column, has_lines: Column, weight: float = 1.0) -> Column:
    """Confidence, less for each hop beyond the first, more for evidence and known lines."""
    return confidence * weight * F.exp(-0.35 * (F.greatest(hop, F.lit(1)) - 1)) * provenance_bonus(evidence, has_lines)


def provenance_bonus(evidence: Column, has_lines: Column) -> Column:
    """Up to 1.3: a twentieth for each of the first five pieces of evidence, and another for known lines."""
    return F.least(F.lit(1.3), 1 + F.least(evidence, F.lit(5)) / 20 + F.when(has_lines, 0.05).otherwise(0.0))


def relevance(blob: Column, name: Column, terms: Column) -> Column:
    """1 plus 0.3 times the share of terms found in a text, plus 0.2 if a node's name is one of them."""
    share = F.size(F.filter(terms, lambda t: F.contains(blob, t))) / F.greatest(F.size(terms), F.lit(1))
    return 1 + 0.3 * share + F.when(F.size(terms) == 0, 0.0).when(F.array_contains(terms, F.lower(name)), 0.2).otherwise(0.0)
