"""Readers and writers of the engine's files."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.session import written

SUMMARIES = "repository string, files array<struct<file_path:string,url:string,last_modified:string,source_code:string,summary:string>>"


def read_summaries(spark: SparkSession, folder: str, services: list[str] | None = None, name: str = "summaries.json") -> DataFrame:
    """One row for each file of `<folder>/*/<name>`; a blank repository is an error."""
    raw = spark.read.schema(SUMMARIES).json(f"{folder}/*/{name}", multiLine=True)
    named = F.when(F.length(F.trim(F.coalesce("repository", F.lit("")))) > 0, F.trim("repository")).otherwise(F.raise_error(F.lit("a summary file without a repository")))
    rows = raw.select(named.alias("repository"), F.explode("files").alias("f")).select("repository", "f.*")
    return rows.filter(F.col("repository").isin(services)) if services else rows


def extraction_priority(path: Column) -> Column:
    """The order in which files are read for the graph."""
    p = F.lower(path)
    tests = [F.contains(p, F.lit("asyncapi")), F.contains(p, F.lit("schema_state_")), F.contains(p, F.lit("configmap")), p.endswith(".cs"), F.contains(p, F.lit("appsettings.prod")), F.contains(p, F.lit("appsettings")), F.contains(p, F.lit("ingress"))]
    out = F.lit(10)
    for i, t in reversed(list(enumerate(tests))):
        out = F.when(t, F.lit(i)).otherwise(out)
    return out


def wanted_files(files: DataFrame, extensions: list[str], exclude_files: list[str] = (), include_prefixes: list[str] = (), exclude_dirs: list[str] = ()) -> DataFrame:
    """Files (file_path) by ending, then excluded names, then included prefixes, then excluded folders."""
    path = F.col("file_path")
    name = F.element_at(F.split(path, "/"), -1)
    keep = F.lit(False)
    for e in extensions:
        keep = keep | path.endswith(e)
    for g in exclude_files:
        keep = keep & ~name.rlike(T.glob_regex(g))
    inside = F.lit(False)
    for p in include_prefixes:
        inside = inside | path.startswith(p)
    out = F.lit(False)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    for d in exclude_dirs:
        hit = path.startswith(d.rstrip("/*") + "/") if "/" in d else _any_folder(folders, T.glob_regex(d))
        out = out | hit
    return files.filter(keep & (inside | ~out))


def _any_folder(folders: Column, pattern: str) -> Column:
    return F.exists(folders, lambda x: x.rlike(pattern))


def migration_files(files: DataFrame, sources: list[str]) -> DataFrame:
    """Of the configured folders, in order, the `.sql` files of the first that has any, in natural order.

    files: repository, file_path; each repository is judged alone.
    """
    rank = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(sources))):
        rank = F.when(F.col("file_path").startswith(s.rstrip("/") + "/"), F.lit(i)).otherwise(rank)
    ranked = files.filter(F.lower("file_path").endswith(".sql")).withColumn("_rank", rank).filter("_rank IS NOT NULL")
    first = ranked.groupBy("repository").agg(F.min("_rank").alias("_first"))
    return ranked.join(first, "repository").filter("_rank = _first").drop("_rank", "_first").withColumn("natural", T.natural_key(F.col("file_path"))).orderBy("repository", "natural").drop("natural")


def read_graph_csv(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Exported nodes and edges; rows without an id go, blanks get defaults."""
    n = spark.read.csv(nodes, header=True)
    e = spark.read.csv(edges, header=True)

    def value(c: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default)).alias(c)

    count = F.coalesce(F.try_to_number("evidence_count", F.lit("999999999")).cast("int"), F.lit(0)).alias("evidence_count")
    good = n.filter(F.trim("id") != "").select("id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("id")).alias("label"), value("node_type", "UNKNOWN"), count, value("last_seen", ""))
    ends = e.filter((F.trim("source") != "") & (F.trim("target") != "")).select("id", "source", "target", value("edge_type", "RELATED"), count, value("last_seen", ""))
    return good, ends


def node_size(evidence: Column) -> Column:
    """The size at which a node is drawn."""
    return F.round(10 + F.least(F.lit(45.0), F.sqrt(evidence) * 3.5), 2)


#: Colours of node types, in the order of their names and then again.
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")


def drawn_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (id, label, node_type, evidence_count, ...) with the size and colour they are drawn in."""
    types = nodes.select("node_type").distinct()
    place = F.row_number().over(W.orderBy("node_type")) - 1  # a handful of types
    colours = types.select("node_type", F.get(F.array(*map(F.lit, PALETTE)), F.pmod(place, F.lit(len(PALETTE)))).alias("color"))
    return nodes.join(colours, "node_type").select(*nodes.columns, node_size(F.col("evidence_count")).alias("size"), "color")


def write_graph_html(nodes: DataFrame, edges: DataFrame, folder: str, most: int = 20_000) -> None:
    """A page that draws an exported graph. A page holds its graph whole, so more than `most` rows are an error."""
    shown = [df.limit(most + 1).toJSON().collect() for df in (drawn_nodes(nodes), edges)]
    if max(map(len, shown)) > most:
        raise ValueError(f"a page holds at most {most} nodes or edges")
    legend = "".join(f"<li style='color:{r.color}'>{html.escape(r.node_type)}</li>" for r in drawn_nodes(nodes).select("node_type", "color").distinct().orderBy("node_type").collect())
    data = "{" + ", ".join(f'"{name}": [{", ".join(rows)}]' for name, rows in zip(("nodes", "edges"), shown, strict=True)) + "}"
    page = f"<!DOCTYPE html><meta charset='utf-8'><title>Graph</title><ul>{legend}</ul><svg id='g' viewBox='0 0 1000 1000'></svg><script>const graph = {data.replace('</', '<' + chr(92) + '/')};\n{_DRAW}</script>"
    nodes.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("errorifexists").text(folder)


_DRAW = """const at = new Map(graph.nodes.map((n, i) => [n.id, [500 + 450 * Math.cos(6.2832 * i / graph.nodes.length), 500 + 450 * Math.sin(6.2832 * i / graph.nodes.length)]]));
const draw = (tag, values) => { const e = document.createElementNS('http://www.w3.org/2000/svg', tag); for (const k in values) e.setAttribute(k, values[k]); return document.getElementById('g').appendChild(e); };
for (const e of graph.edges) if (at.has(e.source) && at.has(e.target)) draw('line', {x1: at.get(e.source)[0], y1: at.get(e.source)[1], x2: at.get(e.target)[0], y2: at.get(e.target)[1], stroke: '#ccc'});
for (const n of graph.nodes) draw('circle', {cx: at.get(n.id)[0], cy: at.get(n.id)[1], r: n.size / 5, fill: n.color}).appendChild(document.createElementNS('http://www.w3.org/2000/svg', 'title')).textContent = n.label;"""


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are none, and a line that isn't JSON is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def existing_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The files of an earlier summaries.json; none where there is no such file or it can't be read."""
    empty = spark.createDataFrame([], "file_path string, url string, last_modified string, source_code string, summary string")
    try:
        rows = spark.read.schema(SUMMARIES).option("mode", "DROPMALFORMED").json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.*")
        rows.limit(1).count()
    except Exception:  # a missing or broken file means that everything is new
        return empty
    return rows.filter(F.col("file_path").isNotNull())


def paged(spark: SparkSession, fetch, schema: str, size: int = 100) -> DataFrame:
    """Rows of a source that gives them by pages: fetch(page, size) from page 1 until a short one.

    For sources of a bounded number of pages, as the files of one change.
    """
    rows, page = [], 1
    while True:
        got = fetch(page, size)
        rows += got
        if len(got) < size:
            return spark.createDataFrame(rows, schema)
        page += 1


#: Characters of the files that one row of summaries holds, about.
PART = 8_000_000


def write_summaries(files: DataFrame, errors: DataFrame, folder: str) -> None:
    """<folder>/summaries: JSON rows of repositories, each a file of its own; <folder>/failed_files the same of errors, if there are any.

    A repository has one row, or if its files are more than PART characters one
    for every so many, so that no task holds a large repository whole.
    files: repository and the columns of a file; errors: repository, file_path, error.
    """
    own = ["file_path", "url", "last_modified", "source_code", "summary"]
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in own), F.lit(0)).cast("long")
    sizes = written(files.groupBy("repository").agg(F.sum(size).alias("_size")), "sizes")
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    large = sizes.filter(F.col("_size") > PART).select("repository", F.ceil(F.col("_size") / PART).alias("_parts"))  # at most total / PART rows
    part = F.struct("repository", F.pmod(F.xxhash64("file_path"), F.coalesce("_parts", F.lit(1))).alias("part")).alias("_part")
    dealt = files.join(F.broadcast(large), "repository", "left").select(part, *own).repartition(-(-total // PART) or 1, "_part")
    rows = dealt.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("files"))
    # What is read as JSON over many lines has one value in a file.
    rows.select("_part.repository", "files").write.mode("overwrite").option("maxRecordsPerFile", 1).json(f"{folder}/summaries")
    failed = errors.groupBy("repository").agg(F.sort_array(F.collect_list(F.struct("file_path", "error"))).alias("failed"))
    if failed.isEmpty():
        jvm = files.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/failed_files")
        path.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    else:
        failed.write.mode("overwrite").json(f"{folder}/failed_files")


def markdown(files: DataFrame) -> DataFrame:
    """(repository, path, text): each summary as a page with its origin in a comment above it."""
    head = F.concat(F.lit("<!-- "), "repository", F.lit("/"), "file_path", F.lit(" | "), F.coalesce("url", F.lit("")), F.lit(" -->\n\n"))
    return files.select("repository", F.concat("file_path", F.lit(".md")).alias("path"), F.concat(head, "summary").alias("text"))


def write_markdown(files: DataFrame, folder: str) -> None:
    """The pages of `markdown` by repository and path; one directory for each page, as Spark's writers have it."""
    pages = markdown(files).withColumn("page", F.concat_ws("/", "repository", "path"))
    pages.select("page", F.col("text").alias("value")).write.mode("overwrite").partitionBy("page").text(folder)


def write_with_manifest(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines, and a manifest with the SHA-256 of each file that was written."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")
        files = df.sparkSession.read.format("binaryFile").load(f"{folder}/{name}/*.json")
        rows = files.select(F.lit(name).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
        manifest = rows if manifest is None else manifest.unionByName(rows)
    if manifest is not None:
        manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
