"""Summaries by section: what they say of topics, interfaces and feature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.functions import text as T

# Section names and table headings.
CONFIGURATION, FLAGS, CONSUMED, PRODUCED, EXTERNAL, PUBLIC = "configuration", "feature flags", "topics consumed", "topics produced", "external api calls", "public api surface"
KNOWN = (CONFIGURATION, FLAGS, CONSUMED, PRODUCED, EXTERNAL, PUBLIC)
TABLE_HEADINGS = ("channel", "topic", "integration", "flag key")

_TICKS = "`([^`]+)`"


def parse(summaries: DataFrame) -> DataFrame:
    """(repo, path, at, section, body): the parts of a summary under its ## and ### headings, in order.

    A heading that begins with a known name has the rest as the first line of
    its body; in others ` - ` and ` | ` part the name from it. What stands
    before the first heading goes, and so do summaries without one.
    """
    text = F.regexp_replace(F.replace("summary", F.lit(" --- "), F.lit("\n")), r"\r\n?", "\n")
    pieces = F.split(F.regexp_replace(text, r"(?<=[^\n])\s+(?=#{2,3}\s+)", "\n"), r"(?m)^[ \t]*#{2,3}[ \t]+(?=\S)")
    rows = summaries.filter(F.col("summary").isNotNull()).select("repo", "path", F.posexplode(pieces).alias("at", "_p")).filter("at > 0")
    head, rest = F.lower(F.trim(F.substring_index("_p", "\n", 1))), F.when(F.contains("_p", F.lit("\n")), F.regexp_replace("_p", r"^[^\n]*\n", "")).otherwise("")
    rows = rows.select("repo", "path", "at", head.alias("_h"), rest.alias("_b"))
    name, inline = _heading(F.col("_h"))
    return rows.select("repo", "path", "at", F.trim(name).alias("section"), F.regexp_replace(F.concat_ws("\n", F.nullif(F.trim(inline), F.lit("")), "_b"), r"\A\s+|\s+\z", "").alias("body"))


def _heading(head: Column) -> tuple[Column, Column]:
    name, inline = F.split_part(head, F.lit(" | "), F.lit(1)), F.lit("")
    before, after = F.split_part(head, F.lit(" - "), F.lit(1)), F.regexp_replace(head, r"^.*? - ", "")
    dashed = F.contains(head, F.lit(" - "))
    first = F.when(dashed, before).otherwise(head)
    piped = F.contains(first, F.lit(" | "))
    name = F.when(piped, F.split_part(first, F.lit(" | "), F.lit(1))).otherwise(first)
    inline = F.concat_ws(" ", F.when(piped, F.regexp_replace(first, r"^.*? \| ", "")), F.when(dashed, after))
    for known in KNOWN:
        own = head.rlike(rf"^{known}\b")
        name = F.when(own, known).otherwise(name)
        inline = F.when(own, F.trim(F.regexp_replace(head, rf"^{known}\b[\s:-]*", ""), F.lit(" -:"))).otherwise(inline)
    return name, inline


def _lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _first_cells(lines: Column) -> Column:
    """The first cell of each row of a table, without the rule below its heading."""
    rows = F.filter(lines, lambda x: x.startswith("|") & ~x.rlike(r"^\|\s*-+\s*\|"))
    return F.transform(rows, lambda x: F.trim(F.split_part(F.trim(x, F.lit("|")), F.lit("|"), F.lit(1))))


def topics(body: Column) -> Column:
    """Names of topics in a section: quoted ones, first cells of tables, and bullets that are a name."""
    lines = _lines(body)
    bullets = F.transform(F.filter(lines, lambda x: x.startswith("- ") & ~F.contains(x, F.lit("`"))), lambda x: F.trim(F.regexp_replace(F.substring(x, 3, 10_000), r"\s+[—-]\s+.*$", "")))
    return F.array_distinct(F.filter(F.concat(F.regexp_extract_all(body, F.lit(_TICKS), F.lit(1)), _first_cells(lines), F.filter(bullets, lambda x: x.rlike("^[A-Za-z0-9._/-]+$"))), lambda x: F.trim(x) != ""))


def values(body: Column) -> Column:
    """What a section lists: quoted names, first cells of tables but their headings, and bullets."""
    lines = _lines(body)
    cells = F.filter(_first_cells(lines), lambda x: ~F.lower(T.clean_label(x)).isin(*TABLE_HEADINGS))
    bullets = F.transform(F.filter(lines, lambda x: x.startswith("- ") & ~F.contains(x, F.lit("`"))), lambda x: F.substring(x, 3, 10_000))
    every = F.transform(F.concat(F.regexp_extract_all(body, F.lit(_TICKS), F.lit(1)), cells, bullets), T.clean_label)
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def urls(body: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"https?://[^\s`)]+"), F.lit(0)), lambda x: F.rtrim(x, F.lit(".,;:"))))


def targets(body: Column) -> Column:
    """Public addresses that a text states: URLs, and every host with every path, or alone."""

    def all_of(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))

    def product(hosts: Column, paths: Column) -> Column:
        good = F.transform(F.filter(hosts, lambda h: F.contains(h, F.lit("."))), lambda h: F.rtrim(h, F.lit("/")))
        below = F.concat(F.array(F.lit("")), F.filter(paths, lambda p: p.startswith("/")))
        return F.flatten(F.transform(good, lambda h: F.transform(below, lambda p: F.concat(F.lit("https://"), h, p))))

    quoted = product(all_of(r"(?i)host\s+`([^`]+)`"), all_of(r"(?i)path(?:\s+prefix)?\s+`([^`]+)`"))
    keyed = product(all_of(r"(?im)^\s*-?\s*host:\s*['\"]?([A-Za-z0-9._-]+)"), all_of(r"(?im)^\s*-?\s*path:\s*['\"]?(/[^'\"#\s]*)"))
    return F.array_distinct(F.filter(F.transform(F.concat(urls(body), quoted, keyed), T.clean_label), lambda x: x != ""))


def facts(files: DataFrame, sure) -> DataFrame:
    """The facts that summaries (repo, path, summary) state of their repository, numbered in each file.

    Objects are as written; `extract` makes them canonical. sure: its Confidences.
    """
    from karstflow.operators.extract import source_kind

    rows = parse(files).withColumn("kind", source_kind(F.col("path")))
    body, section, kind = F.col("body"), F.col("section"), F.col("kind")
    configured = kind.isin("asyncapi", "configmap", "appsettings_prod", "appsettings_base")
    none = F.array().cast("array<string>")

    def said(where: Column, found: Column, predicate: str, label: str, confidence: float) -> Column:
        return F.transform(F.when(where, found).otherwise(none), lambda x: F.struct(F.lit(predicate).alias("predicate"), x.alias("object"), F.lit(label).alias("object_label"), F.lit(confidence).alias("confidence")))

    every = F.concat(
        said((section == CONSUMED) & ~configured, topics(body), "CONSUMES_TOPIC", "KAFKA_TOPIC", sure.topic),
        said((section == PRODUCED) & ~configured, topics(body), "PRODUCES_TOPIC", "KAFKA_TOPIC", sure.topic),
        said((section == EXTERNAL) & ~kind.isin("asyncapi", "ingress"), values(body), "CALLS_API", "API", sure.api),
        said((section == CONFIGURATION) & ~kind.isin("asyncapi", "ingress"), urls(body), "CALLS_API", "API", sure.api),
        said((section == FLAGS), values(body), "USES_FEATURE_FLAG", "FEATURE_FLAG", sure.config_flag),
        said((section == PUBLIC) & (kind == "ingress"), targets(body), "EXPOSES_API", "API", sure.exposed),
    )
    out = rows.filter(kind != "csproj").select("repo", "path", "kind", "at", F.posexplode(every).alias("_i", "x"))
    return out.select("repo", "path", "kind", F.col("repo").alias("subject"), F.lit("REPO").alias("subject_label"), "x.predicate", "x.object", "x.object_label", "x.confidence", (F.lit(1_000_000) + F.col("at") * 10_000 + F.col("_i")).alias("at"))
