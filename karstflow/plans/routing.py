"""Which services a query is about, and what that does to its search."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.functions import text as T
from karstflow.operators import phrases
from karstflow.operators.fusion import overfetch
from karstflow.session import written

# Wording that asks for all services, and what may stand before `services` in it.
ALL_SERVICES = ("all services", "across services")
BEFORE_SERVICES = ("downstream", "upstream", "external", "internal", "other", "product", "source", "target", "consumer", "producer")
DISCOVERY = rf"\b(?:which|what)\s+(?:(?:{'|'.join(BEFORE_SERVICES)})\s+){{0,3}}services?\b"
GLOBAL, BOOST, HARD_FILTER = "GLOBAL", "BOOST", "HARD_FILTER"


def token_key(text: str) -> str:
    x = re.sub(r"[\s_]+", "-", text.strip().lower())
    return re.sub("-+", "-", re.sub("[^a-z0-9-]", "", x)).strip("-")


@dataclass(frozen=True)
class Service:
    source: str
    short_form: str = ""
    long_form: str = ""


def catalogue(text: str) -> list[Service]:
    """Services of a JSON list whose fields are a string or a list; rows without a short and a long form go."""

    def values(x) -> list[str]:
        return sorted({str(v).strip() for v in (x if isinstance(x, list) else [x]) if v and str(v).strip()})

    out = []
    for row in json.loads(text):
        short, long = values(row.get("short_form")), values(row.get("long_form"))
        if short or long:
            out += [Service(s, a, b) for s in values(row.get("source")) or [""] for a in short or [""] for b in long or [""]]
    return out


def aliases(services: list[Service]) -> dict[str, frozenset[str]]:
    """Alias -> sources, the longest alias first."""
    found: dict[str, set[str]] = {}
    for s in services:
        for a in (s.source, s.short_form, s.long_form):
            if s.source and (key := token_key(a)):
                found.setdefault(key, set()).add(s.source)
    return {k: frozenset(found[k]) for k in sorted(found, key=lambda k: (-len(k), k))}


@dataclass(frozen=True)
class Decision:
    """services: all detected; ambiguous: aliases that several services share; matched: service -> alias."""

    mode: str = GLOBAL
    services: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()
    k: int = 5
    matched: dict[str, str] = field(default_factory=dict)


def stands_in(phrase: str, text: str) -> bool:
    """Whether a phrase stands in a text with no letter or digit beside it."""
    return re.search(rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])", text) is not None


def _named(phrase: str, query: str) -> bool:
    return bool(phrase) and (stands_in(phrase, token_key(query)) or stands_in(phrase, query.lower()))


def matches(query: str, services: list[Service]) -> tuple[dict[str, str], set[str]]:
    """(service -> its longest alias in the query, aliases there that several services share)."""
    sure, ambiguous = {}, set()
    for alias, sources in aliases(services).items():
        if _named(alias, query):
            if len(sources) == 1:
                sure.setdefault(*sources, alias)
            else:
                ambiguous.add(alias)
    return sure, ambiguous


def asks_for_all(query: str) -> bool:
    low = query.lower()
    return any(x in low for x in ALL_SERVICES) or re.search(DISCOVERY, low) is not None


def local_pattern(alias: str) -> str:
    """What ties a question's wording to a service: in it, its own, or what it does."""
    name = r"[\s-]+".join(re.escape(x) for x in alias.split("-") if x)
    return rf"\b(?:in|within|inside)\s+{name}\b|\b{name}\s*'s\b|\b(?:what|which|how)\b.+\bdoes\s+{name}\b"


def plan(query: str, services: list[Service], k: int = 5) -> Decision:
    """GLOBAL without services or for a question about all; HARD_FILTER for one sure service that the wording is tied to; else BOOST.

    Services are looked for in the expanded query, unless the query itself is
    tied to the only one that it names.
    """
    sure, shared = matches(query, services)
    tied = len(sure) == 1 and not shared and re.search(local_pattern(next(iter(sure.values()))), query.lower())
    if not tied:
        sure, shared = matches(expand(query, services), services)
    found = Decision(GLOBAL, tuple(sorted(sure)), tuple(sorted(shared)), k, sure)
    if not sure or asks_for_all(query):
        return found
    if len(sure) == 1 and not shared and re.search(local_pattern(next(iter(sure.values()))), query.lower()):
        return replace(found, mode=HARD_FILTER, ambiguous=())
    return replace(found, mode=BOOST, k=overfetch(k))


def expand(query: str, services: list[Service]) -> str:
    """The query and after it, in order, the other form and the source of every service that it names by one form."""
    more = set()
    for s in services:
        forms = (s.short_form, s.long_form)
        for own, other in (forms, forms[::-1]):
            if own and (stands_in(token_key(own), token_key(query)) or stands_in(own.lower(), query.lower())):
                more |= {other, s.source} - {""}
    return " ".join([query, *sorted(more)])


def strategy_of(name: str) -> tuple[str, bool]:
    """(base strategy, whether services decide) of a strategy's name."""
    base = name.strip().lower()
    return base.removesuffix("-service-aware"), base.endswith("-service-aware")


# The same for tables: queries (query_id, query), services (source, short_form, long_form). Names are found by equality
# (`phrases`), and what a set of names adds to a query is put together once for all queries that name it.

#: Parts that the queries of a set of names are dealt to when they meet what it adds, so that a name of many queries isn't one task's.
PARTS = 64


def _expansions(queries: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, query, _set) with the set of forms that a query names, or null; (_set, _m) with what that adds)."""
    forms = services.select("source", F.explode(F.array(F.struct(F.col("short_form").alias("own"), F.col("long_form").alias("other")), F.struct(F.col("long_form").alias("own"), F.col("short_form").alias("other")))).alias("f")).select("source", "f.*").filter("own <> ''").distinct()
    rows = queries.select("query_id", "query")
    hit = phrases.named(_texts(rows), forms.select(F.col("own").alias("phrase")))
    of = written(hit.groupBy(F.col("id").alias("query_id")).agg(F.sort_array(F.collect_set("phrase")).alias("_own")).withColumn("_set", F.to_json("_own")), "forms")
    named = of.select("_set", "_own").distinct().select("_set", F.explode("_own").alias("own")).join(forms, "own")
    more = named.select("_set", F.explode(F.array("other", "source")).alias("x")).filter("x <> ''").groupBy("_set").agg(F.array_join(F.sort_array(F.collect_set("x")), " ").alias("_m"))
    return rows.join(of.select("query_id", "_set"), "query_id", "left"), more


def _texts(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))


def _dealt(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows with `_set` beside the columns of their set, if it has any."""
    parts = rows.withColumn("_p", F.pmod(F.xxhash64("query_id"), F.lit(PARTS)).cast("int")).repartition(PARTS, "_set", "_p")
    return parts.join(sets.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["_set", "_p"], "left").drop("_p")


def expand_all(queries: DataFrame, services: DataFrame) -> DataFrame:
    """`expand` for a table of queries."""
    rows, more = _expansions(queries, services)
    return _dealt(rows, more).select("query_id", F.concat_ws(" ", "query", "_m").alias("query"))


def _aliases(services: DataFrame) -> DataFrame:
    """(alias, _n, source): how many services have an alias, and one of them."""
    keys = services.filter("source <> ''").select(F.explode(F.array("source", "short_form", "long_form")).alias("_a"), "source").select(T.token_key(F.col("_a")).alias("alias"), "source").filter("alias <> ''").distinct()
    return keys.groupBy("alias").agg(F.count(F.lit(1)).alias("_n"), F.min("source").alias("source"))


def _hits(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, services, ambiguous, alias) of found phrases (id, phrase) that are aliases; alias is the longest of the only service."""
    hit = found.withColumnRenamed("phrase", "alias").join(keys, "alias")
    own = hit.filter("_n = 1").groupBy("id", "source").agg(F.max(F.struct(F.length("alias").alias("n"), "alias")).alias("_b"))
    sure = own.groupBy("id").agg(F.sort_array(F.collect_list("source")).alias("services"), F.max("_b").alias("_b"))
    shared = hit.filter("_n > 1").groupBy("id").agg(F.sort_array(F.collect_list("alias")).alias("ambiguous"))
    none = F.array().cast("array<string>")
    return sure.join(shared, "id", "full_outer").select("id", F.coalesce("services", none).alias("services"), F.coalesce("ambiguous", none).alias("ambiguous"), "_b")


def _beside(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with query_id beside their hits, empty where there are none."""
    none = F.array().cast("array<string>")
    return rows.join(hits.withColumnRenamed("id", "query_id"), "query_id", "left").withColumns({c: F.coalesce(c, none) for c in ("services", "ambiguous")})


def match_all(queries: DataFrame, services: DataFrame) -> DataFrame:
    """(query_id, services, ambiguous, alias): `matches` for a table of queries; alias is the only service's."""
    keys = written(_aliases(services), "aliases")
    found = phrases.named(_texts(queries), keys.select(F.col("alias").alias("phrase")))
    return _beside(queries.select("query_id"), written(_hits(found, keys), "hits")).select("query_id", "services", "ambiguous", F.col("_b.alias").alias("alias"))


def _tied(query: Column, alias: Column) -> Column:
    name = F.array_join(F.filter(F.split(alias, "-"), lambda x: x != ""), r"[\s-]+")
    pattern = F.concat(F.lit(r"\b(?:in|within|inside)\s+"), name, F.lit(r"\b|\b"), name, F.lit(r"\s*'s\b|\b(?:what|which|how)\b.+\bdoes\s+"), name, F.lit(r"\b"))
    return F.coalesce(F.regexp_like(F.lower(query), pattern), F.lit(False))


def plan_all(queries: DataFrame, services: DataFrame) -> DataFrame:
    """(query_id, mode, services, ambiguous): `plan` for a table of queries.

    No expanded query is searched whole. What a set of names adds is searched
    once, and each query with the head of what it gets: an alias has letters or
    digits at both ends, so one that begins in the query ends there or within
    as many characters after it as the longest alias has.
    """
    rows, more = _expansions(queries, services)
    keys, more = written(_aliases(services), "aliases"), written(more, "expansions")
    known = keys.select(F.col("alias").alias("phrase"))
    most = (keys.agg(F.max(F.length("alias"))).first()[0] or 0) + 1
    head = lambda m: F.regexp_extract(m, rf"^(?s:.{{0,{most}}})[a-z0-9]*", 0)  # noqa: E731  to where a phrase may end
    heads = more.select("_set", head(F.lower("_m")).alias("_h"), head(T.token_key(F.col("_m"))).alias("_k"))
    met = rows.filter("_set IS NOT NULL").join(heads, "_set", "left")
    key = T.token_key(F.col("query"))
    met = met.select(F.col("query_id").alias("id"), F.explode(F.array(F.concat_ws(" ", F.lower("query"), "_h"), F.concat_ws("-", F.nullif(key, F.lit("")), F.nullif("_k", F.lit(""))))).alias("text"))
    own = written(_hits(phrases.named(_texts(rows), known), keys), "hits")
    both = written(_hits(phrases.standing(met, known), keys), "hits")
    added = written(_hits(phrases.named(more.select(F.col("_set").alias("id"), F.col("_m").alias("text")), known), keys), "hits")

    first = _beside(rows, own)
    one = (F.size("services") == 1) & (F.size("ambiguous") == 0) & _tied(F.col("query"), F.col("_b.alias"))
    first = first.withColumn("_set", F.when(~one, F.col("_set")))
    names = ("services", "ambiguous", "_b")
    wide = first.join(both.select(F.col("id").alias("query_id"), *[F.col(c).alias(f"_x{c}") for c in names]), "query_id", "left")
    # A query with a set has its own hits among those with the head.
    small = wide.select("query_id", "query", "_set", *[F.when(F.col("_set").isNotNull(), F.col(f"_x{c}")).otherwise(F.col(c)).alias(c) for c in names])
    all_ = _dealt(small, added.select(F.col("id").alias("_set"), *[F.col(c).alias(f"_x{c}") for c in names]))

    def joined(c: str) -> Column:
        mine, more = F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"_x{c}", F.array().cast("array<string>"))
        fresh = F.filter(mine, lambda x: ~F.array_contains(more, x))
        return F.when(F.size(fresh) == 0, more).otherwise(F.sort_array(F.concat(more, fresh)))

    kept = all_.select("query_id", "query", joined("services").alias("services"), joined("ambiguous").alias("ambiguous"), F.greatest("_b", "_x_b")["alias"].alias("alias"))
    low = F.lower("query")
    wanted = low.rlike(DISCOVERY)
    for x in ALL_SERVICES:
        wanted = wanted | F.contains(low, F.lit(x))
    local = (F.size("services") == 1) & (F.size("ambiguous") == 0) & _tied(F.col("query"), F.col("alias"))
    mode = F.when((F.size("services") == 0) | wanted, GLOBAL).when(local, HARD_FILTER).otherwise(BOOST)
    return kept.select("query_id", mode.alias("mode"), "services", "ambiguous")
