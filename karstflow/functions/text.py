"""Text functions on columns. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term: word characters of any script, with inner hyphens.
TERM = r"(?U)\w+(?:-\w+)*"

# Words that tell nothing in a query.
STOPWORDS = (
    "a", "an", "and", "are", "as", "by", "can", "do", "does", "for", "from", "how", "in", "is", "of", "on", "or", "that", "the", "to", "what",
    "which", "with", "many", "each", "service", "services", "implement", "implements", "declare", "declares", "declared",
)


def terms(text: Column) -> Column:
    """The lower-cased terms of a text in order. Null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def cased_terms(text: Column) -> Column:
    """The terms as written."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def token_key(text: Column) -> Column:
    """A name in the form that aliases are compared in: lower case, hyphens for blanks, nothing but a-z, 0-9 and hyphens."""
    x = F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", "-")
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9-]", ""), "-+", "-")
    return F.trim(x, F.lit("-"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text with no letter or digit directly beside it."""
    return F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower(phrase), F.lit("\\E(?![a-z0-9])")))


def clean_label(text: Column) -> Column:
    """A graph label without emphasis, runs of blanks, line references and closing marks."""
    x = F.regexp_replace(_stripped(F.replace(text, F.lit("**"), F.lit(""))), r"\s+", " ")
    return F.rtrim(F.trim(F.regexp_replace(x, r"\(L\d+(?:-\d+)?\)", "")), F.lit(".,;:"))


def query_terms(text: Column, most: int = 20) -> Column:
    """The first distinct terms of a query that tell something."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9_.-]{1,}"), F.lit(0))
    telling = F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS) & ~t.rlike(r"^\d+$"))
    return F.slice(F.array_distinct(telling), 1, most)


def _stripped(x: Column) -> Column:
    """Without white space at either end; trim() alone takes blanks only."""
    return F.regexp_replace(x, r"\A\s+|\s+\z", "")


def summary_body(text: Column) -> Column:
    """A summary without its reasoning section, its references and its line citations."""
    x = F.regexp_replace(text, r"(?ms)^##\s+Source References\s*$.*\z", "")
    x = F.regexp_replace(x, r"(?ms)^##\s+Reasoning\s*$.*?(?=^##\s|\z)", "")
    return _stripped(F.regexp_replace(x, r"\s*\([^()\s]*:?L\d+(?:-L?\d+)?\)", ""))


def summary_references(text: Column) -> Column:
    """The references at the end of a summary, or nothing."""
    return _stripped(F.regexp_extract(text, r"(?ms)^##\s+Source References\s*$(.*)\z", 1))


def summary_fault(text: Column, migrations: bool = False) -> Column:
    """Why a summary isn't complete, or null: its sections, or the overview of migrations, and an end that is no heading."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    wanted = ("## Schema Overview",) if migrations else ("## Purpose", "## Key Business Logic")
    missing = F.array_compact(F.array(*[F.when(~F.contains(text, F.lit(h)), F.lit(h)) for h in wanted]))
    return (
        F.when(F.coalesce(_stripped(text), F.lit("")) == "", "empty").when(F.size(missing) > 0, F.concat(F.lit("without "), F.array_join(missing, ", ")))
        .when(F.element_at(lines, -1).rlike(r"^##\s+"), "ends with a heading")
    )


def valid_summary(text: Column, migrations: bool = False) -> Column:
    """Whether a summary is complete."""
    return summary_fault(text, migrations).isNull()


def without_reasoning(text: Column) -> Column:
    """A summary without headed or bold reasoning blocks."""
    x = F.regexp_replace(text, r"(?ims)^#{1,6}\s*reasoning\b.*?(?=^#{1,6}\s|\z)", "")
    return _stripped(F.regexp_replace(x, r"(?ims)^\*\*reasoning:?\*\*.*?(?=^#{1,6}\s|^\*\*|\z)", ""))


def numbered_lines(text: Column) -> Column:
    """Every line with its number in front."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def repository_path(path: Column, service: Column) -> Column:
    """A path with forward slashes, without doubled ones, a leading ./ and the folder that only summaries have."""
    x = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+", "/")
    x = F.regexp_replace(x, r"^(?:\./)+", "")
    folder = F.concat(F.lit("summaries/"), service, F.lit("/"))
    return F.when(x.startswith(folder), F.substring(x, F.length(folder) + 1, F.length(x))).otherwise(x)


def url_host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    return F.parse_url(url, F.lit("PATH"))


# What names of interfaces, topics and flags may hold, and what never is one.
API_PREFIXES = ("apiurls", "apiconfig", "webapiconfig")
API_SUFFIXES = ("baseurl", "url", "uri", "endpoint", "host", "domain", "address", "name")
API_NOISE = ("api", "apiapi", "apiurls", "apiconfig", "webapiconfig", "defaultapi", "localhostapi")
API_NOISE_PARTS = (
    "connectionstring", "containername", "blobcontainer", "httpclienthandler", "contentserializer", "authorizationurl", "allowautoredirect", "baseaddress", "servicecollection",
    "defaulttenant", "clientid", "username", "password", "retry", "timeout", "policy", "exception",
)
API_NOISE_ENDINGS = ("client", "handler", "config", "serializer", "policy")
CONFIG_TOPIC_PARTS = ("kafkatopics__", "akkaconfig.topics", "kafkaconsumerconfig.topics")
RAW_TOPIC_PARTS = ("constants.outboundtopics.", "constants.kafka.", "akkaconfig.topics[", "kafkaconsumerconfig.topics")
TOPIC_NOISE = (
    "status", "result", "results", "performed", "notperformed", "orderheld", "application/json", "type", "subscribe", "commonheaders", "context", "eventid", "guid", "post", "get", "vendor", "productcode",
)
MEDIA_TYPES = ("application/json", "text/plain", "application/xml")
FLAG_NOISE_PARTS = (
    "config", "launchdarkly", "licensekey", "securityprotocol", "supportedvendors", "sectionname", "descriptor", "continueondeserializationerrors", "continueonfailure", "usepostgrespersistence",
    "authsettings", "new_relic", "aspnetcore_environment", "sasl_ssl", "automapperlicensekey", "ildclient", "ilaunchdarklyservice", "sdk-", "permit__", "productconfiguration__", "kafkaconfig.",
)
HOST_NOISE = ("api", "dev", "prod", "staging", "localhost", "default", "hooks")
PATH_NOISE = ("api", "health", "live", "oauth2", "swagger")
TABLE_NOISE = ("TABLE", "SCHEMA", "OVERVIEW")
LANGUAGES = {"cs": "csharp", "sql": "sql", "json": "json", "py": "python", "ts": "typescript", "js": "javascript", "yaml": "yaml", "yml": "yaml"}

_API = "[a-z0-9]+api(?:v[0-9]+)?"


def _any_part(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def _unwrapped(token: Column) -> Column:
    """What stands inside `#{...}`, or the token itself."""
    inside = F.regexp_extract(token, r"^#\{([^}]+)\}", 1)
    return F.when(inside != "", F.trim(inside)).otherwise(token)


def _raw_name(value: Column) -> Column:
    """A written name without blanks and quotes at its ends."""
    return F.trim(F.trim(clean_label(value)), F.lit("\"'"))


def _valid_api(name: Column, raw: Column) -> Column:
    low = F.lower(raw)
    good = name.rlike("^[a-z0-9_-]{4,40}$") & ~name.rlike("^[0-9]+$") & (F.size(F.split(name, "api", -1)) <= 3) & ~name.isin(*API_NOISE)
    return good & ~_any_part(name, API_NOISE_PARTS) & ~_any_part(low, CONFIG_TOPIC_PARTS) & ~name.rlike(f"(?:{'|'.join(API_NOISE_ENDINGS)})$")


def _without_interface(name: Column, raw: Column) -> Column:
    """A name without the I of an interface, as the raw spelling shows it."""
    return F.when(name.startswith("i") & (F.length(name) > 4) & F.regexp_replace(raw, "[^A-Za-z0-9]", "").rlike("^[iI][A-Z]"), F.substring(name, 2, 200)).otherwise(name)


def _with_api(name: Column) -> Column:
    compact = F.regexp_replace(name, "[_-]+", "")
    return F.when(compact.endswith("api"), compact).otherwise(F.concat(name, F.lit("api")))


def _api_in(part: Column) -> Column:
    return F.when(part.rlike(_API), F.regexp_extract(part, f"({_API})", 1)).otherwise(_with_api(part))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once and named once in the plan."""
    return F.element_at(F.transform(F.array(value), f), 1)


def api_of_url(url: Column) -> Column:
    """The interface that a URL names: by its first telling path segment, else by its host; null without a host."""

    def clean(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[^a-z0-9_-]+", "")

    def named(u: Column) -> Column:
        segments = F.transform(F.split(F.coalesce(u["path"], F.lit("")), "/"), clean)
        telling = F.filter(segments, lambda x: (x != "") & ~x.isin(*PATH_NOISE) & (x.rlike(_API) | ~x.rlike("^v[0-9]+$")))
        labels = F.filter(F.split(u["host"], r"\."), lambda x: x != "")
        head = let(labels, lambda x: clean(F.when(F.get(x, F.lit(0)).isin(*HOST_NOISE) & (F.size(x) > 1), F.get(x, F.lit(1))).otherwise(F.get(x, F.lit(0)))))
        okta = F.contains(F.concat(F.lit("."), u["host"], F.lit(".")), F.lit(".okta.")) | u["host"].endswith(".okta.com")
        part = let(F.coalesce(F.get(telling, F.lit(0)), F.nullif(head, F.lit(""))), _api_in)
        return F.when(F.coalesce(u["host"], F.lit("")) == "", F.lit(None)).when(okta, F.lit("oktaapi")).otherwise(part)

    return let(F.struct(url_host(url).alias("host"), url_path(url).alias("path")), named)


def _api_of_name(x: Column) -> Column:
    """The valid interface name in struct(raw, plain)."""
    raw, plain = x["raw"], x["plain"]
    compact = F.nullif(F.regexp_extract(plain, f"\\b({_API})\\b", 1), F.lit(""))
    stems = [F.when(plain.endswith(e), F.nullif(F.regexp_extract(F.rtrim(F.regexp_replace(plain, f"{e}$", ""), F.lit("._-")), f"({_API})$", 1), F.lit(""))) for e in API_SUFFIXES]
    last = let(F.trim(F.element_at(F.split(plain, r"\."), -1), F.lit("._-")), lambda n: _without_interface(n, raw))
    last = let(last, lambda n: F.when(n.startswith("nternal"), F.concat(F.lit("i"), n)).otherwise(n))
    last = let(last, lambda n: F.when(F.contains(n, F.lit("api")), n))
    known = F.when(F.contains(plain, F.lit("okta")), F.lit("oktaapi"))
    name = F.coalesce(let(compact, lambda n: _without_interface(n, raw)), known, let(F.coalesce(*stems), lambda n: _without_interface(n, raw)), last)
    return let(name, lambda n: F.when(_valid_api(n, raw), n))


def api_name(value: Column) -> Column:
    """The canonical name of an interface from a URL, a configuration key or a written name; null where nothing usable is left."""

    def plain(low: Column) -> Column:
        return F.regexp_replace(F.replace(F.replace(low, F.lit("__"), F.lit(".")), F.lit("::"), F.lit(".")), "[^a-z0-9._-]+", "")

    def named(x: Column) -> Column:
        return F.when(x["raw"] == "", F.lit(None)).when(x["low"].rlike("^https?://"), api_of_url(x["low"])).otherwise(let(F.struct(x["raw"].alias("raw"), plain(x["low"]).alias("plain")), _api_of_name))

    def lowered(raw: Column) -> Column:
        low = F.replace(F.trim(let(F.lower(raw), _unwrapped), F.lit("\"' ")), F.lit("`"), F.lit(""))
        return F.struct(raw.alias("raw"), F.regexp_replace(low, f"^(?:{'|'.join(API_PREFIXES)})[._-]*", "").alias("low"))

    return let(let(_raw_name(value), lowered), named)


def topic_name(value: Column) -> Column:
    """The canonical name of a message topic; null for media types, references to constants and other noise."""

    def named(low: Column) -> Column:
        cut = F.trim(F.split_part(F.regexp_replace(_unwrapped(low), r"\s+", ""), F.lit("/"), F.lit(1)), F.lit("._-"))
        good = lambda x: x.rlike("^[a-z0-9._-]{3,120}$") & ~x.rlike("^[0-9]+$") & ~_any_part(x, CONFIG_TOPIC_PARTS) & ~x.isin(*TOPIC_NOISE)
        return F.when(~low.isin(*MEDIA_TYPES) & ~_any_part(low, RAW_TOPIC_PARTS), let(cut, lambda x: F.when(good(x), x)))

    return let(F.lower(F.replace(_raw_name(value), F.lit("`"), F.lit(""))), named)


def flag_name(value: Column) -> Column:
    """The canonical name of a feature flag: Enable... as written, others with - or _ in lower case; null for anything else."""

    def named(x: Column) -> Column:
        low = F.lower(x)
        bad = low.startswith("ifeatureflags") | F.contains(x, F.lit("__")) | ~x.rlike("^[A-Za-z0-9._-]+$") | _any_part(low, FLAG_NOISE_PARTS)
        return F.when(bad, F.lit(None)).when(low.rlike("^enable.+"), F.concat(F.lit("Enable"), F.substring(x, 7, 500))).when(x.rlike("[-_]"), low)

    raw = let(F.replace(_raw_name(value), F.lit("`"), F.lit("")), _unwrapped)
    cut = F.rtrim(F.trim(F.split_part(raw, F.lit(":"), F.lit(1))), F.lit("()"))
    return let(let(cut, lambda x: F.when(F.lower(x).startswith("ifeatureflags."), F.regexp_replace(x, r"^[^.]*\.", "")).otherwise(x)), named)


def table_name(value: Column) -> Column:
    """The plain name of a table: the last dotted part without quotes, brackets or blanks; null where it can't be one."""
    x = F.rtrim(F.regexp_replace(F.replace(_stripped(clean_label(value)), F.lit("`"), F.lit("")), r"[\[\]\"\s]", ""), F.lit(".,;:)"))
    last = F.element_at(F.split(F.regexp_replace(x, "(?i)^table:", ""), r"\."), -1)
    return let(last, lambda x: F.when(x.rlike(r"^[A-Za-z_][A-Za-z0-9_]{1,120}$") & ~F.upper(x).isin(*TABLE_NOISE), x))


def table_variants(name: Column) -> Column:
    """Forms under which a table may be named, in the order in which they are tried: as it is, then in the singular."""
    x = F.lower(F.regexp_replace(name, r"[\W_]", ""))
    n = F.length(x)
    forms = F.array(
        x,
        F.when(x.endswith("ies") & (n > 3), F.concat(F.left(x, n - 3), F.lit("y"))),
        F.when(x.endswith("es") & (n > 2), F.left(x, n - 2)),
        F.when(x.endswith("s") & (n > 1), F.left(x, n - 1)),
    )
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull() & (v != "")))


def language_of(path: Column) -> Column:
    """A file's language by its ending."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("text"))


def service_bucket(path: Column) -> Column:
    """The part of a system that a title belongs to: src:<folder>, k8s, path:<title> or unknown."""
    title = F.lower(F.trim(path))
    folder = F.array_join(F.filter(F.split(F.regexp_extract(title, "^src/([^/]*)", 1), r"\."), lambda x: x != ""), ".")
    short = F.regexp_replace(folder, r"(?<=[^.])(?:\.(?:api|core|di|messages|service|svc|webapi|worker))+$", "")
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("unknown")).when(title.startswith("src/"), F.concat(F.lit("src:"), short)).when(F.split_part(title, F.lit("/"), F.lit(1)) == "k8s", F.lit("k8s")).otherwise(F.concat(F.lit("path:"), title))


def natural_key(path: Column) -> Column:
    """A key in whose order numbers inside names count by value (numbers of up to 18 digits)."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 18, "0")).otherwise(p)), "")


def glob_regex(pattern: str) -> str:
    """A regular expression for a file-name pattern of `*`, `?` and `[...]`."""
    import fnmatch

    return "^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"
