"""Secret scans: fixed patterns and a battery of randomness tests.

Beside the patterns, every token of 20 or more characters of base 64 that the
patterns leave is a candidate. What is tested is its longest part between
separators if that has 20 characters, else all of it without separators; so a
prefix such as `sk-` is no part of the test. The encoding is inferred from the
alphabet alone: hexadecimal, base 26, 32, 36 or 64 (62 characters without the separators). Digits alone are a number.

Three tests ask whether the characters could be drawn at random: chi-squared
for uniform use of the alphabet, in cells of characters that ordinary text
uses about alike; runs about the alphabet's middle; and lag-one serial
correlation. Fisher's method combines them to one p-value, small where the
token has structure. The share of random tokens that the battery calls
structured is LOST, whatever their length.

Length-aware control of false discoveries: a token's evidence against being
ordinary is the likelihood ratio of uniform use to that of ordinary text and
identifiers over the cells, an e-value, which grows with length; it counts as
0 where the battery finds structure. Candidates of one encoding and length
band are judged together by Benjamini and Hochberg's procedure for e-values:
of what a band reports, at most the share FALSE is expected to be ordinary.
The procedure runs on counts of e-values in fixed steps, a table whose size
doesn't depend on the corpus, over all documents. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import settled, texts, written
from karstflow.llm.spans import add_spans, add_union, joined, replaced

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
SEPARATORS = "[+/_=-]+"
#: Characters that a part, or a token without separators, must have for a test.
PART, LEAST = 20, 16

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

# Letters by how common they are in text of Latin script, and the
# shares of ordinary text and identifiers. Cells of an alphabet in the order of
# their values: (characters, share).
COMMON, MIDDLE, RARE, DIGITS = "eainrstol", "duhcmgpfb", "ywvkxjqz", "0123456789"
CELLS = {
    "hex": (("01234", 0.5), ("56789", 0.4), ("abcdef", 0.1)),
    "base26": ((COMMON, 0.68), (MIDDLE, 0.25), (RARE, 0.07)),
    "base32": ((COMMON, 0.62), (MIDDLE, 0.20), (RARE, 0.07), ("234567", 0.11)),
    "base36": ((COMMON, 0.62), (MIDDLE, 0.20), (RARE, 0.07), (DIGITS, 0.11)),
    "base64": ((COMMON, 0.60), (MIDDLE, 0.20), (RARE, 0.06), (DIGITS, 0.06), ((COMMON + MIDDLE + RARE).upper(), 0.08)),
}
ALPHABETS = {name: "".join(x for x, _ in cells) for name, cells in CELLS.items()}

#: Share of random tokens that the battery may lose; share of ordinary ones among what a band reports.
LOST, FALSE = 0.01, 0.05
#: e-values are counted in steps of log10, up to the last.
STEP, STEPS = 0.05, 400
BAND, BANDS = 8, 16


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once and named once in the plan."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, by a Chebyshev fit with a relative error under 1.2e-7."""

    def fit(v: Column) -> Column:
        out = F.lit(0.17087277)
        for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
            out = out * v["t"] + c
        return v["t"] * F.exp(out - v["x"] * v["x"])

    return _let(x, lambda y: _let(F.struct((1 / (1 + 0.5 * y)).alias("t"), y.alias("x")), fit))


def _chi_tail(x: Column, df: int) -> Column:
    """The upper tail of chi-squared with 2, 3 or 4 degrees of freedom."""
    if df == 2:
        return F.exp(-x / 2)
    if df == 4:
        return F.exp(-x / 2) * (1 + x / 2)
    return _erfc(F.sqrt(x / 2)) + F.sqrt(2 * x / math.pi) * F.exp(-x / 2)


def _two_sided(z: Column) -> Column:
    return _erfc(F.least(F.abs(z), F.lit(30.0)) / math.sqrt(2))


def _counts(text: Column, encoding: str) -> list[Column]:
    """How many characters of a text lie in each cell."""
    return [(F.length(text) - F.length(F.translate(text, x, ""))).cast("double") for x, _ in CELLS[encoding]]


def _walk(v: Column, half: int) -> Column:
    """Sums over an array of values: ends, runs about the middle, values above it, sum, squares and lagged products."""
    return F.aggregate(
        v,
        F.struct(F.lit(-1).alias("last"), F.lit(-1).alias("first"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sl")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when(a["first"] < 0, x).otherwise(a["first"]).alias("first"),
            (a["runs"] + F.when((a["last"] >= 0) & ((a["last"] >= half) == (x >= half)), 0.0).otherwise(1.0)).alias("runs"),
            (a["high"] + F.when(x >= half, 1.0).otherwise(0.0)).alias("high"),
            (a["s"] + x).alias("s"),
            (a["ss"] + x.cast("double") * x).alias("ss"),
            (a["sl"] + F.when(a["last"] >= 0, a["last"].cast("double") * x).otherwise(0.0)).alias("sl"),
        ),
    )


def _scores(w: Column) -> Column:
    """struct(chi, runs, serial) of a walk with n and chi: a statistic and two normal scores."""
    n = w["n"]
    both = 2 * w["w"]["high"] * (n - w["w"]["high"])
    moments = F.struct(w.alias("w"), both.alias("both"), (w["w"]["s"] / n).alias("m"))

    def scored(x: Column) -> Column:
        n, w = x["w"]["n"], x["w"]["w"]
        both, m = x["both"], x["m"]
        var, spread = both * (both - n) / (n * n * (n - 1)), w["ss"] - n * m * m
        runs = F.when(both > n, (w["runs"] - both / n - 1) / F.sqrt(var)).otherwise(30.0)
        lagged = w["sl"] - m * (2 * w["s"] - w["first"] - w["last"]) + (n - 1) * m * m
        serial = F.when(spread > 1e-9, (lagged / spread + 1 / n) * F.sqrt(n)).otherwise(30.0)
        return F.struct(x["w"]["chi"].alias("chi"), runs.alias("runs"), serial.alias("serial"))

    return _let(moments, scored)


def _battery(text: Column, encoding: str) -> Column:
    """The combined p-value of a text in the characters of an alphabet (at least 16 of them)."""
    letters = ALPHABETS[encoding]
    size, cells = len(letters), CELLS[encoding]
    n = F.length(text).cast("double")
    chi = sum((_let(c, lambda y: y * y) * (size / len(x)) for c, (x, _) in zip(_counts(text, encoding), cells, strict=True)), F.lit(0.0)) / n - n
    values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(letters), c) - 1)
    scores = _let(F.struct(n.alias("n"), F.greatest(chi, F.lit(0.0)).alias("chi"), _walk(values, size // 2).alias("w")), _scores)

    def fisher(z: Column) -> Column:
        tails = (_chi_tail(z["chi"], len(cells) - 1), _two_sided(z["runs"]), _two_sided(z["serial"]))
        half = -sum((F.log(F.greatest(p, F.lit(1e-300))) for p in tails), F.lit(0.0))
        # Half of Fisher's statistic, which is chi-squared with six degrees of freedom.
        return _let(half, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return _let(scores, fisher)


def _evidence(text: Column, encoding: str) -> Column:
    """log10 of the likelihood ratio of uniform use to ordinary use."""
    cells, size = CELLS[encoding], len(ALPHABETS[encoding])
    return sum((c * math.log10(len(x) / size / share) for c, (x, share) in zip(_counts(text, encoding), cells, strict=True)), F.lit(0.0))


def tested_part(token: Column) -> Column:
    """What of a token is tested; null where that is too short."""
    parts = F.split(token, SEPARATORS)
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    whole = F.array_join(parts, "")
    return F.when(longest["n"] >= PART, longest["p"]).when(F.length(whole) >= LEAST, whole)


def encoding_of(part: Column) -> Column:
    """The smallest alphabet that has all characters; null for digits alone."""
    return (
        F.when(part.rlike("^[0-9]+$"), F.lit(None))
        .when(part.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(part.rlike("^(?:[a-z]+|[A-Z]+)$"), F.lit("base26"))
        .when(part.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(part.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), F.lit("base36"))
        .when(part.isNotNull(), F.lit("base64"))
    )


def _level(part: Column, encoding: str) -> Column:
    """The step of log10 of the e-value; -1 where it is less than 1 or the battery finds structure."""

    def judged(x: Column) -> Column:
        # Weak evidence needs no battery.
        weak = F.when(x["log"] < 0, True).otherwise(_battery(x["text"], encoding) < LOST)
        return F.when(weak, -1).otherwise(F.least(F.floor(x["log"] / STEP), F.lit(STEPS))).cast("int")

    return _let(part if encoding == "base64" else F.lower(part), lambda t: _let(F.struct(t.alias("text"), _evidence(t, encoding).alias("log")), judged))


def found(docs: DataFrame, *keep: str, rest: bool = False) -> DataFrame:
    """doc_id, the base spans by kind and the candidates with band and level.

    Candidates are sought in what the base spans leave. rest: that too, as
    `text`, with spaces in place of the spans.
    """
    left = ["text"] * rest
    t = docs.select("doc_id", "text", *keep)
    t = add_spans(t, "text", "assign", ASSIGN, F.col("text").rlike("[:=]"))
    # The pattern's own second group, for its length.
    t = t.withColumn("assign", F.when(F.size("assign") > 0, F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 12)).otherwise(F.col("assign")))
    t = add_spans(t, "text", "access", ACCESS, F.contains("text", F.lit("AKIA")))
    t = add_spans(t, "text", "hex", HEX)
    t = add_union(t, [(F.col(k), "") for k in BASE], "_u")
    t = settled(t.withColumn("text", replaced(F.col("text"), "_u", like=True)).drop("_u"))
    t = add_spans(t, "text", "_c", CANDIDATE)

    def judged(x: Column, part: Column, encoding: Column) -> Column:
        level = F.lit(None).cast("int")
        for name in CELLS:
            level = F.when(encoding == name, _level(part, name)).otherwise(level)
        band = F.least(F.floor(F.length(part) / BAND), F.lit(BANDS)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat_ws("/", encoding, band.cast("string")).alias("band"), level.alias("level"))

    def with_part(x: Column) -> Column:
        part = tested_part(x["match"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), part.alias("part"), encoding_of(part).alias("encoding"))

    plain = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in BASE]
    t = settled(t.select("doc_id", *left, *keep, *plain, F.when(F.size("_c") > 0, F.filter(F.transform("_c", with_part), lambda x: x["encoding"].isNotNull())).alias("_c")))
    none = F.array().cast("array<struct<start:int,end:int,band:string,level:int>>")
    return t.select("doc_id", *left, *keep, *BASE, F.when(F.size("_c") > 0, F.transform("_c", lambda x: judged(x, x["part"], x["encoding"]))).otherwise(none).alias("candidates"))


def thresholds(rows: DataFrame) -> dict[str, int]:
    """For each band the least level that is reported.

    Benjamini and Hochberg's procedure for e-values, on counts: the level is
    the least whose e-value reaches the band's candidates over FALSE times
    those at or above it. At most bands times encodings times steps counts
    reach the driver.
    """
    counts: dict[str, dict[int, int]] = {}
    for r in rows.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.level").count().collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    out = {}
    for band, n in counts.items():
        total, above, out[band] = sum(n.values()), 0, STEPS + 1
        for level in sorted(n, reverse=True):
            above += n[level]
            if level >= 0 and 10 ** (level * STEP) >= total / (FALSE * above):
                out[band] = level
    return out


def scan(docs: DataFrame, *keep: str, rest: bool = False) -> DataFrame:
    """doc_id, `keep`, and an array of struct(start, end) for each of KINDS; rest: as for `found`.

    A null or empty text has no spans. Repeated rows count each in the bands.
    The patterns' work on a text is written to the shared folder once, so that
    the second look at the candidates reads no text.
    """
    rows = written(found(docs, *keep, rest=rest), "secrets")
    limits = thresholds(rows)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.lit(None).cast("map<string,int>")
    secret = F.transform(F.filter("candidates", lambda x: x["level"] >= F.element_at(limit, x["band"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return rows.withColumn("random", secret).drop("candidates")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row for each row of `docs`.

    spans: those of the patterns and of the battery, by start and then kind.
    Null and empty texts have none; an empty table gives no rows.
    """
    kinds = [(k, F.col(k)) for k in KINDS]
    return scan(texts(docs)).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(kinds[:3], by_start=True), 256).alias("base_sha256"),
        joined(kinds, by_start=True).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """The rows of `docs` with every span of their text replaced by `mask`, and n_chars set anew.

    A null text stays null. Spans that overlap are replaced as one.
    """
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != "text"]
    # A row has its text once: what lies outside all spans is the same in what the base spans leave.
    boxed = docs.select(F.struct(F.col("text").isNull().alias("none"), *[F.struct(*others).alias("all")] * bool(others)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    clean = add_union(scan(boxed, rest=True).select("doc_id", "text", *KINDS), [(F.col(k), mask) for k in KINDS], "_spans")
    clean = clean.select("doc_id", F.when(~F.col("doc_id.none"), replaced(F.col("text"), "_spans")).alias("_text"))
    return clean.select(*[F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"doc_id.all.`{c}`").alias(c) for c in names])
