"""Personal data: fixed patterns, and terms that give away whom they stand beside.

What the patterns find are protected entities. All other words of the
documents in which an entity stands are its context. Over the whole corpus,
the documents that a term shares with an entity are counted, as are all
documents of the term and of the entity. The posterior n(t, e) / (n(t) + 1) says how surely a reader
of the term thinks of the entity, and its ratio to the entity's share of all
documents, in bits, how much the term tells. A term beyond both thresholds is
removed if the posterior is near certainty and else generalised, wherever it
stands in any document; one document alone never brings a term there. It is
generalised to its longest beginning that some other, more frequent term has
too, so that a reader of the beginning can't think of the entity as surely; a
term without one becomes <term>. DataFrame functions only.

The patterns are those of the contract in forms that scan a text once:
possessive where nothing after could need less, and starting only where an
earlier start is impossible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import settled, texts, written
from karstflow.llm.spans import add_spans, add_union, joined, replaced

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # A start inside a run of local characters fails as the run's first does, unless a match ended there.
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    # Runs of fewer than 16 digits would be dropped anyway.
    "card": "[0-9](?:[\\x20-]?[0-9]){15,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
KINDS = (*BASE, "term")
TERM = "[\\p{L}\\p{M}\\p{N}]+"
#: Disclosure thresholds: posterior and bits beyond which a term is generalised, posterior from which it is removed.
POSTERIOR, BITS, REMOVE = 0.5, 5.0, 0.9

_SPAN = "array<struct<start:int,end:int>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+", "")
    return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))


PASSES = {
    "ip": lambda x: F.forall(F.split(x["match"], "\\."), _byte),
    "card": lambda x: F.length(_digits(x["match"])).between(16, 19) & _luhn(_digits(x["match"])),
    "phone": lambda x: F.length(_digits(x["match"])).between(8, 15),
}


def found(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, `keep`, and for each kind an array of struct(start, end, match)."""
    t = docs.select("doc_id", "text", *keep)
    likely = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        t = add_spans(t, "text", kind, pattern, likely.get(kind))
        if kind in PASSES:
            t = t.withColumn(kind, F.when(F.size(kind) > 0, F.filter(kind, PASSES[kind])).otherwise(F.col(kind)))
    return t


def _entities(kind: str) -> Column:
    """The distinct names of a kind's finds."""
    return F.array_distinct(F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["match"]) if kind in ("email", "ip") else _digits(x["match"]))))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+")), lambda t: (F.length(t) > 2) & ~t.rlike("[0-9]"))


def disclosures(rows: DataFrame) -> DataFrame:
    """(entity, term, n_e, posterior, bits) of the terms beyond the thresholds.

    Every count is over all documents, whole. Each is combined in the task that
    makes it before anything is exchanged. Pairs that can't pass are left out
    before they are made: n_te is at most n_e, and neither may be one.
    """
    own = rows.select("uid", F.explode("entities").alias("entity"))
    entities = own.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter("n_e > 1")
    term_docs = rows.select(F.explode(_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = F.lit(float(rows.count()))
    # An entity's own characters are no terms beside it.
    beside = rows.filter(F.size("entities") > 0).select("uid", F.explode(_terms(F.coalesce("_clear", "_text"))).alias("term"))
    beside = beside.join(term_docs.filter((F.col("n_t") > 1) & (F.log2(total / F.col("n_t")) >= BITS)), "term")
    pairs = beside.join(own.join(entities, "entity"), "uid").filter(F.col("n_e") > POSTERIOR * (F.col("n_t") + 1))
    # What remains of a pair is its counts.
    known = pairs.groupBy("entity", "term", "n_t", "n_e").agg(F.count(F.lit(1)).alias("n_te")).filter("n_te > 1")
    posterior = F.col("n_te") / (F.col("n_t") + 1)
    bits = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e")))
    return known.select("entity", "term", "n_e", posterior.alias("posterior"), bits.alias("bits")).filter((F.col("posterior") > POSTERIOR) & (F.col("bits") >= BITS))


def _beginnings(term: Column) -> Column:
    """The beginnings of a term, of two characters and more, without itself."""
    return F.when(F.length(term) > 2, F.transform(F.sequence(F.lit(2), F.length(term) - 1), lambda n: F.left(term, n))).otherwise(F.array().cast("array<string>"))


def general_forms(rows: DataFrame, strong: DataFrame) -> DataFrame:
    """(term, form) of strong terms (term, n_e) that have a general form: a beginning and an ellipsis.

    A beginning will do if some term that has it stands in so many documents
    that even all of the entity's leave the posterior at the threshold or below.
    """
    own = strong.select("term", "n_e", F.explode(_beginnings(F.col("term"))).alias("p"))
    vocabulary = rows.select(F.explode(_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    every = vocabulary.select("n_t", F.explode(F.concat(_beginnings(F.col("term")), F.array("term"))).alias("p"))
    most = every.join(own.select("p").distinct(), "p", "left_semi").groupBy("p").agg(F.max("n_t").alias("most"))
    good = own.join(most, "p").filter(F.col("n_e") <= POSTERIOR * (F.col("most") + 1))
    return good.groupBy("term").agg(F.concat(F.max_by("p", F.length("p")), F.lit("…")).alias("form"))


def scan(docs: DataFrame, *keep: str, forms: bool = False) -> DataFrame:
    """doc_id, `keep`, the spans of each of KINDS as struct(start, end), and of terms also the mask: nothing where they are to be removed.

    forms: whether masks are general forms where there are some; else all are
    <term>. A null or empty text has no spans. Rows are told apart by a number
    given when the patterns' finds are written, so ids may be null or repeated;
    repeated rows count each as a document.
    """
    first = found(docs.withColumn("_text", F.col("text")), "_text", *keep)
    plain = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in BASE]
    first = settled(first.select("doc_id", "_text", *keep, *plain, F.concat(*[_entities(k) for k in BASE]).alias("entities")))
    # The text without its entities, every other character in its place.
    first = add_union(first, [(F.col(k), "") for k in BASE], "_u").withColumn("_clear", F.when(F.size("_u") > 0, replaced(F.col("_text"), "_u", like=True))).drop("_u")
    rows = written(first.withColumn("uid", F.monotonically_increasing_id()), "entities")
    strong = written(disclosures(rows).groupBy("term").agg((F.max("posterior") >= REMOVE).alias("remove"), F.max("n_e").alias("n_e")), "terms")
    form = F.lit("<term>")
    if forms:
        strong = written(strong.join(general_forms(rows, strong.filter("NOT remove")), "term", "left"), "forms")
        form = F.coalesce("form", form)
    strong = strong.select("term", F.when(F.col("remove"), "").otherwise(form).alias("mask"))
    told = rows.select("uid", F.explode(_terms(F.coalesce("_clear", "_text"))).alias("term")).join(strong, "term")
    marks = written(told.groupBy("uid").agg(F.collect_list(F.struct("term", "mask")).alias("told")), "marks")
    marked = rows.drop("entities").join(marks, "uid", "left").withColumn("told", F.map_from_entries("told")).withColumn("_text", F.coalesce("_clear", "_text")).drop("_clear")
    marked = add_spans(marked, "_text", "_t", TERM, F.col("told").isNotNull())
    spans = F.filter(F.transform("_t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at("told", F.lower(x["match"])).alias("mask"))), lambda x: x["mask"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,mask:string>>")
    return marked.withColumn("term", F.when(F.size("_t") > 0, spans).otherwise(empty)).drop("uid", "_text", "told", "_t")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: one row for each row of `docs`.

    spans: those of the patterns and of disclosing terms, by kind and then
    start. Null and empty texts have none; an empty table gives no rows.
    """
    kinds = [(k, F.col(k)) for k in KINDS]
    return scan(texts(docs)).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(kinds[:4], by_start=False), 256).alias("base_sha256"),
        joined(kinds, by_start=False).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): entities become <kind>, disclosing terms their general form, <term> or nothing.

    Spans that overlap are replaced as one, by the mask of the one that begins
    first, then of the kind listed first. A null text is an empty one.
    """
    marked = scan(texts(docs), "text", forms=True)
    masks = [(F.col(k), f"<{k}>") for k in BASE]
    masks.append((F.col("term"), lambda x: x["mask"]))
    return add_union(marked, masks, "_spans").select("doc_id", replaced(F.col("text"), "_spans").alias("text"))
