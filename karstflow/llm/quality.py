"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text. The ledger keeps its measurements and
one bit for each rule that the text fails. Policies are versioned masks over
those bits, and ablations are counts over them, so neither reads a text again.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import settled, texts, words_of, written

#: Words of the windows that count as repeated.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the ledger's measurements


#: Bits are never given anew: a stored ledger stays readable.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "n_words > 0 AND 2 * n_symbols > n_words * 3"),
    Rule(3, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule(4, "duplicate_lines", "n_lines > 3 AND 10 * n_dup_lines > 6 * n_lines"),
    Rule(5, "few_letters", "n_words > 0 AND 2 * n_letters < word_chars"),
)

#: What each version rejects. A text is kept if it fails none of the mask's rules.
POLICIES = {1: 0b000011, 2: 0b111111}


def mask_of(*names: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each 8-word window of a text, in order; null where there is none."""
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits, one row for each row of `docs`.

    A null or empty text has no words and fails too_few_words. Repeated rows
    are judged one by one alike. A line is what lies between \\n; only lines
    with a word count as lines or duplicates.
    """
    t = texts(docs)
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    split = t.select("doc_id", words_of(F.col("text")).alias("_w"), symbols.cast("long").alias("n_symbols"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"), F.length(F.regexp_replace("text", "[^\\p{L}\\p{M}]+", "")).cast("long").alias("n_letters"))
    measured = split.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join("_w", "")), F.lit(0)).cast("long").alias("word_chars"),
        "n_symbols",
        "n_letters",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("_w")).alias("_h"),
    )
    # Most texts repeat no window and stop here; of the others, windows are sorted by hash, those with an equal neighbour kept, and the words they cover counted once.
    repeats = F.size("_h") > F.size(F.array_distinct("_h"))
    sorted_ = measured.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    last = F.size("_s") - 1
    twice = F.filter(
        "_s",
        lambda x, k: ((k > 0) & (F.get(F.col("_s"), k - 1)["h"] == x["h"])) | ((k < last) & (F.get(F.col("_s"), k + 1)["h"] == x["h"])),
    )
    placed = sorted_.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1), p + WINDOW) - p)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    counted = placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES[1:]), F.when(F.expr(RULES[0].fails), F.lit(1 << RULES[0].bit)).otherwise(F.lit(0)))
    return settled(counted.withColumn("fail_bits", bits.cast("long")))


def verdicts(book: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """The ledger with base_failed (rules 0 and 1) and kept under a policy."""
    return book.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(POLICIES[1])) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(POLICIES[1] | POLICIES[version])) == 0,
        "policy": F.lit(version),
    })


def ablations(book: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that would be kept without it.

    One pass over the bits: rows are first counted by their masked bits (at
    most 2 ** rules of them), and bit_or and bit_and over those counts say
    which rules ever fire and which fire always.
    """
    mask = POLICIES[version]
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in RULES if mask >> r.bit & 1])).alias("r")
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    kept_without = F.col("bits").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("r.bit"))) == 0
    return patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(fails & kept_without, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(kept_without, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("any_bits"),
        F.bit_and("bits").alias("all_bits"),
    )


def keep_clean(docs: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """The rows of `docs`, all columns, that the policy keeps.

    Judged beside the row itself, so that repeated or null ids need no join.
    """
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), F.col("text"))
    return verdicts(ledger(boxed), version).filter("kept").select("doc_id.*")


def query(docs: DataFrame) -> DataFrame:
    """The stored ledger under the current policy: doc_id, measurements, base_failed, kept, fail_bits, policy.

    The ledger is written before a policy is applied, as other policies and
    ablations would read it. One row for each row of `docs`; null and empty
    texts fail too_few_words; an empty table gives no rows.
    """
    return verdicts(written(ledger(docs), "ledger")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_letters", "n_lines", "fail_bits", "policy")


#: The query in SQL: every rule by its definition, windows compared word by word.
SQL = """WITH w AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
n AS (SELECT r, doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l FROM w),
g AS (SELECT r, unnest(range(1, len(w) - 6)) i, w FROM w WHERE len(w) >= 8), h AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') g FROM g),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) k FROM h), p AS (SELECT r, count(DISTINCT pos_) n FROM (SELECT r, unnest(range(i, i + 8)) pos_ FROM c WHERE k > 1) GROUP BY r),
m AS (SELECT doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, length(regexp_replace(t, '[^\\p{L}\\p{M}]+', '', 'g')) n_letters, len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(p.n, 0) n_repeat_words FROM n LEFT JOIN p ON p.r = n.r),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN n_words > 0 AND 2 * n_symbols > n_words * 3 THEN 4 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 8 ELSE 0 END + CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 6 * n_lines THEN 16 ELSE 0 END + CASE WHEN n_words > 0 AND 2 * n_letters < word_chars THEN 32 ELSE 0 END fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 base_failed, fail_bits = 0 kept, 2 policy FROM b"""
