"""Which of many phrases stand in which of many texts, by equality and not by trying every pair.

A text is cut where a phrase may begin or end, what is as long as some phrase
becomes rows, and those are joined with the phrases. So the work grows with
the texts and the phrases, not with their product.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.functions import text as T

#: A run of letters and digits, or any other character: phrases begin and end between two of these.
_PIECE = "[a-z0-9]+|[^a-z0-9]"
#: Rows that a task hands on at once.
_ROWS = 50_000


def _rows(each: Callable[..., Iterator[tuple]], *names: str):
    """For mapInArrow: the rows that `each` gives for a row's values; the first column keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in each(*values):
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield packed(rows, kind)
                        rows = []
        if rows:
            yield packed(rows, kind)

    def packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        first, *others = zip(*rows, strict=True)
        return pa.record_batch([pa.array(first, kind), *(pa.array(x, pa.int32() if isinstance(x[0], int) else pa.string()) for x in others)], list(names))

    return run


def _runs(sizes: list[int]):
    """The distinct runs of so many pieces of a text with no letter or digit beside them."""

    def each(key, text: str) -> Iterator[tuple]:
        found = re.findall(_PIECE, text)
        open_ = [True, *(not re.match("[a-z0-9]", x) for x in found), True]  # [i]: nothing stands in the way before piece i, [i + 1]: nor after piece i - 1
        n = len(found)
        return ((key, x) for x in {"".join(found[i : i + c]) for i in range(n) if open_[i] for c in sizes if i + c <= n and open_[i + c + 1]})

    return _rows(each, "id", "run")


def standing(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase), each pair once: `T.has_phrase` of texts (id, text) and phrases (phrase)."""
    known = phrases.select("phrase", F.lower("phrase").alias("run")).filter("run <> ''").distinct()
    sizes = sorted(r.n for r in known.select(F.size(F.regexp_extract_all("run", F.lit(_PIECE), F.lit(0))).alias("n")).distinct().collect())
    rows = texts.filter("text IS NOT NULL").select("id", F.lower("text").alias("text"))
    return rows.mapInArrow(_runs(sizes), f"id {texts.schema['id'].dataType.simpleString()}, run string").join(known, "run").select("id", "phrase").distinct()


def named(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase), each pair once: phrases that stand in a text as they are or by `token_key`; those without a key never do."""
    known = phrases.select("phrase", T.token_key(F.col("phrase")).alias("_k")).filter("_k <> ''").distinct()
    keyed = standing(texts.select("id", T.token_key(F.col("text")).alias("text")), known.select(F.col("_k").alias("phrase")))
    return standing(texts, known).unionByName(keyed.withColumnRenamed("phrase", "_k").join(known, "_k").select("id", "phrase")).distinct()


def _windows(most: int):
    """The distinct windows of a text: a part and so many characters after it, and how many places are the part's own."""

    def each(key, parts: list[str]) -> Iterator[tuple]:
        found = set()
        for i, part in enumerate(parts):
            tail, k = "", i + 1
            while len(tail) < most and k < len(parts):
                tail, k = f"{tail}-{parts[k]}", k + 1
            found.add((key, part + tail[:most], len(part)))
        yield from found

    return _rows(each, "id", "window", "own")


def _strings(lengths: list[int]):
    """The distinct strings of such lengths that begin in a window's own places."""

    def each(window: str, own: int) -> Iterator[tuple]:
        return ((window, own, x) for x in {window[i : i + n] for n in lengths for i in range(min(own, len(window) - n + 1))})

    return _rows(each, "window", "own", "string")


def inside(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(id, string), each pair once: strings (string) that a text contains anywhere.

    texts: id and parts, an array that stands for its parts joined by hyphens;
    no string begins with a hyphen. Windows that several texts have are
    searched once.
    """
    known = strings.select("string").filter("string <> ''").distinct()
    lengths = sorted(r.n for r in known.select(F.length("string").alias("n")).distinct().collect())
    windows = texts.select("id", "parts").mapInArrow(_windows(max(lengths, default=0)), f"id {texts.schema['id'].dataType.simpleString()}, window string, own int")
    found = windows.select("window", "own").distinct().mapInArrow(_strings(lengths), "window string, own int, string string").join(known, "string")
    return windows.join(found, ["window", "own"]).select("id", "string").distinct()
