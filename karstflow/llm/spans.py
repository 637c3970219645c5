"""Regular expression matches with their places, from DataFrame functions only.

Spark gives the matches of a pattern but not where they lie. The gaps between
them, from a split by the same pattern, and running sums of the lengths of
gaps and matches give the places, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import settled

#: Elements that a running sum copies at once: a text's work grows with its matches times this.
_RUN = 128


def _sums(xs: Column) -> Column:
    """Running sums with a leading 0."""
    return F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def add_places(df: DataFrame, matches: str, gaps: Column, name: str) -> DataFrame:
    """Add `name`, an array of struct(start, end, match), for an array column of matches.

    gaps: what lies between the matches; evaluated only where there are some.
    """
    g, b, s = f"_{name}_g", f"_{name}_b", f"_{name}_s"
    some = F.size(matches) > 0
    df = df.withColumn(g, F.when(some, F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda x, m: F.struct(F.length(x).alias("gap"), F.length(m).alias("len"), m.alias("m")))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(g) - 1) / _RUN).cast("int")), lambda i: F.slice(F.col(g), i * _RUN + 1, _RUN))
    df = df.withColumn(b, F.when(some, F.transform(blocks, lambda x: F.struct(x.alias("x"), _sums(F.transform(x, lambda e: e["gap"] + e["len"])).alias("sums"))))).drop(g)
    df = df.withColumn(s, F.when(some, _sums(F.transform(b, lambda x: F.element_at(x["sums"], -1)))))
    placed = F.flatten(F.zip_with(F.slice(s, 1, F.size(b)), b, lambda at, x: F.zip_with(x["x"], F.slice(x["sums"], 2, F.size(x["x"])), lambda e, end: F.struct((at + end - e["len"]).alias("start"), (at + end).alias("end"), e["m"].alias("match")))))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return df.withColumn(name, F.when(some, placed).otherwise(none)).drop(b, s)


def add_spans(df: DataFrame, text: str, name: str, pattern: str, likely: Column | None = None) -> DataFrame:
    """Add `name`, an array of struct(start, end, match): the leftmost non-overlapping matches in order.

    likely: a cheap test without which there is no match. The pattern never
    matches the empty text.
    """
    m = f"_{name}_m"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if likely is not None:
        found = F.when(likely, found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(m, found)
    return add_places(df, m, F.split(text, pattern, -1), name).drop(m)


def joined(kinds: list[tuple[str, Column]], by_start: bool) -> Column:
    """`kind:start:end` of arrays of spans, comma-joined, by start and then kind as listed, or by kind and then start."""

    def keyed(order: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct((x["start"] if by_start else F.lit(order)).alias("a"), (F.lit(order) if by_start else x["start"]).alias("b"), x["end"].alias("c"), F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")).alias("s")))

    parts = [keyed(order, kind, spans) for order, (kind, spans) in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda x: x["s"]), ",")


def _last_ends(spans: Column) -> Column:
    """The greatest end of each span and those before it: a running maximum in blocks of _RUN."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _RUN).cast("int")), lambda i: F.slice(spans, i * _RUN + 1, _RUN))

    def most(ends: Column) -> Column:
        return F.aggregate(ends, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.greatest(F.coalesce(F.try_element_at(a, F.lit(-1)), x), x))))

    inside = F.transform(blocks, lambda b: most(F.transform(b, lambda x: x["end"])))
    carried = F.transform(F.array(inside), lambda y: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(most(F.transform(y, lambda b: F.element_at(b, -1))), 1, F.size(y) - 1)), y, lambda c, b: F.transform(b, lambda e: F.greatest(c, e))))
    return F.flatten(F.element_at(carried, 1))


def add_union(df: DataFrame, kinds: list[tuple[Column, str | Callable[[Column], Column]]], name: str) -> DataFrame:
    """Add `name`: the spans of (spans, mask or mask of a span) kinds as disjoint struct(start, end, mask) in order.

    Spans that overlap become one, whose mask is that of the first: the one
    that begins first, then the kind listed first. Work is linear in the spans.
    """
    e, m, f = f"_{name}_e", f"_{name}_m", f"_{name}_f"

    def keyed(order: int, spans: Column, mask: str | Callable[[Column], Column]) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end"), (F.lit(mask) if isinstance(mask, str) else mask(x)).alias("mask")))

    every = F.concat(*[keyed(i, k, mask) for i, (k, mask) in enumerate(kinds)])
    df = df.withColumn(e, F.when(F.size(every) > 0, F.sort_array(every)))
    df = settled(df.withColumn(m, F.when(F.col(e).isNotNull(), _last_ends(F.col(e)))))
    firsts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(F.col(e), i)["start"] >= F.get(F.col(m), i - 1)))
    df = settled(df.withColumn(f, F.when(F.col(e).isNotNull(), firsts)))
    # A group ends where the next one begins.
    spans = F.transform(f, lambda i, k: F.struct(F.get(F.col(e), i)["start"].alias("start"), F.get(F.col(m), F.coalesce(F.get(F.col(f), k + 1), F.size(e)) - 1).alias("end"), F.get(F.col(e), i)["mask"].alias("mask")))
    none = F.array().cast("array<struct<start:int,end:int,mask:string>>")
    return settled(df.withColumn(name, F.coalesce(spans, none)).drop(e, m, f))


def replaced(text: Column, spans: str, like: bool = False) -> Column:
    """`text` with each of the spans of a column of `add_union` replaced by its mask.

    like: by as many spaces as the span is long, so that places stay. The text
    is cut as UTF-32, where a place is an offset, so work is linear.
    """
    x, most = F.col(spans), F.lit(2147483647)

    def part(raw: Column, start: Column, length: Column) -> Column:
        return F.decode(F.substring(raw, 4 * start + 1, length), "UTF-32")

    def mask(s: Column) -> Column:
        return F.repeat(F.lit(" "), s["end"] - s["start"]) if like else s["mask"]

    def walked(raw: Column) -> Column:
        at = lambda i: F.when(i > 0, F.get(x, i - 1)["end"]).otherwise(F.lit(0))
        parts = F.transform(x, lambda s, i: F.concat(part(raw, at(i), 4 * (s["start"] - at(i))), mask(s)))
        return F.concat(F.array_join(parts, ""), part(raw, F.element_at(x, -1)["end"], most))

    return F.when(F.size(x) > 0, F.element_at(F.transform(F.array(F.encode(text, "UTF-32")), walked), 1)).otherwise(text)
