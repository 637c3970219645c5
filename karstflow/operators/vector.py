"""Vector search by exact cosine similarity, in double precision.

Queries, a stated set, are taken in blocks of bounded size; each task holds a
block and multiplies its own items with it as matrices, a batch at a time,
keeping the best of each query. So what is exchanged are k rows for each query
and task, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karstflow.session import written

#: Queries that every task holds at once.
BLOCK = 4096
#: Stands for the number of an item without one: farther than any.
NO_NUMBER = 1 << 40
#: Scores that a task holds at once.
SCORES = 1 << 19


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two vectors; null where one is null or has no length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors by their length; those without one become not-a-number and have no similarity."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _leaders(ids: list, questions: np.ndarray, k: int, floor: float, by_label: bool, places: int):
    """For mapInArrow over (item_id, embedding, label): the best of each query, and label, in the task.

    A list of a query, or of a query and label, is a cell. What reaches the
    score of a cell's last so far is gathered and cut to k a cell again when it
    has become as much as was kept, so nothing is done by query and item but a
    product and a comparison, and memory is bounded by SCORES and k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, types, known, own = len(ids), None, {}, []
        least = np.full((1, n), floor)
        step, slack, most, new = max(1, SCORES // n), 10.0**-places, SCORES, 0

        def cut(rows: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
            cells, values, names, groups = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((names, -values, cells))
            cells, values = cells[order], values[order]
            place = np.arange(len(cells)) - np.searchsorted(cells, cells)
            last = place == k - 1
            least.reshape(-1)[cells[last]] = values[last]
            first = place < k
            return [(cells[first], values[first], names[order][first], groups[order][first])]

        for batch in batches:
            if not batch.num_rows:
                continue
            types = batch.schema
            items, labels = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(2).to_pylist(), object)
            items = np.array(items.tolist()) if items.dtype == object else items
            codes = np.array([known.setdefault(x, len(known)) for x in labels.tolist()]) if by_label else np.zeros(len(items), int)
            if len(known) > len(least):
                least = np.concatenate([least, np.full((len(known) - len(least), n), floor)])
            vectors = _unit(_matrix(batch.column(1)))
            for at in range(0, len(items), step):
                scores = vectors[at : at + step] @ questions.T
                code = codes[at : at + step]
                rows, q = np.nonzero(scores >= (least[code] if by_label else least) - slack)
                values = np.round(scores[rows, q], places)
                good = values >= least[code[rows], q]
                rows, q, values = rows[good], q[good], values[good]
                own.append((code[rows] * n + q, values, items[at + rows], labels[at + rows]))
                new += len(rows)
                if new >= most:
                    own, new = cut(own), 0
                    most = max(SCORES, len(own[0][0]))
        if own:
            cells, values, names, groups = cut(own)[0]
            for at in range(0, len(cells), SCORES):
                some = slice(at, at + SCORES)
                yield pa.record_batch([pa.array([ids[q] for q in cells[some] % n]), pa.array(names[some], types.field(0).type), pa.array(groups[some].tolist(), types.field(2).type), pa.array(values[some], pa.float64())], ["query_id", "item_id", "label", "score"])

    return run


def _ranked(items: DataFrame, queries: DataFrame, k: int, floor: float, by_label: bool, places: int) -> DataFrame:
    asked = queries.filter(F.col("query_embedding").isNotNull()).select("query_id", "query_embedding")
    label = F.col("label") if "label" in items.columns else F.lit(None).cast("string").alias("label")
    rows = items.filter(F.col("embedding").isNotNull()).select("item_id", "embedding", label)
    schema = T.StructType([asked.schema["query_id"], rows.schema["item_id"], T.StructField("label", rows.schema["label"].dataType), T.StructField("score", T.DoubleType())])
    names = [r.query_id for r in asked.select("query_id").orderBy("query_id").toLocalIterator()] if asked.limit(BLOCK + 1).count() > BLOCK else None
    parts = [asked] if names is None else [asked.filter(F.col("query_id").between(names[a], names[min(a + BLOCK, len(names)) - 1])) for a in range(0, len(names), BLOCK)]
    found = []
    for part in parts:
        block = part.toArrow()
        if block.num_rows:
            questions = _unit(_matrix(block["query_embedding"].combine_chunks()))
            found.append(rows.mapInArrow(_leaders(block["query_id"].to_pylist(), questions, k, floor, by_label, places), schema))
    if not found:
        return items.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    w = W.partitionBy("query_id", *(["label"] if by_label else [])).orderBy(F.col("score").desc(), "item_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(items: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, places: int = 6) -> DataFrame:
    """(query_id, item_id, label, score, rank): the k most similar items of each query; ties go to the lesser item_id.

    items: item_id, embedding and, if wanted, label; queries: query_id,
    query_embedding. Filters come first, so they lose nothing. Vectors that are
    null or have no length are no items.
    """
    return _ranked(items if where is None else items.filter(where), queries, k, -np.inf, False, places)


def nearest_by_label(items: DataFrame, queries: DataFrame, k: int = 10, floor: float = 0.11, places: int = 6) -> DataFrame:
    """The k most similar items of each label for each query, at or above a floor."""
    return _ranked(items, queries, k, floor, True, places)


def nearest_numbers(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k items whose number is nearest to the query's; ties go to the lesser item_id.

    items: item_id, n; queries: query_id, at. Items without a number come last.
    Items are put in order once, with places: those wanted are among the k
    before and the k after a query's own place, which are in four parts of k
    places, so a query meets these parts and not every item. Of equal numbers
    the first k can be wanted.
    """
    known = items.select("item_id", F.coalesce(F.col("n").cast("long"), F.lit(NO_NUMBER)).alias("n"))
    kept = written(known.withColumn("_r", F.row_number().over(W.partitionBy("n").orderBy("item_id"))).filter(F.col("_r") <= k), "numbers")
    sizes = kept.groupBy("n").agg(F.count(F.lit(1)).alias("_c")).select("n", "_c", F.lit(0).alias("_q"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"))
    asked = queries.select(F.col("at").cast("long").alias("n"), F.lit(0).cast("long").alias("_c"), F.lit(1).alias("_q"), "query_id")
    # One row for each number that there is and each query, in one order.
    places = written(sizes.unionByName(asked).withColumn("_so", F.sum("_c").over(W.orderBy("n", "_q").rowsBetween(W.unboundedPreceding, 0))), "places")
    placed = kept.join(places.filter("_q = 0").select("n", "_c", (F.col("_so") - F.col("_c")).alias("_before")), "n")
    sides = F.array(F.struct(F.lit(0).alias("_side"), (F.col("_before") + F.col("_c") - F.col("_r")).alias("_at")), F.struct(F.lit(1).alias("_side"), (F.col("_before") + F.col("_r") - 1).alias("_at")))
    placed = placed.select("item_id", "n", F.explode(sides).alias("x")).select("item_id", "n", "x.*", F.floor(F.col("x._at") / k).alias("_part"))
    ends = F.array(*[F.struct(F.lit(side).alias("_side"), F.lit(side * k).cast("long").alias("_to"), (F.floor((F.col("_so") - 1 + side) / k) + more).alias("_part")) for side, more in ((0, 0), (0, -1), (1, 0), (1, 1))])
    wanted = places.filter("_q = 1").select("query_id", F.col("n").alias("at"), "_so", F.explode(ends).alias("x")).select("query_id", "at", "_so", "x.*")
    near = placed.join(wanted, ["_side", "_part"]).filter((F.col("_at") < F.col("_so") + F.col("_to")) & (F.col("_at") >= F.col("_so") + F.col("_to") - k))
    near = near.select("query_id", "item_id", (-F.abs(F.col("n") - F.col("at"))).alias("score"))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id"))).filter(F.col("rank") <= k)


def with_rows(ranked: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """Late materialisation: the ranked few beside their wide rows."""
    return ranked.join(wide, key)


def embed(rows: DataFrame, provider, column: str = "text", batch: int = 200) -> DataFrame:
    """`rows` with an `embedding` from provider(list of texts) -> list of vectors, asked in batches."""

    def run(frames):
        for frame in frames:
            vectors = []
            for at in range(0, len(frame), batch):
                vectors += provider(frame[column].iloc[at : at + batch].tolist())
            yield frame.assign(embedding=vectors)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
