"""Packing by minimum bin slack.

A text's ids and the end id make its piece; what fills whole windows is cut
off first. The rest, shorter than a window, is known by its length alone, so
the corpus is a histogram of at most `window - 1` lengths, however large it
is. On that histogram the driver fills one window at a time: its largest
length left is set, and a bitset of reachable sums (one Python integer, a
shift for each length) finds the lengths left that come closest to the
capacity; the counts of each length are tracked back through the bitsets. A
filling is used as often as the histogram allows, so there are about as many
fillings as lengths.

The plan has a row for each length in a filling. A piece finds its sequence
from its rank among the pieces of its length. Ids never move: only ids of
documents, lengths and checksums are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm.bpe import RoundsBPE, default_vocabulary, encoded_rows, tokenizer
from karstflow.llm.common import dense_rank_in_groups, parallelism, texts, written


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length come closest to `room` without passing it.

    counts: how many there are of each length. Longer ones go first, and the
    search stops as soon as the room is filled to the last place.
    """
    limit = (1 << room + 1) - 1
    sums, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... and the rest of its copies reach every count
            k = min(many, left)
            steps.append((length, k, sums))
            sums |= sums << length * k & limit
            left, many = left - k, many * 2
        if sums >> room & 1:
            break
    best = sums.bit_length() - 1
    used: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            best -= length * k
            used[length] = used.get(length, 0) + k
    return used


def minimum_bin_slack(histogram: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings (times, [(length, count), ...]) that use the whole histogram."""
    left = {k: n for k, n in histogram.items() if n}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = fill({k: n for k, n in left.items() if n}, window - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def _plan(fillings: list[tuple[int, list[tuple[int, int]]]]) -> list[np.ndarray]:
    """Columns (length, first rank, count in a sequence, first sequence, first offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in fillings:
        offset = 0
        for length, count in used:
            rows.append((length, rank.get(length, 0), count, sequence, offset))
            rank[length] = rank.get(length, 0) + times * count
            offset += length * count
        sequence += times
    return list(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def _pieces(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), one row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tail = tokenizer(path, RoundsBPE), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for key, ids in encoded_rows(batch, bpe):
                ids += tail
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    out.append((key, start, len(part) // 4, zlib.crc32(part), total))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, window: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Sequences hold at most `window` ids; sequence ids and the offsets in each
    are gapless. A null or empty text is its end id alone. Repeated rows are
    packed each. An empty table gives no rows. Pieces of one length are ranked
    over many tasks, though a third of them may be copies.
    """
    path = path or default_vocabulary()
    pieces = written(_pieces(docs, path, window, end_id).withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    full, rest = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window)
    # At most window - 1 rows.
    histogram = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}
    fillings = minimum_bin_slack(histogram, window)
    length, first, count, sequence, offset = _plan(fillings)
    # Ranks of a length begin with the length's own block of this key.
    block = np.int64(1 << 40)
    at = length * block + first
    filled = sum(times for times, _ in fillings)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(at, own * block + rank, side="right") - 1
            n = rank - first[k]
            seats = [pa.array(sequence[k] + n // count[k]), pa.array(offset[k] + n % count[k] * own)]
            yield pa.record_batch([*batch.columns[:5], *seats], [*batch.schema.names[:5], "sequence_id", "offset"])

    buckets = max(16, parallelism(docs.sparkSession))
    order = [F.col("doc_id"), F.col("start"), F.col("_uid")]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"])
    ranked = dense_rank_in_groups(rest, ["length"], order, F.col("_uid"), "rank", buckets)
    seated = ranked.select(*names, "rank").mapInArrow(seat, schema)
    whole = dense_rank_in_groups(full.withColumn("_all", F.lit(0)), ["_all"], order, F.col("_uid"), "rank", buckets)
    return seated.unionByName(whole.select(*names, (F.col("rank") + filled).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def query(docs: DataFrame) -> DataFrame:
    """`pack` with the contract's vocabulary, window of 4,096 and end id 2."""
    return pack(docs)
