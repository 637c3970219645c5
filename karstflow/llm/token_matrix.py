"""Token ids as packed matrices: best-fit-decreasing with a segment tree.

A task reads its share of the documents, encodes them and cuts texts longer
than a row into pieces. When it holds a bounded number of ids, it packs them:
the longest piece first, each into the open row whose free space is the least
that takes it, found by a segment tree over free spaces. Nothing is shuffled,
so neither a hot key nor a lost executor touches more than one task's share.

A row of the matrix has the ids of its pieces end to end, the cumulative
lengths at which they begin and end, and position ids that restart at 0 with
each piece, counted on from the piece's place in its document if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm.bpe import RoundsBPE, default_vocabulary, encoded_rows, tokenizer
from karstflow.llm.common import texts

#: Ids that a task holds before it packs them; the last group of a task is smaller.
GROUP = 1_000_000


class FreeSpace:
    """Open rows by free space. A node of the tree counts the open rows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, free: int, n: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(row, free) of the open row with the least free space of at least `length`."""
        at = self.leaves + length
        if not self.count[at]:
            # Up to the first node with something to its right, then down to its least leaf.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Rows of indexes into `lengths` (each 1 to `window`); equal lengths in their order."""
    space, rows = FreeSpace(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = space.take(lengths[i])
        row, free = found or (len(rows), window)
        if not found:
            rows.append([])
        rows[row].append(i)
        if free > lengths[i]:
            space.put(row, free - lengths[i])
    return rows


def pack(docs: DataFrame, path: str | None = None, window: int = 4096, end_id: int | None = 2, continued: bool = False) -> DataFrame:
    """sequence_id, ids, cu_seqlens, positions, doc_ids, starts: one row for each row of the matrix.

    ids and positions: little-endian 32-bit. doc_ids and starts: each piece's
    document and the ids of it that lie in earlier pieces. sequence_id: unique,
    the task's number in its high half. continued: positions count on from
    `starts`. A null or empty text is its end id alone, or nothing without an
    end id. Repeated rows are packed each. An empty table gives no rows.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, tail = tokenizer(path, RoundsBPE), b"" if end_id is None else end_id.to_bytes(4, "little")
        made = TaskContext.get().partitionId() << 32
        pieces: list[tuple[int | None, int, bytes]] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            length = np.fromiter((len(x[2]) // 4 for x in pieces), np.int64, len(pieces))
            rows = best_fit_decreasing(length.tolist(), window)
            own = [pieces[i] for row in rows for i in row]
            count = np.fromiter(map(len, rows), np.int64, len(rows))
            length = length[[i for row in rows for i in row]]
            # Bounds of pieces among all ids, and of rows among the pieces.
            at, first = np.concatenate(([0], np.cumsum(length))), np.concatenate(([0], np.cumsum(count)))
            begin = np.array([x[1] for x in own], np.int64)
            positions = np.arange(at[-1]) - np.repeat(at[:-1] - (begin if continued else 0), length)
            # A row's cumulative lengths: 0, then the end of each piece.
            ends = np.zeros(len(own) + len(rows), np.int32)
            ends[np.arange(len(own)) + np.repeat(np.arange(len(rows)), count) + 1] = at[1:] - np.repeat(at[first[:-1]], count)
            numbers = np.arange(made, made + len(rows))
            made += len(rows)
            lists = [pa.array(first.astype(np.int32)), pa.array((first + np.arange(len(first))).astype(np.int32))]
            cut = pa.py_buffer((4 * at[first]).astype(np.int32).tobytes())

            def binary(raw: bytes) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(rows), [None, cut, pa.py_buffer(raw)])

            out = [
                pa.array(numbers), binary(b"".join(x[2] for x in own)), pa.ListArray.from_arrays(lists[1], pa.array(ends)), binary(positions.astype("<u4").tobytes()),
                pa.ListArray.from_arrays(lists[0], pa.array([x[0] for x in own], pa.int64())), pa.ListArray.from_arrays(lists[0], pa.array(begin)),
            ]
            pieces.clear()
            return pa.record_batch(out, ["sequence_id", "ids", "cu_seqlens", "positions", "doc_ids", "starts"])

        for batch in batches:
            for key, ids in encoded_rows(batch, bpe):
                ids += tail
                for at in range(0, len(ids), 4 * window):
                    pieces.append((key, at // 4, ids[at : at + 4 * window]))
                held += len(ids) // 4
                if held >= GROUP:
                    yield packed()
                    held = 0
        yield packed()

    return texts(docs).mapInArrow(run, "sequence_id long, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>")


def write(packed: DataFrame, path: str) -> DataFrame:
    """Store a packed matrix, a record for each of its rows, and read it again."""
    packed.write.parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the pieces in a packed matrix: what `pack` cut, again."""
    piece = F.explode(F.arrays_zip("doc_ids", "starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("b"))).alias("p")
    return packed.select("ids", piece).select(F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.expr("substring(ids, 4 * p.a + 1, 4 * (p.b - p.a))").alias("ids"))


def query(docs: DataFrame) -> DataFrame:
    """The matrix's rows with digests in place of ids and positions; `write` would store them.

    sequence_id, n_tokens, n_segments, doc_ids, starts, cu_seqlens, ids_sha256,
    positions_sha256. Null and empty texts are their end id; repeated rows are
    packed each; an empty table gives no rows.
    """
    return pack(docs).select(
        "sequence_id",
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"),
        F.size("doc_ids").cast("long").alias("n_segments"),
        "doc_ids",
        "starts",
        "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("positions", 256).alias("positions_sha256"),
    )
