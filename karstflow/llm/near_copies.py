"""Near copies by SimHash fingerprints of word shingles: an index on byte positions with a count filter, verified by exact Jaccard similarity.

A text is the set of its distinct five-word shingles, and texts of equal sets
are one node. Two nodes are linked if their sets' Jaccard similarity is at
least 0.8. By 64 SimHash bits such sets differ in up to 13 and more, which may
leave no byte equal, so the fingerprint is wider: 272 bytes at 272 positions.
A bit of sets of similarity 0.8 differs with probability 0.1515 at most (the
angle at cosine 8/9), so they share each positional byte with 0.27 and about 73
of all. Postings are kept for 128 disjoint pairs of positions: at 0.8 a pair
meets in none once in 14,000 times. Sets of a few shingles differ in more bits;
they are also listed by those of their least shingles of which a partner must
have one.

A list of two bytes has a 65,536th of unrelated fingerprints, so every posting
carries 16 more bytes, and only members with a partner in their list that
differs from them in few of those bits go on. Of fingerprints that then meet,
the shared positional bytes are tallied, and pairs with fewer than the minimum
are dropped. Only the others are verified.

No list emits all of its pairs. Members are first compared with a few that are
the least of a list of theirs; what then lies in several components is compared in blocks of
bounded size, and only across components, by fingerprints and slots, which
bound what two sets share from above. A pair is compared in the first of its
lists only. Sets are fetched for members that have a partner there, so what a
dense group of texts that are not quite similar hands on doesn't grow with the
number of its lists. The result is the same as from all pairs of the lists that
pass the count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import let_workers_import, tidy, written
from karstflow.llm.components import components
from karstflow.llm.simhash import shingle_hashes

WORDS = 5
#: Least similarity as a fraction: comparisons are of whole numbers.
LEAST = (4, 5)
#: Lists of a fingerprint, and the positions of each; after them, positions of the bytes that a posting carries.
BANDS, WIDTH, CARRIED = 128, 2, 16
POSITIONS = BANDS * WIDTH + CARRIED
#: Positional bytes that a linked pair shares at least, and the bits carried in which it differs at most.
SHARED, APART = 24, 40
#: Sets of at most so many shingles are listed by shingles too.
SMALL = 8
#: Members of a list that are compared with each other before they go on; all members of longer lists do.
SHORT = 4096
#: Rows whose postings of one pair of positions are sorted in one task, and bytes of postings handed on at once.
SLICE, AT_ONCE = 1 << 17, 1 << 20
#: Least members of its lists that a node is first compared with.
HUBS = 4
#: Bits of a set's slots, of which its shingles fill one each.
SLOTS = 4096
#: Members of a list on one side of a block, and their shingles.
SIDE, SHINGLES = 512, 1 << 20

_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, (POSITIONS // 8, 1), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_BIT, _ONES = np.arange(8, dtype=np.uint64)[:, None, None], np.uint64(0x0101010101010101)
_POSTING = np.dtype([("key", "<u2"), ("node", "<i8"), ("carried", "<u8", (CARRIED // 8,))])


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def bits_of(own: np.ndarray) -> np.ndarray:
    """The hashes of a set as wide as a fingerprint: words of 64 bits by their place, a column for each shingle."""
    x = (own[None, :] ^ _SEEDS) * _MIX[0]
    x ^= x >> _HALF
    x *= _MIX[1]
    x ^= x >> _HALF
    return x


def fingerprint(own: np.ndarray) -> bytes:
    """The SimHash of a set, a bit being 1 if set in over half of the hashes; empty for the empty set."""
    if not len(own):
        return b""
    counts = np.zeros((8, POSITIONS), np.int64)
    # Eight counts stand in the bytes of a word, so 255 hashes are added at once.
    for at in range(0, len(own), 255):
        counts += ((bits_of(own[at : at + 255])[None] >> _BIT) & _ONES).sum(axis=2).view(np.uint8)
    return np.packbits(2 * counts > len(own), axis=0, bitorder="little").tobytes()


def heads(own: np.ndarray) -> bytes:
    """The low two bytes of the shingles of a small set of which every similar set has one among its own."""
    least, of = LEAST
    n = len(own)
    return own[: n + 1 + -n * least // of].astype("<u2").tobytes() if n <= SMALL else b""


def _sketches(docs: DataFrame) -> DataFrame:
    """(row, node, n, bytes, heads): of each row the number of its set, the set's size, its fingerprint and, of a small one, its heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, prints, first = [], [], [], []
            for x in batch.column(1):
                own = shingle_set(x.as_py())
                node.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                n.append(len(own))
                prints.append(fingerprint(own))
                first.append(heads(own))
            yield pa.record_batch([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(prints, pa.binary()), pa.array(first, pa.binary())], ["row", "node", "n", "bytes", "heads"])

    return docs.select("row", "text").mapInArrow(tidy(run), "row long, node long, n int, bytes binary, heads binary")


def _postings(rows: DataFrame, slices: int) -> DataFrame:
    """(part, data): packed postings of the nodes of `rows`. A part is a slice, by key, of the lists of one pair of positions, or after them of those by heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([p for p, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], ["part", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # Of copies in a batch one is enough here; the others are found with their lists.
            node, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            prints = _bytes(batch.column(1))[at]
            first = [np.frombuffer(batch.column(2)[i].as_py(), "<u2") for i in at.tolist()]
            out = np.empty(len(node), _POSTING)
            out["node"], out["carried"] = node, np.ascontiguousarray(prints[:, BANDS * WIDTH :]).view("<u8")
            for band in range(BANDS + 1):
                if band < BANDS:
                    out["key"] = np.ascontiguousarray(prints[:, band * WIDTH : (band + 1) * WIDTH]).view("<u2")[:, 0]
                else:
                    out = np.repeat(out, [len(x) for x in first])
                    out["key"] = np.concatenate(first)
                for k in range(slices):
                    some = out[out["key"] % slices == k] if slices > 1 else out
                    if len(some):
                        held.append((band * slices + k, some.tobytes()))
                        size += some.nbytes
                if size >= AT_ONCE:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return rows.filter("n > 0").select("node", "bytes", "heads").mapInArrow(tidy(run), "part int, data binary")


def with_partner(key: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """Which members of lists, sorted by list, have one in theirs that differs in few of the bits carried; of a long list all."""
    n = len(key)
    cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]))
    marked = np.repeat(np.diff(cut) > SHORT, np.diff(cut))
    at, step = np.flatnonzero(~marked), 1
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return marked
        near = at[np.bitwise_count(carried[at] ^ carried[at + step]).sum(axis=1) <= APART]
        marked[near] = marked[near + step] = True
        step += 1


def _met(slices: int):
    """For mapInArrow over whole parts: (list, node) of the members that have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(data)
        for part in sorted(held):
            own = np.frombuffer(b"".join(held.pop(part)), _POSTING)
            own = own[np.lexsort((own["node"], own["key"]))]
            own = own[np.concatenate(([True], (own["key"][1:] != own["key"][:-1]) | (own["node"][1:] != own["node"][:-1])))]
            own = own[with_partner(own["key"], own["carried"])]
            lists = (part // slices << 8 * WIDTH) + own["key"].astype(np.int64)
            yield pa.record_batch([pa.array(lists), pa.array(np.ascontiguousarray(own["node"]))], ["list", "node"])

    return run


def slots(own: np.ndarray) -> bytes:
    """Which slots the shingles of a set fill.

    Two sets share at most as many shingles as they share slots, and beyond
    those as many as the one with fewer has more shingles than slots.
    """
    filled = np.zeros(SLOTS, bool)
    filled[own % SLOTS] = True
    return np.packbits(filled).tobytes()


def _sets(texts: DataFrame) -> DataFrame:
    """(node, n, bytes, slots, shingles) of (node, n, bytes, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], pa.array([slots(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "bytes", "slots", "shingles"])

    return texts.select("node", "n", "bytes", "text").mapInArrow(tidy(run), "node long, n int, bytes binary, slots binary, shingles binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    least, of = LEAST
    both = len(a) + len(b) - len(np.union1d(a, b))
    return of * both >= least * (len(a) + len(b) - both) > 0


def _set(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_py(), np.uint64)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v, u_bytes, v_bytes) those that share enough bytes."""
    for batch in batches:
        if batch.num_rows:
            near = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(axis=1) >= SHARED
            yield pa.record_batch([x.filter(pa.array(near)) for x in batch.columns[:2]], ["u", "v"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v, u_set, v_set) those that are similar enough."""
    for batch in batches:
        near = pa.array([similar(_set(a), _set(b)) for a, b in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
        yield pa.record_batch([x.filter(near) for x in batch.columns[:2]], ["u", "v"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Blocks of rows that arrive sorted by their first three columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = [0, *((keys[1:] != keys[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if (k := tuple(keys[a].tolist())) != key:
                if held:
                    yield key, held
                held, key = [], k
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


class _Sides:
    """A block's columns list, i, j, node, label, is_left, n, bytes, slots; `right` has the places of its right side."""

    def __init__(self, band: int, held: list[pa.RecordBatch]):
        self.band = band
        self.node, self.label, self.left, self.n = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(3, 7))
        self.right = np.flatnonzero(~self.left) if not self.left.all() else np.arange(len(self.node))
        self.prints = np.concatenate([_bytes(x.column(7)) for x in held])
        self.slots = np.concatenate([_bytes(x.column(8)) for x in held]).view(np.uint64)
        self.over = self.n - np.bitwise_count(self.slots).sum(axis=1, dtype=np.int64)

    def partners(self, i: int) -> np.ndarray:
        """Places on the right of other components that `i` shares enough bytes with, and may share enough shingles, if no list before this one has the pair."""
        least, of = LEAST
        n, right = self.n, self.right
        # No two sets whose sizes differ by more can be that similar.
        others = right[(self.label[right] != self.label[i]) & (of * np.minimum(n[right], n[i]) >= least * np.maximum(n[right], n[i]))]
        most = np.bitwise_count(self.slots[others] & self.slots[i]).sum(axis=1, dtype=np.int64) + np.minimum(self.over[others], self.over[i])
        others = others[(of + least) * most >= least * (n[others] + n[i])]
        if not len(others):
            return others
        same = self.prints[others] == self.prints[i]
        listed = same[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).all(axis=2)[:, : self.band].any(axis=1)
        # Both are members of each list that has them if they differ in few of the bits carried; others may be missing in some.
        kept = np.bitwise_count(self.prints[others, BANDS * WIDTH :] ^ self.prints[i, BANDS * WIDTH :]).sum(axis=1, dtype=np.int64) <= APART
        return others[(same.sum(axis=1) >= SHARED) & ~(listed & kept)]


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, i, j, node, label, is_left, n) of the members that have a partner in their block."""
    for key, held in _blocks(batches):
        block = _Sides(key[0] >> 8 * WIDTH, held)
        marked = np.zeros(len(block.node), bool)
        for i in np.flatnonzero(block.left).tolist():
            others = block.partners(i)
            if len(others):
                marked[i] = True
                marked[others] = True
        if marked.any():
            some = [pa.array(x[marked]) for x in (block.node, block.label, block.left, block.n)]
            yield pa.record_batch([*[pa.array(np.full(len(some[0]), k, np.int64)) for k in key], *some], ["list", "i", "j", "node", "label", "is_left", "n"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components of blocks that arrive sorted: a forest of each."""
    for key, held in _blocks(batches):
        block = _Sides(key[0] >> 8 * WIDTH, held)
        sets = [_set(s) for x in held for s in x.column(9)]
        links = []
        for i in np.flatnonzero(block.left).tolist():
            for k in block.partners(i).tolist():
                if block.label[k] != block.label[i] and similar(sets[i], sets[k]):
                    block.label = np.where(block.label == block.label[k], block.label[i], block.label)
                    links.append((block.node[i], block.node[k]))
        yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def _linked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a link; root names their component."""
    least, of = LEAST
    slices = 1 + rows.count() // SLICE
    dealt = _postings(rows, slices).repartitionById((BANDS + 1) * slices, "part")
    found = written(dealt.mapInArrow(tidy(_met(slices)), "list long, node long"), "lists")
    every = found.join(rows.join(found.select("node").distinct(), "node", "left_semi").select("node", "n").distinct(), "node")
    lists = every.groupBy("list").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    met = written(every.join(lists, "list"), "postings")
    # One row of each node first: a text of many copies is one row in the join.
    needed = rows.groupBy("node").agg(F.min("row").alias("row")).join(met.select("node").distinct(), "node", "left_semi")
    sets = written(_sets(docs.join(rows.join(needed.select("row"), "row", "left_semi"), "row")), "shingles")
    sized = of * F.least("n", "hub_n") >= least * F.greatest("n", "hub_n")
    # The first few of a node's hubs join most groups; lists that then hold several components are compared as a whole below.
    hubs = met.filter("node <> hub").filter(sized).groupBy("node").agg(F.slice(F.array_sort(F.collect_set("hub")), 1, HUBS).alias("hubs"))
    pairs = hubs.select(F.col("node").alias("u"), F.explode("hubs").alias("v"))

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        u, v = (sets.select(F.col("node").alias(x), F.col(column).alias(f"{x}_of")) for x in "uv")
        return pairs.join(u, "u").join(v, "v").select("u", "v", "u_of", "v_of")

    counted = written(beside(pairs, "bytes").mapInArrow(tidy(_counted), "u long, v long"), "pairs")
    first = written(components(beside(counted, "shingles").mapInArrow(tidy(_verified), "u long, v long")), "components")
    found = first.select("node", "root")
    labelled = met.join(found, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    mixed = labelled.groupBy("list").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("list")
    parts = F.greatest(F.ceil(F.col("size") / SIDE), F.ceil(F.col("total") / SHINGLES)).cast("int")
    members = labelled.join(mixed, "list").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    # Block (i, j) gets the members of i and those of j; block (i, i) those of i.
    dealt = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "list", F.least("part", "other").cast("long").alias("i"), F.greatest("part", "other").cast("long").alias("j"), "node", "label", (F.col("part") <= F.col("other")).alias("is_left"), "n"
    )
    key = ["list", "i", "j"]

    def blocks(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(sets.select("node", *columns), "node").select(*key, "node", "label", "is_left", "n", *columns).repartition(*key).sortWithinPartitions(*key)

    marked = written(blocks(dealt, "bytes", "slots").mapInArrow(tidy(_with_partners), "list long, i long, j long, node long, label long, is_left boolean, n int"), "partners")
    more = blocks(marked, "bytes", "slots", "shingles").mapInArrow(tidy(_across), "u long, v long")
    tree = first.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(tree.unionByName(more)).select("node", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those that are near copies of another: one of each component stays.

    It is the row with the least doc_id, and of several such rows any one. A row
    without an id stays only if no row of its component has one. Whether ids
    repeat or are null makes no row a copy: rows are told apart by a number
    given when they are written. Null texts and texts without words are copies
    of each other.
    """
    let_workers_import(docs.sparkSession)
    # In a struct, no column of the caller's clashes with one of these.
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.monotonically_increasing_id().alias("row"))
    kept = written(boxed, "numbered")
    source = kept.select("row", F.coalesce("all.text", F.lit("")).alias("text"))
    rows = written(_sketches(source), "sketches")
    place = F.struct(F.col("all.doc_id").isNull().alias("last"), F.col("all.doc_id").alias("doc_id"), "row")
    # First of each node, then of each component: copies are combined before anything is joined.
    first = kept.select("row", place.alias("place")).join(rows.select("row", "node"), "row").groupBy("node").agg(F.min("place").alias("place"))
    rooted = first.join(_linked(rows, source), "node", "left").select("place", F.coalesce("root", "node").alias("root"))
    stay = written(rooted.groupBy("root").agg(F.min("place").alias("best")).select("best.row"), "stay")
    # What goes is less than what stays, so its numbers meet the documents.
    lost = written(rows.select("row").join(stay, "row", "left_anti"), "copies")
    return kept.join(lost, "row", "left_anti").select("all.*")
