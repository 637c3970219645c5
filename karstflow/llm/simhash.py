"""Near-duplicates by SimHash fingerprints and an index on byte positions.

A fingerprint is eight bytes at eight positions. Two fingerprints that differ
in at most 4 bits differ in at most 4 bytes, so they share at least 4
positional bytes: that is the minimum number of matches that a link
guarantees. A posting list of one positional byte holds a 256th of all
fingerprints, and tallying pairs over such lists is quadratic. So postings are
kept for triples of positions: by Turan's construction 20 triples are enough
for every choice of 4 positions to hold one of them, and a list has a
16-millionth of unrelated fingerprints. A list that is long all the same is
parted by a fourth position: a pair with the minimum of matches shares one of
the quadruples too. Of fingerprints that meet in a list, the shared bytes are
tallied; only pairs that reach the minimum are kept, and only those are
verified bit by bit.

No list emits all of its pairs: what leaves a list is a forest of its links,
with fewer rows than the list has fingerprints. A list beyond a bounded length
is dealt to slices in several tasks, each compared as a whole and with the
list's least member; slices are then compared with each other in blocks of
bounded size, and only across components. The result is the same as from all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import beside_least, let_workers_import, texts, written
from karstflow.llm.components import components

#: Fingerprints of a list, or of a slice of a longer one, that are compared as a whole.
SHORT = 2048
#: Hashes whose bits are counted at once.
_AT_ONCE = 1 << 16


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included, with A-Z lower-cased.

    Fewer words than a shingle: the whole sequence is one; no word: none.
    """
    # On bytes, lower() and split() know ASCII only, which is what is asked for.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), "<u8", n - shingle + 1)


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; zero if there are none."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        bits = np.unpackbits(hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row for each row of `docs`, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def position_lists(least: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any `least` of the eight hold one of them.

    From 4 on, triples inside one of three groups of positions, or two of a
    group with one of the next; below, all sets of that size.
    """
    if least < 4:
        return list(combinations(range(8), least))
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    inside = [c for g in groups for c in combinations(g, 3)]
    return inside + [(*two, one) for k, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]


def _lists(fp: Column, sets: list[tuple[int, ...]]) -> list[Column]:
    """A fingerprint's list for each set of positions: the set's number above the bytes at its positions."""

    def key(number: int, positions: tuple[int, ...]) -> Column:
        out = F.lit(number << 8 * len(positions)).cast("long")
        for at, p in enumerate(positions):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)), 8 * at))
        return out

    return [key(i, x) for i, x in enumerate(sets)]


def _postings(nodes: DataFrame, bits: int) -> DataFrame:
    """(list, fp, slice, slices, hub): each fingerprint in the list of every position set.

    slices: how many a list is dealt to; hub: the least fingerprint of a list
    that has several. Lists of triples that are longer than SHORT give way to
    lists of the quadruples that hold them.
    """
    sets = position_lists(8 - bits)

    def sized(rows: DataFrame) -> DataFrame:
        return rows.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("hub")).filter(F.col("size") > SHORT)

    rows = nodes.select(F.explode(F.array(*_lists(F.col("fp"), sets))).alias("list"), "fp")
    if bits <= 4:
        long = sized(rows).select("list")
        wider = list(combinations(range(8), 4))
        holding = F.array(*[F.array(*[F.lit(i) for i, w in enumerate(wider) if set(x) <= set(w)]) for x in sets])
        # A set's number stands above its three bytes.
        numbers = F.get(holding, F.shiftright("list", 24).cast("int"))
        every = F.array(*_lists(F.col("fp"), wider))
        parted = rows.join(long, "list", "left_semi").select("fp", F.explode(F.transform(numbers, lambda i: F.get(every, i))).alias("list")).distinct()
        # Lists of quadruples are told from those of triples by their sign.
        rows = rows.join(long, "list", "left_anti").unionByName(parted.select((-1 - F.col("list")).alias("list"), "fp"))
    slices = F.coalesce(F.ceil(F.col("size") / SHORT), F.lit(1)).cast("int")
    both = rows.join(sized(rows), "list", "left").select("list", "fp", slices.alias("slices"), "hub")
    return both.withColumn("slice", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("slices")).cast("int"))


_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def tallied(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Of pairs of fingerprints, the places of those that share at least so many positional bytes."""
    x = a ^ b
    # The high bit of a byte is left unset where any bit of the byte is set.
    equal = ~(((x & _LOW) + _LOW) | x | _LOW)
    return np.flatnonzero(np.bitwise_count(equal) >= least)


def verified(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Of pairs of fingerprints, which differ in at most so many bits."""
    return np.bitwise_count(a ^ b) <= bits


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The places of the pairs that pass the tally and then the bits."""
    at = tallied(a, b, 8 - bits)
    return at[verified(a[at], b[at], bits)]


class _Forest:
    """Components of the places of one array of fingerprints, and the links that joined them."""

    def __init__(self, labels: np.ndarray):
        self.label = labels
        self._map = np.arange(int(labels.max(initial=-1)) + 1)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Take links of places, of which only those that join two components are kept."""
        a, b = self.label[i], self.label[j]
        apart = a != b
        if not apart.any():
            return
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        kept = []
        where = apart.nonzero()[0]
        for k, x, y in zip(where.tolist(), a[where].tolist(), b[where].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(k)
        changed = np.array(list(parent))
        self._map[changed] = [root(x) for x in parent]
        self.label = self._map[self.label]
        self._map[changed] = changed
        self.left.append(i[kept])
        self.right.append(j[kept])

    def links(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        return fp[np.concatenate([none, *self.left])], fp[np.concatenate([none, *self.right])]


def _forest(lists: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the lists of sorted arrays: one comparison of arrays for each distance in them."""
    forest, at, step = _Forest(np.arange(len(fp))), np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[lists[at] == lists[at + step]]
        if not len(at):
            return forest.links(fp)
        i = at[_linked(fp[at], fp[at + step], bits)]
        forest.join(i, i + step)
        step += 1


def _inside(bits: int):
    """For mapInArrow over (list, slice, fp, hub) in order: the links inside slices and of their members to the hub, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, fp = np.empty((0, 2), np.int64), np.empty(0, np.uint64)

        def links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Work off what is complete; leave the rows of the slice that may go on."""
            nonlocal lists, fp
            number = np.cumsum(np.concatenate(([0], (lists[1:] != lists[:-1]).any(axis=1)))) if len(lists) else np.empty(0, np.int64)
            cut = len(lists) if last else int(np.searchsorted(number, number[-1]))
            yield links(*_forest(number[:cut], fp[:cut], bits))
            lists, fp = lists[cut:], fp[cut:]

        for x in batches:
            if not x.num_rows:
                continue
            own = x.column(2).to_numpy().view(np.uint64)
            lists = np.concatenate([lists, np.stack([x.column(0).to_numpy(), x.column(1).to_numpy().astype(np.int64)], axis=1)])
            fp = np.concatenate([fp, own])
            some = np.flatnonzero(x.column(3).is_valid().to_numpy(zero_copy_only=False))
            hub = x.column(3).fill_null(0).to_numpy().view(np.uint64)
            some = some[own[some] != hub[some]]
            some = some[_linked(own[some], hub[some], bits)]
            yield links(hub[some], own[some])
            if len(fp) >= 1 << 16:
                yield from done(False)
        yield from done(True)

    return run


def _across(bits: int):
    """For mapInArrow: links across components between two slices, in blocks that arrive sorted by block.

    Columns: list, i, j, fp, label, is_left. Gives a forest of each block's links.
    """

    def compare(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, left = rows[:, 0].view(np.uint64), rows[:, 2].astype(bool)
        names, label = np.unique(rows[:, 1], return_inverse=True)
        forest = _Forest(label)
        a, b = left.nonzero()[0], (~left).nonzero()[0]
        # Most of a hot list is one component: its members need only be compared with the others.
        most = np.bincount(label).argmax()
        for some, others in ((a[label[a] != most], b), (a[label[a] == most], b[label[b] != most])):
            for at in range(0, len(some) if len(others) else 0, 64):
                part = some[at : at + 64]
                i, j = np.repeat(part, len(others)), np.tile(others, len(part))
                near = _linked(fp[i], fp[j], bits)
                forest.join(i[near], j[near])
        return forest.links(fp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                u, v = compare(np.concatenate(held))
                held.clear()
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            rows = np.stack([batch.column(i).to_numpy() for i in range(3, 6)], axis=1)
            cuts = [0, *((keys[1:] != keys[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if (k := tuple(keys[a].tolist())) != key:
                    yield from close()
                    key = k
                held.append(rows[a:b])
        yield from close()

    return run


def linked(prints: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, root) of the distinct fingerprints that have a link; root names their component.

    `prints` holds distinct fingerprints in fp. bits: at most 7.
    """
    spark = prints.sparkSession
    let_workers_import(spark)
    postings = _postings(prints.select("fp"), bits)
    dealt = postings.repartition("list", "slice").sortWithinPartitions("list", "slice", "fp")
    met = written(dealt.select("list", "slice", "fp", "hub").mapInArrow(_inside(bits), "u long, v long"), "lists")
    first = written(components(met), "components")
    found = first.select(F.col("node").alias("fp"), "root")
    members = written(postings.filter("slices > 1").select("list", "slice", "slices", "fp"), "members")
    if members.isEmpty():
        return found
    labelled = members.join(found, "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")
    mixed = labelled.groupBy("list").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("list")
    # Block (i, j) gets the members of two slices; those of one have been compared.
    dealt = labelled.join(mixed, "list").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")).filter("other <> slice").select(
        "list", F.least("slice", "other").cast("long").alias("i"), F.greatest("slice", "other").cast("long").alias("j"), "fp", "label", (F.col("slice") < F.col("other")).cast("long").alias("is_left")
    )
    key = ["list", "i", "j"]
    more = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_across(bits), "u long, v long")
    tree = first.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(tree.unionByName(more)).select(F.col("node").alias("fp"), "root")


def _named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component_id) of (fp, least): the least of a linked fingerprint's component, its own if it has no link.

    Linked fingerprints are dealt over salts, so that one component of most of
    them isn't one task.
    """
    both = nodes.join(found, "fp", "left")
    alone = both.filter("root IS NULL").select("fp", F.col("least").alias("component_id"))
    some = beside_least(both, "root", "least", "component_id", F.col("fp"))
    return alone.unionByName(some.select("fp", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of `docs`.

    component_id is the least doc_id that links reach, the row itself
    included; it is null only where no reachable row has an id. Null and empty
    texts have fingerprint zero and are linked like any other. Repeated rows
    share a component. Equal fingerprints are one node of the index, so exact
    copies, however many, cost one row there.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return rows.join(_named(nodes, written(linked(nodes, bits), "linked")), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(docs: DataFrame) -> DataFrame:
    """`near_duplicates` with the contract's four-word shingles and 4 bits."""
    return near_duplicates(docs)
