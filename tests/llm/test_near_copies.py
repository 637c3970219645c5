"""The pipeline's near-dedup against all pairs in plain Python."""

import random

import numpy as np
import pytest

from karstflow.llm import near_copies
from test_contracts import LOWER, words


def shingled(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Places of the rows that stay."""
    sets, label = [shingled(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                label = [label[j] if x == label[i] else x for x in label]
    return {min((i for i in range(len(rows)) if label[i] == x), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for x in set(label)}


def _copies():
    rng = random.Random(4)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 200))]
        for _ in range(4):
            t = list(base)
            # Each new word changes five shingles of each side.
            for _ in range(rng.randint(0, len(t) // 40)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(t)))
    return rows


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SIDE", 3)
    rows = _copies()
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == survivors(rows) and len(got) < len(rows) - 30
    assert near_copies.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    copied, unnamed = text(), text()
    rows = [(None, text()), (None, text()), (7, text()), (7, text()), (None, copied), (3, copied), (5, copied), (None, unnamed), (None, unnamed)]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((rows[i][0] or 0, rows[i][1]) for i in survivors(rows)) and len(got) == 6


def test_fingerprints_are_simhash():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 254, 255, 256, 700):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        hashes = [int.from_bytes(x.tobytes(), "little") for x in np.ascontiguousarray(near_copies.bits_of(own).T)]
        bits = sum(1 << k for k in range(8 * near_copies.POSITIONS) if 2 * sum(h >> k & 1 for h in hashes) > len(own))
        assert near_copies.fingerprint(own) == bits.to_bytes(near_copies.POSITIONS, "little")
    # Bits at random would share two bytes in 512; sets of similarity 0.8 share about 73 of 272.
    shared = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = (np.frombuffer(near_copies.fingerprint(np.sort(s)), np.uint8) for s in (x[:90], x[10:]))
        shared.append(int((a == b).sum()))
    assert 70 < np.mean(shared) < 79 and min(shared) >= near_copies.SHARED


def _met(spark, rows, slices):
    docs = spark.createDataFrame(rows, "row long, text string")
    sketches = near_copies._sketches(docs).cache()
    parts = near_copies._postings(sketches, slices).repartitionById((near_copies.BANDS + 1) * slices, "part")
    lists = {}
    for r in parts.mapInArrow(near_copies._met(slices), "list long, node long").collect():
        lists.setdefault(r.list, set()).add(r.node)
    return {r.row: r.node for r in sketches.collect()}, lists


@pytest.mark.parametrize("short", [4096, 0])
def test_every_similar_pair_meets(spark, monkeypatch, short):
    """Also sets of one to eight shingles, whatever the number of slices."""
    monkeypatch.setattr(near_copies, "SHORT", short)
    rng = random.Random(9)
    rows = _copies()
    for n in range(1, 13):
        for _ in range(5):
            t = [f"x{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join([*t, "more"]))]
    sets = [shingled(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(pairs) > 60
    nodes, lists = _met(spark, rows, 1)
    assert all(any({nodes[i], nodes[j]} <= x for x in lists.values()) for i, j in pairs)
    assert _met(spark, rows, 3)[1] == lists


def test_many_slices(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE", 40)
    rows = _copies()
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == survivors(rows)


def test_few_hubs(spark, monkeypatch):
    """A large group of near copies gives a bounded number of pairs a node."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(w if k != i else "new" for k, w in enumerate(base))) for i in range(150)]
    sizes, written = {}, near_copies.written

    def counting(rows, name, *more):
        out = written(rows, name, *more)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "written", counting)
    assert [r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert sizes["pairs"] <= 4 * len(rows)


def test_dense_group(spark, monkeypatch):
    """Texts that share much, but few of which are similar enough: a node isn't handed on with each of its lists."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for k in rng.sample(range(30), rng.randint(4, 5)):
            t[5 * k] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sizes, written = {}, near_copies.written

    def counting(rows, name, *more):
        out = written(rows, name, *more)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "written", counting)
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == survivors(rows) and len(got) > 60
    assert sizes["postings"] > 20 * len(rows) and sizes["partners"] <= 4 * len(rows)


def _block(prints, own, band):
    sides = near_copies._Sides.__new__(near_copies._Sides)
    n = len(own)
    sides.band, sides.node, sides.label, sides.right = band, np.arange(n), np.arange(n), np.arange(n)
    sides.n = np.array([len(x) for x in own])
    sides.prints = prints
    sides.slots = np.stack([np.frombuffer(near_copies.slots(x), np.uint64) for x in own])
    sides.over = sides.n - np.bitwise_count(sides.slots).sum(axis=1, dtype=np.int64)
    return sides


@pytest.mark.parametrize("size", [3, 100, 3000, 20000])
def test_slots_lose_no_pair(size):
    """Also of sets with more shingles than there are slots."""
    rng = np.random.default_rng(size)
    pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
    own = [np.unique(pool[rng.integers(0, size // 4 + 1) :][:size]) for _ in range(12)]
    prints = np.zeros((len(own), near_copies.POSITIONS), np.uint8)
    sides = _block(prints, own, 0)
    for i, a in enumerate(own):
        assert {k for k, b in enumerate(own) if k != i and near_copies.similar(a, b)} <= set(sides.partners(i).tolist())


def test_a_pair_is_compared_in_its_first_list():
    rng = np.random.default_rng(2)
    own = [np.arange(50, dtype=np.uint64)] * 2
    prints = rng.integers(0, 256, (2, near_copies.POSITIONS)).astype(np.uint8)
    prints[1, : near_copies.BANDS] = prints[0, : near_copies.BANDS]
    prints[1, :8] ^= 1
    prints[1, -near_copies.CARRIED :] = prints[0, -near_copies.CARRIED :]
    assert [b for b in range(near_copies.BANDS + 1) if len(_block(prints, own, b).partners(0))] == [0, 1, 2, 3, 4]
    # Far apart in the bits carried, they may be missing in the first: all lists count.
    prints[1, -near_copies.CARRIED :] ^= 255
    assert all(len(_block(prints, own, b).partners(0)) for b in range(near_copies.BANDS + 1))
