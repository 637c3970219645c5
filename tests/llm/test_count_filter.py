"""The count filter of the byte-position index: what reaches verification."""

import random

import numpy as np

from karstflow.llm import simhash


def shared(a, b):
    return sum(a >> 8 * p & 255 == b >> 8 * p & 255 for p in range(8))


def test_only_counted_pairs_are_verified(monkeypatch):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(300):
        x = centre
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {centre & ~0xFFFFFF | rng.getrandbits(24) for _ in range(100)} | {centre & 0xFFFFFF | rng.getrandbits(40) << 24 for _ in range(100)}
    prints = sorted(prints)
    reached = []
    whole = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda a, b, bits: reached.extend(zip(a.tolist(), b.tolist())) or whole(a, b, bits))
    u, v = simhash._forest(np.zeros(len(prints), np.int64), np.array(prints, np.uint64), 4)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :]]
    counted = {p for p in pairs if shared(*p) >= 4}
    assert set(reached) == counted and len(reached) == len(counted) < len(pairs) / 2
    assert all((a ^ b).bit_count() <= 4 for a, b in zip(u.tolist(), v.tolist()))
    # no pair within the bits is lost by the count
    assert {p for p in pairs if (p[0] ^ p[1]).bit_count() <= 4} <= counted
