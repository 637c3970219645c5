"""Class-based scores against plain Python: exchange, placing and the score itself."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from karstflow.llm import class_lm
from test_contracts import LOWER, ROWS, SCHEMA, words


def test_exchange():
    """Units of two kinds that follow each other in turn end in two classes."""
    rng = np.random.default_rng(0)
    m = np.zeros((12, 12), np.int64)
    m[:6, 6:] = rng.integers(20, 60, (6, 6))
    m[6:, :6] = rng.integers(20, 60, (6, 6))
    cls = class_lm.exchange(class_lm.Pairs.of(m), 2)
    assert len(set(cls[:6])) == len(set(cls[6:])) == 1 and cls[0] != cls[6]


@pytest.mark.parametrize("fixed", [0, 1])
def test_no_move_helps(fixed):
    """After an exchange no unit has a better class, by the likelihood computed anew."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.integers(0, 9, (9, 9)) * (rng.random((9, 9)) < 0.6)
        cls = class_lm.exchange(class_lm.Pairs.of(m), 3, fixed=fixed)
        assert not fixed or cls[8] == 3
        best = class_lm.likelihood(m, cls, 3 + fixed)
        for unit in range(9 - fixed):
            for other in range(3):
                moved = cls.copy()
                moved[unit] = other
                assert class_lm.likelihood(m, moved, 3 + fixed) <= best + 1e-6


def brute(rows, share, classes):
    """Scores by the definition: counts in dictionaries, one token after the other."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    tokens = [[*words((t or "").translate(LOWER)), ""] for _, t in rows]
    count = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, distinct = sum(count.values()), len(count)
    units = sorted((w for w, c in count.items() if c >= share * total), key=lambda w: (-count[w], w.encode()))
    units += [""] if "" not in units else []
    place = {w: i for i, w in enumerate(units)}
    rest = len(units)
    m = np.zeros((rest + 1, rest + 1), np.int64)
    pairs = [(x, y) for t, h in zip(tokens, held) if not h for x, y in zip(["", *t], t)]
    for x, y in pairs:
        m[place.get(x, rest), place.get(y, rest)] += 1
    found = class_lm.exchange(class_lm.Pairs.of(m), classes, fixed=1)
    coarse = lambda w: int(found[place.get(w, rest)])

    def logs(n, width):
        all_ = sum(n.values())
        into = [sum(v for (_, b), v in n.items() if b == c) for c in range(width)]
        out = [sum(v for (a, _), v in n.items() if a == c) for c in range(width)]
        return lambda a, b: math.log10((n[a, b] + (into[b] + 0.1) / (all_ + 0.1 * width)) / (out[a] + 1))

    step = logs(collections.Counter((coarse(x), coarse(y)) for x, y in pairs), classes + 1)
    size = [sum(count[w] for w in units if coarse(w) == c) for c in range(classes)]
    near = collections.defaultdict(list)
    for t, h in zip(tokens, held):
        for i, w in enumerate(t):
            if not h and w not in place:
                near[w].append((coarse(t[i - 1] if i else ""), coarse(t[i + 1])))
    cls = {w: coarse(w) for w in units}
    for w, seen in near.items():
        gains = [round(sum(step(a, c) + step(c, b) for a, b in seen) - len(seen) * math.log10(max(size[c] + len(seen), 1)), 6) for c in range(classes)]
        cls[w] = gains.index(max(gains))
    sizes = [sum(count[w] for w in cls if cls[w] == c) for c in range(classes)]
    types = [sum(1 for w in cls if cls[w] == c) for c in range(classes)]
    once = [sum(1 for w in cls if cls[w] == c and count[w] == 1) for c in range(classes)]
    unseen = once.index(max(once))
    final = logs(collections.Counter((cls[x], cls[y]) for x, y in pairs), classes)
    for (d, _), h, t in zip(rows, held, tokens):
        known = [cls.get(w, unseen) for w in ["", *t]]
        score = sum(final(a, b) + math.log10((count[w] + 0.1) / (sizes[b] + 0.1 * (types[b] + 1))) for a, b, w in zip(known, known[1:], t))
        yield d, h, len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), 5), round(score, 5)


def _random_rows():
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(900)]
    return [(i, " ".join(rng.choice(rare if rng.random() < 0.3 else common[:15] if k % 2 else common[15:]) for k in range(rng.randint(0, 80)))) for i in range(150)]


@pytest.mark.parametrize("rows", [ROWS, _random_rows()], ids=["awkward", "random"])
@pytest.mark.parametrize("small", [False, True], ids=["whole", "small"])
def test_scores(spark, monkeypatch, rows, small):
    if small:  # blocks of a few texts, words that go on over batches
        monkeypatch.setattr(class_lm, "BLOCK", 700)
        monkeypatch.setattr(class_lm, "ROWS", 7)
        monkeypatch.setattr(class_lm, "PARTS", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = class_lm.score(docs, share=0.01, classes=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = lambda r: (r[0], r[1], r[2], r[3], r[4], round(r[5], 5), round(r[6], 5))
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    for a, b in zip(sorted(map(plain, got), key=key), sorted(brute(rows, 0.01, 4), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)


def test_without_training_texts(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = class_lm.query(spark.createDataFrame([(held, "a b"), (held, None)], SCHEMA)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)] and all(r.score < 0 for r in got)


_IDLE = """
import re, sys, types
import numpy as np, pyarrow as pa, pyspark
from karstflow.llm import class_lm

pyspark.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

class Rows:
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

def batches(n):
    rng = np.random.default_rng(n)
    for _ in range(3):
        texts = [" ".join(map(str, rng.integers(0, 400_000, 400).tolist())) for _ in range(4000)]
        yield pa.record_batch([pa.array(range(4000), pa.int64()), pa.array(texts), pa.array([False] * 4000)], ["doc_id", "text", "held_out"])

run = class_lm.blocks(Rows(), [class_lm.END, "7"])
for n in (1, 2):
    for _ in run(batches(n)):
        pass
    # What the first task leaves behind is the libraries' own.
    sys.stdout.write(f"{held()} ")
import gc, ctypes
gc.collect()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(held())
"""


def test_idle_workers_hold_little():
    """After a task a worker holds no more than it does once all that it doesn't use is given back."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", _IDLE], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=True).stdout
    first, second, least = map(float, out.split())
    assert max(first, second) < least + 40, out
