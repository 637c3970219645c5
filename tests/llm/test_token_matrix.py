"""Stored matrices read back, and what bpe gives beside its query."""

import collections
import hashlib

import numpy as np

from karstflow.llm import bpe, token_matrix
from test_contracts import ROWS, SCHEMA, library  # noqa: F401  a fixture


def test_written_and_read(spark, tmp_path, library):  # noqa: F811
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for continued in (False, True):
        stored = token_matrix.write(token_matrix.pack(docs, window=64, continued=continued), f"{tmp_path}/{continued}")
        pieces = collections.defaultdict(list)
        for r in stored.collect():
            ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
            assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == len(ids) == len(positions) <= 64 and len(r.doc_ids) == len(r.starts) == len(r.cu_seqlens) - 1
            for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
                assert positions[a:b].tolist() == list(range(start * continued, start * continued + b - a))
                pieces[d].append((start, ids[a:b].tolist()))
        expected = collections.defaultdict(list)
        for d, t in ROWS:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
            expected[d] += [(a, ids[a : a + 64]) for a in range(0, len(ids), 64)]
        assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in expected.items()}


def test_query(spark):
    rows = token_matrix.query(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.cu_seqlens[-1] for r in rows) and all(r.n_segments == len(r.doc_ids) for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    whole = token_matrix.pack(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert collections.Counter(r.ids_sha256 for r in rows) == collections.Counter(hashlib.sha256(r.ids).hexdigest() for r in whole)


def test_encode_and_decode(spark, library):  # noqa: F811
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ROWS)], SCHEMA)
    path = bpe.default_vocabulary()
    coded = bpe.encode(docs, path, end_id=2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in coded.collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, (_, t) in enumerate(ROWS)}
    back = {r.doc_id: r.text for r in bpe.decode(coded, path).collect()}
    assert back == {i: library.decode(ids, skip_special_tokens=False) for i, ids in got.items()}


def test_lists_as_arrays(library, monkeypatch):  # noqa: F811
    """Every list merged as an array, none of them, and the usual way give the library's ids."""
    import random

    rng = random.Random(8)
    letters = "aaaabbcdeelnnoorsstt éüßñ漢😀'12#"
    batch = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * n for n in range(40)] + ["abab" * 9 + "a", "eeee" * 50 + " " + "ssss" * 33]
    expected = [library.encode(t, add_special_tokens=False).ids for t in batch]
    for often, short in ((1, 1 << 30), (1 << 30, 1), (3, 4), (40, 20)):
        monkeypatch.setattr(bpe, "OFTEN", often)
        monkeypatch.setattr(bpe, "SHORT_ONES", short)
        own = bpe.PairIndexBPE(bpe.default_vocabulary())
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(batch)] == expected


def test_idle_worker_forgets(monkeypatch):
    import time

    import pyarrow as pa

    monkeypatch.setattr(bpe, "IDLE", 0.2)
    own = bpe.PairIndexBPE(bpe.default_vocabulary())
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["some words", "some more"])], ["doc_id", "text"])
    first = list(bpe.encoded_rows(batch, own))
    assert own._known.young
    time.sleep(0.6)
    assert not own._known.young and list(bpe.encoded_rows(batch, own)) == first
