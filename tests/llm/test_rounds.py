"""Merging in rounds: the ids of the pair index and of the library, with less work."""

import random
import time

import numpy as np

from karstflow.llm import bpe, packing, token_matrix
from test_contracts import ROWS, library  # noqa: F401  a fixture

ODD = ["a" * 47, "a" * 48, "a" * 49, "ab" * 24 + "c", "é" * 24, "é" * 25, "'s'LL", "日本語日本語", "x<|endoftext|>y", "a\x1cb ΑΣ Σ", "😀😀😀 \U0010ffff", "1234 --- ...!!", "z"]


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices("etaoinshrdlucmfwygpbvkxqjzéß", k=draw.randint(1, 14))) for _ in range(n)]


def test_same_ids(library):  # noqa: F811
    texts = [t or "" for _, t in ROWS] + ODD + [" ".join(ODD), " ".join(words(1, 3000))]
    rounds = bpe.RoundsBPE(bpe.default_vocabulary())
    assert rounds.encode_batch(texts) == bpe.PairIndexBPE(bpe.default_vocabulary()).encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in rounds.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pretokens_and_late_ranks_go_by_the_index(monkeypatch):
    rounds, own = bpe.RoundsBPE(bpe.default_vocabulary()), []
    assert not rounds._late
    indexed = bpe.PairIndexBPE.merge
    monkeypatch.setattr(bpe.PairIndexBPE, "merge", lambda self, x: own.append(x) or indexed(self, x))
    rounds.merge(["b" * bpe.LONG, "b" * (bpe.LONG + 1)])
    assert own == [["b" * (bpe.LONG + 1)]]
    rounds._late = True
    rounds.merge(["b"])
    assert own[1:] == [["b"]]


def test_less_work():
    # op7 and op8 spend nearly all their time here; their budget left a sixth less than the index took.
    def seconds(kind: type) -> float:
        encoder, took = kind(bpe.default_vocabulary()), []
        for seed in range(3):
            own = list(dict.fromkeys(words(seed, 30_000)))
            began = time.process_time()
            encoder.merge(own)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(bpe.RoundsBPE) < 0.7 * seconds(bpe.PairIndexBPE)


def test_operators_use_it():
    assert packing.RoundsBPE is token_matrix.RoundsBPE is bpe.RoundsBPE
