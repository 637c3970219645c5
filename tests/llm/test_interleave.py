"""Sequences of texts and media: what pages lose, what joins resolve, and the features, against plain Python."""

import collections
import hashlib
import json
import math
import struct
import zlib

import pytest

from karstflow.llm import interleave
from test_contracts import ROWS, SCHEMA


def shown(html):
    return [(x["kind"], x["text"], x["caption"]) for x in interleave.parse(html)]


@pytest.mark.parametrize(("html", "items"), [
    ("<figure><img src=a><figcaption>cap</figure>after", [("media", "a", "cap"), ("text", "after", None)]),
    ("<figure><img src=a><figcaption>cap<p>after<p>more", [("media", "a", "cap"), ("text", "after", None), ("text", "more", None)]),
    ("<figure><img src=a><figcaption>cap", [("media", "a", "cap")]),
    ("<figure><figcaption>alone</figcaption></figure>x", [("text", "alone", None), ("text", "x", None)]),
    ("one<noscript>two<img src=b><p>three", [("text", "one", None), ("text", "two", None), ("media", "b", None), ("text", "three", None)]),
    ("one<noscript>two<img src=b></noscript>three", [("text", "one", None), ("text", "three", None)]),
    ("one<template><noscript>x</template>two", [("text", "one", None), ("text", "two", None)]),
    ("one</noscript>two", [("text", "onetwo", None)]),
    ("one<script>var x = '<p>';", [("text", "one", None)]),
    ("<img src=a><img src=a><img>", [("media", "a", None), ("media", "a", None)]),
    ("", []),
])
def test_pages(html, items):
    assert shown(html) == items


def test_resolved(spark):
    """Pages that share a digest, a page that repeats one, one that is missing, null ids and null pages."""
    pages = [(1, '<p>a</p><img src="sha256:x" alt="one"><p>b</p><img src="sha256:y"><img src="sha256:x" alt="again">'), (2, '<img src="sha256:x"><img src="http://e/p.png" alt="far">'), (None, '<img src="sha256:zz" alt="lost">'), (None, "c"), (2, None), (2, '<img src="sha256:y">')]
    media = spark.createDataFrame([("x", 5, "fx"), ("y", 6, "fy"), ("unused", 7, "fu")], "digest string, n_bytes long, feature string")
    got = interleave.resolved(interleave.sequences(spark.createDataFrame(pages, "doc_id long, html string").repartition(3)), media).collect()
    flat = [(r.doc_id, [(x.position, x.kind, x.text if x.kind == "text" else x.caption, x.media.feature if x.media else None) for x in r.sequence]) for r in got]
    expected = [
        (1, [(0, "text", "a", None), (1, "media", "one", "fx"), (2, "text", "b", None), (3, "media", None, "fy"), (4, "media", "again", "fx")]),
        (2, [(0, "media", None, "fx"), (1, "media", "far", None)]), (None, [(0, "media", "lost", None)]), (None, [(0, "text", "c", None)]), (2, []), (2, [(0, "media", None, "fy")]),
    ]
    assert collections.Counter(map(repr, flat)) == collections.Counter(map(repr, expected))
    assert interleave.resolved(interleave.sequences(spark.createDataFrame([], "doc_id long, html string")), media).collect() == []


def feature(raw):
    """The feature of a payload, sample by sample."""
    counts, n = collections.Counter(raw), len(raw)
    mean = sum(raw) / n
    deviation = math.sqrt(max(0.0, sum(x * x for x in raw) / n - mean * mean))
    columns = [sum(raw[r + c] for r in range(0, n, 192) for c in range(16 * k, 16 * k + 16)) for k in range(12)]
    edge = int("".join("01"[a < b] for a, b in zip(columns, columns[1:])), 2)
    return {"w": 192, "h": n // 192, "mean": round(mean, 6), "dev": round(deviation, 6), "entropy": round(abs(sum(c / n * math.log2(c / n) for c in counts.values())), 6), "edge": f"{edge:03x}"}


def stored(raw):
    """The PNG of a payload, written out by the format's rules."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + raw[i : i + 192] for i in range(0, len(raw), 192))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 192, len(raw) // 192, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def test_query_columns(spark):
    got = collections.defaultdict(list)
    for r in interleave.query(spark.createDataFrame(ROWS, SCHEMA).repartition(2)).collect():
        got[r.doc_id].append(r)
    for d, t in ROWS:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        png = stored(full)
        paragraphs = [x for x in (t or "").split("\n")]
        items = [f"text:{len(paragraphs[0])}"] * bool(paragraphs[0]) + [f"media:{len(png)}"] + [f"text:{len(x)}" for x in paragraphs[1:] if x] + [f"media:{len(png)}"] * (len(paragraphs) > 1)
        own = [r for r in got[d] if r.payload_sha256 == hashlib.sha256(full).hexdigest()]
        assert own and len(got[d]) == sum(x == d for x, _ in ROWS)
        for r in own:
            assert (r.media_sha256, r.media_bytes, r.n_bytes) == (hashlib.sha256(png).hexdigest(), len(png), len(raw))
            mine, plain = json.loads(r.feature), feature(full)
            assert {k: v for k, v in mine.items() if k not in ("mean", "dev", "entropy")} == {k: v for k, v in plain.items() if k not in ("mean", "dev", "entropy")}
            assert all(mine[k] == pytest.approx(plain[k], abs=2e-6) for k in ("mean", "dev", "entropy"))
            assert r.sequence == ",".join(items) and r.n_items == len(items) and r.text_chars == sum(map(len, paragraphs))
