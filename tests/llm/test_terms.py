"""Disclosing terms, also far from their entity, against counts in plain Python."""

import collections
import math
import random
import re

import regex

from karstflow.llm import pii
from test_contracts import personal


def test_op6_whole_documents(spark):
    gap = "the patient came and met us and wrote about the case from home " * 10
    rows = [(i, f"Zebedee came. {gap} zq@clinic.example.org") for i in range(4)] + [(9, f"so said Zebedee. {gap}")]
    rows += [(100 + i, gap) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.query(docs).collect()}
    # far from the address, and in a text without it
    assert got[0] == ["term:0:7"] and got[9] == ["term:8:15"] and not any(got[100 + i] for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("Zebedee" in clean[d] for d in (0, 1, 2, 3, 9))


def brute(rows):
    """Term spans of each row by the definition, counted document by document."""
    texts = [t or "" for _, t in rows]
    names, clear = [], []
    for t in texts:
        spans = personal(t)
        own = set()
        for kind, a, b in spans:
            own.add((kind, t[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])))
            t = t[:a] + " " * (b - a) + t[b:]
        names.append(own)
        clear.append(t)
    split = lambda t: {x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", t.lower()) if len(x) > 2 and not re.search("[0-9]", x)}
    n_t = collections.Counter(x for t in texts for x in split(t))
    n_e = collections.Counter(e for own in names for e in own)
    n_te = collections.Counter((x, e) for t, own in zip(clear, names) for e in own for x in split(t))
    strong = {x for (x, e), n in n_te.items() if n > 1 and n / (n_t[x] + 1) > 0.5 and math.log2(n * len(rows) / (n_t[x] * n_e[e])) >= 5 and math.log2(len(rows) / n_t[x]) >= 5}
    for t in clear:
        yield [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t) if m[0].lower() in strong]


def test_op6_random_tables(spark):
    for seed in range(3):
        rng = random.Random(seed)
        common = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
        people = [(f"{w}.x@mail{k}.org", [f"Secret{w}", f"Other{w}"]) for k, w in enumerate(("ada", "bob", "cyd", "dan", "eve"))] + [("+1 202 555 0100", ["Zebedee"]), ("10.0.0.7", ["Ümlaut", "host9"])]
        rows = []
        for i in range(500):
            words = [rng.choice(common) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.15:
                who, terms = rng.choice(people)
                words += [who] + [t for t in terms if rng.random() < 0.8]
            if rng.random() < 0.01:
                words.append("Zebedee")
            rng.shuffle(words)
            rows.append((i if rng.random() < 0.9 else None, " ".join(words) if rng.random() < 0.97 else None))
        expected = collections.Counter((d, tuple(x)) for (d, _), x in zip(rows, brute(rows), strict=True))
        got = pii.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        spans = [(r.doc_id, tuple(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term"))) for r in got]
        assert collections.Counter(spans) == expected and any(x for _, x in spans)


def test_op6_overlaps_and_many(spark):
    """Spans that overlap are masked as one, and 50,000 addresses in linear work; a null text is empty."""
    import time

    rows = [(1, "call +4111 1111 1111 1111 now"), (2, "a@b.org " * 50_000), (3, None)]
    began = time.time()
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "call +<card> now", 2: "<email> " * 50_000, 3: ""} and time.time() - began < 90


def test_op6_general_forms(spark):
    """The longest beginning that a frequent term shares; <term> without one; nothing near certainty."""
    rows = [(i, f"met Zebedee and Quorvex by zq@clinic.example.org {'at home' if i % 2 else 'here'}") for i in range(4)]
    rows += [(10 + i, f"a zebra and zebu {i}") for i in range(20)] + [(100 + i, "and by the way home here at a time") for i in range(300)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "<term> zeb… and <term> by <email> here" and clean[10] == rows[4][1]
    many = [(i, f"met Zebedee by zq@clinic.example.org {i}") for i in range(12)] + [(100 + i, "and by the way") for i in range(600)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert clean[3] == "  by <email> 3"
