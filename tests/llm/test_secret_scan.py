"""The randomness battery against plain Python, its losses and its false finds."""

import math
import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from karstflow.llm import secret_scan as S
from test_contracts import ROWS, SCHEMA, secrets_of


def chi_tail(x, df):
    return {2: lambda: math.exp(-x / 2), 3: lambda: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 4: lambda: math.exp(-x / 2) * (1 + x / 2)}[df]()


def battery(text, encoding):
    letters, cells, n = S.ALPHABETS[encoding], S.CELLS[encoding], len(text)
    v = [letters.index(c) for c in text]
    chi = sum((sum(c in x for c in text) - n * len(x) / len(letters)) ** 2 / (n * len(x) / len(letters)) for x, _ in cells)
    high = [a >= len(letters) // 2 for a in v]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    both = 2 * up * (n - up)
    var = both * (both - n) / (n * n * (n - 1))
    z_runs = (runs - both / n - 1) / math.sqrt(var) if var > 0 else 30
    m = sum(v) / n
    spread = sum((a - m) ** 2 for a in v)
    z_serial = (sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n) if spread > 1e-9 else 30
    x = -sum(math.log(max(p, 1e-300)) for p in (chi_tail(chi, len(cells) - 1), *(math.erfc(min(abs(z), 30) / math.sqrt(2)) for z in (z_runs, z_serial))))
    return math.exp(-x) * (1 + x + x * x / 2)


def encoding_of(p):
    for pattern, name in (("[0-9]+", None), ("[0-9a-f]+|[0-9A-F]+", "hex"), ("[a-z]+|[A-Z]+", "base26"), ("[A-Z2-7]+", "base32"), ("[0-9a-z]+|[0-9A-Z]+", "base36")):
        if re.fullmatch(pattern, p):
            return name
    return "base64"


def random_spans(rows):
    """Spans of kind random for each row, one candidate after the other."""
    judged = []
    for k, (_, text) in enumerate(rows):
        text = text or ""
        for _, a, b in secrets_of(text):
            text = text[:a] + " " * (b - a) + text[b:]
        for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
            parts = re.split("[+/_=-]+", m[0])
            part = max(parts, key=lambda p: (len(p), p))
            if len(part) < 20:
                part = "".join(parts)
            name = encoding_of(part) if len(part) >= 16 else None
            if not name:
                continue
            low = part if name == "base64" else part.lower()
            log = sum(sum(c in x for c in low) * math.log10(len(x) / len(S.ALPHABETS[name]) / s) for x, s in S.CELLS[name])
            level = -1 if log < 0 or battery(low, name) < 0.01 else min(math.floor(log / 0.05), 400)
            judged.append((name, min(len(part) // 8, 16), level, k, m.start(), m.end()))
    out = [[] for _ in rows]
    for name, band, level, k, a, b in judged:
        family = [x[2] for x in judged if x[:2] == (name, band)]
        good = [t for t in family if t >= 0 and 10 ** (t * 0.05) >= len(family) / (0.05 * sum(f >= t for f in family))]
        if good and level >= min(good):
            out[k].append((a, b))
    return out


def check(spark, rows):
    got = {r.doc_id: r.spans for r in S.query(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], SCHEMA).repartition(3)).collect()}
    expected = random_spans(rows)
    for i in range(len(rows)):
        assert [x for x in got[i].split(",") if x.startswith("random")] == [f"random:{a}:{b}" for a, b in expected[i]], rows[i]
    return expected


ORDINARY = ["donau", "dampf", "schiff", "fahrt", "gesellschaft", "State", "Manager", "Factory", "get", "User", "ById", "request", "http", "2024", "01", "-", "_", "/", "=", "config", "MAX", "SIZE", "internationalisation", "x", "9"]


def tables():
    rng = random.Random(21)
    token = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    ordinary = lambda: "".join(rng.choice(ORDINARY) for _ in range(rng.randint(3, 8)))
    everything = string.ascii_letters + string.digits
    some = [("sk-" + token(string.ascii_lowercase + string.digits, 32)) for _ in range(30)] + [token(everything, rng.randint(18, 70)) for _ in range(60)] + [token("0123456789ABCDEF", 24) for _ in range(20)] + [token("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26) for _ in range(20)]
    mixed = [(i, " ".join(rng.sample(some, 2) + [ordinary() for _ in range(6)])) for i in range(60)]
    return {"mixed": mixed, "ordinary": [(i, " ".join(ordinary() for _ in range(9))) for i in range(60)], "awkward": ROWS}


@pytest.mark.parametrize("name", ["mixed", "ordinary", "awkward"])
def test_random_spans(spark, name):
    check(spark, tables()[name])


def test_losses_and_false_finds(spark):
    """Keys of 20 characters and with prefixes are found; ordinary tokens beside them aren't."""
    rng = random.Random(5)
    token = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    twenty = [token(string.ascii_letters + string.digits, 20) for _ in range(500)]
    prefixed = ["sk-" + token(string.ascii_lowercase + string.digits, 32) for _ in range(300)]
    words = ["".join(rng.choice(ORDINARY[:13]) for _ in range(rng.randint(4, 7))) for _ in range(1500)]
    words += ["/".join(rng.choice(ORDINARY[:12]) for _ in range(5)) for _ in range(500)]
    rows = [(i, f"see {t} there") for i, t in enumerate(twenty + prefixed + words)]
    got = {r.doc_id: r.n_random for r in S.query(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = lambda a, b: sum(got[i] for i in range(a, b))
    assert found(0, 500) >= 0.93 * 500 and found(500, 800) >= 0.85 * 300
    assert found(800, len(rows)) <= 0.05 * found(0, 800)


def test_erfc(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 4.0, 8.0, 15.0, 21.0]
    for x, y in spark.createDataFrame([(x,) for x in xs], "x double").select("x", S._erfc(F.col("x"))).collect():
        assert y == pytest.approx(math.erfc(x), rel=2e-7)


def test_many_spans(spark):
    """100,000 secrets in one text are masked in linear work."""
    rows = [(1, "0123456789abcdef " * 100_000, 0), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    began = time.time()
    got = {r.doc_id: r for r in S.redact(docs).collect()}
    assert got[1].text == "<secret> " * 100_000 and got[1].n_chars == 900_000 and got[2].text is None
    assert time.time() - began < 60
