"""The pipeline against its stages in plain Python, row for row."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from karstflow.llm import bpe, quality
from test_contracts import ROWS, words
from test_near_copies import survivors
from test_secret_scan import random_spans
from test_contracts import quality_of, secrets_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(text):
    """Whether the current policy keeps a text, by its rules as they are written."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = quality_of(text)
    n_lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    n_letters = sum(c.isalpha() or __import__("unicodedata").category(c)[0] == "M" for c in text or "")
    names = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_lines": n_lines, "n_letters": n_letters}
    return not any(eval(r.fails.replace("AND", "and").replace("OR", "or"), {}, names) for r in quality.RULES)


def redacted(rows):
    """The texts with all spans masked, those of the battery judged over all rows."""
    for (d, text), random_ in zip(rows, random_spans(rows), strict=True):
        spans = sorted([(a, b) for _, a, b in secrets_of(text or "")] + random_)
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [text[at:a], "<secret>"]
            at = max(at, b)
        yield d, None if text is None else "".join(out) + text[at:]


def _awkward():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    copied, unnamed = text(60), text(60)
    near = copied.split()
    near[30] = "other"
    rows = [(None, text(40)), (None, text(40)), (5, text(40)), (5, text(40)), (None, copied), (6, copied), (9, " ".join(near)), (None, unnamed), (None, unnamed), (7, text(40) + f" token = {key} end"), (8, text(30) + f" {key[::-1]} end")]
    return rows + [(10, "too short"), (11, ""), (12, None), (12, None), (13, " ".join(["again and again it says so here"] * 9)), (14, text(9000)), (15, "#$% " * 40 + text(30))] + ROWS


def _sf():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


@pytest.mark.parametrize("rows", [_sf(), _awkward()], ids=["sf0.001", "awkward"])
def test_pipeline(spark, tmp_path, rows):
    from tokenizers import Tokenizer

    extra = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    # Columns with names that the stages use themselves.
    clashing = f"{COLUMNS}, _row long, node long, text_ string, uid long"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in extra], clashing).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    staged = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert staged.columns == docs.columns
    clean = [(d, t) for d, t in rows if kept(t)]
    assert collections.Counter((r.doc_id, r.text) for r in staged.collect()) == collections.Counter(clean)
    alone = [clean[i] for i in sorted(survivors(clean))]
    unique = corpus_pipeline.near_dedup(spark, staged, str(tmp_path))
    assert unique.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in unique.collect()) == collections.Counter(alone)
    masked = list(redacted(alone))
    scanned = corpus_pipeline.secret_scans(spark, unique, str(tmp_path))
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in scanned.collect()) == collections.Counter((d, t, len(t)) for d, t in masked)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    expected = collections.Counter()
    for d, t in masked:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        expected.update((d, a, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == expected
    at = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id] and r.offset + r.length <= 4096
        at[r.sequence_id] += r.length
    assert sorted(at) == list(range(len(at)))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "packing"]
