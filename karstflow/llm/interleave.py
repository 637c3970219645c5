"""Interleaved document sequences: text and media in the order of a page.

Parsing a page yields one array of structs, text and media references, each
with its position. Media live apart, one row for each digest, stored as 8-bit
grey samples in PNG. Only references are joined, on their digests; what the
join finds goes back into the sequence by the reference's position, so texts,
media and captions stay aligned whatever order the join returns, and no text
is exchanged.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import let_workers_import, texts, written

SCHEME = "sha256:"
#: Samples in a row of a stored image; payloads are padded to whole rows.
ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

SEQUENCE = "array<struct<position:int,kind:string,text:string,chars:int,digest:string,caption:string>>"


class _Page(HTMLParser):
    """Items of a page in order: dicts of kind, text, digest, caption.

    What stands in a hidden element is dropped when the element is closed; of
    elements that never close, only script and style hide the rest of a page.
    A caption ends with its element, with the figure, and where a block begins;
    one without media is text.
    """

    HIDDEN = frozenset(("script", "style", "template", "noscript"))
    MEDIA = frozenset(("img", "audio", "video", "source", "embed"))
    BREAKS = frozenset(("p", "div", "section", "article", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "br", "pre", "blockquote"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._hidden: list[tuple[str, list[dict]]] = []  # open hidden elements, and the items before each
        self._figure: list[dict] | None = None
        self._caption: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self._text)
        self._text.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        """A figure's caption belongs to each of its media."""
        if self._caption is None:
            return
        caption, self._caption = "".join(self._caption), None
        for item in self._figure or ():
            item["caption"] = caption
        if not self._figure:
            self._text.append(caption)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.HIDDEN:
            self.flush()
            self._hidden.append((tag, self.items))
            self.items = []
        elif tag in self.MEDIA:
            found = dict(attrs)
            if src := found.get("src"):
                self.flush()
                item = {"kind": "media", "text": src, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": found.get("alt")}
                self.items.append(item)
                if self._figure is not None and not self._hidden:
                    self._figure.append(item)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self._caption = []
        elif tag in self.BREAKS:
            if tag != "br":
                self.end_caption()
            self.flush()
            if tag == "figure":
                self._figure = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            if any(tag == x for x, _ in self._hidden):
                while self._hidden:
                    opened, before = self._hidden.pop()
                    self._text.clear()
                    self.items = before
                    if opened == tag:
                        break
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
        elif tag in self.BREAKS:
            if tag == "figure":
                self.end_caption()
            self.flush()
            if tag == "figure":
                self._figure = None

    def handle_data(self, data: str) -> None:
        (self._text if self._caption is None or self._hidden else self._caption).append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.end_caption()
        self.flush()
        while self._hidden:
            opened, before = self._hidden.pop()
            self.items = before if opened in ("script", "style") else before + self.items
        return self.items


def parse(html: str) -> list[dict]:
    """The items of a page with their positions. An empty page has none."""
    page = _Page()
    page.feed(html)
    return [{"position": i, **item} for i, item in enumerate(page.finish())]


def png(samples: bytes, width: int = ROW) -> bytes:
    """8-bit grey samples, whole rows of them, as a PNG."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """The rows of samples of what `png` stored; anything else is an error."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, width, height = 8, [], 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Size, mean, deviation, entropy and a difference hash of samples, as JSON."""
    counts = np.bincount(rows.ravel(), minlength=256)
    n, values = rows.size, np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = math.sqrt(max(0.0, float((counts * values * values).sum() / n) - mean * mean))
    shares = counts[counts > 0] / n
    columns = rows.reshape(len(rows), 12, ROW // 12).sum(axis=(0, 2), dtype=np.int64)
    edge = int("".join("01"[int(a < b)] for a, b in zip(columns, columns[1:])), 2)
    return json.dumps({"w": rows.shape[1], "h": rows.shape[0], "mean": round(mean, 6), "dev": round(deviation, 6), "entropy": round(abs(float((shares * np.log2(shares)).sum())), 6), "edge": f"{edge:03x}"}, separators=(",", ":"))


def sequences(pages: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, sequence) of (doc_id, html): one row for each row of `pages`; items have position, kind, text, chars, digest and caption.

    with_text: whether texts go along; chars, their length, always does.
    """
    let_workers_import(pages.sparkSession)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("chars", pa.int32()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[{**x, "chars": len(x["text"]), "text": x["text"] if with_text or x["kind"] == "media" else None} for x in parse(html.as_py() or "")] for html in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(items, kind)], ["doc_id", "sequence"])

    return pages.select("doc_id", "html").mapInArrow(run, f"doc_id long, sequence {SEQUENCE}")


def payload(text: str) -> bytes:
    """UTF-8, filled with spaces to a positive multiple of ROW."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)


def stored(docs: DataFrame) -> DataFrame:
    """(digest, n_bytes, media): the payload of each text in stored form, once in each batch for equal payloads.

    digest: SHA-256 of the payload's bytes and the unpadded length, so that a
    text that ends in spaces isn't taken for its padded neighbour.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, tuple[int, bytes]] = {}
            for text in batch.column(1):
                raw = payload(text := text.as_py())
                n = len(text.encode("utf-8", "surrogatepass"))
                digest = f"{hashlib.sha256(raw).hexdigest()}-{n}"
                if digest not in seen:
                    seen[digest] = n, png(raw)
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.binary())], ["digest", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "digest string, n_bytes long, media binary")


def media_table(docs: DataFrame) -> DataFrame:
    """(digest, n_bytes, media), one row for each digest."""
    return stored(docs).groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("media").alias("media"))


def read_back(media: DataFrame) -> DataFrame:
    """(digest, n_bytes) and what the stored bytes of a media table give when read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2):
                data = data.as_py()
                rows = unpng(data)
                raw = rows.tobytes()
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(rows)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds, strict=True)]], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "n_bytes", "media").mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolved(found: DataFrame, media: DataFrame) -> DataFrame:
    """(doc_id, sequence) of `sequences` with the media columns in place: each item has `media`, a struct of the row with its digest, or null.

    Repeated and shared references meet the one row of their digest; a digest
    without a row leaves a null, the reference stays. Rows are told apart by a
    number given when the sequences are written, so ids may be null or
    repeated. References are small rows, so the optimiser splits those of a
    digest that many pages share.
    """
    rows = written(found.withColumn("_row", F.monotonically_increasing_id()), "sequences")
    refs = rows.select("_row", F.explode(F.filter("sequence", lambda x: x["digest"].isNotNull())).alias("x")).select("_row", F.col("x.position").alias("position"), F.col("x.digest").alias("digest"))
    met = refs.join(media.withColumn("media", F.struct(*[c for c in media.columns if c != "digest"])).select("digest", "media"), "digest")
    back = met.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias("_found"))
    both = rows.join(back, "_row", "left")
    return both.select("doc_id", F.transform("sequence", lambda x: x.withField("media", F.element_at("_found", x["position"]))).alias("sequence"))


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each text as a page of its paragraphs, with its payload as a captioned figure after the first and, if there are more, as an image at the end."""
    t = texts(docs)
    raw = F.encode("text", "utf-8")
    n = F.octet_length("text")
    fill = F.greatest(F.lit(1), F.ceil(n / ROW)).cast("int") * ROW - n
    digest = F.concat(F.sha2(F.concat(raw, F.encode(F.repeat(F.lit(" "), fill), "utf-8")), 256), F.lit("-"), n.cast("string"))
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    figure = F.concat(F.lit(f'</p><figure><img src="{SCHEME}'), "_d", F.lit('"><figcaption>doc '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    first, more = F.substring_index("_e", "\n", 1), F.regexp_replace(F.regexp_replace("_e", r"\A[^\n]*\n", ""), "\n", "</p><p>")
    rest = F.when(F.contains("_e", F.lit("\n")), F.concat(F.lit("<p>"), more, F.lit(f'</p><img alt="end" src="{SCHEME}'), "_d", F.lit('">'))).otherwise("")
    return t.select("doc_id", digest.alias("_d"), escaped.alias("_e")).select("doc_id", F.concat(F.lit("<p>"), first, figure, rest).alias("html"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id and what its payload's stored form gives, with the place and caption of its figure and the whole sequence.

    sequence: kind:chars of texts and kind:bytes of media, in order, comma-joined.
    A null or empty text has a payload of one row of spaces. Equal texts share
    one stored form. Repeated rows give a row each; an empty table none. A text
    of any length is one payload, held by one task at a time.
    """
    found = resolved(sequences(pages_of(docs), with_text=False), read_back(media_table(docs)))
    media = F.filter("sequence", lambda x: x["media"].isNotNull())
    shown = F.transform("sequence", lambda x: F.concat_ws(":", x["kind"], F.when(x["kind"] == "text", x["chars"].cast("string")).otherwise(x["media"]["media_bytes"].cast("string"))))
    chars = F.aggregate(F.filter("sequence", lambda x: x["kind"] == "text"), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    rows = found.select("doc_id", F.get(media, F.lit(0)).alias("m"), F.size("sequence").alias("n_items"), F.size(media).alias("n_media"), chars.alias("text_chars"), F.array_join(shown, ",").alias("sequence"))
    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return rows.select("doc_id", *[F.col(f"m.media.{c}").alias(c) for c in columns], "m.position", "m.caption", "n_items", "n_media", "text_chars", "sequence")
