"""Interleaved document sequences: text and media references in document order, payloads by digest.

HTML parses into an ordered array of structs (position, kind, text, digest, caption). Payloads are
stored losslessly as 8-bit grey PNG images of WIDTH samples a row in a table keyed by the
payload's SHA-256; references are resolved by a join on that digest, so positions and captions stay
aligned with what they refer to.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, stored
from .textkernel import slices, trimmed

WIDTH, FILL, LEVEL, SCHEME = 192, b" ", 1, "media:sha256-"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "n_samples long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SILENT = {"script", "style", "template", "title", "head"}
_BLOCK = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "br", "figure", "footer", "nav", "blockquote", "pre"}


def padded(text):
    """Column: the text's UTF-8 bytes (null: none), spaces appended up to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    fill = F.when(size == 0, WIDTH).otherwise((WIDTH - size % WIDTH) % WIDTH).cast("int")
    return F.concat(raw, F.repeat(F.lit(FILL.decode()), fill).cast("binary"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """8-bit grey samples, WIDTH a row, as a PNG image; the payload is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> bytes:
    """The samples of encode_png's images, with every checksum and length verified."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, shape, packed = 8, None, []
    while at < len(image):
        size = int.from_bytes(image[at : at + 4], "big")
        if at + size + 12 > len(image):
            raise ValueError("a chunk is cut off")
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if (width, rest) != (WIDTH, [8, 0, 0, 0, 0]):
                raise ValueError("not a grey image of the stored form")
            shape = height
        elif kind == b"IDAT":
            packed.append(data)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if shape is None or len(lines) != shape * (WIDTH + 1):
        raise ValueError("rows are missing")
    lines = lines.reshape(shape, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("rows are filtered")
    return lines[:, 1:].tobytes()


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = self.caption = 0
        self.figure: int | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.caption and self.figure is not None and self.figure < len(self.items):
            for item in self.items[self.figure :]:
                if item["kind"] == "media":
                    item["caption"] = f"{item['caption']} {text}" if item["caption"] else text
        else:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK or tag in ("img", "figcaption"):
            self.end_text()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption += 1
        elif tag == "img":
            given = dict(attrs)
            source = given.get("src") or ""
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": source[len(SCHEME) :] if source.startswith(SCHEME) else None, "caption": given.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK or tag == "figcaption":
            self.end_text()
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption":
            self.caption = max(0, self.caption - 1)
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)


def parse_html(html: str | None) -> list[dict]:
    """Text and media references of a page in order; positions count from 0. Null: no items."""
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    reader.end_text()
    return reader.items


def sequences(pages: DataFrame, id_column: str, *more: str) -> DataFrame:
    """id, more, sequence (SEQUENCE) for each row of pages (id, html, more); null or empty html gives an empty sequence."""
    require(pages, id_column, "html", *more)
    named = [id_column, *more]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for part in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([parse_html(x) for x in part.columns[-1].to_pylist()], kind)], [*named, "sequence"])

    return pages.select(*named, "html").mapInArrow(run, ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in named) + f", sequence {SEQUENCE}")


def media_table(payloads: DataFrame) -> DataFrame:
    """digest, media: the stored table of payloads (digest, payload) as PNG images, written to the shared folder.

    A task encodes and stores a payload once, however many of its rows hold it.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # of the task's rows
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                digests, payloads = batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256)
                fresh = [i for i, d in enumerate(map(bytes.fromhex, digests)) if d not in done and not done.add(d)]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in fresh], pa.string()), pa.array([encode_png(payloads[i].as_py()) for i in fresh], pa.binary())], ["digest", "media"])

    return stored(payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary"))


def features(media: DataFrame) -> DataFrame:
    """digest and FEATURES, one row for each digest, of the samples read back from media (digest, media).

    feature: height, mean, deviation, entropy and the share of rows that differ from the one above.
    Raises if the samples don't have the digest they are stored under.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = decode_png(image)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"media stored under {digest} holds {found}")
                samples = np.frombuffer(payload, np.uint8)
                count = np.bincount(samples, minlength=256)
                share = count[count > 0] / len(samples)
                mean = float((count * np.arange(256)).sum() / len(samples))
                spread = float(np.sqrt(max(0.0, (count * np.arange(256) ** 2).sum() / len(samples) - mean * mean)))
                out.append((digest, len(payload), found, zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), f"h={len(samples) // WIDTH} mean={mean:.4f} sd={spread:.4f} bits={float(-(share * np.log2(share)).sum()):.4f}"))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["digest", "n_samples", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInArrow(run, f"digest string, {FEATURES}").dropDuplicates(["digest"])


def interleaved(pages: DataFrame, media: DataFrame, id_column: str = "page_id", *more: str, kinds: tuple[str, ...] = ("text", "media")) -> DataFrame:
    """id, more, position, kind, text, caption, digest, n_items and FEATURES: every item of every page, in place.

    pages: id, html, more (columns that come along). media: digest, media (media_table's). Features are computed
    once a digest and only these small rows meet the references, so a payload that many pages share is read
    once. Text items and references whose digest is missing or unknown stay, with null features. n_items
    counts all of a page's; kinds says which are returned. Pages without items give no rows; repeated pages
    give their items each; null ids are carried through.
    """
    parsed = sequences(pages, id_column, *more)
    items = parsed.select(id_column, *more, F.size("sequence").alias("n_items"), F.explode(F.filter("sequence", lambda x: x["kind"].isin(*kinds))).alias("i")).select(id_column, *more, "n_items", "i.*")
    return items.join(stored(features(media)), "digest", "left")
