"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of structs, texts and media references
with their captions.  Payloads live in a media store keyed by digest, each as an
8-bit greyscale image (binary PGM, 64 samples a row), a lossless carrier for any
bytes padded to a multiple of 64.  References are resolved by a join on the
digest; only the reference and what was computed from the stored bytes travel
through the join, never the payload, and positions and captions stay beside
their reference throughout.

Markup is taken as it comes: figures may nest, a caption may stand before or
after its media, ``</figure>`` closes an open caption, and what is never closed
ends with the page.  No text is lost: a caption without media, or outside a
figure, is a text item, and so is what an unclosed ``noscript`` or ``template`` hides.

Null html or payload counts as empty; a reference that the store lacks stays,
unresolved (``resolved`` false); equal payloads share a digest and so all their
values, however many copies there are; repeated rows stay repeated; an empty
table gives an empty one.  A very long payload is one image of many lines, held by
one task at a time.  Rows carry the columns of ``keep``, named by the caller; the
names position, ref, caption, digest, resolved and those of the features are taken.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import table_path

WIDTH = 64
MEDIA_TAGS = {"img", "audio", "video", "source", "embed"}
SKIPPED = {"script", "style"}
#: Not shown, if they are closed.
HIDDEN = {"noscript", "template"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "table", "section", "article", "blockquote", "pre", "br", "hr", "ul", "ol", "body", "figure", "figcaption", "title", "nav", "td", "th"}
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
ITEM_DDL = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
FEATURES_DDL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Figure:
    def __init__(self):
        self.media: list[dict] = []
        self.words: list[str] = []
        self.in_caption = False


class _Sequence(HTMLParser):
    """Collects the ordered items of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skipping: str | None = None
        self.hidden: list[tuple[str, list[str]]] = []
        self.figures: list[_Figure] = []

    def add(self, kind: str, **values) -> dict:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "ref": None, "caption": None, **values})
        return self.items[-1]

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add("text", text=text)

    def in_caption(self) -> bool:
        return bool(self.figures) and self.figures[-1].in_caption

    def end_figure(self):
        self.flush()
        figure = self.figures.pop()
        caption = " ".join("".join(figure.words).split())
        for item in figure.media:
            item["caption"] = caption or item["caption"]
        if caption and not figure.media:
            self.add("text", text=caption)

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping = tag
        elif tag in HIDDEN:
            self.hidden.append((tag, []))
        if tag in BLOCKS and tag != "figcaption" and self.in_caption():
            self.figures[-1].words.append(" ")
        elif tag in BLOCKS:
            self.flush()
        a = dict(attrs)
        if tag == "figure":
            self.flush()
            self.figures.append(_Figure())
        elif tag == "figcaption" and self.figures:
            self.figures[-1].words.append(" ")
            self.figures[-1].in_caption = True
        elif tag in MEDIA_TAGS and a.get("src"):
            self.flush()
            item = self.add("media", ref=a["src"], caption=a.get("alt") or a.get("title"))
            if self.figures:
                self.figures[-1].media.append(item)

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED | HIDDEN | {"figure", "figcaption"}:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.skipping:
            self.skipping = None
        for i in range(len(self.hidden) - 1, -1, -1):
            if self.hidden[i][0] == tag:
                del self.hidden[i:]
                break
        if tag == "figcaption" and self.in_caption():
            self.figures[-1].in_caption = False
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in BLOCKS and self.in_caption():
            self.figures[-1].words.append(" ")
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.skipping is None:
            (self.hidden[-1][1] if self.hidden else self.figures[-1].words if self.in_caption() else self.text).append(data)

    def finish(self) -> list[dict]:
        self.flush()
        while self.figures:
            self.end_figure()
        for _, words in self.hidden:
            self.text += words
        self.flush()
        return self.items


def parse_html(html: str | None) -> list[dict]:
    """Ordered items of a page; malformed markup never raises."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.finish()


def interleave(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` and ``items``, the ordered sequence of texts and media references."""
    kept = pages.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", items {ITEM_DDL}"

    def run(batches):
        for b in batches:
            items = pa.array([parse_html(x) for x in b.column(len(keep)).to_pylist()], pa.list_(ITEM))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], items], names=[*keep, "items"])

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)


def padded(payload: Column) -> Column:
    """The bytes, with bytes 0 up to a positive multiple of ``WIDTH``."""
    n = F.greatest(F.ceil(F.octet_length(payload) / WIDTH) * WIDTH, F.lit(WIDTH)).cast("int")
    return F.rpad(payload, n, F.lit(b"\x00"))


def as_image(samples: Column) -> Column:
    """A binary PGM with the samples as its pixels."""
    header = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(samples) / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(header.cast("binary"), samples)


def write_store(media: DataFrame, name: str = "media-store") -> str:
    """Write (digest, payload) as a media store in the shared folder; its path."""
    path = table_path(media.sparkSession, name)
    samples = padded(F.coalesce(F.col("payload"), F.lit(b"")))
    media.select("digest", as_image(samples).alias("media")).write.option("compression", "zstd").parquet(path)
    return path


def samples_of(media: bytes) -> memoryview:
    """The samples of a binary PGM."""
    view, at, fields = memoryview(media), 0, []
    while len(fields) < 4:
        end = at
        while view[end] not in b" \n\t\r":
            end += 1
        fields.append(bytes(view[at:end]))
        at = end + 1
    if fields[0] != b"P5" or fields[3] != b"255" or len(view) - at != int(fields[1]) * int(fields[2]):
        raise ValueError("not an 8-bit binary PGM")
    return view[at:]


def describe(samples: memoryview) -> str:
    """Mean, deviation, entropy and share of high samples."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    n, level = int(counts.sum()), np.arange(256)
    mean = int(counts @ level) / n  # whole sums, so that equal samples give equal digits anywhere
    spread = math.sqrt(max(0.0, int(counts @ (level * level)) / n - mean * mean))
    some = counts[counts > 0]
    entropy = math.log2(n) - float((some * np.log2(some)).sum()) / n
    return f"mean={mean:.4f};sd={spread:.4f};entropy={entropy:.4f};high={int(counts[128:].sum()) / n:.4f}"


def store_features(spark, path: str) -> DataFrame:
    """One row per digest, computed from the stored bytes read back."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0), b.column(1)):
                stored = memoryview(media.as_buffer())
                s = samples_of(stored)
                rows.append((digest.as_py(), len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(s)))
            names = [f.split()[0] for f in FEATURES_DDL.split(", ")]
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = spark.read.schema("digest string, media binary").parquet(path).mapInArrow(run, FEATURES_DDL)
    names = [f.split()[0] for f in FEATURES_DDL.split(", ")]
    return rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in names[1:]])


def resolve(sequences: DataFrame, keep: list[str], features: DataFrame, scheme: str = "sha256:") -> DataFrame:
    """A row per media reference: ``keep``, position, ref, caption and the payload's features."""
    refs = sequences.select(*keep, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("_i")).select(
        *keep, F.col("_i.position").alias("position"), F.col("_i.ref").alias("ref"), F.col("_i.caption").alias("caption"))
    keyed = refs.withColumn("digest", F.when(F.col("ref").startswith(scheme), F.substring("ref", len(scheme) + 1, 64)))
    return keyed.join(features, "digest", "left").withColumn("resolved", F.col("media_sha256").isNotNull())


def assemble(sequences: DataFrame, key: str, resolved: DataFrame) -> DataFrame:
    """``key`` (unique) and ``items`` again in order, media items with the digest of their stored bytes."""
    found = resolved.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", "media_sha256"))).alias("_found"))
    items = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in ("position", "kind", "text", "ref", "caption")], F.col("_found")[x["position"]].alias("media_sha256")))
    return sequences.join(found, key, "left").select(key, items.alias("items"))
