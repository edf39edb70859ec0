"""WARC archives: writing, and reading back by boundary-chain verification.

Writing is a projection: a record is a string, the separator of records is the
line separator of Spark's text sink, so archives go to any store that Spark
writes.  A page whose payload equals that of a page with a smaller id becomes a
revisit without payload.

Reading does not trust the magic: payloads may contain it.  Each task emits
every position that looks like a record together with the offset where its
successor must start; pointer jumping from the start of the file keeps the
records that the chain reaches and rejects the rest.  A file holds at most
``FILE_BYTES`` bytes before compression, or one record, so what a task or a chain
holds is bounded.  Where a chain ends before its file does, a damaged record say,
``damage`` reports the rest; ``read`` gives the records up to there.

Null html is the empty payload, which is deduplicated like any other; a null
url is empty.  Rows with the same page_id and payload are all responses; a null
page_id reads back as null, and among equal payloads it revisits.  Records are
those of the rows, repeated rows included; an empty table gives none.  Only
page_id, url and html are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, table_path

#: Bytes of a file before compression, and of the records that are written most to a file.
FILE_BYTES, SMALL = 1 << 26, 1 << 15
CRLF = "\r\n"
_magic = re.compile(rb"WARC/1\.[01]\r\n")
RECORD_DDL = "file string, position long, successor long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("file", pa.string()), ("position", pa.int64()), ("successor", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame) -> DataFrame:
    """One WARC record per page, as ``value``, without the closing separator."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("digest"))
    repeated = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # a written table: broadcast only if its true size is under the session's threshold
    joined = keyed.join(materialize(repeated, "warc-repeated"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "%0A"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2),
    )
    return joined.select(F.concat(head, block).alias("value"), size_class(F.octet_length("payload")).alias("class"))


def size_class(n: Column) -> Column:
    """0 for pages of up to ``SMALL`` bytes less room for a header, 3 for up to 8 times as many, and so on."""
    steps = F.ceil(F.log2((n + 4096) / F.lit(float(SMALL))) / 3)
    return (F.greatest(steps, F.lit(0)) * 3).cast("int")


def write(pages: DataFrame, path: str) -> None:
    """Archives in ``path``, gzipped; pages of like size share files, so that a count of records bounds the bytes."""
    made = records(pages)
    classes = pages.groupBy(size_class(F.coalesce(F.octet_length("html"), F.lit(0))).alias("class")).count().collect()  # a row per power of 8
    for k in sorted(r["class"] for r in classes) or [0]:
        most = max(1, FILE_BYTES // (SMALL << k))
        made.where(F.col("class") == k).select("value").write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower()] = v.strip()
    return out


def _number(name: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(m[1]) if m else None


def candidates(file: str, data: bytes) -> list[tuple]:
    """Every position that looks like a record, with its successor's offset."""
    out = []
    for m in _magic.finditer(data):
        at = m.start()
        body = data.find(b"\r\n\r\n", at)
        if body < 0:
            continue
        f = _fields(data[at:body])
        length = f.get(b"content-length", b"")
        if not length.isdigit() or len(length) > 15:
            continue
        body += 4
        end = body + int(length)
        if data[end:end + 4] != b"\r\n\r\n":
            continue
        split = data.find(b"\r\n\r\n", body, end)
        http = _fields(data[body:split]) if split >= 0 else {}
        kind = f.get(b"warc-type", b"").decode("latin-1")
        if kind == "revisit":
            size, digest = http.get(b"content-length", b"0"), f.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
            size = int(size) if size.isdigit() and len(size) < 16 else 0
        else:
            start = split + 4 if split >= 0 else body
            size, digest = end - start, base64.b32encode(hashlib.sha1(memoryview(data)[start:end]).digest()).decode()
        out.append((file, at, end + 4, _number(f.get(b"warc-record-id")), size, digest, kind, _number(f.get(b"warc-refers-to")) if kind == "revisit" else None))
    return out


def unzipped(content: bytes) -> bytes:
    """All members of a gzip file; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        parts.append(z.decompress(rest))
        rest = z.unused_data
    return b"".join(parts)


def reachable(position: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates (sorted by position) the chain from offset 0 reaches, by pointer jumping."""
    n = len(position)
    jump = np.searchsorted(position, successor)
    jump = np.where((jump < n) & (position[np.minimum(jump, n - 1)] == successor), jump, n) if n else jump
    jump = np.r_[jump, n].astype(np.int64)
    mark = np.zeros(n + 1, dtype=bool)
    if n and position[0] == 0:
        mark[0] = True
        for _ in range(max(1, n.bit_length())):
            mark[jump[mark]] = True
            jump = jump[jump]
    return mark[:n]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of all archives in ``path``, and a row of type ``unreached`` for each
    file that goes on where the chain from its start ends: from ``position`` up to ``successor``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def emit(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = unzipped(content.as_buffer().to_pybytes())
                rows = candidates(file, data) + [(file, len(data), len(data), None, None, None, "unreached", None)]
                yield pa.RecordBatch.from_pylist([dict(zip(_RECORD.names, r)) for r in rows], schema=_RECORD)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        end, table = table.slice(len(table) - 1), table.slice(0, len(table) - 1)  # nothing starts as far on as the end of the file
        table = table.filter(pa.array(reachable(table["position"].to_numpy(), table["successor"].to_numpy()), pa.bool_()))
        last = max(table["successor"].to_pylist(), default=0)
        if last == end["position"][0].as_py():
            return table
        return pa.concat_tables([table, end.set_column(1, _RECORD.field("position"), pa.array([last], pa.int64()))])

    return files.mapInArrow(emit, RECORD_DDL).groupBy("file").applyInArrow(chain, RECORD_DDL)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of all archives in ``path``."""
    return scan(spark, path).where("record_type <> 'unreached'")


def damage(spark: SparkSession, path: str) -> DataFrame:
    """file, position, successor: what no chain reaches of the archives in ``path``."""
    return scan(spark, path).where("record_type = 'unreached'").select("file", "position", "successor")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    path = table_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
