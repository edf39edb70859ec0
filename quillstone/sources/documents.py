"""Directories of files, and their page texts through a pluggable extractor.

PDF layout extraction is a boundary: an extractor maps a file's bytes to pages
``{"page_no", "text", "tables"}``, and may add ``plain`` (the text without layout,
taken where the layout text is blank), ``objects`` (words with their boxes) and
``boxes`` (of the tables), from which the text outside the tables is made.  The
engine ships ``PlainExtractor``, which reads UTF-8 text with form feeds between
pages; a PDF extractor plugs in the same way.  A file that fails is reported,
never fatal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.tables import text_outside

_BOX = "x0: double, top: double, x1: double, bottom: double"
PAGE_ROWS = f"path string, page_no int, text string, tables array<array<array<string>>>, error string, plain string, objects array<struct<{_BOX}, text: string>>, boxes array<struct<{_BOX}>>"


class PlainExtractor:
    """UTF-8 text, one page per form feed, no tables."""

    def __call__(self, content: bytes) -> Iterator[dict]:
        for i, text in enumerate(content.decode("utf-8").split("\f")):
            yield {"page_no": i + 1, "text": text, "tables": []}


def list_files(spark: SparkSession, directory: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """source, filepath, extension, size_bytes, modified_time and content of matching files
    (dot files are never listed)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("source"), F.col("path").alias("filepath"), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1)).alias("extension"),
        F.col("length").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_time"), "content")


def check_directory(spark: SparkSession, directory: str) -> None:
    """``NotADirectoryError`` for what is no folder of Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(directory)


def other_files(spark: SparkSession, directory: str, pattern: str = "*.[pP][dD][fF]") -> int:
    """Files of the folder that the pattern leaves out (dot files do not count)."""
    every = spark.read.format("binaryFile").load(directory).select("path")
    return every.join(list_files(spark, directory, pattern).select(F.col("filepath").alias("path")), "path", "left_anti").count()


def check_file(path: str) -> None:
    """``ValueError`` for a file of another kind."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a pdf: {path}")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterator[dict]] | None = None) -> DataFrame:
    """A row per page; a failing file gives one row with ``error``."""
    extractor = extractor or PlainExtractor()

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["filepath"], batch["content"]):
                try:
                    rows += [(path, p["page_no"], p["text"], p.get("tables") or [], None, p.get("plain"), p.get("objects"), p.get("boxes")) for p in extractor(bytes(content))]
                except Exception as e:  # noqa: BLE001  isolation per file
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}", None, None, None))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "tables", "error", "plain", "objects", "boxes"])

    return files.select("filepath", "content").mapInPandas(run, PAGE_ROWS)


def page_texts(pages: DataFrame, outside: bool | Column = False) -> DataFrame:
    """The pages with their text: the layout text, else the plain one, else empty; with
    ``outside``, where words and tables are known, the words that lie in no table."""
    blank = lambda c: F.trim(F.regexp_replace(c, "\\s", " ")) == ""
    text = F.coalesce(F.when(~blank(F.col("text")), F.col("text")), F.col("plain"), F.col("text"), F.lit(""))
    if outside is not False:
        known = F.lit(outside) & F.col("objects").isNotNull() & (F.size("boxes") > 0)
        text = F.when(known, text_outside(F.col("objects"), F.col("boxes"))).otherwise(text)
    return pages.withColumn("text", F.when(F.col("error").isNull(), text)).drop("plain", "objects", "boxes")


def ingest_counts(documents: DataFrame) -> DataFrame:
    """Documents loaded, enriched and skipped."""
    ok = F.col("error").isNull()
    return documents.agg(F.count_if(ok).alias("loaded"), F.count_if(ok & F.col("registry_id").isNotNull()).alias("enriched"), F.count_if(~ok).alias("skipped"))
