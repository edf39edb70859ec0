"""The chunk index and the embedding cache, as tables; JSON at the boundary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vector
from quillstone.sources.schemas import CACHE, INDEX, META


def _first_character(spark: SparkSession, path: str) -> str:
    """Of the first file that is not blank; ``path`` may be a file, a folder or a pattern."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for s in fs.globStatus(target) or [] for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    for f in sorted((f.getPath() for f in found if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda x: x.toString()):
        stream = fs.open(f)
        try:
            while (c := stream.read()) >= 0:
                if not chr(c).isspace() and c not in (0xEF, 0xBB, 0xBF):  # a byte order mark
                    return chr(c)
        finally:
            stream.close()
    return ""


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON, as an array or as lines.  A missing top-level key is an error."""
    array = _first_character(spark, path) == "["
    rows = spark.read.schema(INDEX).option("multiLine", array).option("mode", "FAILFAST").json(path)
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"index rows need {c}")).cast(INDEX[c].dataType)).otherwise(F.col(c)).alias(c) for c in ("text", "embedding", "chunk_index", "total_chunks", "strategy")]
    return rows.select(*checked, "metadata")


def save_index(chunks: DataFrame, path: str) -> None:
    """Parquet, overwritten."""
    chunks.write.mode("overwrite").parquet(path)


def metadata(chunks: DataFrame) -> Column:
    """The metadata of a row as one struct; columns that the rows lack are null."""
    return F.struct(*[(F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in META])


def metadata_json(chunks: DataFrame) -> Column:
    """The metadata of a row as a JSON object with every key."""
    return F.to_json(metadata(chunks), {"ignoreNullFields": "false"})


def as_index(chunks: DataFrame) -> DataFrame:
    """Rows of the index at its JSON boundary, from embedded chunks."""
    if "metadata" in chunks.columns:
        return chunks.select(*INDEX.names)
    return chunks.select(F.col("chunk").alias("text"), vector.doubles(F.col("embedding")).alias("embedding"), "chunk_index", "total_chunks", "strategy", metadata(chunks).alias("metadata"))


def export_json(chunks: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines, written in parallel.  With ``array`` one file with one JSON array,
    for readers of whole files; it streams through one task."""
    rows = as_index(chunks)
    if not array:
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return

    def run(batches):
        head = "["
        for b in batches:
            lines = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(head if i == 0 else ",") + x for i, x in enumerate(lines)], pa.string())], names=["value"])
            head = "," if lines else head
        yield pa.RecordBatch.from_arrays([pa.array(["]" if head == "," else "[]"], pa.string())], names=["value"])

    lines = rows.select(F.to_json(F.struct(*INDEX.names), {"ignoreNullFields": "false"}).alias("value"))
    lines.coalesce(1).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def save_texts(docs: DataFrame, path: str, text_col: str = "text", name_col: str | None = None) -> None:
    """The texts as UTF-8 lines, or with ``name_col`` a folder per document that holds its text file."""
    if name_col is None:
        docs.select(text_col).write.mode("overwrite").text(path)
        return
    rows = docs.select(F.col(text_col).alias("value"), F.col(name_col).alias("name"))
    rows.write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def cache_key(text) -> F.Column:
    return F.md5(text.cast("binary"))


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path)


def load_cache_json(spark: SparkSession, directory: str, model: str) -> DataFrame:
    """One ``{md5}.json`` per vector, each a JSON array of numbers."""
    files = spark.read.option("wholetext", True).text(directory).select(F.input_file_name().alias("f"), "value")
    return files.select(F.regexp_extract("f", r"([0-9a-f]{32})\.json$", 1).alias("cache_key"), F.lit(model).alias("model"), F.from_json("value", "array<double>").alias("embedding"))


def probe(chunks: DataFrame, cache: DataFrame, model: str, text_col: str = "chunk") -> DataFrame:
    """The chunks with ``cache_key`` and ``embedding``, null for misses.  The key covers text and model."""
    own = cache.where(F.col("model") == model).select("cache_key", "embedding").dropDuplicates(["cache_key"])
    return chunks.withColumn("cache_key", cache_key(F.col(text_col))).join(own, "cache_key", "left")


def misses(chunks: DataFrame, cache: DataFrame, model: str, text_col: str = "chunk") -> DataFrame:
    """Distinct texts that the cache lacks."""
    own = cache.where(F.col("model") == model).select("cache_key")
    return chunks.select(cache_key(F.col(text_col)).alias("cache_key"), F.col(text_col).alias("text")).join(own, "cache_key", "left_anti").dropDuplicates(["cache_key"])


def append_cache(new: DataFrame, path: str) -> None:
    new.select("cache_key", "model", "embedding").write.mode("append").parquet(path)


def cache_counts(probed: DataFrame) -> DataFrame:
    return probed.agg(F.count_if(F.col("embedding").isNotNull()).alias("hits"), F.count_if(F.col("embedding").isNull()).alias("misses"))
