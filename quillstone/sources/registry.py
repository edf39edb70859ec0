"""The document registry: a checked dimension table, and the lookup join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vocabulary as V


def whole(c):
    """A number as an integer; text that is no whole number is null (a fraction is an error elsewhere)."""
    number = F.expr(f"try_cast({c} as double)")
    return F.when(number == F.floor(number), number.cast("int"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header.  Missing columns raise ``ValueError``; a null or non-numeric
    ``id`` fails the job; bad years and priorities are null; a fractional year is an error.
    ``position`` counts the rows in the order of the file."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension in ("xlsx", "xls"):
        return _from_excel(spark, path)
    if extension != "csv":
        raise ValueError(f"unsupported registry format: .{extension}")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)  # one task reads a file whole, in order
    return checked(rows.withColumn("position", F.monotonically_increasing_id()))


def _from_excel(spark: SparkSession, path: str) -> DataFrame:
    """Driver-side adapter; needs a pandas Excel engine, which may not be installed."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str)
    frame["position"] = range(len(frame))
    return checked(spark.createDataFrame(frame.astype(object).where(frame.notna(), None)).withColumn("position", F.col("position").cast("long")))


def checked(raw: DataFrame) -> DataFrame:
    missing = sorted(set(V.REGISTRY_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"registry lacks columns {missing}; it has {raw.columns}")
    fraction = lambda c: F.when(F.expr(f"try_cast({c} as double)") % 1 != 0, F.raise_error(F.lit(f"fractional {c} in the registry")).cast("int")).otherwise(whole(c))
    note = F.coalesce(F.col("commentaire").cast("string"), F.lit("")) if "commentaire" in raw.columns else F.lit("")
    texts = [F.col(c).cast("string").alias(c) for c in ("type_document", "titre", "source", "url", "nom_pdf", "theme")]
    return raw.select(F.col("id").cast("int").alias("id"), *texts, fraction("annee").alias("annee"), fraction("priorite").alias("priorite"), note.alias("commentaire"), *(["position"] if "position" in raw.columns else []))


def last_wins(registry: DataFrame, order_col: str, key: str = "nom_pdf") -> DataFrame:
    """One row per key: the last one."""
    w = Window.partitionBy(key).orderBy(F.desc(order_col))
    return registry.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def enrich(files: DataFrame, registry: DataFrame, source_col: str = "source") -> DataFrame:
    """Left join on the pdf name in the file name.  The registry is broadcast only
    under the session's size threshold.  Unmatched files keep empty defaults."""
    kept = registry.select(
        F.col("nom_pdf").alias("_pdf"), F.col("id").alias("registry_id"), "type_document", "titre", "annee",
        F.col("source").alias("source_juridique"), "url", "nom_pdf", "theme", "priorite", "commentaire")
    out = files.withColumn("_name", T.pdf_name(F.col(source_col))).join(kept, F.col("_name") == F.col("_pdf"), "left").drop("_name", "_pdf")
    return out.fillna("", ["type_document", "titre", "source_juridique", "url", "nom_pdf", "theme", "commentaire"])
