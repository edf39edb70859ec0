"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

_text = lambda n: T.StructField(n, T.StringType(), False)
_int = lambda n: T.StructField(n, T.IntegerType(), True)

META = T.StructType([
    _text("source"), _text("filepath"), _text("extension"), T.StructField("size_bytes", T.LongType(), False), _text("modified_time"),
    _int("registry_id"), _text("type_document"), _text("titre"), _int("annee"), _text("source_juridique"), _text("url"),
    _text("nom_pdf"), _text("theme"), _int("priorite"), _text("commentaire"), _text("extraction_mode"),
])
#: The index at its JSON boundary.
INDEX = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()),
    T.StructField("strategy", T.StringType()), T.StructField("metadata", META),
])
CACHE = T.StructType([
    T.StructField("cache_key", T.StringType()), T.StructField("model", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
])
_box = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "top", "x1", "bottom")])
PAGES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("page_no", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
])
