"""Prompt assembly and answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import priority_label


def header(enriched: Column, titre: Column, kind: Column, priority: Column, year: Column, source: Column, url: Column, file: Column) -> Column:
    """Title, type and label, year, source and address of an enriched document; else the file."""
    known = F.concat_ws(
        " | ", F.concat(F.lit("Titre: "), titre), F.concat(F.lit("Type: "), kind, F.lit(" (priorité: "), priority_label(priority), F.lit(")")),
        F.concat(F.lit("Année: "), F.coalesce(year.cast("string"), F.lit("None"))), F.concat(F.lit("Source: "), source), F.concat(F.lit("URL: "), url))
    return F.when(enriched, known).otherwise(F.concat(F.lit("Fichier: "), file))


def build_context(rows: DataFrame, key: str = "query_id", rank: str = "position", header_col: str = "header", text_col: str = "chunk") -> DataFrame:
    """One row per query: numbered excerpts in rank order.  Bounded by top-k rows a query."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(header_col).alias("h"), F.col(text_col).alias("t"))))
    grouped = rows.groupBy(key).agg(items.alias("_items"))
    one = lambda x, i: F.concat(F.lit("--- Extrait "), (i + 1).cast("string"), F.lit(" ["), x["h"], F.lit("] ---\n"), x["t"], F.lit("\n"))
    return grouped.select(key, F.array_join(F.transform("_items", one), "\n").alias("context"))


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Extraits des documents :\n\n"), context, F.lit("\n\n---\n\nQuestion posée : "), question,
        F.lit("\n\nRépondre d'abord en quelques phrases, puis préciser au besoin. S'en tenir aux extraits et citer le titre, le type et l'année de chaque source."))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def source_listing(enriched: Column, titre: Column, kind: Column, priority: Column, year: Column, cosine: Column, final: Column, url: Column, file: Column, rank: Column) -> Column:
    known = F.format_string(
        "[%d] %s...\n%s | P%s (%s) | %s\nScore: cos=%.4f final=%.4f\nURL: %s", rank, F.left(titre, F.lit(65)), kind,
        F.coalesce(priority.cast("string"), F.lit("None")), priority_label(priority), F.coalesce(year.cast("string"), F.lit("None")), cosine, final, url)
    return F.when(enriched, known).otherwise(F.format_string("[%d] %s (score=%.4f)", rank, file, cosine))
