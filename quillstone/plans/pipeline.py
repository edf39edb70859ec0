"""Index build and question answering, end to end; also a command line."""

from __future__ import annotations

import argparse
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking, cleaning, prompt, retrieval, tables
from quillstone.sources import documents, index, providers, registry
from quillstone.storage import materialize

DECOMPOSE = "Découper la question en sous-questions de recherche, une par ligne, sans numéro."
REWRITE = "Reformuler la question en une seule requête de recherche, sur une ligne."
ANSWER = "Répondre en français, uniquement à partir des extraits donnés, en citant les sources."


def ingest(spark: SparkSession, directory: str, registry_path: str | None = None, mode: str | None = None, extractor=None, ordered: bool = True) -> DataFrame:
    """doc_id, text, error and metadata of every file, in the order of the file names
    unless ``ordered`` is false.  The doc_id is the file's name, or its path where
    several folders hold one of that name.

    Each file is read and extracted once: its pages are written to the shared folder."""
    files = documents.list_files(spark, directory)
    pages = materialize(documents.extract_pages(files, extractor).withColumn("doc_id", F.xxhash64("path")), "pages")
    good = pages.where("error is null")
    if mode is None:
        moded = good.join(tables.document_mode(_page_texts(good)), "doc_id")
    else:
        moded = good.withColumn("mode", F.lit(mode))
    modes = moded.select("doc_id", "mode").where("page_no is not null").dropDuplicates(["doc_id"])
    folded = tables.fold_pages(_page_texts(moded, True), F.col("mode")).join(modes, "doc_id")
    failed = pages.where("error is not null").select("doc_id", F.lit(None).cast("string").alias("text"), "error", F.lit("generic").alias("mode"))
    done = cleaning.clean_documents(folded.select("doc_id", "text", "error", "mode")).unionByName(failed)
    enriched = files.drop("content").withColumn("doc_id", F.xxhash64("filepath"))
    if registry_path:
        enriched = registry.enrich(enriched, registry.last_wins(registry.load_registry(spark, registry_path), "position"))
    else:
        enriched = enriched.withColumns({"registry_id": F.lit(None).cast("int"), "priorite": F.lit(None).cast("int"), "annee": F.lit(None).cast("int"), **{c: F.lit("") for c in ("type_document", "titre", "source_juridique", "url", "nom_pdf", "theme", "commentaire")}})
    many = F.count(F.lit(1)).over(Window.partitionBy("source")) > 1
    out = done.join(enriched, "doc_id").withColumnRenamed("mode", "extraction_mode").withColumn("doc_id", F.when(many, F.col("filepath")).otherwise(F.col("source")))
    return out.orderBy("source", "filepath") if ordered else out


def _page_texts(pages: DataFrame, billing: bool = False) -> DataFrame:
    """The pages' cleaned texts; billing documents leave out what stands in tables, which are formatted apart."""
    texts = documents.page_texts(pages, F.col("mode") == "ngap") if billing else documents.page_texts(pages)
    return texts.withColumn("text", T.dedupe_adjacent_lines(T.normalize_page_text(F.col("text"))))


def ingest_file(spark: SparkSession, path: str, registry_path: str | None = None, mode: str | None = None, extractor=None) -> DataFrame:
    """One file; another kind is a ``ValueError``, a missing one a ``FileNotFoundError``."""
    documents.check_file(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    return ingest(spark, path, registry_path, mode, extractor)


def build_index(spark: SparkSession, directory: str, out: str, cache: str, registry_path: str | None = None, mode: str | None = None, strategy: str = "semantic", chunk_size: int = 800, overlap: int = 150, least: int = 150, most: int = 1500, embedder=None, extractor=None) -> dict:
    """Ingest, chunk, embed, write; the counts of each step.  Nothing to read gives an empty index."""
    embedder = embedder or providers.HashEmbedder()
    documents.check_directory(spark, directory)
    docs = materialize(ingest(spark, directory, registry_path, mode, extractor, ordered=False), "documents")
    counts = documents.ingest_counts(docs).first().asDict()
    counts["skipped"] += documents.other_files(spark, directory)
    chunks = materialize(chunking.chunk_documents(docs.where("error is null").drop("error"), strategy, chunk_size, overlap, least, most), "chunks")
    embedded = providers.embed_chunks(chunks, cache, embedder)
    key = F.concat_ws("#", "doc_id", F.col("chunk_index").cast("string"))
    index.save_index(embedded.withColumn("vec_id", F.xxhash64(key)), out)
    written = spark.read.parquet(out)
    stats = chunking.chunk_stats(written).first()
    return {**counts, **(stats.asDict() if stats else {"n_chunks": 0})}


def ask(spark: SparkSession, index_path: str, question: str, embedder, chat, top_k: int = 100, retrieval_k: int = 150, least: float = 0.68, multi_query: bool = True, reranker=None, dedup: bool = False, rewrite: bool = False) -> SimpleNamespace:
    """Answer, question, prompt, sub-queries and ranked sources.  The question is
    decomposed, or rewritten if only that is asked for; blank queries are dropped."""
    chunks = spark.read.parquet(index_path)
    asked = spark.createDataFrame([(0, question)], "query_id long, text string")
    if multi_query:
        asked = providers.sub_queries(asked, chat, DECOMPOSE)
    elif rewrite:
        asked = providers.rewritten(asked, chat, REWRITE)
    else:
        asked = asked.withColumn("sq_idx", F.lit(0))
    texts = [r["text"].strip() for r in asked.orderBy("sq_idx").collect() if r["text"] and r["text"].strip()] or [question]
    queries = spark.createDataFrame([(0, i, [float(x) for x in v]) for i, v in enumerate(embedder.embed(texts))], "query_id long, sq_idx long, vec array<double>")
    merged = scores = None
    if reranker is not None:
        merged = materialize(retrieval.merge_best(retrieval.search(chunks, queries, retrieval_k)), "candidates")
        candidates = merged.join(chunks.select("vec_id", "chunk"), "vec_id").withColumn("query", F.lit(question))
        scores = providers.rerank_candidates(candidates, reranker)
    found = retrieval.retrieve(chunks, queries, top_k, retrieval_k, least, scores, dedup, merged=merged)
    rows = found.join(chunks.drop("embedding", "priorite", "annee"), "vec_id").withColumn("meta_priorite", F.col("priorite"))
    header = prompt.header(F.col("registry_id").isNotNull(), F.col("titre"), F.col("type_document"), F.col("priorite"), F.col("annee"), F.col("source_juridique"), F.col("url"), F.col("source"))
    context = prompt.build_context(rows.withColumn("header", header))
    built = context.select(prompt.user_prompt(F.lit(question), F.col("context")).alias("p")).first()
    text = built.p if built else ""
    reply = chat.chat([{"role": "system", "content": ANSWER}, {"role": "user", "content": text}], 0.2, 2000)
    return SimpleNamespace(answer=reply, query=question, rewritten_query=texts[0] if rewrite and not multi_query else question, sub_queries=texts, prompt=text, sources=rows.orderBy("position").collect())


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Build a chunk index from a folder of documents.")
    p.add_argument("directory")
    p.add_argument("--registry")
    p.add_argument("--out", default="index")
    p.add_argument("--cache", default="cache")
    p.add_argument("--json", help="also export the index as JSON lines")
    p.add_argument("--provider", choices=["hash", *providers.EmbeddingConfig.KNOWN], default="hash")
    p.add_argument("--model", default="")
    p.add_argument("--mode", choices=["ngap", "generic"])
    p.add_argument("--strategy", choices=chunking.STRATEGIES, default="semantic")
    p.add_argument("--chunk-size", type=int, default=800)
    p.add_argument("--overlap", type=int, default=150)
    p.add_argument("--min-chunk-size", type=int, default=150)
    p.add_argument("--max-chunk-size", type=int, default=1500)
    return p.parse_args(given)


def main(given: list[str] | None = None) -> dict:
    a = arguments(given)
    from quillstone.session import get_session

    spark = get_session()
    embedder = None if a.provider == "hash" else providers.embedder_of(providers.EmbeddingConfig(a.provider, a.model))
    counts = build_index(spark, a.directory, a.out, a.cache, a.registry, a.mode, a.strategy, a.chunk_size, a.overlap, a.min_chunk_size, a.max_chunk_size, embedder)
    if a.json:
        index.export_json(spark.read.parquet(a.out), a.json)
    print(counts)
    return counts


if __name__ == "__main__":
    main()
