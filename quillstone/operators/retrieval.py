"""Exact retrieval for batches of queries.

Queries are a stated set, taken in blocks of at most ``BLOCK`` vectors; chunks
are streamed against a block as matrix products, and every batch forwards only
its own best rows per query.  So the work a query causes is one pass over the
chunks, what is shuffled is at most k rows per query and batch, and no pair of
query and chunk is ever a row.

A matrix product sums in an order of its own, which can part equal scores and
move a score over a limit.  So products only choose candidates, with room for
their rounding; a score is the dot product summed in order of the dimensions
over the product of the norms, to the last bit the same in any batch and block.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import vector

#: Query vectors that a task holds at once.
BLOCK = 2048


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(values) % len(column):
        raise ValueError("vectors of unequal size")
    return values.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _room(m: np.ndarray) -> float:
    """More than a product of unit vectors and ``_cosine`` can lie apart by rounding."""
    return 4 * (m.shape[1] + 8) * np.finfo(np.float64).eps


def _norms(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for column in m.T:
        total += column * column
    return np.sqrt(total)


def _cosine(a: np.ndarray, b: np.ndarray, norms_a: np.ndarray, norms_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the rows ``i`` of a with the rows ``j`` of b; zero where either norm is zero."""
    total = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        total += x[i] * y[j]
    both = norms_a[i] * norms_b[j]
    return np.divide(total, both, out=np.zeros_like(total), where=both > 0)


def _fewer_copies(ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows that have ``k`` copies of smaller ids: they score the same, so none is among the ``k`` best."""
    _, which = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
    kept = order[place < k]
    return ids[kept], m[kept]


def search(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", key: tuple[str, ...] = ("query_id", "sq_idx"), query_vector: str = "vec") -> DataFrame:
    """(key..., id, cosine_score, rank): the ``k`` best chunks of every query vector.

    Ties keep the order of ``id_col``.  ``queries`` has the key columns (long)
    and a vector column."""
    rows = chunks.select(F.col(id_col).cast("long").alias(id_col), vector.doubles(F.col(vector_col)).alias("_v")).where("_v is not null")
    keys = [*key, id_col]
    schema = ", ".join(f"{c} long" for c in keys) + ", cosine_score double"
    found = None
    for block in _blocks(queries.select(*[F.col(c).cast("long") for c in key], vector.doubles(F.col(query_vector)))):
        labels = np.array([r[:-1] for r in block], dtype=np.int64)
        matrix = np.array([r[-1] for r in block], dtype=np.float64)

        def run(batches, labels=labels, matrix=matrix):
            unit, norms = _unit(matrix), _norms(matrix)
            for b in batches:
                if not b.num_rows:
                    continue
                ids, m = b.column(0).to_numpy(), _matrix(b.column(1))
                if m.shape[1] != matrix.shape[1]:
                    raise ValueError("vectors of unequal size")
                ids, m = _fewer_copies(ids, m, k)
                score = partial(_cosine, matrix, m, norms, _norms(m))
                asker, hit = best_of(unit @ _unit(m).T, ids, k, score, _room(m))
                columns = [labels[asker, i] for i in range(labels.shape[1])] + [ids[hit], score(asker, hit)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*keys, "cosine_score"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy(*key).orderBy(F.desc("cosine_score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(near: np.ndarray, ids: np.ndarray, k: int, score=None, room: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest scores of each row; of equal ones those of the smallest ids.

    ``near`` is the scores, or within ``room`` of ``score(row, column)``.  Only what may reach the k-th
    score is scored and sorted, not the whole row."""
    if near.shape[1] > k:
        least = np.partition(near, -k, axis=1)[:, -k] - 2 * room
        row, column = np.nonzero(near >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(near.shape))
    scores = score(row, column) if score else near[row, column]
    order = np.lexsort((ids[column], -scores, row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(near)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def _blocks(queries: DataFrame):
    block = []
    for r in queries.toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def score_stats(chunks: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_vector: str = "vec") -> DataFrame:
    """query_id, n, least, mean and most cosine of every query vector over all chunks;
    each batch sends one partial row a query."""
    rows = chunks.select(F.col(id_col).cast("long"), vector.doubles(F.col(vector_col)).alias("_v")).where("_v is not null")
    schema, found = "query_id long, n long, total double, least double, most double", None
    for block in _blocks(queries.select(F.col("query_id").cast("long"), vector.doubles(F.col(query_vector)))):
        labels, matrix = np.array([r[0] for r in block]), _unit(np.array([r[1] for r in block], dtype=np.float64))

        def run(batches, labels=labels, matrix=matrix):
            for b in batches:
                if b.num_rows:
                    s = matrix @ _unit(_matrix(b.column(1))).T
                    columns = [labels, np.full(len(labels), b.num_rows), s.sum(1), s.min(1), s.max(1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "n", "total", "least", "most"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], schema)
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"))


def merge_best(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The best score of each chunk over a query's sub-queries, with its first place (sub-query, rank)."""
    return found.groupBy("query_id", id_col).agg(F.max("cosine_score").alias("cosine_score"), F.min(F.struct("sq_idx", "rank")).alias("_first")).select(
        "query_id", id_col, "cosine_score", F.col("_first.sq_idx").alias("first_sq"), F.col("_first.rank").alias("first_rank"))


def fuse(merged: DataFrame, model_scores: DataFrame | None = None, id_col: str = "vec_id", priority: str = "priorite", year: str = "annee", weights=vector.WEIGHTS) -> DataFrame:
    """Adds priority_score, recency_score, rerank_score and final_score.  A candidate
    that the model did not score gets 0."""
    out = merged
    if model_scores is not None:
        out = out.join(model_scores.select("query_id", id_col, F.col("relevance_score").alias("_m")), ["query_id", id_col], "left")
    out = out.withColumns({
        "priority_score": vector.priority_score(F.col(priority)), "recency_score": vector.recency_score(F.col(year)),
        "rerank_score": F.coalesce(F.col("_m"), F.lit(0.0)) if model_scores is not None else F.lit(0.0),
    })
    final = vector.final_score(F.col("cosine_score"), F.col("rerank_score"), F.col("priority_score"), F.col("recency_score"), model_scores is not None, weights)
    return out.withColumn("final_score", final).drop("_m")


def filter_by_score(scored: DataFrame, least: float = 0.68) -> DataFrame:
    """On the cosine score, inclusive."""
    return scored.where(F.col("cosine_score") >= least)


def deduplicate(scored: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", rank: str = "position") -> DataFrame:
    """Greedy in rank order: a row stays if no kept row of its query has a cosine over ``threshold``.

    Grouped by query; a query's candidates are bounded by its sub-queries times k."""
    schema = scored.schema.simpleString()[len("struct<"):-1]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(rank)
        m = _matrix(table[vector_col].combine_chunks())
        unit, norms, room, kept = _unit(m), _norms(m), _room(m), []
        for i in range(len(m)):
            near = unit[kept] @ unit[i]
            over = (near > threshold + room).any()
            at = np.array(kept, dtype=np.int64)[np.abs(near - threshold) <= room]
            if not over and not (_cosine(m, m, norms, norms, at, np.full(len(at), i)) > threshold).any():
                kept.append(i)
        return table.take(pa.array(kept, pa.int64()))

    return scored.groupBy("query_id").applyInArrow(fold, schema)


def ranked(scored: DataFrame, top_k: int, id_col: str = "vec_id") -> DataFrame:
    """The first ``top_k`` by final score; ties in first-seen order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "first_sq", "first_rank", id_col)
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)


def retrieve(chunks: DataFrame, queries: DataFrame, top_k: int = 10, retrieval_k: int = 30, least: float = 0.68, model_scores: DataFrame | None = None, dedup: bool = False, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", merged: DataFrame | None = None) -> DataFrame:
    """Search, merge, fuse, filter, rank.  Vectors stay out of the plan after the
    search unless duplicates are removed; the filter stands before the fusion, as
    it reads the cosine only.  ``merged`` candidates, if given, are not searched again."""
    if merged is None:
        merged = merge_best(search(chunks, queries, retrieval_k, id_col, vector_col), id_col)
    merged = filter_by_score(merged, least)
    extra = [vector_col] if dedup else []
    carried = chunks.select(id_col, "priorite", "annee", *extra)
    scored = fuse(merged.join(carried, id_col), model_scores, id_col)
    if dedup:
        everything = ranked(scored, 1 << 30, id_col)
        scored = deduplicate(everything, threshold, id_col, vector_col).drop("position", vector_col)
    return ranked(scored, top_k, id_col)
