"""Vector bin packing of documents into shards.

Bytes, tokens and rows are balanced jointly: each placement unit goes to the
shard where the dot product of its (bytes, tokens, rows) vector with the
shard's residual capacity is highest, largest units first.  At the end, swaps of
units with equal row counts level the bytes.

A group is the set of rows with equal text and is the unit of placement.  The
placement itself runs on the driver over a bounded number of units, whatever
the size of the corpus:

* the ``SINGLE`` largest groups are units of their own; the others, each small
  beside a shard, are dealt by hash into ``LOTS`` lots (a corpus of up to
  ``SINGLE`` groups has no lot);
* only a group that exceeds a whole shard in bytes, tokens or rows is split, by a
  hash of ``doc_id``, into slices of lot size.  There are fewer than ``3 * shards``
  such groups; their rows are marked ``split``.

So the table of single groups and the table of units are broadcast within fixed
bounds.  How far apart the shards' bytes remain is logged and given by ``gap``.

Nothing is dropped.  Null text counts as no bytes and is grouped with the empty
text; null or repeated ``doc_id`` values are rows like any other; an empty
table gives an empty result; ties are broken by unit number.  A very long text is
a unit that may outweigh a shard; it is not cut.  ``shard_documents`` keeps columns
of any name but ``shard``.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, text_or_empty

#: Groups placed singly, and hash lots of the others: the bounds on what the driver places.
SINGLE, LOTS = 16384, 16384
ROW_BYTES = 8
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (4.0, 1.0, 1.0)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow per-row measures: everything later reads these instead of texts."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("_group"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.when(F.length(F.trim(text)) == 0, F.lit(0)).otherwise(F.size(F.split(text, "[\\x20\\t-\\r]+"))).cast("long").alias("_tokens"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )


def _with_units(rows: DataFrame, single: list[tuple[int, int, int]]) -> DataFrame:
    """Adds ``_unit`` and ``split``; ``single`` has (group, first unit, slices) of the largest groups, ``SINGLE`` at most."""
    lot = F.pmod(F.col("_group"), F.lit(LOTS)).cast("long")
    table = rows.sparkSession.createDataFrame(single, "_group long, _first long, _slices long")
    spread = F.col("_first") + F.pmod(F.xxhash64("doc_id", "_group"), F.col("_slices"))
    found = rows.join(F.broadcast(table), "_group", "left")
    return found.withColumns({"_unit": F.coalesce(spread, lot), "split": F.coalesce(F.col("_slices") > 1, F.lit(False))}).drop("_first", "_slices")


def largest_groups(rows: DataFrame, shards: int) -> list[tuple[int, int, int]]:
    """(group, first unit, slices) of the largest groups; one slice unless the group exceeds a shard."""
    total = rows.agg(F.sum("size"), F.sum("_tokens"), F.count(F.lit(1))).first()
    totals = [float(x or 0) for x in total]
    if not totals[2]:
        return []
    share = F.greatest(*[F.col(c) / F.lit(max(t, 1.0)) for c, t in zip(("b", "t", "n"), totals)])
    groups = rows.groupBy("_group").agg(F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count(F.lit(1)).alias("n")).select("_group", share.alias("share"), "n")
    out, first = [], LOTS
    for g, s, n in groups.orderBy(F.desc("share"), "_group").limit(SINGLE).collect():
        slices = int(min(n, np.ceil(max(s * LOTS / 8, 4 * s * shards)))) if s * shards > 1 else 1
        out.append((g, first, slices))
        first += slices
    return out


def pack(vectors: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """Shard of each unit; ``vectors`` has a row of (bytes, tokens, rows) per unit."""
    capacity = np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    scaled = vectors / capacity
    weighted = scaled * np.array(weights)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -(scaled * weights).sum(axis=1))):
        k = int(np.argmax(residual @ weighted[i]))
        residual[k] -= scaled[i]
        out[i] = k
    return out


def level(vectors: np.ndarray, out: np.ndarray, shards: int) -> np.ndarray:
    """Swaps units of equal row counts between the fullest and the emptiest shard, as
    long as that brings their bytes closer, which ends as every swap does; rows and the
    number of units stay."""
    size, rows, out = vectors[:, 0], vectors[:, 2], out.copy()
    load = np.bincount(out, size, minlength=shards)
    while True:
        high, low = int(np.argmax(load)), int(np.argmin(load))
        gap = load[high] - load[low]
        best = None
        a, b = np.flatnonzero(out == high), np.flatnonzero(out == low)
        for n in np.intersect1d(rows[a], rows[b]):
            u, v = a[rows[a] == n], b[rows[b] == n]
            v = v[np.argsort(size[v], kind="stable")]
            at = np.searchsorted(size[v], size[u] - gap / 2)
            for k in (np.maximum(at - 1, 0), np.minimum(at, len(v) - 1)):
                left = np.abs(gap - 2 * (size[u] - size[v[k]]))
                i = int(np.argmin(left))
                if left[i] < gap and (best is None or left[i] < best[0]):
                    best = (left[i], u[i], v[k[i]])
        if best is None:
            return out
        _, x, y = best
        out[x], out[y] = low, high
        load[high] += size[y] - size[x]
        load[low] += size[x] - size[y]


def gap(vectors: np.ndarray, where: np.ndarray, shards: int) -> np.ndarray:
    """Fullest less emptiest shard, over the mean one, in bytes, tokens and rows."""
    load = np.stack([np.bincount(where, vectors[:, i], minlength=shards) for i in range(vectors.shape[1])])
    return (load.max(axis=1) - load.min(axis=1)) / np.maximum(load.mean(axis=1), 1e-9)


def plan(rows: DataFrame, shards: int) -> tuple[list, DataFrame]:
    """Largest groups, and the table (_unit, shard, _offset) that places every unit."""
    spark = rows.sparkSession
    hot = largest_groups(rows, shards)
    units = (
        _with_units(rows, hot).groupBy("_unit")
        .agg(F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("_unit").collect()
    )
    if not units:
        return hot, spark.createDataFrame([], "_unit long, shard int, _offset long")
    vectors = np.array([[u.b, u.t, u.n] for u in units], dtype=float)
    where = level(vectors, pack(vectors, shards), shards)
    logging.getLogger(__name__).info("%d units in %d shards; gap of bytes, tokens, rows: %s", len(units), shards, gap(vectors, where, shards))
    seen, placed = [0] * shards, []
    for u, k in zip(units, where.tolist()):
        placed.append((u["_unit"], k, seen[k]))
        seen[k] += u.n
    return hot, spark.createDataFrame(placed, "_unit long, shard int, _offset long")


def shard_rows(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, split (whether its group exceeds a shard).

    Slots are gapless within a shard: the unit's offset plus the rank in the
    unit, so no task ever numbers a whole shard."""
    rows = materialize(measures(docs), "shard-measures")
    hot, placed = plan(rows, shards)
    in_unit = Window.partitionBy("_unit").orderBy("doc_id", "_group")
    return (
        _with_units(rows, hot).withColumn("_rank", F.row_number().over(in_unit) - 1)
        .join(F.broadcast(placed), "_unit")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_rank")).alias("slot"), "split")
    )


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """The documents, whole, with a ``shard`` column (replacing any of that name); texts are not shuffled."""
    rows = materialize(measures(docs), "shard-measures")
    hot, placed = plan(rows, shards)
    names = [f"_d{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*names).withColumns({
        "_group": F.xxhash64(text_or_empty(names[docs.columns.index("text")])), "doc_id": F.col(names[docs.columns.index("doc_id")]).cast("long")})
    found = _with_units(keyed, hot).join(F.broadcast(placed), "_unit")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns) if c != "shard"], "shard")
