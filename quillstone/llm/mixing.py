"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share of the corpus over its
present share.  A hash of (seed, doc_id) is a uniform draw; inverting the
Poisson distribution function at it gives the document's count, so the counts
are the same on every run and on every cluster.  Each document is exploded by
its count and the copies are dealt globally by another hash and ordered by it.

Native: DataFrame functions only.  One distribution is inverted at any rate; its
terms are carried as logarithms, which keeps them in range.

Null sources form one source of their own.  Rows with equal ``doc_id`` get
equal counts, null ``doc_id`` counts as an empty key.  Sources without a target
weight get rate zero only if weights are given explicitly.  An empty table
gives an empty result.  Texts are carried along whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize

SEED = "mix-1"


def _key(*parts):
    """A uniform 52-bit integer from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, source_col: str = "source") -> DataFrame:
    """(``_source``, ``rate``): target share over present share.

    Without explicit weights the target weight of a source is its row count to
    the power ``1 / temperature``."""
    counts = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weighted = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(1.0 / temperature)))
    else:
        table = docs.sparkSession.createDataFrame([(k or "", float(v)) for k, v in weights.items()], "_source string, _w double")
        weighted = counts.join(table, "_source", "left").fillna(0.0, ["_w"])
    rows, weight = weighted.agg(F.sum("_n"), F.sum("_w")).first()
    return weighted.select("_source", (F.col("_w") / F.lit(weight or 1.0) * F.lit(float(rows or 0)) / F.col("_n")).alias("rate"))


def poisson_count(rate, *key):
    """The Poisson quantile of the hash of ``key`` at mean ``rate``: the first count whose
    distribution function is over it."""
    u = _key(F.lit(SEED), *key, F.lit(1)) / F.lit(float(2**52))
    counts = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("below"), F.lit(0).alias("k"))

    def step(a, i):
        log = a["log"] + F.log(rate / i)
        return F.struct(log.alias("log"), (a["below"] + F.exp(log)).alias("below"), (a["k"] + (a["below"] <= u).cast("int")).alias("k"))

    return F.when(rate > 0, F.aggregate(counts, start, step, lambda a: a["k"])).otherwise(0)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, source_col: str = "source") -> DataFrame:
    """The documents repeated to the target mix, with ``copy`` (from 1), ``rate`` and
    ``mix_key``, shuffled globally.  Columns of those names in ``docs`` stay; ours then
    have the prefix ``mix_``."""
    rates = materialize(source_rates(docs, weights, temperature, source_col).withColumnsRenamed({"_source": "_mixed", "rate": "_rate"}), "mix-rates")
    # rates is a written table: it is broadcast only if its size is under the session's threshold
    counted = (
        docs.withColumn("_mixed", F.coalesce(F.col(source_col), F.lit(""))).join(rates, "_mixed").drop("_mixed")
        .withColumn("_count", poisson_count(F.col("_rate"), F.col("doc_id")))
    )
    copies = counted.where("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    keyed = copies.withColumn("_key", _key(F.lit(SEED), F.col("doc_id"), F.lit("copy"), F.col("_copy")))
    named = {c: c if c not in docs.columns else f"mix_{c}" for c in ("copy", "rate", "mix_key")}
    ours = [F.col(i).alias(named[c]) for i, c in (("_copy", "copy"), ("_rate", "rate"), ("_key", "mix_key"))]
    return keyed.repartition("_key").sortWithinPartitions("_key").select(*docs.columns, *ours)
