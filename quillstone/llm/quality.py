"""Quality classifier: a sparse rule ensemble.

Boosted trees are grown over document statistics, every tree path becomes a
conjunctive rule, an L1-penalised logistic regression weighs the rules, and the
rules that keep a weight are compiled into one Spark column expression.

Statistics are taken over whole texts; the trees and weights are fitted on about
``SAMPLE`` labelled documents at most (a documented bound), those with a small hash of
doc_id.  The sample is drawn from the labels, so a bounded table is broadcast and
no text moves.

Null text counts as empty; an empty text has a score like any other, with most
statistics zero; very long texts are counted whole, by patterns of linear cost.
Repeated rows get equal scores; of conflicting labels of a document the smaller
holds, of several texts of one doc_id one is learned from.  A null doc_id is
scored and never learned from or held out.  A score of exactly 0.5 predicts 1.
Without labels of both classes the score is the share of label 1 (0.5 if there
are no labels, which keeps every document).  An empty table gives an empty one.
``score`` returns ``keep`` and its own columns; ``keep_good`` keeps columns of any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import rules as R
from quillstone.llm.common import materialize, text_or_empty

#: Bound on the labelled rows that reach the driver.
SAMPLE = 20000
TREES, DEPTH, PENALTY = 24, 3, 0.0015

FEATURES = [
    "log_chars", "log_words", "mean_word", "upper", "digits", "pipes", "marks", "bangs", "distinct", "repeats",
    "line_chars", "short_words", "commas", "accents",
]


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the statistics of every whole text."""
    t = F.col("_t")
    base = docs.withColumn("_t", text_or_empty(text_col)).withColumn("_w", F.split(F.col("_t"), "[\\x20\\t-\\r]+"))
    chars, words = F.greatest(F.length(t), F.lit(1)).cast("double"), F.size("_w").cast("double")
    per = lambda pattern: F.regexp_count(t, F.lit(pattern)) / chars
    columns = {
        "log_chars": F.log1p(F.length(t)),
        "log_words": F.log1p(words),
        "mean_word": chars / words,
        "upper": per("[A-Z\\x{C0}-\\x{DE}]"),
        "digits": per("[0-9]"),
        "pipes": per("\\|"),
        "marks": per("[#$%*&@^~<>{}\\[\\]=_\\\\]"),
        "bangs": per("[!?]"),
        "distinct": F.size(F.array_distinct("_w")) / words,
        "repeats": F.regexp_count(t, F.lit("(?<![^\\x20\\t-\\r])([^\\x20\\t-\\r]++)\\x20\\1(?![^\\x20\\t-\\r])")) / words,
        "line_chars": F.log1p(chars / (F.regexp_count(t, F.lit("\n")) + 1)),
        "short_words": F.size(F.filter("_w", lambda w: F.length(w) <= 3)) / words,
        "commas": per("[,.]"),
        "accents": per("[\\x{DF}-\\x{24F}]"),
    }
    return base.select(*keep, *[F.round(columns[c].cast("double"), 6).alias(c) for c in FEATURES])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """Bias and weighted rules."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return float(np.log(p / (1 - p))), []
    _, trees = R.boost(x, y, TREES, DEPTH, leaf=max(5, len(y) // 500))
    found = list(dict.fromkeys(p for tree in trees for p in R.paths(tree)))
    bias, weights = R.lasso_logistic(R.rule_matrix(found, x), y, PENALTY)
    return bias, [(rule, float(w)) for rule, w in zip(found, weights) if abs(w) > 1e-4]


def score_column(bias: float, weighted: list[tuple[tuple, float]]):
    z = F.lit(bias)
    for rule, w in weighted:
        z = z + F.when(R.rule_column(rule, FEATURES), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out():
    """The rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, _q) of the labels that may be learned, about ``SAMPLE`` at most."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"))
    n = marks.count()
    if n > SAMPLE:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < F.lit(int(SAMPLE / n * (1 << 40))))
    return marks


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are learned from, with ``_q``.  The labels are broadcast: there are about ``SAMPLE`` at most."""
    return docs.withColumn("_id", F.col("doc_id").cast("long")).join(F.broadcast(learnable(labels)), "_id")


def fit_on(known: DataFrame) -> tuple[float, list[tuple[tuple, float]]]:
    """The ensemble fitted on ``known`` rows (_id, _q and the statistics), one for each document."""
    rows = known.groupBy("_id", "_q").agg(F.min(F.struct(*FEATURES)).alias("_s")).collect()
    data = np.array([[r["_q"], *r["_s"]] for r in sorted(rows, key=lambda r: r["_id"])], dtype=float).reshape(-1, len(FEATURES) + 1)
    return fit(data[:, 1:], data[:, 0])


def score(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    stats = materialize(statistics(docs, list(dict.fromkeys([*keep, "doc_id"]))), "quality-stats")
    bias, weighted = fit_on(sampled(stats, labels))
    s = F.round(score_column(bias, weighted), 6)
    return stats.select(*keep, held_out().alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, all columns.

    The model is fitted on the statistics of the sample alone; the rules are then
    applied to every row where it stands, so texts are not shuffled."""
    bias, weighted = fit_on(statistics(sampled(docs.select("doc_id", "text"), labels), ["_id", "_q"]))
    names = [f"_d{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    scored = statistics(plain, names).where(F.round(score_column(bias, weighted), 6) >= 0.5)
    return scored.select(*names).toDF(*docs.columns)
