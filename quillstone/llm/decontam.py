"""Benchmark decontamination: BM25 with block-max WAND.

The test items are the indexed collection and every training passage is a
query.  Terms are pairs of adjacent words: single words are so common to all
text that their upper bounds would prune nothing.  An item's term impacts are its BM25 weights over its self-score, so a
score is the share of the item's BM25 mass that the passage holds, and one
threshold fits all items.  Passages are windows of ``WINDOW`` tokens at every
``STRIDE``; items longer than ``STRIDE`` tokens are indexed in parts, so that
each part lies whole in some passage.  All (passage, part) pairs at or above the
threshold are retrieved with block-max WAND, after the sum of its terms' upper
bounds discards a passage that cannot reach it; then the overlap with the item's
question and with its answer is verified on token n-grams.

Items of under ``LEAST_TOKENS`` tokens say too little for a partial overlap:
they are indexed alike and match only where the text holds all their tokens in
a row.  An item of one token has no pair and is looked up by its word.

Document frequencies and the mean length are taken over all items first, then
the index is built in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES``
bytes, so a score does not depend on the block.  A block is broadcast; a larger
benchmark takes one pass over the corpus for each.  The driver holds the pair
frequencies of the benchmark, the small side; the corpus is only streamed: no
shuffle.

An item is a row of the benchmark: ids may be null or repeated and are only
carried; repeated rows match alike.  Items without tokens (null, empty, marks
only) match nothing.  Null or empty documents match nothing; very long ones are
read window by window.  ``doc_id`` may be null or repeated; each row is judged
alone.  Of both tables only ``doc_id``, ``text`` and ``item_id`` are read, so
further columns of any name do not matter; ``decontaminate`` keeps them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 128, 64
K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Items of fewer tokens must stand in the text word for word.
LEAST_TOKENS = 8
#: Bounds of one index: what a task holds.
BLOCK_ITEMS, BLOCK_BYTES = 20000, 1 << 25
POSTINGS_BLOCK = 64
NGRAM, OVERLAP = 5, 0.6
#: Scripts without spaces between words: each character is a token.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_plain = re.compile(r"\w+").findall
_mixed = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+").findall
_unspaced = re.compile(f"[{UNSPACED}]").search
_sentence = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])")


def tokenize(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _plain(text) if text.isascii() or not _unspaced(text) else _mixed(text)


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer, what stands before it the question; of a
    single sentence the last quarter is the answer."""
    parts = [p for p in _sentence.split(text.strip()) if tokenize(p)]
    if len(parts) > 1:
        return tokenize(" ".join(parts[:-1])), tokenize(parts[-1])
    words = tokenize(text)
    cut = max(1, len(words) * 3 // 4)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int) -> set[tuple]:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def coverage(part: list[str], words: list[str]) -> float:
    """Share of the part's n-grams that the words hold."""
    if not part:
        return 1.0
    n = min(NGRAM, len(part))
    own = grams(part, n)
    return len(own & grams(words, n)) / len(own)


def parts_of(words: list[str]) -> list[list[str]]:
    """An item's tokens in parts of at most ``STRIDE``; none for a single token."""
    if len(words) < 2:
        return []
    size = math.ceil(len(words) / math.ceil(len(words) / STRIDE))
    return [words[k:k + size] for k in range(0, len(words), size)]


class Frequencies:
    """Over all items: in how many parts a pair stands, how many parts there are, and their mean length."""

    def __init__(self, texts):
        self.df: Counter = Counter()
        self.parts = total = 0
        for text in texts:
            for part in parts_of(tokenize(text)):
                pairs = list(zip(part, part[1:]))
                self.df.update(set(pairs))
                self.parts += 1
                total += len(pairs)
        self.mean = total / max(1, self.parts)

    def idf(self, pair: tuple[str, str]) -> float:
        n = self.df[pair]
        return math.log(1 + (self.parts - n + 0.5) / (n + 0.5))


class Index:
    """Block-max inverted index of one block of test items (id, text), known by their place in it."""

    def __init__(self, items: list[tuple], known: Frequencies | None = None):
        known = known or Frequencies(t for _, t in items)
        words = [tokenize(t) for _, t in items]
        #: Per item: id, tokens of the question, of the answer, and all.
        self.items = [(i, *question_answer(t or ""), w) for (i, t), w in zip(items, words)]
        self.single: dict[str, list[int]] = {}
        parts = []
        for place, own in enumerate(words):
            if len(own) == 1:
                self.single.setdefault(own[0], []).append(place)
            parts += [(place, p) for p in parts_of(own)]
        self.part_item = [i for i, _ in parts]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in parts for w in ws}))}
        self.base = len(self.vocabulary) + 1
        code = lambda pair: self.vocabulary[pair[0]] * self.base + self.vocabulary[pair[1]]
        weights = []
        for _, ws in parts:
            raw = {p: known.idf(p) * f * (K1 + 1) / (f + K1 * (1 - B + B * (len(ws) - 1) / known.mean)) for p, f in Counter(zip(ws, ws[1:])).items()}
            total = sum(raw.values())
            weights.append({code(p): w / total for p, w in raw.items()})
        self.terms = np.array(sorted({t for w in weights for t in w}), dtype=np.int64)
        number = {t: k for k, t in enumerate(self.terms.tolist())}
        self.docs: list[list[int]] = [[] for _ in number]
        self.impacts: list[list[float]] = [[] for _ in number]
        for p, own in enumerate(weights):
            for t, w in own.items():
                self.docs[number[t]].append(p)
                self.impacts[number[t]].append(w)
        self.top = [max(x, default=0.0) for x in self.impacts]
        cut = range(0, 1 << 62, POSTINGS_BLOCK)
        self.block_last = [[d[min(len(d), a + POSTINGS_BLOCK) - 1] for a in cut[:math.ceil(len(d) / POSTINGS_BLOCK)]] for d in self.docs]
        self.block_top = [[max(x[a:a + POSTINGS_BLOCK]) for a in cut[:math.ceil(len(x) / POSTINGS_BLOCK)]] for x in self.impacts]
        self.bounds = np.array(self.top + [0.0])

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        """Codes of adjacent words; with an unknown word (0) the code is of no term."""
        return ids[:-1] * self.base + ids[1:]

    def term_numbers(self, words: list[str]) -> np.ndarray:
        """Term number at every position but the last; ``len(terms)`` where there is none."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
        out = np.full(max(0, len(words) - 1), len(self.terms), dtype=np.int64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if len(self.terms) else np.empty(0, np.int64)
        codes = self._pairs(ids)[at]
        found = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        known = self.terms[found] == codes
        out[at[known]] = found[known]
        return out

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All parts whose score is at least ``threshold``, by block-max WAND."""
        threshold -= 1e-9
        out, cursors = [], [[self.docs[t][0], t, 0] for t in terms if self.docs[t]]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.top[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            block_bound, jump = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.part_item)
            for _, t, pos in cursors[:pivot + 1]:
                b = bisect_left(self.block_last[t], doc, pos // POSTINGS_BLOCK)
                if b < len(self.block_last[t]):
                    block_bound += self.block_top[t][b]
                    jump = min(jump, self.block_last[t][b] + 1)
            if block_bound < threshold:
                target = max(jump, doc + 1)
            else:
                if cursors[0][0] == doc:
                    score = sum(self.impacts[t][pos] for _, t, pos in cursors[:pivot + 1])
                    if score >= threshold:
                        out.append((doc, score))
                    target = doc + 1
                else:
                    target = doc
            alive = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < target:
                    c[2] = bisect_left(self.docs[c[1]], target, c[2])
                    if c[2] == len(self.docs[c[1]]):
                        continue
                    c[0] = self.docs[c[1]][c[2]]
                alive.append(c)
            cursors = alive
        return out

    def passages(self, numbers: np.ndarray) -> list[int]:
        """Starts of the windows whose terms' upper bounds reach the threshold."""
        bound = self.bounds[numbers]
        if bound.sum() < THRESHOLD - 1e-9:
            return []
        sums = np.add.reduceat(bound, np.arange(0, len(numbers), STRIDE))
        both = sums.copy()
        both[:-1] += sums[1:]
        last = max(1, len(sums) - WINDOW // STRIDE + 1)
        return (np.flatnonzero(both[:last] >= THRESHOLD - 1e-9) * STRIDE).tolist()

    def matches(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(place of the item, score, question overlap, answer overlap, token offset) of every verified item."""
        words = tokenize(text)
        best: dict[int, tuple] = {}
        if self.single:
            for word in self.single.keys() & set(words):
                at = words.index(word)
                best.update({place: (place, 1.0, 1.0, 1.0, at) for place in self.single[word]})
        if len(words) > 1 and len(self.terms):
            numbers = self.term_numbers(words)
            for start in self.passages(numbers):
                terms = np.unique(numbers[start:start + WINDOW])
                for part, score in self.search(terms[terms < len(self.terms)].tolist()):
                    place = self.part_item[part]
                    _, question, answer, own = self.items[place]
                    around = words[max(0, start - len(own)):start + WINDOW + len(own)]
                    if len(own) < LEAST_TOKENS:
                        q = a = float(tuple(own) in grams(around, len(own)))
                    else:
                        q, a = coverage(question, around), coverage(answer, around)
                    if q >= OVERLAP and a >= OVERLAP and (place not in best or (score, -start) > (best[place][1], -best[place][4])):
                        best[place] = (place, score, q, a, start)
        return [best[i] for i in sorted(best)]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes (or one item) each, in order of id and text."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t <> ''").orderBy("i", "t")
    known = Frequencies(r.t for r in rows.select("t").toLocalIterator())
    block, size = [], 0
    for r in rows.toLocalIterator():
        own = len(r.t.encode())
        if block and (len(block) == BLOCK_ITEMS or size + own > BLOCK_BYTES):
            yield Index(block, known)
            block, size = [], 0
        block.append((r.i, r.t))
        size += own
    if block:
        yield Index(block, known)


MATCH_DDL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, token_offset long"
_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document row and verified test item."""
    spark, out, names = docs.sparkSession, None, [c.split()[0] for c in MATCH_DDL.split(", ")]
    for index in indexes(benchmark):
        def run(batches, shared=spark.sparkContext.broadcast(index)):
            index = shared.value
            for b in batches:
                rows = [(i, index.items[m[0]][0], *m[1:]) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for m in index.matches(t.as_py())]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=names)

        found = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()).mapInArrow(run, MATCH_DDL)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCH_DDL)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified test item, all columns; texts are not shuffled."""
    at, spark = docs.columns.index("text"), docs.sparkSession
    for index in indexes(benchmark):
        def run(batches, shared=spark.sparkContext.broadcast(index)):
            index = shared.value
            for b in batches:
                yield b.filter(pa.array([not index.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
