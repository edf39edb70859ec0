"""Secret scans through a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over the trigrams
that any match must contain.  Documents are indexed in segments (one Arrow
batch, bounded in bytes): a segment's postings map every trigram that some rule
asks for to the documents that hold it.  Rules intersect and unite postings,
and only the candidates are verified with the expression itself; a rule without
mandatory trigrams scans every document.  A segment is a pure function of its
rows, so a lost executor costs its segments only, and nothing is shuffled.

The index folds ASCII case, so case-insensitive rules share it.  Null text
counts as empty and has no spans; ``doc_id`` may be null or repeated, as each row
is scanned alone; an empty table gives an empty one.  Very long texts are scanned
whole.  Only the id and the text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import text_or_empty

#: Literal alternatives followed at once; classes with more members count as unknown.
EXACT, MEMBERS = 64, 4
BLOCK = 1 << 22


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0  # characters that ``group`` has at least; shorter matches are dropped, without retries


#: Fixed formats: the base kinds first, then public token formats.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 0, 32),
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 0, 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 0, 39),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + MORE
ANY = ("any",)


def _both(a, b):
    if a == ANY or b == ANY:
        return b if a == ANY else a
    return a if a == b else ("and", frozenset([a, b]))


def _either(queries):
    queries = frozenset(queries)
    if ANY in queries or not queries:
        return ANY
    return next(iter(queries)) if len(queries) == 1 else ("or", queries)


def _of_string(s: str):
    grams = frozenset(("tri", s[i:i + 3]) for i in range(len(s) - 2))
    if not grams:
        return ANY
    return next(iter(grams)) if len(grams) == 1 else ("and", grams)


def _exact(items) -> set[str] | None:
    """All strings that the items match, lower-cased, or None if unknown or too many."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            more = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= MEMBERS:
            more = {chr(x).lower() for _, x in arg}
        elif op is C.SUBPATTERN:
            more = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] <= 1:
            more = _exact(arg[2])
            if more is not None and arg[0] == 0:
                more = more | {""}
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            more = {""}
        else:
            more = None
        if more is None or len(out) * len(more) > EXACT:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(items):
    result, run = ANY, []

    def flush():
        nonlocal result, run
        if run:
            result = _both(result, _either(_of_string(s) for s in _exact(run)))
        run = []

    for item in items:
        if _exact(run + [item]) is not None:
            run = run + [item]
            continue
        flush()
        op, arg = item
        if op is C.SUBPATTERN:
            result = _both(result, _query(arg[3]))
        elif op is C.BRANCH:
            result = _both(result, _either(_query(x) for x in arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            result = _both(result, _query(arg[2]))
        elif _exact([item]) is not None:
            run = [item]
    flush()
    return result


def trigram_query(pattern: str):
    """Boolean query over lower-cased trigrams that every match satisfies."""
    return _query(list(parser.parse(pattern)))


def trigrams(query) -> set[str]:
    if query[0] == "tri":
        return {query[1]} if query[1].isascii() else set()
    return set().union(*map(trigrams, query[1])) if len(query) > 1 else set()


def lookup(query, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Documents (sorted numbers) that satisfy the query."""
    if query[0] == "any":
        return everything
    if query[0] == "tri":
        return postings.get(query[1], everything[:0]) if query[1].isascii() else everything
    parts = sorted((lookup(q, postings, everything) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Index:
    """Which trigrams to index, as a table from trigram code to number."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, r.flags | re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.names = sorted(set().union(*(trigrams(q) for _, _, q in self.rules)))
        self.numbers = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(self.names):
            a, b, c = t.encode()
            self.numbers[a << 16 | b << 8 | c] = i + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        keys = []
        for at in range(0, max(0, len(data) - 2), BLOCK):
            x = self.fold[data[at:at + BLOCK + 2]]
            which = self.numbers[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
            hit = np.flatnonzero(which)
            doc = np.searchsorted(offsets, hit + at, side="right") - 1
            inside = hit + at + 3 <= offsets[doc + 1]
            keys.append(np.unique(which[hit][inside].astype(np.int64) << 40 | doc[inside]))
        key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        number, doc = key >> 40, key & ((1 << 40) - 1)
        cuts = np.searchsorted(number, np.arange(1, len(self.names) + 2))
        return {t: doc[cuts[i]:cuts[i + 1]] for i, t in enumerate(self.names)}

    def spans(self, texts: pa.Array) -> list[list[tuple[str, int, int, int]]]:
        """For each text its (kind, kind_order, start, end), in code points."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and n else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        whole = data.tobytes()
        postings, everything = self.postings(data, offsets), np.arange(n)
        found: list[list] = [[] for _ in range(n)]
        decoded: dict[int, str] = {}
        for order, (rule, rx, query) in enumerate(self.rules):
            probe = None if query != ANY else _probe(rule)
            for i in lookup(query, postings, everything).tolist():
                if probe is not None and not probe.search(whole, offsets[i], offsets[i + 1]):
                    continue
                if i not in decoded:
                    decoded[i] = whole[offsets[i]:offsets[i + 1]].decode("utf-8")
                for m in rx.finditer(decoded[i]):
                    if len(m.group(rule.group)) >= rule.least:
                        found[i].append((m.start(), order, m.end(), rule.kind))
        return [sorted(x) for x in found]


def _of_ascii(items) -> bool:
    """Whether the items are only ASCII characters, classes that list such, and groups, choices and repeats of these."""
    for op, arg in items:
        if op is C.LITERAL:
            good = arg < 128
        elif op is C.IN:
            good = all((o is C.LITERAL and x < 128) or (o is C.RANGE and x[1] < 128) for o, x in arg)
        elif op is C.SUBPATTERN:
            good = _of_ascii(arg[3])
        elif op is C.BRANCH:
            good = all(map(_of_ascii, arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            good = _of_ascii(arg[2])
        else:
            good = False
        if not good:
            return False
    return True


def _probe(rule: Rule):
    """For a full scan: a pattern over bytes that every text with a match satisfies, so that the others
    are not decoded, or None.  Only for one repeated class does ``least`` bound the repeats."""
    items = list(parser.parse(rule.pattern, rule.flags))
    if not _of_ascii(items):
        return None
    single = len(items) == 1 and items[0][0] is C.MAX_REPEAT and items[0][1][:2] == (1, C.MAXREPEAT) and len(items[0][1][2]) == 1 and items[0][1][2][0][0] is C.IN
    pattern = rule.pattern[:-1] + "{%d,}" % rule.least if single and rule.pattern.endswith("]+") and rule.group == 0 and rule.least else rule.pattern
    return re.compile(pattern.encode(), rule.flags)


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array<struct<start, kind_order, end, kind>> in order of start, then kind."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind_order", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        index = Index(rules)
        for b in batches:
            found = index.spans(b.column(1).cast(pa.string()))
            rows = [[dict(zip(("start", "kind_order", "end", "kind"), s)) for s in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, f"{id_col} long, spans array<struct<start: long, kind_order: long, end: long, kind: string>>")
