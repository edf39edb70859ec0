"""Chunking: fixed, overlapping, structural and by billing act."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

STRATEGIES = ("naive", "overlap", "semantic")
LEAST, LEAST_SECTION = 20, 30


# --- fixed and overlapping: native, linear in the text ----------------------


def naive_chunks(c: Column, size: int = 1000) -> Column:
    """Slices of ``size`` characters, stripped; those under 20 characters go."""
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.filter(F.transform(pieces, T.strip), lambda x: F.length(x) >= LEAST)


def overlap_chunks(c: Column, size: int = 800, overlap: int = 150) -> Column:
    """Windows of ``size`` at every ``size - overlap``: each is a piece of the text and the heads of the next ones."""
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be less than the chunk size ({size})")
    step = size - overlap
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    more = -(-overlap // step)

    def window(x, i):
        tail = F.array_join(F.slice(pieces, i + 2, F.lit(more)), "") if more else F.lit("")
        return T.strip(F.concat(x, F.left(tail, F.lit(overlap))))

    return F.filter(F.transform(pieces, window), lambda x: F.length(x) >= LEAST)


# --- structural: order-dependent merges, in Python over whole texts ---------

_ROMAN = r"[IVX\d]+"
#: Fixed patterns: what a section starts with, after a line start and white space.
SECTION_STARTS = [
    rf"TITRE\s+{_ROMAN}", rf"CHAPITRE\s+{_ROMAN}", rf"PARTIE\s+{_ROMAN}", r"SECTION\s+\d+", r"Préambule\b", r"Art(?:icle)?\.?\s+\d+",
    r"Art\.\s+1er\b", r"Article\s+[LRD]\.\s*\d+", r"Article\s+unique\b", r"Article\s+préliminaire\b", r"ANNEXE", r"Annexe",
    r"\d+\.\d+(?:\.\d+)?\s+[A-ZÉÈÀÊÔÎÛÇa-z]", r"\d+/\s+[A-ZÉÈÀÊÔÎÛÇa-z]",
]
_boundary = re.compile(r"(?=(?:^|\n)\s*(?:" + "|".join(SECTION_STARTS) + "))", re.M)
_major = re.compile(r"(?:TITRE|CHAPITRE|PARTIE|SECTION)\s+", re.I)
_title = re.compile(r"(?:TITRE|CHAPITRE|PARTIE|SECTION|ANNEXE)\s+", re.I)
_article_title = re.compile(r"Art(?:icle)?\.?\s+\d+")
_article = re.compile(r"Article\b", re.I)
_act = re.compile(r"^\s*-\s+.+?:\s*coefficient\s+\d+[,.]?\d*(?:,\s*lettre clé\s+.+)?\s*$", re.I)


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Python twin of ``overlap_chunks``."""
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be less than the chunk size ({size})")
    cut = (text[i:i + size].strip() for i in range(0, len(text), size - overlap))
    return [x for x in cut if len(x) >= LEAST]


def is_heading(text: str) -> bool:
    s = text.strip()
    return len(s) < 120 and bool(_title.match(s) or (_article_title.match(s) and "\n" not in s))


def _fit(pieces: list[str], most: int, size: int, overlap: int) -> list[str]:
    """Pieces over ``most`` characters are cut into windows; then those under 30 go."""
    out = []
    for p in pieces:
        out += windows(p, size, overlap) if len(p) > most else [p]
    return [p for p in out if len(p.strip()) >= LEAST_SECTION]


def _merge_sections(sections: list[str], least: int) -> list[str]:
    """A heading takes what follows it; a short plain section joins what stands before it."""
    done: list[str] = []
    open_ = ""
    for s in sections:
        if open_ and (is_heading(open_) or (len(s) < least and not is_heading(s))):
            open_ += "\n\n" + s
        else:
            done += [open_] if open_ else []
            open_ = s
    if open_ and done and len(open_) < least and not is_heading(open_):
        done[-1] += "\n\n" + open_
    elif open_:
        done.append(open_)
    return done


def section_chunks(text: str, least: int = 100, most: int = 1500, size: int = 800, overlap: int = 150) -> list[str]:
    """At section starts, else at blank lines, else as windows."""
    for parts in (_boundary.split(text), text.split("\n\n")):
        sections = [s.strip() for s in parts if s.strip()]
        if len(sections) > 1:
            return _fit(_merge_sections(sections, least), most, size, overlap)
    return windows(text, size, overlap)


class _Acts:
    """Collects chunks: an act with its context and what follows it, and text outside acts."""

    def __init__(self):
        self.chunks: list[str] = []
        self.context: list[str] = []
        self.block: list[str] = []
        self.in_act = False

    def close(self):
        if self.block:
            self.chunks.append("\n".join(self.block))
        self.block, self.in_act = [], False

    def feed(self, line: str):
        if _major.match(line):
            self.close()
            self.context = [line]
        elif _article.match(line):
            self.close()
            self.context = self.context[:1] + [line]
        elif _act.match(line):
            self.close()
            self.block, self.in_act = [*self.context, line], True
        else:
            self.block.append(line)


def act_chunks(text: str, most: int = 1800, least: int = 80) -> list[str]:
    """One billing act a chunk, with its headings; short chunks join the next unless both are plain acts."""
    acts = _Acts()
    for raw in text.splitlines():
        line = raw.strip()
        if line and not line.startswith("===== PAGE"):
            acts.feed(line)
    acts.close()
    merged: list[str] = []
    for chunk in acts.chunks:
        if merged and len(merged[-1]) < least and not (_act.search(merged[-1]) and _act.search(chunk)):
            merged[-1] += "\n\n" + chunk
        else:
            merged.append(chunk)
    out = []
    for chunk in merged:
        out += [chunk] if len(chunk) <= most else windows(chunk, most, 150)
    return [c.strip() for c in out if len(c.strip()) >= LEAST_SECTION]


# --- dispatch ---------------------------------------------------------------


def chunk_documents(docs: DataFrame, strategy: str = "semantic", chunk_size: int = 800, overlap: int = 150, least: int = 100, most: int = 1500, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per chunk: ``id_col``, chunk_index (from 0), total_chunks, strategy, chunk, and the other columns."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "naive":
        made = docs.withColumn("_chunks", naive_chunks(F.coalesce(F.col(text_col), F.lit("")), chunk_size))
    elif strategy == "overlap":
        made = docs.withColumn("_chunks", overlap_chunks(F.coalesce(F.col(text_col), F.lit("")), chunk_size, overlap))
    else:
        # the recogniser runs in the JVM; its flag travels with the text through one Arrow pass
        flagged = docs.withColumn("_acts", T.is_act_text(F.col(text_col)))
        at, flag = flagged.columns.index(text_col), flagged.columns.index("_acts")
        schema = docs.schema.simpleString()[len("struct<"):-1] + ",_chunks:array<string>"

        def run(batches):
            for b in batches:
                rows = zip(b.column(at).to_pylist(), b.column(flag).to_pylist())
                made = [[] if not t else act_chunks(t, most, least) if acts else section_chunks(t, least, most, chunk_size, overlap) for t, acts in rows]
                yield pa.RecordBatch.from_arrays([*b.columns[:flag], pa.array(made, pa.list_(pa.string()))], names=[*b.schema.names[:flag], "_chunks"])

        made = flagged.mapInArrow(run, schema)
    others = [c for c in docs.columns if c not in (text_col, id_col)]
    return made.select(id_col, *others, F.size("_chunks").alias("total_chunks"), F.lit(strategy).alias("strategy"), F.posexplode("_chunks").alias("chunk_index", "chunk")).select(
        id_col, "chunk_index", "total_chunks", "strategy", "chunk", *others)


def chunk_stats(chunks: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """Count, least, mean (whole) and most characters; no rows if there are no chunks."""
    n = F.length(chunk_col)
    out = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.min(n).cast("long").alias("least"), F.floor(F.sum(n) / F.count(F.lit(1))).cast("long").alias("mean"), F.max(n).cast("long").alias("most"))
    return out.where("n_chunks > 0")
