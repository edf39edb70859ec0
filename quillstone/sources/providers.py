"""Boundaries to models: embedding, chat, reranking.

A provider is any object with the method below.  The ``Http`` ones speak the
common JSON form of such services; the stubs are deterministic and offline.  A
provider knows the name of its key's variable only: the key is read where the
call is made, and never stands in a column, a plan or a closure.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import reply_lines, rewritten_question, strip
from quillstone.sources.index import append_cache, misses, probe


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class EmbeddingConfig:
    """Models and sizes of the known providers."""

    provider: str = "mistral"
    model: str = ""
    dimensions: int = 0
    batch_size: int = 10
    delay: float = 0.5

    KNOWN = {"mistral": {"mistral-embed": 1024}, "openai": {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072}}
    ADDRESS = {"mistral": "https://api.mistral.ai/v1", "openai": "https://api.openai.com/v1"}
    KEY = {"mistral": "MISTRAL_API_KEY", "openai": "OPENAI_API_KEY"}

    def resolved(self) -> "EmbeddingConfig":
        if self.provider not in self.KNOWN:
            raise ValueError(f"unknown provider: {self.provider}")
        models = self.KNOWN[self.provider]
        model = self.model or next(iter(models))
        return EmbeddingConfig(self.provider, model, self.dimensions or models.get(model, 0), self.batch_size, self.delay)


@dataclass(frozen=True)
class HashEmbedder:
    """Hashed bag of words, unit length: equal texts get equal vectors."""

    model: str = "hash"
    dimensions: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dimensions
        for w in re.findall(r"\w+", text.lower()):
            h = hashlib.md5(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % self.dimensions] += 1.0 if h[4] & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v


class ScriptedChat:
    """Answers from a function of the messages."""

    def __init__(self, reply: Callable[[list[dict]], str]):
        self.reply = reply

    def chat(self, messages: list[dict], temperature: float = 0.1, max_tokens: int = 300) -> str:
        return self.reply(messages)


class LexicalReranker:
    """Share of the query's words that the document holds."""

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        words = set(re.findall(r"\w+", query.lower()))
        return [(i, len(words & set(re.findall(r"\w+", d.lower()))) / max(1, len(words))) for i, d in enumerate(documents)]


def api_key(variable: str, env_file: str = ".env") -> str:
    """From the environment, else from a line VAR=value of the env file; else ``ValueError``."""
    if os.environ.get(variable):
        return os.environ[variable]
    if os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and name.strip() == variable:
                    return value.strip().strip("\"'")
    raise ValueError(f"{variable} is not set")


def post(url: str, payload: dict, key: str, timeout: float = 120) -> dict:
    """The JSON reply; any failure is a ``RuntimeError`` that does not hold the key."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{url}: {e.code} {e.read().decode('utf-8', 'replace')[:500]}") from None
    except (OSError, ValueError) as e:
        raise RuntimeError(f"{url}: {e}") from None


@dataclass(frozen=True)
class _Http:
    """Executors need the key's variable too, by ``spark.executorEnv``, or an env file that they can read."""

    address: str
    model: str
    key_variable: str
    timeout: float = 120
    env_file: str = ".env"

    def call(self, path: str, payload: dict) -> dict:
        return post(f"{self.address}/{path}", {"model": self.model, **payload}, api_key(self.key_variable, self.env_file), self.timeout)


@dataclass(frozen=True)
class HttpEmbedder(_Http):
    batch: int = 10
    delay: float = 0.5

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = sorted(self.call("embeddings", {"input": texts})["data"], key=lambda r: r.get("index", 0))
        return [[float(x) for x in r["embedding"]] for r in rows]


@dataclass(frozen=True)
class HttpChat(_Http):
    def chat(self, messages: list[dict], temperature: float = 0.1, max_tokens: int = 300) -> str:
        return self.call("chat/completions", {"messages": messages, "temperature": temperature, "max_tokens": max_tokens})["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class HttpReranker(_Http):
    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        return [(r["index"], float(r["relevance_score"])) for r in self.call("rerank", {"query": query, "documents": documents})["results"]]


def embedder_of(config: EmbeddingConfig) -> HttpEmbedder:
    """The embedder of a known provider; its key must be set."""
    c = config.resolved()
    api_key(c.KEY[c.provider])
    return HttpEmbedder(c.ADDRESS[c.provider], c.model, c.KEY[c.provider], batch=c.batch_size, delay=c.delay)


def embed_query(embedder: Embedder, text: str) -> list[float]:
    """The vector of one question; the cache is for chunks."""
    return [float(x) for x in embedder.embed([text])[0]]


def embed_missing(missing: DataFrame, embedder: Embedder, batch: int | None = None, tasks: int | None = None) -> DataFrame:
    """cache_key, model, embedding for the texts; ``tasks`` bounds the parallel callers.
    The embedder's own ``batch`` and ``delay`` (seconds between calls) hold where it has them."""
    if tasks:
        missing = missing.coalesce(tasks)
    batch, delay = batch or getattr(embedder, "batch", 10), getattr(embedder, "delay", 0.0)

    def run(batches):
        called = False
        for frame in batches:
            for at in range(0, len(frame), batch):
                if called and delay:
                    time.sleep(delay)
                called = True
                some = frame.iloc[at:at + batch]
                yield pd.DataFrame({"cache_key": some["cache_key"], "model": embedder.model, "embedding": embedder.embed(list(some["text"]))})

    return missing.select("cache_key", "text").mapInPandas(run, "cache_key string, model string, embedding array<double>")


def embed_chunks(chunks: DataFrame, cache_path: str, embedder: Embedder, batch: int | None = None, tasks: int | None = None, text_col: str = "chunk") -> DataFrame:
    """The chunks with ``embedding``: cached vectors are reused, distinct misses are
    computed once and appended to the cache, and all are read from it."""
    from quillstone.sources.index import load_cache
    from quillstone.sources.schemas import CACHE

    spark = chunks.sparkSession
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    append_cache(embed_missing(misses(chunks, load_cache(spark, cache_path), embedder.model, text_col), embedder, batch, tasks), cache_path)
    return probe(chunks, load_cache(spark, cache_path), embedder.model, text_col)


def rerank_candidates(candidates: DataFrame, reranker, query_col: str = "query", text_col: str = "chunk", id_col: str = "vec_id") -> DataFrame:
    """query_id, id, relevance_score from a reranker, one call a query over its bounded candidates."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id_col)
        scores = dict(reranker.rerank(frame[query_col].iloc[0], list(frame[text_col])))
        return pd.DataFrame({"query_id": frame["query_id"], id_col: frame[id_col], "relevance_score": [float(scores.get(i, 0.0)) for i in range(len(frame))]})

    return candidates.groupBy("query_id").applyInPandas(run, f"query_id long, {id_col} long, relevance_score double")


def sub_queries(questions: DataFrame, chat, prompt: str) -> DataFrame:
    """query_id, sq_idx, text: each question decomposed by the chat provider; the
    question itself where the reply has no usable line.  Questions are a stated,
    small set and are handled on the driver."""
    rows = [(r["query_id"], r["text"], chat.chat([{"role": "system", "content": prompt}, {"role": "user", "content": r["text"]}])) for r in questions.toLocalIterator()]
    asked = questions.sparkSession.createDataFrame(rows, "query_id long, question string, reply string")
    parsed = F.filter(F.transform(reply_lines(F.col("reply"), F.col("question")), strip), lambda x: x != "")
    return asked.select("query_id", F.posexplode(F.when(F.size(parsed) > 0, parsed).otherwise(F.array("question"))).alias("sq_idx", "text"))


def rewritten(questions: DataFrame, chat, prompt: str) -> DataFrame:
    """query_id, sq_idx (0), text: each question rewritten by the chat provider; the question itself where the reply is blank."""
    rows = [(r["query_id"], r["text"], chat.chat([{"role": "system", "content": prompt}, {"role": "user", "content": r["text"]}])) for r in questions.toLocalIterator()]
    asked = questions.sparkSession.createDataFrame(rows, "query_id long, question string, reply string")
    return asked.select("query_id", F.lit(0).alias("sq_idx"), rewritten_question(F.col("reply"), F.col("question")).alias("text"))
