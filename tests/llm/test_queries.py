"""Every registered query against its contract, on tables with nulls, blanks, copies and long texts."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.llm import media, mixing, quality, queries, rules, sharding
from quillstone.llm.common import materialize
from tests.llm.test_operators import (
    NASTY, PII, SECRETS, base_spans, corpus, force_components, labelled, matches_by_force, plain_fingerprint, removed_by_force, words)

SECRET_TEXTS = ['PassWord = "abcdefgh1" Api_Key="0123456789abcdef0123456789abcdef"', "AKIA" + "B" * 16, "é😀 secret=é token: abcdefgh12", "f" * 40]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables; doc_id 0, 1, ... names the texts."""
    rng = random.Random(3)
    items = [(i, f"{words(rng, 20)}. {words(rng, 6)}.") for i in range(8)] + [(None, "why? because"), (3, None)]
    texts = corpus(5, 50) + NASTY + SECRET_TEXTS + [f"{words(rng, 40)} {items[2][1]} {words(rng, 20)}", "so why? Because."]
    texts = [t for t in texts if t is None or len(t) < 60000]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t else None, "x", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, size int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(t) and len(t) % 3 > 0), 0) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    html = [None, "", "<p>a", "<p>a", "WARC/1.1\r\n\r\n", "é" * 3000, ""]
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, texts, items, html


def run(spark, sf, name):
    return {r[0] if name != "op2_decontamination" else (r.doc_id, r.item_id): r for r in queries.QUERIES[name](spark, sf[0]).collect()}


def kinds(spark, sf, name):
    return dict(queries.QUERIES[name](spark, sf[0]).dtypes)


def test_all_are_registered():
    names = sorted(n for n in entry.queries() if n.startswith("op"))
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
    assert set(names) == set(queries.QUERIES) and "pipeline" in entry.queries()


def test_op1(spark, sf):
    got = run(spark, sf, "op1_media")
    types = kinds(spark, sf, "op1_media")
    assert [types[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")] == [
        "bigint", "bigint", "bigint", "string", "bigint", "bigint", "string", "string"]
    assert sorted(got) == list(range(len(sf[1])))
    for i, t in enumerate(sf[1]):
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        level = np.frombuffer(full, np.uint8).astype(float)
        share = np.unique(level, return_counts=True)[1] / len(level)
        expect = {"mean": level.mean(), "sd": level.std(), "entropy": -(share * np.log2(share)).sum(), "high": (level >= 128).mean()}
        assert {k: float(v) for k, v in (x.split("=") for x in r.feature.split(";"))} == pytest.approx(expect, abs=1e-4)
        assert (r.position, r.caption, r.texts) == (1, f"{len(raw)} bytes", "0:Payload of a document|2:End of the page")


def test_op2(spark, sf):
    expect = {(d, sf[2][k][0]): round(s, 6) for d, t in enumerate(sf[1]) if t for k, s in matches_by_force(sf[2], t).items()}
    got = {k: r.score for k, r in run(spark, sf, "op2_decontamination").items()}
    assert got == pytest.approx(expect) and len(got) >= 2 and (len(sf[1]) - 1, None) in got


def pack_by_force(vectors, shards):
    """Largest units first, each to the shard of the highest dot product with the residual capacity."""
    capacity = [max(sum(v[i] for v in vectors) / shards, 1e-9) for i in range(3)]
    scaled = [[v[i] / capacity[i] for i in range(3)] for v in vectors]
    residual = [[1.0] * 3 for _ in range(shards)]
    out = [0] * len(vectors)
    for u in sorted(range(len(vectors)), key=lambda u: (-sum(x * w for x, w in zip(scaled[u], sharding.WEIGHTS)), u)):
        dots = [sum(r * x * w for r, x, w in zip(residual[k], scaled[u], sharding.WEIGHTS)) for k in range(shards)]
        k = max(range(shards), key=lambda k: (round(dots[k], 9), -k))
        residual[k] = [r - x for r, x in zip(residual[k], scaled[u])]
        out[u] = k
    return out


def test_op3(spark, sf):
    got = run(spark, sf, "op3_sharding")
    assert sorted(got) == list(range(len(sf[1])))
    slots, where, load = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for i, t in enumerate(sf[1]):
        raw, r = (t or "").encode(), got[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
        where[t or ""].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    split = {sf[1][i] or "" for i, r in got.items() if r.split}
    assert all(len(x) == 1 for t, x in where.items() if t not in split)
    rows = len(sf[1])
    assert all(sum((t or "") == s for t in sf[1]) > rows / 24 or sum(len(s.encode()) + 8 for t in sf[1] if (t or "") == s) > sum(load.values()) / 24 for s in split)


def test_packing_and_levelling_by_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        v = np.stack([rng.integers(8, 900, 60), rng.integers(0, 90, 60), rng.choice([1, 1, 1, 2, 5], 60)], 1).astype(float)
        first = sharding.pack(v, 5)
        assert first.tolist() == pack_by_force(v.tolist(), 5)
        last = sharding.level(v, first, 5)
        load = np.bincount(last, v[:, 0], 5)
        assert (np.bincount(last, v[:, 2], 5) == np.bincount(first, v[:, 2], 5)).all()
        assert load.max() - load.min() <= np.ptp(np.bincount(first, v[:, 0], 5))
        high, low = int(load.argmax()), int(load.argmin())
        width = load[high] - load[low]
        for a in np.flatnonzero(last == high):
            for b in np.flatnonzero(last == low):
                assert v[a, 2] != v[b, 2] or abs(width - 2 * (v[a, 0] - v[b, 0])) >= width
        assert sharding.gap(v, last, 5)[0] == pytest.approx(width / load.mean())


def test_lots_hold_the_tail_and_large_groups_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SINGLE", 20)
    monkeypatch.setattr(sharding, "LOTS", 16)
    rng = random.Random(6)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(300)] + ["half a shard " * 30] * 4 + ["hot"] * 150
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_rows(rows, 4).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert len(got) == len(texts) and {texts[r.doc_id] for r in got if r.split} == {"hot"}
    assert len(where["hot"]) > 1 and all(len(x) == 1 for t, x in where.items() if t != "hot")
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


@pytest.mark.parametrize("name, base", [("op4_pii", PII), ("op5_secrets", SECRETS)])
def test_op4_and_op5(spark, sf, name, base):
    got = run(spark, sf, name)
    assert sorted(got) == list(range(len(sf[1])))
    for i, t in enumerate(sf[1]):
        spans = base_spans(base, t or "")
        assert got[i].base_sha256 == digest(spans)
        for kind, *_ in base:
            assert got[i][f"n_{kind}"] == sum(s[3] == kind for s in spans)
        listed = got[i].spans.split(",") if got[i].spans else []
        assert [x for x in listed if x.split(":")[0] in {k for k, *_ in base}] == [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert [int(x.split(":")[1]) for x in listed] == sorted(int(x.split(":")[1]) for x in listed)


def test_op6(spark, sf):
    got = run(spark, sf, "op6_substrings")
    assert sorted(tuple(r) for r in got.values()) == removed_by_force(sf[1], range(len(sf[1])))


def test_op7(spark, sf):
    got, first = run(spark, sf, "op7_warc"), {}
    for i, h in enumerate(sf[3]):
        raw = (h or "").encode()
        f = first.setdefault(raw, i)
        assert tuple(got[i]) == (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)


def test_op8(spark, sf):
    got = run(spark, sf, "op8_simhash")
    fps = [plain_fingerprint(t) for t in sf[1]]
    root = force_components(fps, 4)
    smallest = {}
    for i, f in enumerate(fps):
        smallest[root[f]] = min(i, smallest.get(root[f], i))
    assert [(got[i].fingerprint, got[i].component_id) for i in range(len(fps))] == [(f"{f:016x}", smallest[root[f]]) for f in fps]


def test_op9(spark, sf):
    rows = queries.QUERIES["op9_mixing"](spark, sf[0]).collect()
    sources = collections.Counter(f"s{i % 3}" if i % 7 else "" for i in range(len(sf[1])))
    weight = {s: n ** 0.5 for s, n in sources.items()}
    counts = collections.Counter(r.doc_id for r in rows)
    for i, t in enumerate(sf[1]):
        s = f"s{i % 3}" if i % 7 else ""
        rate = weight[s] / sum(weight.values()) * len(sf[1]) / sources[s]
        u = int(hashlib.md5(f"mix-1:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = float(np.exp(-rate))
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert counts.get(i, 0) == k
    assert all(r.text == sf[1][r.doc_id] and 1 <= r.copy <= counts[r.doc_id] for r in rows)


@pytest.mark.parametrize("rate", [0.0, 0.3, 64.0, 900.0, 3000.0])
def test_poisson_quantiles_at_any_rate(spark, rate):
    rows = spark.range(400).select("id", mixing.poisson_count(F.lit(rate), F.col("id")).alias("n")).collect()
    for r in rows[:60]:
        u = int(hashlib.md5(f"mix-1:{r.id}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, log = 0, -rate
        terms = [np.exp(log)]
        while rate and sum(terms) <= u and k < 2 * rate + 100:
            k += 1
            log += np.log(rate / k)
            terms.append(np.exp(log))
        assert abs(r.n - k) <= (1 if rate > 500 else 0)  # the last digits of a sum of thousands of terms
    assert abs(np.mean([r.n for r in rows]) - rate) <= 4 * (rate / 400) ** 0.5


def statistics_by_force(t):
    t = t or ""
    w = [x for x in __import__("re").split(r"[\x20\t-\r]+", t)]
    chars, n = max(len(t), 1), len(w)
    count = lambda rx: len(__import__("re").findall(rx, t))
    return [np.log1p(len(t)), np.log1p(n), chars / n, count("[A-ZÀ-Þ]") / chars, count("[0-9]") / chars, count(r"\|") / chars,
            count(r"[#$%*&@^~<>{}\[\]=_\\]") / chars, count("[!?]") / chars, len(set(w)) / n,
            count(r"(?<![^\x20\t-\r])([^\x20\t-\r]++)\x20\1(?![^\x20\t-\r])") / n, np.log1p(chars / (t.count("\n") + 1)), sum(len(x) <= 3 for x in w) / n,
            count("[,.]") / chars, count("[ß-ɏ]") / chars]


def test_op10(spark, sf):
    got = run(spark, sf, "op10_quality")
    assert sorted(got) == list(range(len(sf[1])))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_compiled_rules_equal_the_rule_matrix(spark):
    docs, labels, _ = labelled(spark)
    stats = materialize(quality.statistics(docs, ["doc_id", "text"]), "t").collect()
    for r in stats:
        assert [r[f] for f in quality.FEATURES] == pytest.approx(statistics_by_force(r.text), abs=2e-6)
    x = {r.doc_id: np.array([[r[f] for f in quality.FEATURES]]) for r in stats}
    bias, weighted = quality.fit_on(quality.sampled(spark.createDataFrame(stats), labels))
    assert len(weighted) > 3
    for r in quality.score(docs, labels, ["doc_id"]).collect():
        z = bias + rules.rule_matrix([k for k, _ in weighted], x[r.doc_id])[0].astype(float) @ np.array([w for _, w in weighted])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-6)


def test_quality_with_odd_ids_and_labels(spark):
    docs, labels, _ = labelled(spark, 300)
    more = docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs).unionByName(docs.limit(7))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (2, 0, 0), (2, 1, 0), (3, 7, 0), (4, None, 0)], "doc_id long, quality int, toxic int"))
    got = quality.score(more, odd, ["doc_id"]).collect()
    assert len(got) == more.count() and sum(r.doc_id is None and not r.held_out for r in got) == 5
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert all(len(v) == 1 for k, v in by.items() if k is not None)


def test_media_store_holds_every_payload_once_per_row(spark, sf):
    path = media.write_store(spark.read.parquet(f"{sf[0]}/documents.parquet").select(F.sha2(media.padded(F.coalesce("text", F.lit("")).cast("binary")), 256).alias("digest"), F.col("text").cast("binary").alias("payload")))
    assert spark.read.parquet(path).count() == len(sf[1]) and media.store_features(spark, path).count() == len({hashlib.sha256((t or "").encode() + b"\0" * (-len((t or "").encode()) % 64 if t else 64)).hexdigest() for t in sf[1]})
