"""The pipeline's stages on a small corpus with planted cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import simhash
from tests.llm.test_operators import words


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents, bad ones, exact and near copies, leaks, nulls; ids tell which."""
    rng = random.Random(21)
    clean = [words(rng, rng.randint(60, 200)) for _ in range(240)]
    bad = [rng.choice([t.upper().replace(" ", "!! "), " | ".join(t.split())]) for t in (words(rng, 80) for _ in range(60))]
    copies = clean[:20]
    near = []
    for t in clean[20:40]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    items = [(i, f"{words(rng, 30)}. {words(rng, 9)}.") for i in range(6)]
    leaks = [f"{words(rng, 60)} {t} {words(rng, 20)}" for _, t in items]
    texts = clean + bad + copies + near + leaks + [None]
    names = ["clean"] * 240 + ["bad"] * 60 + ["copy"] * 20 + ["near"] * 20 + ["leak"] * 6 + ["null"]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else None, "x") for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").withColumnRenamed("shard", "extra").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(n != "bad"), 0) for i, n in enumerate(names) if n in ("clean", "bad")], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, names


def test_stages_take_effect_and_keep_clean_documents(spark, planted):
    path, names = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    of = lambda *kinds: {i for i, n in enumerate(names) if n in kinds}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "t")
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == before.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    after = ids(seen["quality"][1])
    assert not after & of("bad") and len(of("clean") - after) <= 2 and len(of("leak") - after) <= 1
    kept = ids(seen["near_duplicates"][1])
    assert not kept & of("copy", "near") and of("clean") & after <= kept
    clean = ids(seen["decontamination"][1])
    assert clean == kept - of("leak")
    mixed = seen["mixing"][1]
    assert ids(mixed) <= clean and 0.8 * len(clean) < mixed.count() < 1.2 * len(clean)
    assert mixed.exceptAll(docs.drop("shard")).count() == 0
    last = docs.collect()
    assert docs.columns[-1] == "shard" and len(last) == mixed.count() and all(0 <= r.shard < 24 for r in last)
    assert sum(zlib.crc32((r.text or "").encode()) for r in last) == sum(zlib.crc32((r.text or "").encode()) for r in mixed.collect())


def test_run_and_empty_table(spark, planted, tmp_path):
    path, _ = planted
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 0 and out.select(F.min("shard")).first()[0] >= 0
    empty = str(tmp_path / "sf")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_texts_that_stay_are_not_shuffled_for_those_that_go(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(1500)) for _ in range(200)]
    rows = list(enumerate(texts)) + [(200 + i, t + " more") for i, t in enumerate(texts[:6])] + [(None, texts[7]), (None, texts[8] + " once"), (206, None)]
    docs = corpus_pipeline.materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "t")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where neither side of the join is small
    try:
        kept = simhash.deduplicate(docs)
        before = written()
        found = kept.collect()
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r.doc_id for r in found) == [*range(200), 206] and {r.text for r in found} == {*texts, None}
    assert moved < sum(map(len, texts)) / 4


@pytest.mark.parametrize("slots", [1 << 10, simhash.SLOTS])
def test_slots_pass_over_no_wanted_row(spark, monkeypatch, slots):
    monkeypatch.setattr(simhash, "SLOTS", slots)
    rows, wanted = spark.range(-20000, 20000).withColumn("k", F.col("id") * 7), spark.range(-20000, 20000, 40).withColumn("k", F.col("id") * 7)
    taken = {r.id for r in simhash.slotted(rows, wanted, "id", "k").where("_taken").collect()}
    assert taken >= set(range(-20000, 20000, 40)) and len(taken) < (40000 if slots == 1 << 10 else 5000)
    assert simhash.slotted(rows, wanted.limit(0), "id", "k").where("_taken").isEmpty()
