"""Retrieval, joins, sources, providers and plans."""

import json
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from quillstone.functions import vector
from quillstone.operators import prompt, retrieval
from quillstone.plans import pipeline, queries
from quillstone.sources import documents, index, providers, registry
from quillstone.streaming import ingest

VECTORS = "vec_id long, embedding array<float>, priorite int, annee int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(float).tolist(), i % 9, 2000 + i % 25) for i in range(200)]
    rows.append((200, [0.0] * 8, None, None))
    rows.append((201, rows[5][1], 1, 2025))
    return spark.createDataFrame(rows, VECTORS).repartition(5).cache()


def asked(vectors, ids):
    return vectors.where(F.col("vec_id").isin(ids)).select(F.lit(0).alias("query_id"), F.col("vec_id").alias("sq_idx"), F.col("embedding").alias("vec"))


def test_search_equals_brute_force_with_stable_ties(spark, vectors):
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    got = retrieval.search(vectors, asked(vectors, [5, 9]), 7).collect()
    for q in (5, 9):
        cos = lambda v: float(v @ rows[q] / (np.linalg.norm(v) * np.linalg.norm(rows[q]))) if v.any() else 0.0
        best = sorted(rows, key=lambda i: (-round(cos(rows[i]), 9), i))[:7]
        assert [r.vec_id for r in sorted((r for r in got if r.sq_idx == q), key=lambda r: r["rank"])] == best
    assert retrieval.search(vectors, asked(vectors, [200]), 3).select("cosine_score").distinct().collect()[0][0] == 0.0
    assert retrieval.search(vectors, asked(vectors, [-1]), 3).count() == 0
    assert retrieval.search(vectors.limit(0), asked(vectors, [5]), 3).count() == 0


def in_order(a, b):
    """Cosine as SQL sums it: dimension by dimension (Python's sum of floats compensates)."""
    dot = lambda x, y: reduce(float.__add__, (float(p) * float(q) for p, q in zip(x, y)))
    return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)


def test_scores_are_summed_in_order_to_the_last_bit(spark):
    rng = np.random.default_rng(7)
    made = rng.normal(size=(300, 64)).astype(np.float32)
    made[100:200] = made[:100]  # copies score alike, in whatever batch they stand
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<float>").repartition(7)
    got = retrieval.search(rows, asked(rows, [0, 50, 250]), 20).orderBy("sq_idx", "rank").collect()
    expect = []
    for q in (0, 50, 250):
        scores = {i: in_order(made[q], v) for i, v in enumerate(made)}
        expect += [(q, i, scores[i]) for i in sorted(scores, key=lambda i: (-scores[i], i))[:20]]
    assert [(r.sq_idx, r.vec_id, r.cosine_score) for r in got] == expect


def test_unequal_sizes_are_an_error(spark, vectors):
    bad = spark.createDataFrame([(0, 0, [1.0, 2.0])], "query_id long, sq_idx long, vec array<double>")
    with pytest.raises(Exception, match="unequal size"):
        retrieval.search(vectors, bad, 3).collect()
    with pytest.raises(Exception, match="unequal size"):
        vectors.select(vector.cosine(F.col("embedding"), F.array(F.lit(1.0)))).collect()


def test_greedy_dedup_keeps_a_and_c_of_a_chain(spark):
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = spark.createDataFrame([(0, 1, 1, at(0)), (0, 2, 2, at(20)), (0, 3, 3, at(40)), (1, 4, 1, at(0))], "query_id long, vec_id long, position int, embedding array<double>")
    assert {r.vec_id for r in retrieval.deduplicate(rows, 0.93).collect()} == {1, 3, 4}


def test_greedy_dedup_compares_scores_summed_in_order(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 64)).astype(np.float32)
    orders = [rng.permutation(64) for _ in range(60)]
    threshold = sorted(in_order(a[o], b[o]) for o in orders)[30]
    rows = [(q, i, i, v[o].tolist()) for q, o in enumerate(orders) for i, v in ((1, a), (2, b))]
    kept = retrieval.deduplicate(spark.createDataFrame(rows, "query_id long, vec_id long, position int, embedding array<float>"), threshold).collect()
    expect = {(q, i) for q, o in enumerate(orders) for i in (1, 2) if i == 1 or in_order(a[o], b[o]) <= threshold}
    assert {(r.query_id, r.vec_id) for r in kept} == expect


def test_retrieve_and_fusion(spark, vectors):
    found = retrieval.retrieve(vectors, asked(vectors, [5, 9]), 4, 30, -1.0).orderBy("position").collect()
    assert [r.position for r in found] == [1, 2, 3, 4] and found[0].vec_id in (5, 9, 201)
    model = spark.createDataFrame([(0, 5, 0.5)], "query_id long, vec_id long, relevance_score double")
    one = {r.vec_id: r for r in retrieval.retrieve(vectors, asked(vectors, [5, 9]), 60, 30, -1.0, model).collect()}
    r = one[5]
    assert r.rerank_score == 0.5 and one[9].rerank_score == 0.0
    assert r.final_score == pytest.approx(0.5 * r.cosine_score + 0.4 * 0.5 + 0.05 * r.priority_score + 0.05 * r.recency_score)
    few = retrieval.retrieve(vectors, asked(vectors, [5]), 10, 10, -1.0, dedup=True, threshold=0.99).collect()
    assert len([x for x in few if x.vec_id in (5, 201)]) == 1


def test_scores(spark):
    row = spark.range(1).select(*[vector.priority_score(F.lit(p).cast("int")).alias(f"p{p}") for p in (None, 1, 5, 9)], *[vector.recency_score(F.lit(y).cast("int")).alias(f"y{y}") for y in (None, 2030, 2024, 2021, 2016, 2000)]).first()
    assert list(row) == [0.5, 1.0, 0.5, 0.2, 0.5, 1.0, 1.0, 0.8, 0.6, 0.4]


HEADER = "id,type_document,titre,annee,source,url,nom_pdf,theme,priorite"


def test_registry(spark, tmp_path):
    good = tmp_path / "r.csv"
    good.write_text(HEADER + "\n1,loi,A,2019.0,s,u,pdf_1,t,1\n2,loi,B,x,s,u,pdf_1,t,\n3,loi,C,2020,s,u,pdf_3,t,5\n")
    rows = registry.load_registry(spark, str(good))
    assert [(r.id, r.annee, r.priorite, r.commentaire) for r in rows.orderBy("id").collect()] == [(1, 2019, 1, ""), (2, None, None, ""), (3, 2020, 5, "")]
    files = spark.createDataFrame([("pdf_1_x.pdf",), ("pdf_9.pdf",), ("x.pdf",)], "source string")
    got = {r.source: r for r in registry.enrich(files, registry.last_wins(rows, "id")).collect()}
    assert got["pdf_1_x.pdf"].titre == "B" and got["pdf_9.pdf"].registry_id is None and got["x.pdf"].titre == ""
    bad = tmp_path / "b.csv"
    bad.write_text("id,titre\n1,x\n")
    with pytest.raises(ValueError):
        registry.load_registry(spark, str(bad))
    with pytest.raises(ValueError):
        registry.load_registry(spark, "x.txt")
    bad.write_text(HEADER + "\n1,loi,A,2019.5,s,u,pdf_1,t,1\n")
    with pytest.raises(Exception, match="fractional"):
        registry.load_registry(spark, str(bad)).collect()


def test_cache_misses_are_computed_once(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b")], "i int, chunk string")
    path = str(tmp_path / "cache")
    first = {r.i: r.embedding for r in providers.embed_chunks(chunks, path, providers.HashEmbedder()).collect()}
    assert first[1] == first[3] and spark.read.parquet(path).count() == 2
    again = providers.embed_chunks(chunks.union(spark.createDataFrame([(4, "d")], "i int, chunk string")), path, providers.HashEmbedder())
    assert again.where("embedding is null").count() == 0 and spark.read.parquet(path).count() == 3
    other = index.probe(chunks, index.load_cache(spark, path), "another model")
    assert index.cache_counts(other).first().hits == 0


def test_index_round_trip(spark, tmp_path):
    meta = {f: "" for f in ("source", "filepath", "extension", "modified_time", "type_document", "titre", "source_juridique", "url", "nom_pdf", "theme", "commentaire", "extraction_mode")} | {"size_bytes": 1, "registry_id": None, "annee": 2020, "priorite": None}
    path = tmp_path / "i.json"
    path.write_text(json.dumps([{"text": "é", "embedding": [1.0, 2.5], "chunk_index": 0, "total_chunks": 1, "strategy": "naive", "metadata": meta}]))
    rows = index.load_index(spark, str(path))
    index.save_index(rows, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).first()
    assert back.text == "é" and back.embedding == [1.0, 2.5] and back.metadata.annee == 2020
    path.write_text(json.dumps([{"text": "é"}]))
    with pytest.raises(Exception, match="index rows need"):
        index.load_index(spark, str(path)).collect()


def test_files_and_error_isolation(spark, tmp_path):
    (tmp_path / "pdf_1.PDF").write_text("page une\fpage deux")
    (tmp_path / "pdf_2.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "note.txt").write_text("x")
    files = documents.list_files(spark, str(tmp_path))
    assert {r.source for r in files.collect()} == {"pdf_1.PDF", "pdf_2.pdf"}
    pages = documents.extract_pages(files).collect()
    assert sorted((p.page_no, p.text) for p in pages if p.error is None) == [(1, "page une"), (2, "page deux")]
    assert [p.error.split(":")[0] for p in pages if p.error] == ["UnicodeDecodeError"]


def test_index_build_and_answer(spark, tmp_path):
    corpus = tmp_path / "raw"
    corpus.mkdir()
    (corpus / "pdf_1_loi.pdf").write_text("Article 1 " + "soins infirmiers à domicile " * 8 + "\f" + "Article 2 " + "forfait de nuit " * 12)
    (corpus / "pdf_2.pdf").write_bytes(b"\xff")
    (corpus / "note.txt").write_text("x")
    reg = tmp_path / "r.csv"
    reg.write_text(HEADER + "\n1,loi,Titre,2024,s,u,pdf_1,t,1\n")
    counts = pipeline.build_index(spark, str(corpus), str(tmp_path / "index"), str(tmp_path / "cache"), registry_path=str(reg), embedder=providers.HashEmbedder())
    assert (counts["loaded"], counts["enriched"], counts["skipped"]) == (1, 1, 2) and counts["n_chunks"] >= 1
    assert pipeline.ingest_file(spark, str(corpus / "pdf_1_loi.pdf")).count() == 1
    for path, error in ((corpus / "note.txt", ValueError), (corpus / "none.pdf", FileNotFoundError)):
        with pytest.raises(error):
            pipeline.ingest_file(spark, str(path))
    with pytest.raises(NotADirectoryError):
        pipeline.build_index(spark, str(corpus / "none"), "o", "c")
    chat = providers.ScriptedChat(lambda m: "- soins infirmiers à domicile\n- forfait de nuit" if m[0]["role"] == "system" and "sous-questions" in m[0]["content"] else "réponse")
    answer = pipeline.ask(spark, str(tmp_path / "index"), "Quels soins infirmiers ?", providers.HashEmbedder(), chat, top_k=5, retrieval_k=10, least=0.0)
    assert answer.answer == "réponse" and answer.rewritten_query == answer.query and len(answer.sources) >= 1
    assert "Titre: Titre" in answer.prompt and answer.sources[0].final_score >= answer.sources[-1].final_score


def test_streaming_ingest_adds_new_files_once(spark, tmp_path):
    raw, out, state = (tmp_path / n for n in ("raw", "out", "state"))
    raw.mkdir()
    (raw / "a.pdf").write_text("un")
    ingest.run_once(spark, str(raw), str(out), str(state))
    (raw / "b.pdf").write_text("deux\ftrois")
    ingest.run_once(spark, str(raw), str(out), str(state))
    assert sorted(r.text for r in spark.read.parquet(str(out)).collect()) == ["deux", "trois", "un"]


def test_prompt(spark):
    rows = spark.createDataFrame([(1, 2, "h2", "b"), (1, 1, "h1", "a")], "query_id int, position int, header string, chunk string")
    assert prompt.build_context(rows).first().context == "--- Extrait 1 [h1] ---\na\n\n--- Extrait 2 [h2] ---\nb\n"
    listing = spark.range(1).select(prompt.source_listing(F.lit(True), F.lit("T" * 70), F.lit("loi"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0.5), F.lit(0.25), F.lit("u"), F.lit("f"), F.lit(1)).alias("x")).first().x
    assert listing == "[1] " + "T" * 65 + "...\nloi | PNone (Non classé) | None\nScore: cos=0.5000 final=0.2500\nURL: u"


def test_provider_configuration(monkeypatch, tmp_path):
    assert providers.EmbeddingConfig().resolved().model == "mistral-embed"
    assert providers.EmbeddingConfig("openai", "text-embedding-3-large").resolved().dimensions == 3072
    with pytest.raises(ValueError):
        providers.EmbeddingConfig("none").resolved()
    monkeypatch.delenv("A_KEY", raising=False)
    env = tmp_path / ".env"
    env.write_text("A_KEY='v'\n")
    assert providers.api_key("A_KEY", str(env)) == "v"
    with pytest.raises(ValueError):
        providers.api_key("B_KEY", str(env))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    plan = plan_of(queries.QUERIES["multi_query_topk"](spark, sf))
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    chunks = plan_of(queries.QUERIES["chunk_overlap"](spark, sf))
    assert "Exchange" not in chunks and "ReadSchema: struct<doc_id:bigint,text:string>" in chunks


def test_entry_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("kind", sorted(queries.NOISE))
def test_noise_changes_some_rows_but_not_all(spark, kind):
    if kind in ("reply", "files", "acts_only"):
        pytest.skip("the whole text is replaced")
    rows = queries.noised(spark, "/root/testdata/sf0.001", kind).join(queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"), "doc_id")
    changed = rows.where("t <> text").count()
    assert 0 < changed < rows.count()
