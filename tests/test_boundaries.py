"""Round trips, file order, HTTP providers, page sources: what meets the outside."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import storage
from quillstone.operators import retrieval, tables
from quillstone.plans import pipeline
from quillstone.sources import documents, index, providers, registry
from quillstone.streaming import ingest

HEADER = "id,type_document,titre,annee,source,url,nom_pdf,theme,priorite"


@pytest.mark.parametrize("array", [False, True])
def test_exported_json_reloads_with_all_rows(spark, tmp_path, array):
    rows = [(f"c{i}", f"texte {i} é\n\"x\"", [float(i), 0.5], i, 5, "naive", "f.pdf", None if i else 2020, 3) for i in range(5)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk string, embedding array<float>, chunk_index int, total_chunks int, strategy string, source string, annee int, vec_id long").repartition(3)
    path = str(tmp_path / "json")
    index.export_json(chunks, path, array)
    back = {r.chunk_index: r for r in index.load_index(spark, path).collect()}
    assert len(back) == 5
    for _, text, vector, i, total, strategy, source, year, _ in rows:
        r = back[i]
        assert (r.text, r.embedding, r.total_chunks, r.strategy, r.metadata.source, r.metadata.annee, r.metadata.theme) == (text, vector, total, strategy, source, year, None)
    if array:
        whole = "".join(f.read_text() for f in sorted((tmp_path / "json").glob("part-*")))
        assert [sorted(x) for x in json.loads(whole)] == [sorted(["text", "embedding", "chunk_index", "total_chunks", "strategy", "metadata"])] * 5
    again = str(tmp_path / "again")
    index.export_json(index.load_index(spark, path), again, array)
    assert index.load_index(spark, again).count() == 5
    index.export_json(chunks.limit(0), again, array)
    assert index.load_index(spark, again).count() == 0


def test_metadata_as_an_object(spark):
    row = spark.createDataFrame([("f.pdf", 2020)], "source string, annee int")
    made = json.loads(row.select(index.metadata_json(row).alias("m")).first().m)
    assert len(made) == 16 and made["source"] == "f.pdf" and made["annee"] == 2020 and made["theme"] is None


def test_the_last_row_of_the_file_wins(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(HEADER + "\n9,loi,FIRST,2019,s,u,pdf_1,t,1\n2,loi,LAST,2020,s,u,pdf_1,t,1\n")
    rows = registry.load_registry(spark, str(path))
    assert [r.titre for r in registry.last_wins(rows, "position").collect()] == ["LAST"]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "pdf_1.pdf").write_text("soins infirmiers")
    assert [r.titre for r in pipeline.ingest(spark, str(raw), str(path)).collect()] == ["LAST"]


def test_files_come_in_order_of_their_names(spark, tmp_path):
    for folder, names in (("a", ["pdf_2.pdf", "x.pdf"]), ("b", ["B.pdf", "pdf_10.pdf", "x.pdf"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text(f"{folder} {n} " + "mot " * 10)
    rows = pipeline.ingest(spark, str(tmp_path / "*")).collect()
    assert [r.source for r in rows] == ["B.pdf", "pdf_10.pdf", "pdf_2.pdf", "x.pdf", "x.pdf"]
    assert len({r.doc_id for r in rows}) == 5 and rows[0].doc_id == "B.pdf" and rows[3].doc_id.endswith("/a/x.pdf")
    assert rows[3].text.startswith("a x.pdf") and rows[4].text.startswith("b x.pdf")


def boxed():
    """An extractor of two pages: words with a table's box, and a page without layout text."""

    def extract(content):
        word = lambda x, top, text: {"x0": float(x), "top": float(top), "x1": x + 9.0, "bottom": top + 8.0, "text": text}
        signals = "Désignation de l'acte, coefficient, lettre clé AMI NGAP"
        yield {"page_no": 1, "text": "not read", "tables": [[["Désignation", "Coefficient", "Lettre clé"], ["Acte de soin long", "4", "AMI"]]],
               "objects": [word(30, 11, "infirmiers"), word(10, 10, "soins"), word(12, 52, "dedans"), word(10, 90, "fin"), word(40, 80, "bord")],
               "boxes": [{"x0": 10.0, "top": 50.0, "x1": 60.0, "bottom": 70.0}]}
        yield {"page_no": 2, "text": " \n", "plain": signals, "tables": []}

    return extract


def test_words_in_tables_are_left_to_the_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("x")
    row = pipeline.ingest(spark, str(tmp_path), mode="ngap", extractor=boxed()).first()
    assert "soins infirmiers bord fin" in row.text and "dedans" not in row.text and "not read" not in row.text
    assert "- Acte de soin long : coefficient 4, lettre clé AMI" in row.text and "lettre clé AMI NGAP" in row.text
    page = spark.createDataFrame([tuple(next(boxed()(b""))[k] for k in ("objects", "boxes"))], "objects array<struct<x0: double, top: double, x1: double, bottom: double, text: string>>, boxes array<struct<x0: double, top: double, x1: double, bottom: double>>")
    assert page.select(tables.text_outside(F.col("objects"), F.col("boxes")).alias("t")).first().t == "soins infirmiers\nbord\nfin"
    plain = pipeline.ingest(spark, str(tmp_path), mode="generic", extractor=boxed()).first().text
    assert "not read" in plain and "soins" not in plain
    assert pipeline.ingest(spark, str(tmp_path), extractor=boxed()).first().extraction_mode == "ngap"


def counting(path):
    def extract(content):
        with open(path, "a") as f:
            f.write("x")
        yield {"page_no": 1, "text": content.decode() + " soins " * 20, "tables": []}

    return extract


def test_each_file_is_extracted_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(3):
        (raw / f"{i}.pdf").write_text(f"texte {i}")
    count = tmp_path / "count"
    pipeline.build_index(spark, str(raw), str(tmp_path / "out"), str(tmp_path / "cache"), extractor=counting(str(count)))
    assert count.read_text() == "xxx"


def test_texts_and_cached_vectors_as_files(spark, tmp_path):
    docs = spark.createDataFrame([("a.pdf", "un\ndeux"), ("b.pdf", "é")], "doc_id string, text string")
    index.save_texts(docs, str(tmp_path / "all"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "all")).collect()) == ["deux", "un", "é"]
    index.save_texts(docs, str(tmp_path / "each"), name_col="doc_id")
    assert {d.name: next(d.glob("part-*")).read_text() for d in (tmp_path / "each").glob("name=*")} == {"name=a.pdf": "un\ndeux\n", "name=b.pdf": "é\n"}
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / ("0" * 31 + "a.json")).write_text("[1.0, 2.5]")
    row = index.load_cache_json(spark, str(cache), "m").first()
    assert (row.cache_key, row.model, row.embedding) == ("0" * 31 + "a", "m", [1.0, 2.5])


class Service(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, self.headers["Authorization"], body))
        if self.path.endswith("embeddings"):
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        elif self.path.endswith("rerank"):
            out = {"results": [{"index": i, "relevance_score": 1.0 / (i + 1)} for i in range(len(body["documents"]) - 1)]}
        else:
            out = {"choices": [{"message": {"content": "- une question assez longue\n \n"}}]}
        bad = body.get("model") == "bad"
        self.send_response(500 if bad else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"error": "broken"} if bad else out).encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_http_providers(spark, tmp_path, monkeypatch, address):
    monkeypatch.setenv("SOME_KEY", "s3")
    embedder = providers.HttpEmbedder(address, "m", "SOME_KEY", batch=2, delay=0.0)
    assert embedder.embed(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]] and providers.embed_query(embedder, "xy") == [2.0, 1.0]
    assert Service.seen[0][1:] == ("Bearer s3", {"model": "m", "input": ["a", "bcd"]})
    assert providers.HttpReranker(address, "m", "SOME_KEY").rerank("q", ["x", "y", "z"]) == [(0, 1.0), (1, 0.5)]
    chat = providers.HttpChat(address, "m", "SOME_KEY")
    asked = spark.createDataFrame([(0, "Question ?"), (1, "Autre ?")], "query_id long, text string")
    assert [(r.query_id, r.sq_idx, r.text) for r in providers.sub_queries(asked, chat, "p").orderBy("query_id").collect()] == [(0, 0, "une question assez longue"), (1, 0, "une question assez longue")]
    assert [r.text for r in providers.rewritten(asked, chat, "p").collect()] == ["une question assez longue"] * 2
    with pytest.raises(RuntimeError, match="500 .*broken") as failed:
        providers.HttpChat(address, "bad", "SOME_KEY").chat([])
    assert "s3" not in str(failed.value)
    with pytest.raises(RuntimeError):
        providers.HttpChat("http://127.0.0.1:1/v1", "m", "SOME_KEY", 2).chat([])
    candidates = spark.createDataFrame([(0, 7, "q", "x"), (0, 3, "q", "y"), (0, 5, "q", "z")], "query_id long, vec_id long, query string, chunk string")
    env = tmp_path / ".env"  # the workers do not have the variable
    env.write_text("OTHER_KEY=s4\n")
    scores = {r.vec_id: r.relevance_score for r in providers.rerank_candidates(candidates, providers.HttpReranker(address, "m", "OTHER_KEY", env_file=str(env))).collect()}
    assert scores == {3: 1.0, 5: 0.5, 7: 0.0}
    monkeypatch.setenv("MISTRAL_API_KEY", "k")
    made = providers.embedder_of(providers.EmbeddingConfig())
    assert (made.model, made.key_variable, made.batch, made.delay) == ("mistral-embed", "MISTRAL_API_KEY", 10, 0.5) and "k" not in repr(made).split("'")


def test_blank_sub_queries_go(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.pdf").write_text("Article 1 " + "soins infirmiers à domicile " * 8)
    out = str(tmp_path / "index")
    pipeline.build_index(spark, str(raw), out, str(tmp_path / "cache"))
    embedder = providers.HashEmbedder()
    blank = providers.ScriptedChat(lambda m: "- -- 1. ... -- --\n" if "sous-questions" in m[0]["content"] else "x")
    assert pipeline.ask(spark, out, "soins ?", embedder, blank, least=-1.0).sub_queries == ["soins ?"]
    one = providers.ScriptedChat(lambda m: "1. soins à domicile\nsuite" if m[0]["content"] == pipeline.REWRITE else "x")
    got = pipeline.ask(spark, out, "soins ?", embedder, one, least=-1.0, multi_query=False, rewrite=True, reranker=providers.LexicalReranker())
    assert got.sub_queries == ["soins à domicile"] and got.rewritten_query == "soins à domicile" and got.query == "soins ?"
    assert got.sources[0].rerank_score == 0.0 or got.sources[0].rerank_score <= 1.0


def test_arguments(tmp_path, spark):
    a = pipeline.arguments(["dir", "--provider", "openai", "--model", "text-embedding-3-large", "--chunk-size", "500"])
    assert (a.provider, a.model, a.chunk_size, a.min_chunk_size, a.strategy) == ("openai", "text-embedding-3-large", 500, 150, "semantic")
    with pytest.raises(SystemExit):
        pipeline.arguments(["dir", "--provider", "none"])
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.pdf").write_text("Article 1 " + "soins infirmiers à domicile " * 8)
    counts = pipeline.main([str(raw), "--out", str(tmp_path / "o"), "--cache", str(tmp_path / "c"), "--json", str(tmp_path / "j")])
    assert counts["loaded"] == 1 and index.load_index(spark, str(tmp_path / "j")).count() == counts["n_chunks"] >= 1


def test_a_batch_that_runs_again_is_written_once(spark, tmp_path):
    raw, out, state = (tmp_path / n for n in ("raw", "out", "state"))
    raw.mkdir()
    (raw / "a.pdf").write_text("un")
    ingest.run_once(spark, str(raw), str(out), str(state))
    commits = sorted((state / "commits").glob("[0-9]*"))
    for f in [*commits, *(state / "commits").glob(".*.crc")]:  # as if the driver was lost after the write
        f.unlink()
    ingest.run_once(spark, str(raw), str(out), str(state))
    assert [r.text for r in spark.read.parquet(str(out)).collect()] == ["un"]


def test_best_scores_with_ties():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m, n, k = rng.integers(1, 6), rng.integers(1, 40), int(rng.integers(1, 12))
        scores, ids = rng.integers(0, 5, (m, n)).astype(float), rng.permutation(100)[:n]
        row, column = retrieval.best_of(scores, ids, k)
        expect = [(r, c) for r in range(m) for c in sorted(range(n), key=lambda c: (-scores[r, c], ids[c]))[:k]]
        assert list(zip(row.tolist(), column.tolist())) == expect


def test_role_scores_per_row(spark):
    rng = random.Random(1)
    cells = ["", None, "1 5", "2,5", "AMI", "x", "AMI\n4", "  "]
    grids = [(i, [[rng.choice(cells) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 13))]) for i in range(60)]
    got = {(r.k, r.col): (r.coeff_score, r.lk_score, r.text_score) for r in tables.role_scores(spark.createDataFrame(grids, "k int, g array<array<string>>"), "k", "g").collect()}
    expect = {}
    for k, grid in grids:
        for row in grid[:10]:
            for c, v in enumerate(row):
                v = (v or "").strip()
                number, code = bool(tables.coefficients(v)), tables.has_key(v)
                old = expect.get((k, c), (0, 0, 0))
                expect[k, c] = (old[0] + number, old[1] + code, old[2] + (v != "" and not number and not code))
    assert got == expect


def test_tables_between_steps(spark, monkeypatch):
    with storage.scratch(spark):
        gone = storage.materialize(spark.range(3), "t")
        kept = storage.materialize(gone, "kept", lasting=True)
        assert gone.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://x:1", "getConf": staticmethod(lambda: Unset.conf)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Unset)
