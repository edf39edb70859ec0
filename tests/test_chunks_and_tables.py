"""Chunkers, table folds, page folds: goldens and twins."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import chunking as C
from quillstone.operators import tables as B


@pytest.mark.parametrize("size,overlap", [(30, 7), (25, 20), (40, 0), (21, 19)])
def test_windows_native_equals_python(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", "x", "😀" * 50, *["".join(rng.choice("ab é\n😀") for _ in range(rng.randint(0, 200))) for _ in range(30)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.x for r in rows.select("doc_id", C.overlap_chunks(F.col("text"), size, overlap).alias("x")).collect()}
    assert all(got[i] == C.windows(t, size, overlap) for i, t in enumerate(texts))
    naive = {r.doc_id: r.x for r in rows.select("doc_id", C.naive_chunks(F.col("text"), size).alias("x")).collect()}
    assert all(naive[i] == C.windows(t, size, 0) for i, t in enumerate(texts))


def test_windows_reject_large_overlap(spark):
    with pytest.raises(ValueError):
        C.overlap_chunks(F.col("t"), 10, 10)
    with pytest.raises(ValueError):
        C.chunk_documents(spark.createDataFrame([(1, "x")], "doc_id int, text string"), "other")


def test_sections_merge_headings_and_short_parts():
    body = "b" * 130
    text = f"TITRE I\nArticle 1 {body}\nArticle 2 court\nArticle 3 {body}\nCHAPITRE II"
    assert C.section_chunks(text) == [f"TITRE I\n\nArticle 1 {body}", "Article 2 court\n\nArticle 3 " + body]
    assert C.section_chunks("p" * 40 + "\n\n" + "q" * 120) == ["p" * 40, "q" * 120]
    assert C.section_chunks("x" * 1000) == C.windows("x" * 1000, 800, 150)
    assert C.section_chunks("SECTION 1\n" + "y" * 2000 + "\n\nz") == C.windows("SECTION 1\n" + "y" * 2000 + "\n\nz", 800, 150)


def test_acts_carry_context_and_orphans_stay():
    text = "TITRE I\nintro libre assez longue pour compter\nArticle 1\n- Acte un avec un libellé : coefficient 2,5, lettre clé AMI\ncondition de cet acte\n===== PAGE 2\n- Acte deux : coefficient 3\nCHAPITRE II\nfin orpheline de tout le document"
    assert C.act_chunks(text, least=10) == [
        "intro libre assez longue pour compter",
        "TITRE I\nArticle 1\n- Acte un avec un libellé : coefficient 2,5, lettre clé AMI\ncondition de cet acte",
        "TITRE I\nArticle 1\n- Acte deux : coefficient 3", "fin orpheline de tout le document"]


def test_semantic_routes_and_counts(spark):
    act = "AMI SFI AMX\n- a : coefficient 1, lettre clé AMI\n- b : coefficient 2\n- c : coefficient 3"
    rows = spark.createDataFrame([(1, act, "k"), (2, "x" * 900, "k"), (3, None, "k"), (4, "", "k")], "doc_id long, text string, chunk_note string")
    got = C.chunk_documents(rows).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.total_chunks, r.strategy, r.chunk_note) for r in got] == [(1, 0, 1, "semantic", "k"), (2, 0, 2, "semantic", "k"), (2, 1, 2, "semantic", "k")]
    stats = C.chunk_stats(C.chunk_documents(rows, "overlap")).collect()
    assert len(stats) == 1 and stats[0].most == 800
    assert C.chunk_stats(C.chunk_documents(rows.limit(0), "overlap")).count() == 0


HEAD = ["Désignation de l'acte", "Coefficient", "Lettre clé"]


def test_roles():
    assert B.infer_roles([HEAD]) == {"designation": 0, "coefficient": 1, "lettre_cle": 2, "header_row": 0}
    assert B.infer_roles([["", "x"], ["Lettre clé", "Libellé", "coeff."]])["header_row"] == 1
    assert B.infer_roles([["AMI", "texte", "3"], ["K", "autre", "2,5"]]) == {"designation": 1, "coefficient": 2, "lettre_cle": 0, "header_row": None}
    assert B.infer_roles([["x", "1"]], {"designation": 2, "coefficient": 0, "lettre_cle": 1}) == {"designation": 2, "coefficient": 0, "lettre_cle": 1, "header_row": None}
    assert B.infer_roles([]) == B.DEFAULT_ROLES
    with pytest.raises(ValueError):
        B.infer_roles([[], None])


@pytest.mark.parametrize("grid,kind", [
    ([["Stations thermales", "1", "AMI"]], "ignore"), ([["0012", "acte", None, "3"]], "anatpath"), ([["cure", "Maximum de 18 séances"]], "thermal"),
    ([HEAD, ["acte", "3", "AMI"]], "cotation_ngap"), ([["a", "b"]], "ignore"), ([], "ignore"), ([None], "ignore"),
])
def test_kinds(grid, kind):
    assert B.kind_of(grid) == kind


def lines(*rows, inherited=None):
    return B.BillingTable([list(r) for r in rows], inherited).format()


def test_billing_lines():
    assert lines(HEAD, ["Prélèvement", "1,5", "AMI"]) == ["- Prélèvement : coefficient 1,5, lettre clé AMI"]
    assert lines(HEAD, ["Acte", "2", "AMI ou"], ["", "", "AMX ou"], ["", "", "SFI"]) == ["- Acte : coefficient 2, lettre clé AMI ou AMX ou SFI"]
    assert lines(HEAD, ["Acte", "2", "AMI"], ["Par dérogation, ceci", "", ""], ["suite du texte", None, None], ["Texte libre", "", ""]) == [
        "- Acte : coefficient 2, lettre clé AMI | condition: Par dérogation, ceci suite du texte", "Texte libre"]
    assert lines(HEAD, ["un\ndeux", "1\n2", "AMI\nK"]) == ["- un : coefficient 1, lettre clé AMI K", "- deux : coefficient 2, lettre clé AMI K"]
    assert lines(HEAD, ["Acte", "1", "K"], ["", "2", "Z"]) == ["- Acte : coefficient 1, lettre clé K", "- Acte (variante) : coefficient 2, lettre clé Z"]
    assert lines(HEAD, ["", "4", "K"]) == ["- (acte sans libellé extrait) : coefficient 4, lettre clé K"]
    assert lines(HEAD, ["Acte", "1 5", "K"]) == ["- Acte : coefficient 15, lettre clé K"]
    assert lines(["Désignation\nPremier acte\nSecond acte", "Coefficient", "Lettre clé\nAMI\nK"], ["", "1", ""], ["", "2", ""]) == [
        "- Premier acte : coefficient 1, lettre clé AMI", "- Second acte : coefficient 2, lettre clé K"]


def test_native_formats_equal_python(spark):
    grids = [[["0012", "a\nb", None, "3"], ["0012", "x" * 210, "", "2,5"], ["12", "a", "", "3"], ["001", "a"]], [["cure", "18 Séances"], ["", "séance"], None]]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "i int, g array<array<string>>")
    for r in rows.select("i", B.pathology_lines(F.col("g")).alias("p"), B.spa_lines(F.col("g")).alias("s")).collect():
        assert r.p == B.pathology(grids[r.i]) and r.s == B.spa(grids[r.i])


def test_page_fold(spark):
    first = [[HEAD, ["Acte un", "2", "AMI ou"]]]
    second = [[["", "", "SFI"], ["Acte deux", "3", "K"]]]
    pages = [(1, 1, "page une", first), (1, 2, "page deux", second), (1, 3, "  ", []), (2, 1, "seule", None)]
    rows = spark.createDataFrame(pages, "doc_id long, page_no int, text string, tables array<array<array<string>>>").repartition(3)
    got = {r.doc_id: r for r in B.fold_pages(rows).collect()}
    assert got[1].text == "page une\n\n--- Cotations extraites ---\n\n- Acte un : coefficient 2, lettre clé AMI ou SFI\n\npage deux\n\n--- Cotations extraites ---\n\n- Acte deux : coefficient 3, lettre clé K"
    assert got[2].text == "seule" and got[1].error is None
    assert B.join_boundary("x lettre clé AMI ou", "Première partie : a\nSFI\nfin") == ("x lettre clé AMI ou SFI", "Première partie : a\n\nfin")
    assert B.join_boundary("x lettre clé AMI", "SFI") == ("x lettre clé AMI", "SFI")
    assert B.fold_document([("a\na", []), ("", []), ("b", [])], "generic") == "a\n\nb"


def test_boxes(spark):
    objects = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 8.5, 8.5, 30.0, 30.0), (3, 8.5, 8.5, 19.0, 21.9)], "i int, x0 double, top double, x1 double, bottom double").withColumn("page", F.lit(1))
    boxes = spark.createDataFrame([(1, 10.0, 10.0, 20.0, 20.0)], "page int, x0 double, top double, x1 double, bottom double")
    assert {r.i for r in B.outside_boxes(objects, boxes, ["page"]).collect()} == {1, 2}


def test_chunk_semantic_runs_over_acts_and_sections(spark, tmp_path):
    from quillstone.functions import text as T
    from quillstone.plans import queries

    rows = [(i, f"texte {i} " + "mot " * (40 * i + 20)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    source = queries.noised(spark, str(tmp_path), "structure").withColumnRenamed("t", "text").withColumn("acts", T.is_act_text(F.col("text"))).collect()
    assert {r.doc_id for r in source if r.acts} == {3, 7, 11}
    expected = {(r.doc_id, i, c) for r in source for i, c in enumerate(C.act_chunks(r.text, 1500, 100) if r.acts else C.section_chunks(r.text))}
    got = [(r.doc_id, r.chunk_index, r.chunk) for r in queries.chunk_semantic(spark, str(tmp_path)).collect()]
    assert len(got) == len(expected) and set(got) == expected and {d for d, _, _ in got} == set(range(12))
