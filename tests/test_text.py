"""Text kernels against plain Python specifications, over awkward strings."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vocabulary as V
from quillstone.operators import cleaning

PIECES = st.sampled_from([
    "a", "É", "é", "œ", "😀", " ", "  ", "\t", "\n", "\n\n\n", "\r", "\r\n", "\x85", " ", "\xa0", "\x1c", "\xad", "-", "-\n", "---", "12", "3 / 10",
    "page 4 x", "- 5 -", "ou", "2.", "b)", "iv.", "•", "*", "séance", "AMI", "(Modifié", "(Créé par)", ")", " | condition:", "| NOTE :", "’", "", "•",
    "Version en vigueur du 01/02/2024", "Sommaire", "Première partie : x", "lettre clé", "coefficient",
])
TEXTS = st.lists(st.lists(PIECES, max_size=9).map("".join), min_size=12, max_size=12)
RELAXED = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def both(spark, texts, column, plain):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in rows.select("i", column(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), repr(t)


def by_line(keep):
    def run(t):
        rows = t.split("\n")
        s = [x.strip() for x in rows]
        around = [""] + s + [""]
        return "\n".join(x for i, x in enumerate(rows) if keep(s[i], around[i], around[i + 2]))

    return run


def page_number(s, p, n):
    if re.match(r"^[-–]\s*\d+\s*[-–]$", s) or re.match(r"page\s+\d+", s, re.I) or re.match(r"\d+\s*/\s*\d+$", s):
        return True
    return bool(re.match(r"\d{1,4}$", s)) and not any(w in f"{p} {n}" for w in V.COTATION_HINTS)


def noise(s, p, n):
    return not p and not n and bool(re.match(r"(\d{1,2}\.|[a-z°]{1,3}\)|ou|et|ou\s+:|[-–•]\s*|[ivxl]{1,5}\.)$", s, re.I))


def notes(t):
    out, inside = [], False
    for x in t.split("\n"):
        if inside or re.match(r"\s*\((Modifi[eé]|Cr[eé]{1,2}|Abrog[eé])\b", x, re.I):
            inside = ")" not in x
        else:
            out.append(x)
    return "\n".join(out)


def adjacent(t):
    out, last = [], None
    for x in t.splitlines():
        if not x.strip() or x.strip() != last:
            out.append(x)
        last = x.strip() or last
    return "\n".join(out).strip()


def spaces(t):
    t = re.sub(r"[^\S\n]{2,}", " ", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +\n", "\n", t)).strip()


def replaced(table):
    def run(t):
        for k, v in table.items():
            t = t.replace(k, v)
        return t

    return run


CASES = {
    "strip": (T.strip, str.strip),
    "universal_lines": (lambda c: F.array_join(T.universal_lines(c), "¦"), lambda t: "¦".join(t.splitlines())),
    "page_numbers": (T.remove_page_numbers, by_line(lambda *a: not page_number(*a))),
    "noise": (T.remove_noise_lines, by_line(lambda *a: not noise(*a))),
    "separators": (T.remove_separator_lines, by_line(lambda s, p, n: not (len(s) >= 3 and set(s) <= set("-=_*~")))),
    "symbols": (T.remove_single_symbol_lines, by_line(lambda s, p, n: not (len(s) == 1 and not s.isalnum()))),
    "indents": (T.strip_line_starts, lambda t: "\n".join(x.lstrip(" \t") for x in t.split("\n"))),
    "notes": (T.remove_legislative_notes, notes),
    "adjacent": (T.dedupe_adjacent_lines, adjacent),
    "spaces": (T.normalize_spaces, spaces),
    "ingest": (T.ingest_characters, replaced(V.INGEST_CHARACTERS)),
    "clean": (cleaning.normalize_unicode, lambda t: replaced(V.CLEAN_CHARACTERS)(unicodedata.normalize("NFC", t))),
    "keys": (T.has_letter_key, lambda t: any(re.search(rf"\b{k}\b", t.upper()) for k in V.LETTER_KEYS)),
    "numbers": (T.is_numeric_coefficient, lambda t: any(re.match(r"\d+[,.]?\d*$", x.strip().replace(" ", "")) for x in t.split("\n"))),
}


@pytest.mark.parametrize("name", CASES)
@given(texts=TEXTS)
@RELAXED
def test_kernel_equals_specification(spark, name, texts):
    both(spark, texts, *CASES[name])


@given(texts=TEXTS)
@RELAXED
def test_normalize_spaces_is_idempotent(spark, texts):
    both(spark, [spaces(t) for t in texts], T.normalize_spaces, lambda t: t)


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("function,text,expect", [
    (T.split_inline_conditions, "- Acte : texte | condition: valeur", "- Acte : texte\n  Condition : valeur"),
    (T.split_inline_conditions, "x |NOTES : a", "x |NOTES : a"),
    (T.remove_markers, "a\n--- Cotations extraites ---\nb", "a\n\nb"),
    (T.remove_gazette_headers, "Sommaire\nx\nDeuxième partie : actes utilisant des radiations ionisantes", "x"),
    (T.remove_gazette_headers, "a 3 mars 2024\n Texte 5 sur 10 b", "a  b"),
    (T.join_broken_lines, "infir-\nmier\nsuite\nFin. x\n1", "infirmier suite Fin. x\n1"),
    (T.normalize_page_text, "a  b\r\n12\n\n\n\nc  ", "a b\n\nc"),
    (T.header_name, "  Désignation  de\nl'acte ", "designation de l'acte"),
    (T.clean_letter_keys, "ami ou\n AMX ;", "AMI ou AMX"),
    (T.normalize_letter_keys, "AMI, AMX ou ou K x", "AMX ou K"),
    (T.pdf_name, "pdf_12_x.pdf", "pdf_12"), (T.pdf_name, "x_pdf_12", None),
    (T.is_billing_document, "famille et coéfficient", True), (T.is_billing_document, "coefficient", False),
    (T.is_pathology_code, " 0123 ", True), (T.is_pathology_code, "123", False),
    (T.priority_label, None, "Non classé"),
    (T.remove_obsolete_articles, "Article 11 - Soins infirmiers à domicile pour un patient, quel que soit son âge x\ny Article 12 - z", "Article 12 - z"),
])
def test_golden(spark, function, text, expect):
    assert one(spark, function, text) == expect


def test_hyphens_and_guarded_sections():
    assert cleaning.join_hyphens("masseur-\nkinésithérapeute infir-\n  mier Saint-\nLary vingt-\ndeux 12-\nx") == "masseur-kinésithérapeute infirmier Saint-Lary vingt-deux 12-x"
    assert cleaning.drop_sections("a Stations thermales Orientations thérapeutiques b CHAPITRE V c") == "a CHAPITRE V c"
    long = "Stations thermales Orientations thérapeutiques " + "x" * 26000
    assert cleaning.drop_sections(long) == long


def test_clean_documents(spark):
    text = "  Sommaire\n“A”\n12\n---\n*\n (Modifié par\nx)\n\nou\n\nacte | condition: y\ninfir-\n\nmier\n--- Cotations extraites ---\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in cleaning.clean_documents(rows).collect()}
    assert got == {1: '"A"\n\nacte\n Condition : y\ninfirmier', 2: None, 3: ""}
