"""The cleaning chain.  Two steps need Python: NFC, which Spark lacks, and the
substitutions that decide match by match; each is one Arrow pass."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions import text as T
from quillstone.functions import vocabulary as V

_hyphen = re.compile(r"(\w+)-\s*\n\s*(\w+)")
_known = {w.lower() for w in V.COMPOUND_WORDS}
_prefixes, _seconds, _numbers = set(V.COMPOUND_PREFIXES), set(V.COMPOUND_SECONDS), set(V.NUMBER_WORDS)
_structural = re.compile(r"\d|[A-Z]{2}")
#: Fixed patterns: sections that are deleted up to an anchor or the end, unless too long.
_sections = [
    ("stations", re.compile(r"Stations\s+thermales\s+Orientations\s+th.rapeutiques.*?(?=CHAPITRE\s+V|TITRE\s+XVI|$)", re.S)),
    ("references", re.compile(r"REFERENCES\s+DES\s+TEXTES\s+REGLEMENTAIRES.*?(?=ANNEXE\s+1|ANNEXE\s+2|$)", re.S)),
    ("bundles", re.compile(r"Tableau\s+2\s*:\s*R.gles\s+de\s+classement\s+des\s+forfaits\s+BSI.*?(?=ANNEXE\s+2|$)", re.S)),
]
_obsolete = re.compile(V.OBSOLETE_ARTICLE, re.S)


def keeps_hyphen(before: str, after: str) -> bool:
    """Whether "before-after" is a compound rather than a word broken at a line end."""
    b, a = before.lower(), after.lower()
    return (
        f"{b}-{a}" in _known or b in _prefixes or a in _seconds or b in _numbers
        or bool(_structural.match(before)) or (before[0].isupper() and after[0].isupper())
    )


def join_hyphens(text: str) -> str:
    return _hyphen.sub(lambda m: m[1] + ("-" if keeps_hyphen(m[1], m[2]) else "") + m[2], text)


def drop_sections(text: str) -> str:
    for name, pattern in _sections:
        text = pattern.sub(lambda m: m[0] if len(m[0]) > V.GUARDS[name] else "", text)  # noqa: B023
    return text


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def fix_hyphenation(texts: pd.Series) -> pd.Series:
    return texts.map(join_hyphens, na_action="ignore")


@F.pandas_udf(StringType())
def remove_sections(texts: pd.Series) -> pd.Series:
    return texts.map(drop_sections, na_action="ignore")


def rewritten(docs: DataFrame, text_col: str, function) -> DataFrame:
    """``docs`` with the texts (an Arrow array) rewritten in one Arrow pass."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:at], function(b.column(at)), *b.columns[at + 1:]], names=names)

    return docs.mapInArrow(run, docs.schema)


def _where(texts: pa.Array, pattern: str, function) -> pa.Array:
    """The function on the texts that match; the others do not become Python strings."""
    texts = texts.cast(pa.string())
    touched = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
    return pc.replace_with_mask(texts, touched, pa.array([function(t) for t in texts.filter(touched).to_pylist()], pa.string()))


def composed(texts: pa.Array) -> pa.Array:
    """NFC; characters under U+0300 are composed as they stand."""
    return _where(texts, r"[^\x{0}-\x{2FF}]", lambda t: unicodedata.normalize("NFC", t))


#: What any text holds that the callback substitutions change.
_TOUCHED = r"-[\s\pZ\x{B}\x{1C}-\x{1F}\x{85}]*\n|Stations|REFERENCES|Tableau|Article"


def substituted(texts: pa.Array) -> pa.Array:
    """Hyphens, the obsolete article and the sections; only texts that hold a sign of them become Python strings."""
    return _where(texts, _TOUCHED, lambda t: drop_sections(_obsolete.sub("", join_hyphens(t))))


def normalize_unicode(c: Column) -> Column:
    return T.clean_characters(nfc(c))


NATIVE_STEPS = (
    T.clean_characters, T.remove_gazette_headers, T.remove_page_numbers, T.remove_separator_lines, T.remove_single_symbol_lines,
    T.strip_line_starts, T.remove_legislative_notes, T.remove_noise_lines, T.split_inline_conditions,
)


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The whole chain in its fixed order: NFC, native steps, hyphens and sections, native rest."""
    out = rewritten(docs, text_col, composed)
    c = F.col(text_col)
    for step in NATIVE_STEPS:
        c = step(c)
    out = rewritten(out.withColumn(text_col, c), text_col, substituted)
    return out.withColumn(text_col, T.normalize_spaces(T.remove_markers(F.col(text_col))))
