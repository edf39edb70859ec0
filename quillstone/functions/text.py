"""Text kernels as column expressions: column in, column out, whole-stage JVM.

Dialect rules kept throughout: ``strip`` removes all Unicode white space (Spark's
``trim`` removes spaces only), line work is done on arrays (``(?m)^`` differs
after a final newline), ``(?U)`` wherever a class must know accents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V

SPACE = r"[\s\x1c-\x1f]"
#: Every character of Unicode white space, and the four separators U+001C to U+001F.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
PREFIX_CHARACTERS = "-•0123456789.) "


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once; chained rewrites would otherwise inline it at every use."""
    return F.element_at(F.transform(F.array(c), body), 1)


def gated(c: Column, needle: str, rewrite) -> Column:
    """``rewrite(c)`` where ``c`` holds ``needle``, which every match contains; else ``c``."""
    return let(c, lambda x: F.when(x.contains(needle), rewrite(x)).otherwise(x))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def lines(c: Column) -> Column:
    """Split at newlines only."""
    return F.split(c, "\n", -1)


def universal_lines(c: Column) -> Column:
    """Split at every line boundary; no line after a final one, none for empty text."""
    return let(F.split(c, LINE_BREAKS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


# --- filters over single lines ---------------------------------------------


def drop_lines(c: Column, condition) -> Column:
    return unlines(F.filter(lines(c), lambda x: ~let(strip(x), condition)))


def _is_gazette_header(s: Column) -> Column:
    out = s.isin(*V.GAZETTE_HEADERS, *V.CHECKBOX_WORDS, V.ANNEX_HEADER)
    for pattern in V.GAZETTE_PATTERNS:
        out = out | s.rlike("(?U)" + pattern)
    return out


def remove_gazette_headers(c: Column) -> Column:
    """Running headers and footers, then the inline "date Texte n sur m" marks."""
    def unmark(x):
        for p in V.GAZETTE_MARKS:
            x = F.regexp_replace(x, "(?U)" + p, "")
        return x

    return gated(drop_lines(c, _is_gazette_header), "Texte", unmark)


def remove_separator_lines(c: Column) -> Column:
    return drop_lines(c, lambda s: s.rlike(r"^[-=_*~]{3,}\z"))


def remove_single_symbol_lines(c: Column) -> Column:
    return drop_lines(c, lambda s: (F.length(s) == 1) & ~s.rlike(r"[\p{L}\p{N}]"))


def strip_line_starts(c: Column) -> Column:
    return unlines(F.transform(lines(c), lambda x: F.regexp_replace(x, r"\A[ \t]+", "")))


# --- filters that look at the neighbouring lines ----------------------------


def filter_lines_in_context(c: Column, drop) -> Column:
    """``drop(stripped, previous stripped, next stripped)`` over the original lines; edges are empty."""

    def pick(raw, stripped):
        n = F.size(stripped)
        before = F.slice(F.concat(F.array(F.lit("")), stripped), F.lit(1), n)
        after = F.concat(F.slice(stripped, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit("")))
        rows = F.arrays_zip(raw.alias("x"), stripped.alias("s"), before.alias("p"), after.alias("n"))
        return unlines(F.transform(F.filter(rows, lambda r: ~drop(r["s"], r["p"], r["n"])), lambda r: r["x"]))

    return let(lines(c), lambda raw: let(F.transform(raw, strip), lambda stripped: pick(raw, stripped)))


def remove_page_numbers(c: Column) -> Column:
    """Page numbers go; a bare number beside a billing hint stays."""

    def drop(s, p, n):
        context = F.concat(p, F.lit(" "), n)
        hinted = F.lit(False)
        for word in V.COTATION_HINTS:
            hinted = hinted | context.contains(word)
        numbered = s.rlike(r"(?U)^[-–]\s*\d+\s*[-–]\z") | s.rlike(r"(?iU)^page\s+\d+") | s.rlike(r"(?U)^\d+\s*/\s*\d+\z")
        return numbered | (s.rlike(r"(?U)^\d{1,4}\z") & ~hinted)

    return filter_lines_in_context(c, drop)


NOISE_LINE = r"(?iuU)^(?:\d{1,2}\.|[a-z°]{1,3}\)|ou|et|ou\s+:|[-–•]\s*|[ivxl]{1,5}\.)\z"


def remove_noise_lines(c: Column) -> Column:
    """Orphan markers go where both neighbours are blank or missing."""
    return filter_lines_in_context(c, lambda s, p, n: (p == "") & (n == "") & s.rlike(NOISE_LINE))


def dedupe_adjacent_lines(c: Column) -> Column:
    """A line equal to the last non-blank line goes; blank lines are transparent."""
    state = "struct<last:string,out:array<string>>"

    def merge(a, x, s):
        same = (s != "") & s.eqNullSafe(a["last"])
        kept = F.struct(F.when(s != "", s).otherwise(a["last"]).alias("last"), F.concat(a["out"], F.array(x)).alias("out")).cast(state)
        return F.when(same, a).otherwise(kept)

    def step(a, x):
        return let(strip(x), lambda s: merge(a, x, s))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().alias("out")).cast(state)
    return strip(F.aggregate(universal_lines(c), start, step, lambda a: unlines(a["out"])))


LEGISLATIVE_START = "(?iuU)" + V.LEGISLATIVE_START


def remove_legislative_notes(c: Column) -> Column:
    """Notes in parentheses go, to the line that closes them or to the end."""
    state = "struct<inside:boolean,out:array<string>>"

    def step(a, x):
        closes, opens = x.contains(")"), x.contains("(") & x.rlike(LEGISLATIVE_START)
        inside = F.when(a["inside"] | opens, ~closes).otherwise(F.lit(False))
        out = F.when(a["inside"] | opens, a["out"]).otherwise(F.concat(a["out"], F.array(x)))
        return F.struct(inside.alias("inside"), out.alias("out")).cast(state)

    start = F.struct(F.lit(False).alias("inside"), F.array().alias("out")).cast(state)
    return F.aggregate(lines(c), start, step, lambda a: unlines(a["out"]))


# --- whole-text rewrites ----------------------------------------------------


def split_inline_conditions(c: Column) -> Column:
    """"... | condition: x" becomes a line of its own, capitalised."""

    def capitalize(x):
        for word in ("conditions", "condition", "remarque", "note"):
            x = F.regexp_replace(x, f"(?i)\n  {word} :", f"\n  {word.capitalize()} :")
        return x

    split = gated(c, "|", lambda x: F.regexp_replace(x, r"(?iuU)\s*\|\s*(conditions?|remarque|note)\s*:", "\n  $1 :"))
    return gated(split, "\n  ", capitalize)


def remove_markers(c: Column) -> Column:
    return gated(c, "Cotations", lambda x: F.regexp_replace(x, r"(?Umd)^---\s*Cotations\s+extraites\s*---\s*$", ""))


def remove_obsolete_articles(c: Column) -> Column:
    return F.regexp_replace(c, "(?sU)" + V.OBSOLETE_ARTICLE, "")


def normalize_spaces(c: Column) -> Column:
    blanks = "".join(x for x in BLANKS if x != "\n")
    out = F.regexp_replace(c, f"[{blanks}]{{2,}}", " ")
    out = gated(out, " \n", lambda x: F.regexp_replace(x, " +\n", "\n"))
    return strip(gated(out, "\n\n\n", lambda x: F.regexp_replace(x, "\n{3,}", "\n\n")))


def replace_characters(c: Column, table: dict[str, str]) -> Column:
    """One-to-one and deleted characters in one pass, longer replacements after it."""
    short = {k: v for k, v in table.items() if len(v) <= 1}
    order = [k for k in short if short[k]] + [k for k in short if not short[k]]
    out = F.translate(c, "".join(order), "".join(short[k] for k in order))
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def ingest_characters(c: Column) -> Column:
    return replace_characters(c, V.INGEST_CHARACTERS)


def clean_characters(c: Column) -> Column:
    """After NFC (see ``operators.cleaning.nfc``)."""
    return replace_characters(c, V.CLEAN_CHARACTERS)


def remove_running_lines(c: Column) -> Column:
    """Version footers, bare numbers of up to three digits and part headers; blank lines become empty."""

    def drop(s):
        return s.rlike(r"(?U)^Version en vigueur du \d{2}/\d{2}/\d{4}\z") | s.rlike(r"(?U)^\d{1,3}\z") | s.rlike(r"(?U)^(?:Première|Deuxième|Troisième|Quatrième)\s+partie\s*[:\-–]")

    kept = F.filter(universal_lines(c), lambda x: ~let(strip(x), drop))
    return unlines(F.transform(kept, lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x)))


def join_broken_lines(c: Column) -> Column:
    """Ingestion: "-" + newline inside a word vanishes; a newline between letters becomes a space."""
    out = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    letters = "a-zàâçéèêëîïôûùüÿñæœ"
    return F.regexp_replace(out, rf"(?iu)([{letters},;])\n([{letters}])", "$1 $2")


def normalize_page_text(c: Column) -> Column:
    """What ingestion does to the raw text of a page."""
    out = join_broken_lines(remove_running_lines(ingest_characters(c)))
    out = unlines(F.transform(lines(out), lambda x: F.regexp_replace(x, r"[ \t]+\z", "")))
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(strip(out))


# --- recognisers ------------------------------------------------------------


def header_name(c: Column) -> Column:
    """Lower case, white space collapsed, eleven accented letters folded."""
    s = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), rf"(?U){SPACE}+", " ")
    return F.translate(s, "éèêàâçùîïô", "eeeaacuiio")


def count_signals(c: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + c.contains(w).cast("int")
    return out


def is_billing_document(c: Column) -> Column:
    return count_signals(F.upper(header_name(c)), V.DOCUMENT_SIGNALS) >= 2


ACT_COUNT = r"(?iuUd)^\s*-\s+.+?:\s*coefficient\s+\d+[,.]?\d*"


def is_act_text(c: Column) -> Column:
    acts = F.size(F.filter(lines(c), lambda x: x.rlike(ACT_COUNT)))
    return F.coalesce((count_signals(F.lower(c), V.ACT_SIGNALS) >= 3) & (acts >= 3), F.lit(False))


def is_condition_line(c: Column) -> Column:
    """A line that states a condition of the act before it."""
    s, out = strip(c), F.lit(False)
    for word in V.CONDITION_LINE_STARTERS:
        out = out | s.startswith(word)
    return F.coalesce(out, F.lit(False))


def is_header_line(c: Column) -> Column:
    """A line that opens a title, chapter, part, section or article."""
    return F.coalesce(strip(c).rlike(r"(?iuU)^(?:(?:TITRE|CHAPITRE|PARTIE|SECTION)\s|Article\b)"), F.lit(False))


def has_letter_key(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike(rf"(?U)\b(?:{'|'.join(V.LETTER_KEYS)})\b"), F.lit(False))


def is_numeric_coefficient(c: Column) -> Column:
    """Some line, without its spaces, is a number."""
    return F.coalesce(F.exists(lines(c), lambda x: F.replace(strip(x), F.lit(" "), F.lit("")).rlike(r"(?U)^\d+[,.]?\d*\z")), F.lit(False))


def is_pathology_code(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"(?U)^0{1,2}\d{2,3}\z"), F.lit(False))


def normalize_letter_keys(c: Column) -> Column:
    """Known codes in upper case and "ou" stay, consecutive repeats collapse."""
    tokens = F.filter(F.split(strip(c), rf"(?U){SPACE}+", -1), lambda t: (F.lower(t) == "ou") | F.upper(t).isin(*V.LETTER_KEYS))
    named = F.transform(tokens, lambda t: F.when(F.lower(t) == "ou", F.lit("ou")).otherwise(F.upper(t)))
    shifted = F.concat(F.array(F.lit("")), named)
    fresh = F.filter(F.arrays_zip(named, F.slice(shifted, F.lit(1), F.size(named))), lambda r: r["0"] != r["1"])
    return F.array_join(F.transform(fresh, lambda r: r["0"]), " ")


def clean_letter_keys(c: Column) -> Column:
    s = strip(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), rf"(?U){SPACE}+", " "))
    return normalize_letter_keys(strip(F.regexp_replace(s, r"[;,:\-–—]+\z", "")))


def open_code(c: Column) -> Column:
    """The end of a line whose code goes on elsewhere ("... lettre clé AMI ou"), or null."""
    return F.nullif(F.regexp_extract(c, r"(?iuU)(lettre clé\s+[A-Z]{1,4}\s+ou(?:\s+[A-Z]{1,4}\s+ou)*)\s*\z", 1), F.lit(""))


def pdf_name(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?U)^(pdf_\d+)", 1), F.lit(""))


def reply_lines(reply: Column, question: Column) -> Column:
    """Sub-queries of a chat reply: long enough lines without their bullets; the question if there are none."""
    kept = F.filter(F.split(reply, "\n", -1), lambda x: F.length(strip(x)) > 10)
    parsed = F.transform(kept, lambda x: F.ltrim(strip(x), F.lit(PREFIX_CHARACTERS)))
    return F.when(F.size(parsed) > 0, parsed).otherwise(F.array(question))


def rewritten_question(reply: Column, question: Column) -> Column:
    """The first line of a chat reply without its bullet; the question if nothing is left."""
    first = F.ltrim(strip(F.get(F.split(strip(reply), "\n", -1), F.lit(0))), F.lit(PREFIX_CHARACTERS))
    return F.coalesce(F.nullif(first, F.lit("")), question)


def priority_label(c: Column) -> Column:
    out = F.when(c.isNull() | (c == 0), F.lit(V.NO_LABEL))
    for k, v in V.PRIORITY_LABELS.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(V.UNKNOWN_LABEL))
