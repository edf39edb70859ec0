"""Table grids: roles of columns, kinds of tables, billing lines, and the page fold.

Row-wise formats are native.  What depends on the order of rows or pages is a
fold in Python: per grid in an Arrow UDF, per document in ``fold_pages``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillstone.functions import text as T
from quillstone.functions import vocabulary as V

# --- native -----------------------------------------------------------------


def cell(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit("")))


def outside_boxes(objects: DataFrame, boxes: DataFrame, keys: list[str], margin: float = 2.0) -> DataFrame:
    """Objects that lie in no box of their page, boxes grown by ``margin``: an anti-join on the page key."""
    o, b = objects.alias("o"), boxes.alias("b")
    inside = (
        (F.col("o.x0") >= F.col("b.x0") - margin) & (F.col("o.top") >= F.col("b.top") - margin)
        & (F.col("o.x1") <= F.col("b.x1") + margin) & (F.col("o.bottom") <= F.col("b.bottom") + margin))
    for k in keys:
        inside = inside & (F.col(f"o.{k}") == F.col(f"b.{k}"))
    return o.join(b, inside, "left_anti")


def text_outside(objects: Column, boxes: Column, margin: float = 2.0) -> Column:
    """The words of a page that lie in no box (grown by ``margin``), line by line: words
    whose tops are within 3 points of the line's first share it."""
    within = lambda o, b: (o["x0"] >= b["x0"] - margin) & (o["top"] >= b["top"] - margin) & (o["x1"] <= b["x1"] + margin) & (o["bottom"] <= b["bottom"] + margin)
    kept = F.filter(objects, lambda o: ~F.exists(boxes, lambda b: within(o, b)))
    placed = F.array_sort(F.transform(kept, lambda o: F.struct(o["top"].alias("top"), o["x0"].alias("x0"), o["text"].alias("text"))))
    kind = "struct<lines:array<array<struct<x0:double,text:string>>>,top:double>"

    def step(acc, o):
        word, n = F.array(F.struct(o["x0"].alias("x0"), o["text"].alias("text"))), F.size(acc["lines"])
        new = F.struct(F.concat(acc["lines"], F.array(word)).alias("lines"), o["top"].alias("top")).cast(kind)
        longer = F.concat(F.slice(acc["lines"], F.lit(1), n - 1), F.array(F.concat(F.element_at(acc["lines"], -1), word)))
        return F.when((n > 0) & (o["top"] - acc["top"] <= 3.0), F.struct(longer.alias("lines"), acc["top"].alias("top")).cast(kind)).otherwise(new)

    lines = F.aggregate(placed, F.struct(F.array().alias("lines"), F.lit(0.0).alias("top")).cast(kind), step, lambda a: a["lines"])
    return F.array_join(F.transform(lines, lambda words: F.array_join(F.transform(F.array_sort(words), lambda w: w["text"]), " ")), "\n")


def pathology_lines(grid: Column) -> Column:
    at = lambda r, i: cell(F.get(r, F.lit(i)))
    rows = F.filter(grid, lambda r: (F.size(r) >= 4) & T.is_pathology_code(at(r, 0)) & T.is_numeric_coefficient(at(r, 3)))

    def line(r):
        name = F.replace(at(r, 1), F.lit("\n"), F.lit(" "))
        short = F.when(F.length(name) > 200, F.concat(F.left(name, F.lit(200)), F.lit("…"))).otherwise(name)
        return F.concat(F.lit("- Acte "), at(r, 0), F.lit(" : "), short, F.lit(" — coefficient P "), at(r, 3))

    return F.transform(rows, line)


def spa_lines(grid: Column) -> Column:
    at = lambda r, i: F.replace(cell(F.get(r, F.lit(i))), F.lit("\n"), F.lit(" "))
    rows = F.filter(grid, lambda r: (F.size(r) >= 2) & (at(r, 0) != "") & F.lower(at(r, 1)).contains("séance"))
    return F.transform(rows, lambda r: F.concat(F.lit("- "), at(r, 0), F.lit(" : honoraires "), at(r, 1)))


def role_scores(grids: DataFrame, key: str, grid_col: str) -> DataFrame:
    """Per column, how many of the first ten cells look like a coefficient, a code, or text.

    Each row's grid is scored where it stands; ``key`` is unique, so nothing is shuffled."""
    top = F.slice(grid_col, F.lit(1), F.lit(10))
    code = lambda v, yes, no: F.when(T.has_letter_key(v), yes).otherwise(no)
    kind = lambda v: F.when(T.is_numeric_coefficient(v), code(v, "both", "number")).otherwise(code(v, "code", F.when(v != "", "text")))
    kinds = F.transform(top, lambda r: F.transform(r, lambda c: kind(cell(c))))
    width = F.coalesce(F.array_max(F.transform("_k", lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))
    column = grids.select(key, kinds.alias("_k")).select(key, "_k", F.explode(F.when(width > 0, F.sequence(F.lit(0), width - 1))).alias("col"))
    have = column.select(key, "col", F.filter("_k", lambda r: F.size(r) > F.col("col")).alias("_k"))
    count = lambda *names: F.size(F.filter("_k", lambda r: F.get(r, F.col("col")).isin(*names))).cast("long")
    return have.select(key, "col", count("number", "both").alias("coeff_score"), count("code", "both").alias("lk_score"), count("text").alias("text_score"))


# --- recognisers for the folds ----------------------------------------------

_keys = set(V.LETTER_KEYS)
_key_word = re.compile(r"\b(?:" + "|".join(V.LETTER_KEYS) + r")\b")
_number = re.compile(r"\d+[,.]?\d*$")
_code = re.compile(r"0{1,2}\d{2,3}$")
_open_key = re.compile(r"[A-Z]{1,4}\s+OU$")
_open_suffix = re.compile(r"(lettre clé\s+(?:[A-Z]{1,4}\s+ou(?:\s+[A-Z]{1,4}\s+ou)*))\s*$", re.I)
_part_header = re.compile(r"(?:Première|Deuxième|Troisième|Quatrième)\s+partie\s*[:\-–]")
_folded = str.maketrans("éèêàâçùîïô", "eeeaacuiio")

ROLES = ("designation", "coefficient", "lettre_cle")
DEFAULT_ROLES = {"designation": 0, "coefficient": 1, "lettre_cle": 2, "header_row": None}


def clean_cell(value: str | None) -> str:
    return "" if value is None else str(value).strip()


def cell_at(row: list, i: int) -> str:
    return clean_cell(row[i]) if row and i < len(row) else ""


@lru_cache(1 << 14)
def has_key(s: str) -> bool:
    return bool(_key_word.search(s.upper()))


@lru_cache(1 << 14)
def coefficients(s: str) -> tuple[str, ...]:
    """The numeric lines of a cell, inner spaces removed."""
    squeezed = (line.strip().replace(" ", "") for line in s.split("\n"))
    return tuple(x for x in squeezed if _number.match(x))


def tidy_keys(s: str) -> str:
    """Known codes and "ou", repeats collapsed."""
    s = re.sub(r"[;,:\-–—]+$", "", " ".join(s.split())).strip()
    out: list[str] = []
    for token in s.split():
        token = "ou" if token.lower() == "ou" else token.upper()
        if (token == "ou" or token in _keys) and out[-1:] != [token]:
            out.append(token)
    return " ".join(out)


@lru_cache(1 << 14)
def folded(s: str | None) -> str:
    return " ".join(clean_cell(s).lower().split()).translate(_folded)


@lru_cache(1 << 14)
def header_role(s: str | None) -> str | None:
    """The role that a header cell names."""
    t = folded(s)
    if len(t) <= 60 and ("designation" in t or "libelle" in t):
        return "designation"
    if len(t) < 30 and ("coefficient" in t or t.startswith("coeff")):
        return "coefficient"
    return "lettre_cle" if len(t) <= 30 and ("lettre" in t or "cle" in t) else None


def infer_roles(grid: list, inherited: dict | None = None) -> dict:
    """Column of each role: from a header in the first three rows, else inherited, else
    the columns with the most numbers, codes and text (the first wins ties)."""
    rows = [r for r in grid if r]
    if not grid:
        return dict(inherited or DEFAULT_ROLES)
    if not rows:
        raise ValueError("a table without cells")
    for i, row in enumerate(grid[:3]):
        named = {role: c for c, x in enumerate(row or []) if (role := header_role(x))}
        if named:
            return {**DEFAULT_ROLES, **named, "header_row": i}
    if inherited:
        return {**DEFAULT_ROLES, **{r: inherited[r] for r in ROLES if r in inherited}, "header_row": None}
    width, top = max(map(len, rows)), grid[:10]
    column = lambda c: [cell_at(r, c) for r in top]
    numbers = [sum(bool(coefficients(v)) for v in column(c)) for c in range(width)]
    codes = [sum(has_key(v) for v in column(c)) for c in range(width)]
    texts = [sum(bool(v) and not coefficients(v) and not has_key(v) for v in column(c)) for c in range(width)]
    number, code = numbers.index(max(numbers)), codes.index(max(codes))
    free = [c for c in range(width) if c not in (number, code)]
    return {"designation": max(free, key=lambda c: (texts[c], -c)) if free else 0, "coefficient": number, "lettre_cle": code, "header_row": None}


def kind_of(grid: list, inherited: dict | None = None) -> str:
    """ignore, anatpath, thermal or cotation_ngap; the first that applies."""
    rows = [r for r in grid or [] if r]
    if not rows:
        return "ignore"
    head = " ".join(clean_cell(c).lower() for r in grid[:3] for c in r or [])
    if any(w in head for w in V.EXCLUDED_TABLE_WORDS):
        return "ignore"
    if any(len(r) >= 4 and _code.match(cell_at(r, 0)) and coefficients(cell_at(r, 3)) for r in rows):
        return "anatpath"
    if any("maximum de" in cell_at(r, 1).lower() and "séance" in cell_at(r, 1).lower() for r in rows):
        return "thermal"
    roles = infer_roles(grid, inherited)
    if any(coefficients(cell_at(r, roles["coefficient"])) and has_key(cell_at(r, roles["lettre_cle"])) for r in rows):
        return "cotation_ngap"
    if any(any(coefficients(clean_cell(c)) for c in r) and any(has_key(clean_cell(c)) for c in r) for r in rows):
        return "cotation_ngap"
    if inherited is not None and any(coefficients(cell_at(r, inherited.get("coefficient", 1))) for r in rows):
        return "cotation_ngap"
    return "ignore"


# --- billing tables ---------------------------------------------------------


@dataclass
class Row:
    designation: str
    coefficient: str
    key: str


def _filled(s: str) -> list[str]:
    return [x.strip() for x in s.split("\n") if x.strip()]


def _starts(s: str, words) -> bool:
    return s.startswith(tuple(words))


def join_continuations(parts: list[str]) -> list[str]:
    """A line that goes on from the one before is appended to it."""
    out: list[str] = []
    for p in parts:
        if out and p and (p[0].islower() or _starts(p, V.CONTINUATION_STARTERS)):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def acts_first(parts: list[str], n: int) -> list[str]:
    """Acts before conditions where that leaves ``n`` acts; else as they stand."""
    is_condition = lambda p: _starts(p, V.CONDITION_STARTERS) or (len(p) > 250 and "coefficient" not in p.lower())
    acts = [p for p in parts if not is_condition(p)]
    return acts + [p for p in parts if is_condition(p)] if len(acts) == n else parts


@dataclass
class BillingTable:
    """One billing table, read top to bottom."""

    grid: list
    inherited: dict | None = None
    lines: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.roles = infer_roles(self.grid, self.inherited)
        self.rows = [Row(*(cell_at(r, self.roles[k]) for k in ROLES)) if r else None for r in self.grid]
        self._gather_split_keys()
        self.packed_keys = self._packed_keys()
        self.packed_names = self._packed_names()
        self.key_at = self.name_at = 0
        self.last_name = ""

    def _gather_split_keys(self):
        """A priced row takes the codes of the rows below it that have no price."""
        for i, row in enumerate(self.rows):
            if not (row and row.designation and row.key and coefficients(row.coefficient)):
                continue
            parts = [row.key]
            for below in self.rows[i + 1:]:
                key = below.key.upper() if below else ""
                if not below or coefficients(below.coefficient) or not (key in _keys or _open_key.match(key) or has_key(key)):
                    break
                parts.append(below.key)
                below.key = ""
            row.key = " ".join(" ".join(parts).split())

    def _packed_keys(self) -> list[str]:
        """Codes stacked in the code cell of the first two rows."""
        if not self.grid or not self.grid[0]:
            return []
        for row in self.rows[:2]:
            if not row or not row.key:
                continue
            stacked = [x for x in _filled(row.key) if has_key(x) and not any(w in x.lower() for w in ("lettre", "désignation", "coefficient"))]
            if len(stacked) >= (1 if "lettre" in row.key.lower() else 2):
                return stacked
        return []

    def _packed_names(self) -> list[str]:
        """Designations stacked in the header cell."""
        head = self.rows[0] if self.rows else None
        parts = _filled(head.designation) if head else []
        if len(parts) < 2:
            return []
        titled = "designation" in folded(parts[0])
        if not titled and "coefficient" not in folded(head.coefficient):
            return []
        merged = join_continuations(parts[titled:])
        n = sum(bool(r and coefficients(r.coefficient)) for r in self.rows[1:])
        return merged if len(merged) <= n else acts_first(merged, n)

    def _key(self, own: list[str], i: int) -> str:
        """The row's own code, else the packed one, else the row's first usable one."""
        choices = own[i:i + 1] + self.packed_keys[self.key_at:self.key_at + 1] + own
        self.key_at += 1
        return next((tidy_keys(k) for k in choices if has_key(k)), "")

    def _emit(self, name: str, coefficient: str, key: str):
        self.lines.append(f"- {name} : coefficient {coefficient}" + (f", lettre clé {key}" if key else ""))

    def _unpriced(self, row: Row):
        text = row.designation.replace("\n", " ").strip()
        if len([x for x in _filled(row.key) if has_key(x)]) > 1:
            self.key_at += 1
        if len(text) <= 10:
            return
        if self.lines and _starts(text, [*V.CONDITION_STARTERS, V.CONTEXT_STARTER]):
            self.lines[-1] += f" | condition: {text}"
        elif self.lines and text[0].islower():
            self.lines[-1] += " " + text
        else:
            self.lines.append(text)

    def _priced(self, row: Row, prices: tuple[str, ...]):
        own, name = _filled(row.key), row.designation.replace("\n", " ").strip()
        if "designation" in folded(name):
            name = ""
        if not name and self.name_at < len(self.packed_names):
            name = self.packed_names[self.name_at]
            self.name_at += 1
        elif not name and self.last_name:
            for i, price in enumerate(prices):
                self._emit(f"{self.last_name} (variante)", price, self._key(own, i))
            return
        name = name or "(acte sans libellé extrait)"
        if len(prices) == 1:
            key = self._key(own, 0)
            self._emit(name, prices[0], tidy_keys(row.key) if len(own) > 1 else key)
            self.last_name = name
            return
        stacked = _filled(row.designation)
        short = [x for x in stacked if len(x) < 150]
        for i, price in enumerate(prices):
            if len(short) >= len(prices):
                self.last_name = short[len(short) - len(prices) + i]
            else:
                self.last_name = stacked[i] if i < len(stacked) else name
            self._emit(self.last_name, price, self._key(own, i))

    def format(self) -> list[str]:
        first = 0 if self.roles["header_row"] is None else self.roles["header_row"] + 1
        for row in self.rows[first:]:
            if row:
                prices = coefficients(row.coefficient)
                self._priced(row, prices) if prices else self._unpriced(row)
        return self.lines


def pathology(grid: list) -> list[str]:
    out = []
    for r in grid:
        if r and len(r) >= 4 and _code.match(cell_at(r, 0)) and coefficients(cell_at(r, 3)):
            name = cell_at(r, 1).replace("\n", " ")
            out.append(f"- Acte {cell_at(r, 0)} : {name[:200] + '…' if len(name) > 200 else name} — coefficient P {cell_at(r, 3)}")
    return out


def spa(grid: list) -> list[str]:
    pairs = [(cell_at(r, 0).replace("\n", " "), cell_at(r, 1).replace("\n", " ")) for r in grid if r and len(r) >= 2]
    return [f"- {a} : honoraires {b}" for a, b in pairs if a and "séance" in b.lower()]


# --- pages ------------------------------------------------------------------


def leading_key(grids: list, inherited: dict | None) -> str:
    """A code that opens the page's first table and belongs to the page before."""
    first = grids[0][0] if grids and grids[0] else None
    if inherited is None or not first:
        return ""
    row = Row(*(cell_at(first, inherited.get(k, DEFAULT_ROLES[k])) for k in ROLES))
    goes_on = not row.designation or row.designation[0].islower()
    return tidy_keys(row.key) if goes_on and not coefficients(row.coefficient) and has_key(row.key) else ""


def without_repeats(text: str) -> str:
    """A line equal to the last non-blank one goes."""
    out, last = [], None
    for line in text.splitlines():
        s = line.strip()
        if not s or s != last:
            out.append(line)
        last = s or last
    return "\n".join(out).strip()


def page_text(raw: str, grids: list, inherited: dict | None) -> tuple[str, dict | None]:
    """The page's text and formatted tables, and the roles that the next page inherits."""
    parts, roles = [], inherited
    for grid in grids:
        kind = kind_of(grid, roles)
        if kind == "cotation_ngap":
            billing = BillingTable(grid, roles)
            lines, roles = billing.format(), billing.roles
        else:
            lines = pathology(grid) if kind == "anatpath" else spa(grid) if kind == "thermal" else []
        if lines:
            parts.append("\n".join(lines))
    whole = [raw] + ([V.MARKER, *parts] if parts else [])
    return without_repeats("\n\n".join(p for p in whole if p.strip())), roles


def append_key(page: str, key: str) -> str:
    """Adds an orphan code to the page's last line with a code."""
    head, mark, tail = _last_line_with(page, "lettre clé")
    return f"{head}{mark.rstrip()} {key}{tail}" if mark else page


def _last_line_with(text: str, word: str) -> tuple[str, str, str]:
    """What stands before the last line that holds the word, that line, and what follows; normal line ends."""
    lines = text.splitlines()
    held = [i for i, x in enumerate(lines) if word in x.lower()]
    if not held:
        return "\n".join(lines), "", ""
    before, after = lines[:held[-1]], lines[held[-1] + 1:]
    return "".join(x + "\n" for x in before), lines[held[-1]], "".join("\n" + x for x in after)


_goes_on = re.compile(rf"(?:{'|'.join(sorted(V.LETTER_KEYS))}|[A-Z]{{1,4}}\s+OU)")


def join_boundary(before: str, after: str) -> tuple[str, str]:
    """Moves a code that completes the last line of a page back to it."""
    useful = [(i, x.strip()) for i, x in enumerate(after.splitlines()) if x.strip() and not _part_header.match(x.strip())]
    body = "\n".join(before.splitlines()).rstrip()
    open_line = body.rpartition("\n")[2]
    if not useful or not _open_suffix.search(open_line) or not _goes_on.fullmatch(useful[0][1].upper()):
        return before, after
    at, code = useful[0]
    rest = ["" if i == at else x for i, x in enumerate(after.splitlines())]
    return f"{body} {code}".strip(), "\n".join(rest).strip()


def fold_document(pages: list[tuple[str, list]], mode: str) -> str:
    """The text of a document from its pages in order."""
    if mode == "generic":
        made = [without_repeats(raw) for raw, _ in pages]
        return "\n\n".join(p for p in made if p).strip()
    done: list[str] = []
    roles = None
    for raw, grids in pages:
        key = leading_key(grids, roles)
        text, roles = page_text(raw, grids, roles)
        if key and done:
            done[-1] = append_key(done[-1], key)
        if text and done:
            done[-1], text = join_boundary(done[-1], text)
            done.append(text)
        elif text:
            done.append(text)
    return "\n\n".join(p for i, p in enumerate(done) if p.strip() or i < len(done) - 1).strip()


@F.arrow_udf(ArrayType(StringType()))
def classify(tables: pa.Array) -> pa.Array:
    """Kind of every table of a page; roles are not inherited from other pages."""
    return pa.array([[kind_of(g or []) for g in x or []] for x in tables.to_pylist()], pa.list_(pa.string()))


_ROLES = ArrayType(StructType([StructField(k, IntegerType()) for k in (*ROLES, "header_row")]))


@F.arrow_udf(_ROLES)
def roles(tables: pa.Array) -> pa.Array:
    """Columns of the roles in every table of a page; null for tables without cells."""
    kind = pa.list_(pa.struct([(k, pa.int32()) for k in (*ROLES, "header_row")]))
    return pa.array([[infer_roles(g) if any(g or []) else None for g in x or []] for x in tables.to_pylist()], kind)


@F.arrow_udf(StringType())
def leading_code(tables: pa.Array) -> pa.Array:
    """The code that opens a page's first table and belongs to the page before, by the default roles."""
    return pa.array([leading_key([g or [] for g in x or []], DEFAULT_ROLES) for x in tables.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def format_billing(tables: pa.Array) -> pa.Array:
    """Billing lines of all tables of a page."""
    return pa.array([[line for g in x or [] if g for line in BillingTable(g).format()] for x in tables.to_pylist()], pa.list_(pa.string()))


def document_mode(pages: DataFrame, sample: int = 3) -> DataFrame:
    """doc_id, mode: from the text of the first ``sample`` pages."""
    head = pages.where(F.col("page_no") <= sample)  # pages count from 1
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return head.groupBy("doc_id").agg(F.when(T.is_billing_document(joined), F.lit("ngap")).otherwise(F.lit("generic")).alias("mode"))


def fold_pages(pages: DataFrame, mode: str | Column = "ngap") -> DataFrame:
    """doc_id, text, error, from (doc_id, page_no, text, tables); ``mode`` may be a column,
    equal on all pages of a document.  A document whose fold fails keeps its message in
    ``error``; the others are not touched.

    Pages are dealt and sorted by document and folded as a stream: a task holds one
    document's pages at a time."""
    result = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def fold(doc, own):
        try:
            return doc, fold_document([(t or "", [g or [] for g in x or []]) for t, x, _ in own], own[0][2]), None
        except Exception as e:  # noqa: BLE001  isolation per document
            return doc, None, f"{type(e).__name__}: {e}"

    def run(batches):
        doc, own = None, []
        for b in batches:
            done = []
            for d, t, x, m in zip(*[b.column(i).to_pylist() for i in (0, 2, 3, 4)]):
                if own and d != doc:
                    done.append(fold(doc, own))
                    own = []
                doc = d
                own.append((t, x, m))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*done)) or [[]] * 3, result)], schema=result)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(fold(doc, own), result)], schema=result)

    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    how = F.lit(mode) if isinstance(mode, str) else mode
    rows = pages.select("doc_id", "page_no", "text", "tables", how.alias("mode")).repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "page_no")
    return rows.mapInArrow(run, "doc_id long, text string, error string")
