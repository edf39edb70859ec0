"""DuckDB twins of the queries whose steps depend on one another: the cleaning chain,
structural chunks, and tables with pages."""

from __future__ import annotations

from quillstone.functions import vocabulary as V
from quillstone.operators import chunking

N = "chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DIGEST = "select doc_id, length(t)::bigint as n, md5(t) as h"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- the cleaning chain: a step reads doc_id and t of the one before ---------


def rewrite(name: str, before: str, expression: str) -> str:
    return f"{name} as (select doc_id, {expression} as t from {before})"


def drop(name: str, before: str, condition: str) -> str:
    """Lines go where the condition holds of s, the stripped line, and of p and n, its stripped neighbours."""
    return f"""{name}_l as (select doc_id, unnest(string_split(t, {N})) as x, unnest(range(0, len(string_split(t, {N})))) as i from {before}),
{name}_s as (select *, trim(x, {WS}) as s from {name}_l),
{name}_k as (select *, coalesce(lag(s) over w, '') as p, coalesce(lead(s) over w, '') as n from {name}_s window w as (partition by doc_id order by i)),
{name} as (select doc_id, coalesce(string_agg(x, {N} order by i) filter (where not ({condition})), '') as t from {name}_k group by doc_id)"""


_OPENS = r"regexp_matches(l[i + 1], '(?i)^\s*\((modifi[eé]|cr[eé]{1,2}|abrog[eé])')"


def notes(name: str, before: str) -> str:
    return f"""{name}_d as (select doc_id, string_split(t, {N}) as l from {before}),
{name}_f(doc_id, i, inside, kept) as (
  select doc_id, 0, false, []::varchar[] from {name}_d
  union all
  select f.doc_id, i + 1, case when inside or {_OPENS} then not contains(l[i + 1], ')') else false end, case when inside or {_OPENS} then kept else list_append(kept, l[i + 1]) end
  from {name}_f f join {name}_d using (doc_id) where i < len(l)),
{name} as (select doc_id, array_to_string(arg_max(kept, i), {N}) as t from {name}_f group by doc_id)"""


def characters(table: dict[str, str]) -> str:
    kept, gone = [k for k in table if table[k]], [k for k in table if not table[k]]
    return f"translate(t, '{''.join(kept + gone)}', '{''.join(table[k] for k in kept).replace(chr(39), chr(39) * 2)}')"


_WORD = r"[\pL\pN_]+"
_BREAK = rf"'({_WORD})-\s*\n\s*({_WORD})'"
_KEEPS = rf"""(lower(b[i]) || '-' || lower(a[i]) in ({quoted(w.lower() for w in V.COMPOUND_WORDS)}) or lower(b[i]) in ({quoted(V.COMPOUND_PREFIXES + V.NUMBER_WORDS)})
 or lower(a[i]) in ({quoted(V.COMPOUND_SECONDS)}) or regexp_matches(b[i], '^(\d|[A-Z]{{2}})') or (regexp_matches(b[i], '^\p{{Lu}}') and regexp_matches(a[i], '^\p{{Lu}}')))"""


def hyphens(name: str, before: str) -> str:
    return f"""{name}_m as (select doc_id, string_split_regex(t, {_BREAK}) as g, regexp_extract_all(t, {_BREAK}, 1) as b, regexp_extract_all(t, {_BREAK}, 2) as a from {before}),
{name} as (select doc_id, array_to_string([g[i] || b[i] || case when {_KEEPS} then '-' else '' end || a[i] for i in range(1, len(b) + 1)], '') || g[len(b) + 1] as t from {name}_m)"""


#: What opens a section, what ends it, and the longest that goes.
_SECTIONS = [
    (r"Stations\s+thermales\s+Orientations\s+th.rapeutiques", r"CHAPITRE\s+V|TITRE\s+XVI", V.GUARDS["stations"]),
    (r"REFERENCES\s+DES\s+TEXTES\s+REGLEMENTAIRES", r"ANNEXE\s+1|ANNEXE\s+2", V.GUARDS["references"]),
    (r"Tableau\s+2\s*:\s*R.gles\s+de\s+classement\s+des\s+forfaits\s+BSI", r"ANNEXE\s+2", V.GUARDS["bundles"]),
]


def sections(name: str, before: str) -> str:
    """The first section of each kind; no text here has two."""
    out = []
    for k, (opens, ends, most) in enumerate(_SECTIONS):
        found = rf"regexp_extract(t, '(?s)({opens}.*?)(?:{ends}|\n?\z)', 1)"
        out.append(rewrite(f"{name}{k}", before, f"case when length({found}) between 1 and {most} then replace(t, {found}, '') else t end"))
        before = f"{name}{k}"
    return ",\n".join(out)


_HINTS = " or ".join(f"contains(p || ' ' || n, '{w}')" for w in V.COTATION_HINTS)
GAZETTE = rf"""s in ({quoted([*V.GAZETTE_HEADERS, *V.CHECKBOX_WORDS, V.ANNEX_HEADER])}) or regexp_matches(s, '^Version\s+en\s+vigueur\s+du\s+\d{{2}}/\d{{2}}/\d{{4}}\s*$')
 or regexp_matches(s, '(?i)^premi.re\s+partie\s*:?\s*dispositions\s+g.n.rales\s*$') or regexp_matches(s, '(?i)^deuxi.me\s+partie\s*:?.*radiations\s+ionisantes\s*$')
 or regexp_matches(s, '(?i)^cinqui.me\s+partie\s*:?.*biologie\s+m.dicale\s*$')"""
_CONDITIONS = r"regexp_replace(t, '(?i)\s*\|\s*(conditions?|remarque|note)\s*:', chr(10) || '  \1 :', 'g')"
for _w in ("conditions", "condition", "remarque", "note"):
    _CONDITIONS = rf"regexp_replace({_CONDITIONS}, '(?i)\n  {_w} :', chr(10) || '  {_w.capitalize()} :', 'g')"
_ARTICLE = r"regexp_replace(t, '(?s)Article\s+11\s*[-–—]\s*Soins\s+infirmiers\s+.{0,5}domicile\s+pour\s+un\s+patient,\s+quel\s+que\s+soit\s+son\s+.ge.*?(Article\s+12\s*[-–—])', '\1', 'g')"
_MARKS = r"t"
for _p in (r"\d{1,2}\s+[\w\pL]+\s+\d{4}\s+Texte\s+\d+\s+sur\s+\d+", r"(?m)^Texte\s+\d+\s+sur\s+\d+\s*$"):
    _MARKS = f"regexp_replace({_MARKS}, '{_p}', '', 'g')"


def cleaned(source: str) -> str:
    """The whole chain over ``source``, the SQL of doc_id and t."""
    steps = [
        f"d as ({source})",
        rewrite("c1", "d", "nfc_normalize(t)"), rewrite("c2", "c1", characters(V.CLEAN_CHARACTERS)),
        drop("c3", "c2", GAZETTE), rewrite("c4", "c3", _MARKS),
        drop("c5", "c4", rf"regexp_matches(s, '^[-–]\s*\d+\s*[-–]$') or regexp_matches(s, '(?i)^page\s+\d+') or regexp_matches(s, '^\d+\s*/\s*\d+$') or (regexp_matches(s, '^\d{{1,4}}$') and not ({_HINTS}))"),
        drop("c6", "c5", "length(s) >= 3 and translate(s, '-=_*~', '') = ''"),
        drop("c7", "c6", r"length(s) = 1 and not regexp_matches(s, '[\pL\pN]')"),
        rewrite("c8", "c7", f"array_to_string([ltrim(x, ' ' || chr(9)) for x in string_split(t, {N})], {N})"),
        notes("c9", "c8"),
        drop("c10", "c9", r"p = '' and n = '' and regexp_matches(s, '(?i)^(\d{1,2}\.|[a-z°]{1,3}\)|ou|et|ou\s+:|[-–•]\s*|[ivxl]{1,5}\.)$')"),
        rewrite("c11", "c10", _CONDITIONS), hyphens("c12", "c11"), rewrite("c13", "c12", _ARTICLE), sections("c14_", "c13"),
        rewrite("c15", "c14_2", rf"array_to_string([case when regexp_matches(x, '^---\s*Cotations\s+extraites\s*---\s*$') then '' else x end for x in string_split(t, {N})], {N})"),
        rewrite("c16", "c15", rf"trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\v]{{2,}}', ' ', 'g'), ' +\n', {N}, 'g'), '\n{{3,}}', {N} || {N}, 'g'), {WS})"),
    ]
    return "with recursive " + ",\n".join(steps) + "\nselect doc_id, t as text from c16"


def page_normalized(source: str) -> str:
    """What ingestion does to a page's text."""
    text = f"translate(t, '{''.join(k for k, v in V.INGEST_CHARACTERS.items() if v == ' ')}', '    ')".replace("'    ')", "'" + " " * sum(v == " " for v in V.INGEST_CHARACTERS.values()) + "')")
    for k, v in V.INGEST_CHARACTERS.items():
        if v != " ":
            text = f"replace({text}, chr({ord(k)}), {'chr(10)' if v == chr(10) else chr(39) + v + chr(39)})"
    letters = "a-zàâçéèêëîïôûùüÿñæœ"
    return "with " + ",\n".join([
        f"d as ({source})", rewrite("c1", "d", text),
        drop("c2", "c1", r"regexp_matches(s, '^Version en vigueur du \d{2}/\d{2}/\d{4}$') or regexp_matches(s, '^\d{1,3}$') or regexp_matches(s, '^(Première|Deuxième|Troisième|Quatrième)\s+partie\s*[:\-–]')").replace(f"string_agg(x, {N}", f"string_agg(case when s = '' then '' else x end, {N}"),
        rewrite("c3", "c2", rf"regexp_replace(regexp_replace(t, '([\w\pL])-\n([\w\pL])', '\1\2', 'g'), '(?i)([{letters},;])\n([{letters}])', '\1 \2', 'g')"),
        rewrite("c4", "c3", f"array_to_string([rtrim(x, ' ' || chr(9)) for x in string_split(t, {N})], {N})"),
        rewrite("c5", "c4", rf"trim(regexp_replace(regexp_replace(t, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', {N} || {N}, 'g'), {WS})")]) + f" {DIGEST} from c5"


# --- structural chunks --------------------------------------------------------


def windows(text: str, size: int, overlap: int) -> str:
    step = size - overlap
    cut = f"[trim(substr({text}, (j * {step} + 1)::int, {size}), {WS}) for j in range(0, ((length({text}) + {step} - 1) // {step})::int)]"
    return f"list_filter({cut}, lambda y: length(y) >= {chunking.LEAST})"


def _heading(s: str) -> str:
    return rf"(length(trim({s}, {WS})) < 120 and (regexp_matches({s}, '(?i)^\s*(TITRE|CHAPITRE|PARTIE|SECTION|ANNEXE)\s+') or (regexp_matches({s}, '^\s*Art(icle)?\.?\s+\d+') and not contains(trim({s}, {WS}), {N}))))"


_TAKES = f"(m.open <> '' and ({_heading('m.open')} or (length(s.s) < LEAST and not {_heading('s.s')})))".replace("{", "{{").replace("}", "}}").replace("LEAST", "{least}")
_STARTS = "|".join(chunking.SECTION_STARTS).replace("(?:", "(").replace("'", "''")
_ACT = r"'(?i)^\s*-\s+.+?:\s*coefficient\s+\d+[,.]?\d*(,\s*lettre clé\s+.+)?\s*$'"
_ACTS = f"((" + " + ".join(f"contains(lower(t), '{w}')::int" for w in V.ACT_SIGNALS) + rf") >= 3 and len([x for x in string_split(t, {N}) if regexp_matches(x, '(?i)^\s*-\s+.+?:\s*coefficient\s+\d+')]) >= 3)"


def chunked(source: str, least: int = 100, most: int = 1500, size: int = 800, overlap: int = 150) -> str:
    """Structural chunks of ``source``, the SQL of doc_id and t: by act where a text has acts, else by section."""
    return rf"""with recursive d as (select *, {_ACTS} as acts from ({source})),
l as (select doc_id, acts, i, x from (select doc_id, acts, unnest(string_split(t, {N})) as x, unnest(range(0, len(string_split(t, {N})))) as i from d)),
-- sections
g as (select *, sum(regexp_matches(ltrim(x, {WS}) || {N} || coalesce(y, ''), '^({_STARTS})')::int) over (partition by doc_id order by i) as part
      from (select *, lead(x) over (partition by doc_id order by i) as y from l where not acts)),
s1 as (select doc_id, part, trim(string_agg(x, {N} order by i), {WS}) as s from g group by doc_id, part),
s2 as (select doc_id, part, s from s1 where s <> ''),
p2 as (select doc_id, unnest(range(0, len(b))) as part, trim(unnest(b), {WS}) as s from (select doc_id, string_split(t, {N} || {N}) as b from d where not acts and doc_id not in (select doc_id from s2 group by doc_id having count(*) > 1))),
p3 as (select doc_id, part, s from p2 where s <> ''),
s as (select doc_id, s, row_number() over (partition by doc_id order by part) as i from (
  select * from s2 where doc_id in (select doc_id from s2 group by doc_id having count(*) > 1) union all select * from p3 where doc_id in (select doc_id from p3 group by doc_id having count(*) > 1))),
m(doc_id, i, open, done) as (
  select distinct doc_id, 0::bigint, '', []::varchar[] from s
  union all
  select m.doc_id, s.i, case when {_TAKES.format(least=least)} then m.open || {N} || {N} || s.s else s.s end, case when {_TAKES.format(least=least)} or m.open = '' then m.done else list_append(m.done, m.open) end
  from m join s on s.doc_id = m.doc_id and s.i = m.i + 1),
e as (select doc_id, arg_max(open, i) as open, arg_max(done, i) as done from m group by doc_id),
merged as (select doc_id, case when len(done) > 0 and length(open) < {least} and not {_heading('open')} then list_append(done[:-2], done[-1] || {N} || {N} || open) else list_append(done, open) end as c from e),
sectioned as (select doc_id, list_filter(flatten([case when length(p) > {most} then {windows('p', size, overlap)} else [p] end for p in c]), lambda p: length(trim(p, {WS})) >= {chunking.LEAST_SECTION}) as c from merged),
plain as (select doc_id, {windows('t', size, overlap)} as c from d where not acts and doc_id not in (select doc_id from s)),
-- acts
a as (select doc_id, row_number() over (partition by doc_id order by i) as i, trim(x, {WS}) as x from l where acts and trim(x, {WS}) <> '' and not starts_with(trim(x, {WS}), '===== PAGE')),
f(doc_id, i, chunks, context, block) as (
  select distinct doc_id, 0::bigint, []::varchar[], []::varchar[], []::varchar[] from a
  union all
  select f.doc_id, a.i, case when (major or article or act) and len(block) > 0 then list_append(chunks, array_to_string(block, {N})) else chunks end,
         case when major then [a.x] when article then list_append(context[:1], a.x) else context end,
         case when major or article then [] when act then list_append(context, a.x) else list_append(block, a.x) end
  from f join (select *, regexp_matches(x, '(?i)^(TITRE|CHAPITRE|PARTIE|SECTION)\s+') as major, not regexp_matches(x, '(?i)^(TITRE|CHAPITRE|PARTIE|SECTION)\s+') and regexp_matches(x, '(?i)^Article\b') as article,
               not regexp_matches(x, '(?i)^((TITRE|CHAPITRE|PARTIE|SECTION)\s+|Article\b)') and regexp_matches(x, {_ACT}) as act from a) a on a.doc_id = f.doc_id and a.i = f.i + 1),
fe as (select doc_id, arg_max(chunks, i) as chunks, arg_max(block, i) as block from f group by doc_id),
fc as (select doc_id, unnest(range(1, len(c) + 1)) as i, unnest(c) as x from (select doc_id, case when len(block) > 0 then list_append(chunks, array_to_string(block, {N})) else chunks end as c from fe)),
j(doc_id, i, c) as (
  select distinct doc_id, 0::bigint, []::varchar[] from fc
  union all
  select j.doc_id, x.i, case when len(c) > 0 and length(c[-1]) < {least} and not (regexp_matches(c[-1], {_ACT}) and regexp_matches(x.x, {_ACT})) then list_append(c[:-2], c[-1] || {N} || {N} || x.x) else list_append(c, x.x) end
  from j join fc x on x.doc_id = j.doc_id and x.i = j.i + 1),
acted as (select doc_id, list_filter([trim(p, {WS}) for p in flatten([case when length(p) <= {most} then [p] else {windows('p', most, 150)} end for p in c])], lambda p: length(p) >= {chunking.LEAST_SECTION}) as c
          from (select doc_id, arg_max(c, i) as c from j group by doc_id)),
o as (select * from sectioned union all select * from plain union all select * from acted)
select doc_id, unnest(range(0, len(c)))::bigint as chunk_index, len(c)::bigint as total_chunks, 'semantic' as strategy, unnest(c) as chunk from o"""


# --- tables and pages -----------------------------------------------------------

#: Eight orders are the pages of a document: a cover, two pages of one billing table, an excluded
#: table, a pathology grid, a spa grid, and two pages between which a code is cut (or none, every other time).
PAGE_TEXT = f"""case o_orderkey % 8 when 0 then 'titre' || {N} || 'titre' || {N} || 'page de ' || o_orderpriority when 1 then 'tarifs ' || o_orderkey when 2 then 'suite ' || o_orderkey
 when 3 then case when o_orderkey // 8 % 3 = 0 then ' ' else 'page exclue ' || o_orderkey end when 4 then 'examens' when 5 then 'soins ' || o_orderkey
 when 6 then 'Acte ' || o_orderkey || ' : coefficient 4, lettre clé AMI ou' else case when o_orderkey // 8 % 2 = 0 then 'SFI' || {N} || 'fin ' || o_orderkey else 'Première partie : x' || {N} || 'rien ' || o_orderkey end end"""
KIND = "case o_orderkey % 8 when 1 then 'cotation_ngap' when 2 then 'cotation_ngap' when 3 then 'ignore' when 4 then 'anatpath' when 5 then 'thermal' else '' end"
_PRICE = "(o_orderkey % 7) || ',5'"
_PACK = f"'- Pansement ' || o_orderpriority || ' : coefficient ' || {_PRICE} || ', lettre clé AMI' || {N} || '- Injection : coefficient 2, lettre clé AMI ou AMX | condition: Par dérogation au tarif suite du texte'"
_MORE = f"'- Bilan ' || o_orderpriority || ' : coefficient 3, lettre clé AMK AMO' || {N} || '- Bilan ' || o_orderpriority || ' : coefficient 4, lettre clé AMK AMO' || {N} || '- Bilan ' || o_orderpriority || ' (variante) : coefficient 6'"
_PATHOLOGY = f"'- Acte 00' || (o_orderkey % 90 + 10) || ' : Examen ' || o_orderpriority || ' — coefficient P ' || (o_orderkey % 5) || {N} || '- Acte 0012 : Frottis sanguin — coefficient P 1,5'"
_SPA = f"'- Soin ' || o_orderpriority || ' : honoraires maximum de 3 séances' || {N} || '- Bain : honoraires Une Séance'"
BILLING = f"select o_orderkey // 8 as doc_id, (o_orderkey % 8)::int as page_no, case o_orderkey % 8 when 1 then {_PACK} else {_MORE} end as lines from orders where o_orderkey % 8 in (1, 2)"
CLASSES = f"select o_orderkey // 8 as doc_id, (o_orderkey % 8)::int as page_no, {KIND} as kinds from orders"
_MARK = f"{N} || {N} || '{V.MARKER}' || {N} || {N} || "
#: Documents of one remainder are read as generic: their pages as they stand.
FOLD = f"""with p as (select o_orderkey // 8 as doc_id, o_orderkey % 8 as page_no, trim({PAGE_TEXT}) as t, *,
  count(*) filter (where o_orderkey % 8 = 2) over w > 0 as goes_on, count(*) filter (where o_orderkey % 8 = 7) over w > 0 as ends from orders window w as (partition by o_orderkey // 8)),
x as (select doc_id, page_no, case when doc_id % 5 = 4 then case page_no when 0 then replace(t, 'titre' || {N} || 'titre', 'titre') else t end else
  case page_no when 0 then replace(t, 'titre' || {N} || 'titre', 'titre') when 1 then t || {_MARK}{_PACK} || case when goes_on then ' SFI' else '' end when 2 then t || {_MARK}{_MORE}
  when 4 then t || {_MARK}{_PATHOLOGY} when 5 then t || {_MARK}{_SPA} when 6 then t || case when ends and doc_id % 2 = 0 then ' SFI' else '' end
  when 7 then case when doc_id % 2 = 0 then 'fin ' || o_orderkey else t end else t end end as t from p)
select doc_id, string_agg(t, {N} || {N} order by page_no) filter (where t <> '') as text from x group by doc_id"""
ROLES = """select o_orderkey // 8 as doc_id, (o_orderkey % 8)::int as page_no, (case o_orderkey % 8 when 4 then 1 when 5 then 1 else 0 end)::int as designation,
 (case o_orderkey % 8 when 5 then 0 else 1 end)::int as coefficient, (case o_orderkey % 8 when 5 then 0 else 2 end)::int as lettre_cle,
 (case when o_orderkey % 8 in (1, 4) then 0 end)::int as header_row from orders where o_orderkey % 8 between 1 and 5"""
LEADING = "select o_orderkey // 8 as doc_id, (o_orderkey % 8)::int as page_no, case o_orderkey % 8 when 2 then 'SFI' else '' end as code from orders"
