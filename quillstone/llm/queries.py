"""Thin queries of the training-data operators over the driver tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontam, media, mixing, pii, quality, secretscan, sharding, simhash, substring, warc
from quillstone.llm.common import read, text_or_empty

SHARDS = 24


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", text_or_empty().cast("binary").alias("payload"))
    digest = F.sha2(media.padded(F.col("payload")), 256)
    path = media.write_store(docs.select(digest.alias("digest"), "payload"))
    image, caption = F.concat(F.lit("<img src='sha256:"), digest, F.lit("'>")), F.concat(F.octet_length("payload").cast("string"), F.lit(" bytes"))
    # captions before, after, and not closed
    figure = F.when(F.octet_length("payload") % 3 == 0, F.concat(F.lit("<figcaption>"), caption, F.lit("</figcaption>"), image)).when(
        F.octet_length("payload") % 3 == 1, F.concat(image, F.lit("<figcaption>"), caption, F.lit("</figcaption>"))).otherwise(F.concat(image, F.lit("<figcaption>"), caption))
    page = F.concat(F.lit("<article><p>Payload of a document</p><figure>"), figure, F.lit("</figure><p>End of the page</article>"))
    pages = docs.select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), page.alias("html"))
    sequences = media.interleave(pages, ["doc_id", "n_bytes"])
    found = media.resolve(sequences, ["doc_id", "n_bytes", "items"], media.store_features(spark, path))
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: F.concat_ws(":", x["position"], x["text"]))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", F.array_join(texts, "|").alias("texts"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")], "token_offset")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(read(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "split")


def _count(kind: str, spans="spans"):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _digest(kinds: list[str]):
    return F.sha2(pii.joined(F.filter("spans", lambda s: s["kind"].isin(kinds))).cast("binary"), 256).alias("base_sha256")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *[_count(k) for k in pii.BASE], _digest(pii.BASE), pii.joined(F.col("spans")).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in secretscan.BASE]
    found = secretscan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count(k) for k in kinds], _digest(kinds), pii.joined(F.col("spans")).alias("spans"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "n_chars", "copy", F.round("rate", 6).alias("rate"), "mix_key", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])


QUERIES = {
    "op1_media": op1_media, "op2_decontamination": op2_decontamination, "op4_pii": op4_pii, "op5_secrets": op5_secrets,
    "op3_sharding": op3_sharding, "op6_substrings": op6_substrings, "op7_warc": op7_warc, "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing, "op10_quality": op10_quality,
}

def _either(pattern: str) -> str:
    """ASCII letters in either case, without the folding of other letters."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


def _spans_sql(kind: str, order: int, pattern: str, least: int, group: int = 0) -> str:
    """Kind, start and end in code points of the leftmost non-overlapping matches: a start is the
    summed length of the gaps and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {order} as o, p.s as s, p.s + length(p.m) as e from (
  select doc_id, unnest([{{'s': list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0), 'm': m[i], 'k': k[i]}} for i in range(1, len(m) + 1)]) as p
  from (select doc_id, string_split_regex(t, '{quoted}') as g, regexp_extract_all(t, '{quoted}', 0) as m, regexp_extract_all(t, '{quoted}', {group}) as k from d)) where length(p.k) >= {least}"""


_ASSIGN = _either("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = [("assign", _ASSIGN, 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)] + [(r.kind, r.pattern, r.least, r.group) for r in secretscan.MORE]
#: CRC-32 of a list of bytes.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, {}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint)"
_HEX = "[('0x' || substr(h, 2 * i + 1, 2))::bigint for i in range({}, length(h) // 2)]"

_TOKENS = r"regexp_extract_all(lower({}), '[\pL\pN_]+')"
#: Share of a part's n-grams that stand in the list ``w``.
_COVER = "case when len({0}) = 0 then 1.0 else len([g for g in {1} if list_contains({2}, g)])::double / len({1}) end"


def _grams_sql(words: str, n: str) -> str:
    return f"list_distinct([array_to_string({words}[i:i + {n} - 1], ' ') for i in range(1, len({words}) - {n} + 2)])"


ORACLE_SQL = {
    "op2_decontamination": rf"""
with items as (select row_number() over (order by item_id, text) as k, item_id, text, {_TOKENS.format("text")} as w from benchmark where text <> ''),
halves as (select *, [x for x in string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if len({_TOKENS.format("x")}) > 0] as b from items),
qa as (select k, item_id, w, case when len(b) > 1 then {_TOKENS.format("array_to_string(b[:-2], ' ')")} else w[:greatest(1, len(w) * 3 // 4)] end as q,
       case when len(b) > 1 then {_TOKENS.format("b[-1]")} else w[greatest(1, len(w) * 3 // 4) + 1:] end as a from halves),
parts as (select k, j, w[j * z + 1:(j + 1) * z] as w from (select k, w, z, unnest(range(0, ceil(len(w) / z)::bigint)) as j from (select k, w, ceil(len(w) / ceil(len(w) / 64.0))::bigint as z from items where len(w) > 1))),
pairs as (select k, j, len(w) - 1 as n, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as pair from parts),
stat as (select (select count(*) from parts)::double as parts, (select avg(len(w) - 1) from parts) as mean),
df as (select pair, count(distinct (k, j))::double as df from pairs group by pair),
raw as (select k, j, pair, ln(1 + (parts - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) as w from (select k, j, n, pair, count(*)::double as f from pairs group by all) join df using (pair), stat),
impact as (select k, j, pair, w / sum(w) over (partition by k, j) as w from raw),
docs as (select row_number() over () as r, doc_id, {_TOKENS.format("text")} as w from documents where text is not null),
held as (select r, pos, pair, greatest(1, ceil((n - 1) / 64.0)::bigint - 1) as last from (select r, len(w) as n, unnest(range(0, len(w) - 1)) as pos, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as pair from docs) where pair in (select pair from df)),
win as (select distinct r, 64 * (pos // 64 - d) as s, pair from held, (values (0), (1)) x(d) where pos // 64 - d between 0 and last - 1),
found as (select r, s, k, j, sum(w) as score from win join impact using (pair) group by r, s, k, j having sum(w) >= 0.5 - 1e-9),
near as (select found.*, doc_id, item_id, qa.w, q, a, docs.w[greatest(0, s - len(qa.w)) + 1:s + 128 + len(qa.w)] as x from found join docs using (r) join qa using (k)),
seen as (select *, {_grams_sql("q", "least(5, len(q))")} as gq, {_grams_sql("a", "least(5, len(a))")} as ga, {_grams_sql("x", "least(5, len(q))")} as xq, {_grams_sql("x", "least(5, len(a))")} as xa,
         list_contains({_grams_sql("x", "len(w)")}, array_to_string(w, ' '))::int::double as whole from near),
marked as (select r, doc_id, k, item_id, s, score, case when len(w) < 8 then whole else {_COVER.format("q", "gq", "xq")} end as q, case when len(w) < 8 then whole else {_COVER.format("a", "ga", "xa")} end as a from seen),
best as (select *, row_number() over (partition by r, k order by score desc, s) as b from marked where q >= 0.6 and a >= 0.6),
single as (select doc_id, item_id, 1.0 as score, 1.0 as q, 1.0 as a, list_position(docs.w, items.w[1]) - 1 as s from docs, items where len(items.w) = 1 and list_contains(docs.w, items.w[1]))
select doc_id, item_id, round(score, 6) as score, round(q, 6) as question_overlap, round(a, 6) as answer_overlap, s::bigint as token_offset
from (select doc_id, item_id, score, q, a, s from best where b = 1 union all select doc_id, item_id, score, q, a, s from single)""",
    "op1_media": f"""
with d as (select doc_id, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as r from documents),
p as (select *, r || repeat('00', (greatest(64, (n + 63) // 64 * 64) - n)::int) as h from d),
s as (select *, unhex(h) as b, encode('P5' || chr(10) || '64 ' || (length(h) // 128) || chr(10) || '255' || chr(10)) || unhex(h) as m, {_CRC.format(_HEX.format("length(h) // 2 - 64"))} as crc from p),
l as (select doc_id, level, count(*) as k from (select doc_id, unnest({_HEX.format(0)}) as level from p) group by doc_id, level),
q as (select doc_id, sum(k)::double as c, sum(k * level)::double as s1, sum(k * level * level)::double as s2, sum(k * log2(k)) as s3, coalesce(sum(k) filter (where level >= 128), 0)::double as up from l group by doc_id),
f as (select doc_id, s1 / c as mean, sqrt(greatest(0, s2 / c - (s1 / c) * (s1 / c))) as sd, log2(c) - s3 / c as entropy, up / c as high from q)
select doc_id, n::bigint as n_bytes, (length(h) // 2)::bigint as payload_bytes, sha256(b) as payload_sha256, crc::bigint as tail_crc32, octet_length(m)::bigint as media_bytes, sha256(m) as media_sha256,
       printf('mean=%.4f;sd=%.4f;entropy=%.4f;high=%.4f', mean, sd, entropy, high) as feature, 1::int as position, n || ' bytes' as caption, '0:Payload of a document|2:End of the page' as texts
from s join f using (doc_id)""",
    "op5_secrets": "with d as (select doc_id, coalesce(text, '') as t from documents),\ns as ("
    + "\nunion all ".join(_spans_sql(kind, i, pattern, least, group) for i, (kind, pattern, least, group) in enumerate(_SECRETS)) + """)
select d.doc_id, count(*) filter (where kind = 'assign')::bigint as n_assign, count(*) filter (where kind = 'access')::bigint as n_access, count(*) filter (where kind = 'hex')::bigint as n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o) filter (where o < 3), '')) as base_sha256, coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o), '') as spans
from d left join s using (doc_id) group by d.doc_id""",
    "op6_substrings": """
with w as (select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\t-\\r]+') if x <> ''] as words from documents),
win as (select doc_id, i, list_aggregate(words[i:i + 12], 'string_agg', ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w)),
firsts as (select k, min(doc_id) as first from win group by k),
gone as (select doc_id, list(distinct i + j) as p from (select doc_id, i from win join firsts using (k) where first < doc_id), range(0, 13) r(j) group by doc_id),
kept as (select w.doc_id, len(words) as n, [words[i] for i in range(1, len(words) + 1) if not coalesce(list_contains(p, i), false)] as left_words
         from w left join gone using (doc_id))
select doc_id, n::bigint as n_words, (n - len(left_words))::bigint as n_removed, sha256(coalesce(array_to_string(left_words, ' '), '')) as kept_sha256
from kept""",
    "op7_warc": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h),
v as (select p.*, f.first, [('0x' || substr(p.h, 5 * i + 1, 5))::int for i in range(0, 8)] as x from p join f using (h))
select page_id, octet_length(encode(html))::bigint as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (y & 31) + 1, 1) for y in x], '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from v""",
    "op9_mixing": """
with recursive docs as (select doc_id, source, lang, n_chars, text, coalesce(source, '') as s from documents),
counts as (select s, count(*) as n, sqrt(count(*)::double) as w from docs group by s),
rates as (select s, w / (select sum(w) from counts) * (select sum(n) from counts)::double / n as rate from counts),
cdf(s, rate, k, p, c) as (
    select s, rate, 0, exp(-rate), exp(-rate) from rates
    union all
    select s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn as (select d.*, r.rate, ('0x' || substr(md5('mix-1:' || d.doc_id || ':1'), 1, 13))::bigint / 4503599627370496.0::double as u
          from docs d join rates r using (s)),
counted as (select d.doc_id, any_value(d.source) as source, any_value(d.lang) as lang, any_value(d.n_chars) as n_chars,
            any_value(d.text) as text, any_value(d.rate) as rate, count(c.k) as n
            from drawn d join cdf c on c.s = d.s and c.c <= d.u group by d.doc_id),
copies as (select *, unnest(range(1, n + 1)) as copy from counted)
select doc_id, source, lang, n_chars, copy::int as copy, round(rate, 6) as rate,
       ('0x' || substr(md5('mix-1:' || doc_id || ':copy:' || copy), 1, 13))::bigint as mix_key, text
from copies""",
}
