"""Registered queries over the driver tables, and their DuckDB twins.

Raw ``documents`` trigger almost no cleaning rule, so the text queries read the
text through ``NOISE``: an expression that both dialects run, which plants each
rule's cases in some rows and not in the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vector
from quillstone.functions import vocabulary as V
from quillstone.operators import chunking, cleaning, prompt, retrieval, tables
from quillstone.plans import oracles
from quillstone.sources import index as store
from quillstone.sources import registry as reg

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors ----------------------------------------------------------------

_DOT = "list_sum([a[i] * b[i] for i in range(1, len(a) + 1)])"
_VECS = "v as (select vec_id, label, [x::double for x in embedding] as e, sqrt(list_sum([x::double * x::double for x in embedding])) as n from embeddings)"
_COS = "list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) / (q.n * c.n)"


@query("vec_norm", f"with {_VECS} select vec_id, round(n, 6) as norm from v")
def vec_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


_TURNED = "list_sum([e[i] * e[len(e) + 1 - i] for i in range(1, len(e) + 1)])"


@query("vec_dot", f"with {_VECS} select vec_id, round({_TURNED}, 6) as dot, round({_TURNED} / (n * n), 6) as cosine from v")
def vec_dot(spark, sf_dir):
    a, b = F.col("embedding"), F.reverse("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.dot(a, b), 6).alias("dot"), F.round(vector.cosine(a, b), 6).alias("cosine"))


@query("cosine_topk", f"""with {_VECS}, s as (select q.vec_id as query_id, c.vec_id, {_COS} as s from v q, v c where q.vec_id % 50 = 0),
h as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rk from s) select query_id, vec_id, round(s, 6) as score from h where rk <= 10""")
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("sq_idx"), F.col("embedding").alias("vec"))
    return retrieval.search(rows, asked, 10).select("query_id", "vec_id", F.round("cosine_score", 6).alias("score"))


@query("cosine_matrix_stats", f"""with {_VECS}, s as (select q.vec_id as query_id, {_COS} as s from v q, v c where q.vec_id % 50 = 0)
select query_id, count(*) as n, round(min(s), 6) as least, round(avg(s), 6) as mean, round(max(s), 6) as most from s group by query_id""")
def cosine_matrix_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("sq_idx"), F.col("embedding").alias("vec"))
    return retrieval.score_stats(rows, asked).select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("least", "mean", "most")])


def _asked(rows: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50 asks; two of them make a query."""
    k = F.floor(F.col("vec_id") / 50)
    return rows.where("vec_id % 50 = 0").select(F.floor(k / 2).alias("query_id"), (k % 2).alias("sq_idx"), F.col("embedding").alias("vec"))


_HITS = f"""{_VECS}, s as (select (q.vec_id // 50) // 2 as query_id, (q.vec_id // 50) % 2 as sq_idx, c.vec_id, {_COS} as s from v q, v c where q.vec_id % 50 = 0),
h as (select *, row_number() over (partition by query_id, sq_idx order by s desc, vec_id) as rk from s)"""


@query("multi_query_topk", f"with {_HITS} select query_id::bigint as query_id, sq_idx::bigint as sq_idx, vec_id, round(s, 6) as score, rk as rank from h where rk <= 5")
def multi_query_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.search(rows, _asked(rows), 5).select("query_id", "sq_idx", "vec_id", F.round("cosine_score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_BEST = _HITS + """, b as (select query_id, vec_id, max(s) as s, min({'sq': sq_idx, 'rk': rk}) as f from h where rk <= 30 group by query_id, vec_id)"""


@query("best_score_merge", f"with {_BEST} select query_id::bigint as query_id, vec_id, round(s, 6) as score, f.sq::bigint as first_sq, f.rk as first_rank from b")
def best_score_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    merged = retrieval.merge_best(retrieval.search(rows, _asked(rows), 30))
    return merged.select("query_id", "vec_id", F.round("cosine_score", 6).alias("score"), "first_sq", F.col("first_rank").cast("long").alias("first_rank"))


_PRIO = "case when p is null then 0.5 when p = 1 then 1.0 when p = 2 then 0.8 when p = 3 then 0.7 when p = 4 then 0.6 when p = 6 then 0.5 when p = 7 then 0.4 when p = 8 then 0.3 when p = 9 then 0.2 else 0.5 end"
_RECENT = "case when y is null then 0.5 when 2026 - y <= 2 then 1.0 when 2026 - y <= 5 then 0.8 when 2026 - y <= 10 then 0.6 else 0.4 end"


@query("score_priority", f"select vec_id, p, ({_PRIO})::double as priority_score from (select vec_id, case when vec_id % 11 = 10 then null else (vec_id % 11)::int end as p from embeddings)")
def score_priority(spark, sf_dir):
    p = F.when(F.col("vec_id") % 11 != 10, (F.col("vec_id") % 11).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).withColumn("priority_score", vector.priority_score(F.col("p")))


@query("score_recency", f"select o_orderkey, y, ({_RECENT})::double as recency_score from (select o_orderkey, case when o_orderkey % 7 = 0 then null else year(o_orderdate)::int + (o_orderkey % 30)::int end as y from orders)")
def score_recency(spark, sf_dir):
    y = F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate") + (F.col("o_orderkey") % 30).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", y.alias("y")).withColumn("recency_score", vector.recency_score(F.col("y")))


def _with_meta(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"priorite": (F.col("label") % 10).cast("int"), "annee": (F.lit(2010) + F.col("vec_id") % 17).cast("int")})


_META = "m as (select vec_id, (label % 10)::int as p, (2010 + vec_id % 17)::int as y from embeddings)"
_FUSED = f"{_BEST}, {_META}, f as (select b.*, ({_PRIO})::double as pr, ({_RECENT})::double as re from b join m using (vec_id))"


@query("rerank_fusion", f"with {_FUSED} select query_id::bigint as query_id, vec_id, round(0.95 * s + 0.025 * pr + 0.025 * re, 6) as final_score from f")
def rerank_fusion(spark, sf_dir):
    rows = _with_meta(table(spark, sf_dir, "embeddings"))
    merged = retrieval.merge_best(retrieval.search(rows, _asked(rows), 30)).join(rows.select("vec_id", "priorite", "annee"), "vec_id")
    return retrieval.fuse(merged).select("query_id", "vec_id", F.round("final_score", 6).alias("final_score"))


@query("rerank_fusion_with_model_scores", f"""with {_FUSED}
select query_id::bigint as query_id, vec_id, round(0.5 * s + 0.4 * (case when vec_id % 3 = 0 then 0.0 else (vec_id % 10) / 10.0 end) + 0.05 * pr + 0.05 * re, 6) as final_score from f""")
def rerank_fusion_with_model_scores(spark, sf_dir):
    rows = _with_meta(table(spark, sf_dir, "embeddings"))
    merged = retrieval.merge_best(retrieval.search(rows, _asked(rows), 30)).join(rows.select("vec_id", "priorite", "annee"), "vec_id")
    model = merged.where("vec_id % 3 <> 0").select("query_id", "vec_id", ((F.col("vec_id") % 10) / 10.0).alias("relevance_score"))
    return retrieval.fuse(merged, model).select("query_id", "vec_id", F.round("final_score", 6).alias("final_score"))


@query("filter_min_cosine", f"with {_BEST} select query_id::bigint as query_id, vec_id, round(s, 6) as score from b where s >= 0.25")
def filter_min_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.filter_by_score(retrieval.merge_best(retrieval.search(rows, _asked(rows), 30)), 0.25).select("query_id", "vec_id", F.round("cosine_score", 6).alias("score"))


_ORDERED = f"""{_FUSED}, o as (select *, 0.95 * s + 0.025 * pr + 0.025 * re as fs, row_number() over (partition by query_id order by 0.95 * s + 0.025 * pr + 0.025 * re desc, f.sq, f.rk, vec_id) as pos from f where s >= 0.15)"""


@query("greedy_dedup", f"""with recursive {_ORDERED},
r as (select query_id, pos, vec_id, e, n from o join v using (vec_id)),
step(query_id, pos, kept) as (
  select query_id, 0::bigint, []::struct(id bigint, e double[], n double)[] from (select distinct query_id from r)
  union all
  select s.query_id, s.pos + 1,
         case when len([k for k in s.kept if list_sum([k.e[i] * r.e[i] for i in range(1, len(r.e) + 1)]) / (k.n * r.n) > 0.25]) > 0 then s.kept
              else list_append(s.kept, {{'id': r.vec_id, 'e': r.e, 'n': r.n}}) end
  from step s join r on r.query_id = s.query_id and r.pos = s.pos + 1),
last as (select query_id, arg_max(kept, pos) as kept from step group by query_id)
select query_id::bigint as query_id, unnest([k.id for k in kept]) as vec_id from last""")
def greedy_dedup(spark, sf_dir):
    rows = _with_meta(table(spark, sf_dir, "embeddings"))
    merged = retrieval.filter_by_score(retrieval.merge_best(retrieval.search(rows, _asked(rows), 30)), 0.15)
    scored = retrieval.fuse(merged.join(rows.select("vec_id", "priorite", "annee", "embedding"), "vec_id"))
    return retrieval.deduplicate(retrieval.ranked(scored, 1 << 30), 0.25).select("query_id", "vec_id")


@query("retrieve_end_to_end", f"""with {_ORDERED}
select query_id::bigint as query_id, pos as position, vec_id, round(s, 6) as cosine_score, pr as priority_score, re as recency_score, round(fs, 6) as final_score from o where pos <= 10""")
def retrieve_end_to_end(spark, sf_dir):
    rows = _with_meta(table(spark, sf_dir, "embeddings"))
    found = retrieval.retrieve(rows, _asked(rows), 10, 30, 0.15)
    return found.select("query_id", F.col("position").cast("long").alias("position"), "vec_id", F.round("cosine_score", 6).alias("cosine_score"), "priority_score", "recency_score", F.round("final_score", 6).alias("final_score"))


# --- chunks -----------------------------------------------------------------

_STRIP = "regexp_replace({}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"


def _chunk_sql(size: int, step: int) -> str:
    piece = _STRIP.format(f"substr(text, (i * {step} + 1)::int, {size})")
    return f"""w as (select doc_id, i, {piece} as chunk from (select doc_id, text, unnest(range(0, (length(text) + {step} - 1) // {step})) as i from documents where length(text) > 0)),
c as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk_index, count(*) over (partition by doc_id) as total_chunks, chunk from w where length(chunk) >= 20)"""


def _chunked(spark, sf_dir, strategy, **kw):
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), strategy, **kw).withColumns({c: F.col(c).cast("long") for c in ("chunk_index", "total_chunks")})


@query("chunk_naive", f"with {_chunk_sql(1000, 1000)} select doc_id, chunk_index, chunk from c")
def chunk_naive(spark, sf_dir):
    return _chunked(spark, sf_dir, "naive", chunk_size=1000).select("doc_id", "chunk_index", "chunk")


@query("chunk_overlap", f"with {_chunk_sql(800, 650)} select doc_id, chunk_index, chunk from c")
def chunk_overlap(spark, sf_dir):
    return _chunked(spark, sf_dir, "overlap").select("doc_id", "chunk_index", "chunk")


@query("chunk_index_total", f"with {_chunk_sql(800, 650)} select doc_id, chunk_index, total_chunks, 'overlap' as strategy from c")
def chunk_index_total(spark, sf_dir):
    return _chunked(spark, sf_dir, "overlap").select("doc_id", "chunk_index", "total_chunks", "strategy")


@query("chunk_semantic_fallback", f"with {_chunk_sql(800, 650)} select doc_id, chunk_index, total_chunks, chunk from c")
def chunk_semantic_fallback(spark, sf_dir):
    """Raw documents have neither section starts nor blank lines: all of them fall back to windows."""
    return _chunked(spark, sf_dir, "semantic").select("doc_id", "chunk_index", "total_chunks", "chunk")


@query("chunk_stats", f"with {_chunk_sql(800, 650)} select count(*) as n_chunks, min(length(chunk))::bigint as least, (sum(length(chunk)) // count(*))::bigint as mean, max(length(chunk))::bigint as most from c")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(_chunked(spark, sf_dir, "overlap"))


# --- cleaners, on text with planted cases -----------------------------------

_N = "chr(10)"


def _u(code: str) -> str:
    """A character beyond ASCII as a literal of both dialects."""
    return f"'{chr(int(code, 16))}'"


NOISE = {
    "pages": f"case doc_id % 4 when 1 then text || {_N} || '12' || {_N} || 'fin' when 2 then 'la séance' || {_N} || '12' || {_N} || text when 3 then '- 4 -' || {_N} || text || {_N} || 'Page 3 suite' || {_N} || '3 / 10' else text end",
    "separators": f"case doc_id % 3 when 1 then '-----' || {_N} || text || {_N} || ' =*~ ' || {_N} || '--' when 2 then text || {_N} || '--- x ---' else text end",
    "symbols": f"case doc_id % 3 when 1 then '|' || {_N} || text || {_N} || ' * ' || {_N} || 'a' when 2 then text || {_N} || '7' else text end",
    "markers": f"case doc_id % 3 when 1 then 'ou' || {_N} || {_N} || text || {_N} || {_N} || '2.' when 2 then text || {_N} || 'ou' || {_N} || 'suite' || {_N} || {_N} || 'iv.' || {_N} || '  ' || {_N} || 'b)' else text end",
    "indents": f"case doc_id % 2 when 1 then '   ' || text || {_N} || chr(9) || ' fin' else text end",
    "spaces": f"case doc_id % 3 when 1 then '  ' || text || '   x' || {_N} || {_N} || {_N} || {_N} || 'y  ' || {_N} || 'z' || chr(9) || ' ' || 'w' || {_N} when 2 then text || {_N} || {_N} else text end",
    "unicode": f"case doc_id % 3 when 1 then text || {_u('2019')} || 'e' || {_u('0301')} || {_u('a0')} || {_u('ad')} || {_u('201c')} || {_u('f0a7')} || {_u('2212')} when 2 then text || {_u('2015')} || {_u('2009')} else text end",
    "ingest": f"case doc_id % 3 when 1 then text || {_u('2022')} || 'a' || {_u('a0')} || chr(13) || chr(10) || 'b' || {_u('ad')} when 2 then text || {_u('25ba')} || {_u('f0a7')} || {_u('202f')} else text end",
    "running": f"case doc_id % 3 when 1 then 'Version en vigueur du 01/02/2024' || {_N} || text || {_N} || '  ' || {_N} || '123' when 2 then 'Première partie : x' || {_N} || text || {_N} || '1234' else text end",
    "gazette": f"case doc_id % 4 when 1 then 'Sommaire' || {_N} || text || {_N} || '12 mai 2023 Texte 4 sur 99 fin' when 2 then 'Version en vigueur du 01/02/2024' || {_N} || text || {_N} || ' Annexes ' when 3 then 'Première partie : dispositions generales' || {_N} || text || {_N} || 'Nouveau' else text end",
    "notes": f"case doc_id % 4 when 1 then '(Modifié par x)' || {_N} || text when 2 then text || {_N} || ' (abrogé par' || {_N} || 'y' || {_N} || 'z)' || {_N} || 'fin' when 3 then text || {_N} || '(Créé par' || {_N} || 'tout le reste' else text end",
    "conditions": f"case doc_id % 3 when 1 then text || ' | condition: x' || {_N} || 'a |NOTE : y' when 2 then text || '  |  Remarque: z' else text end",
    "ingest_marks": f"case doc_id % 3 when 1 then text || {_N} || '--- Cotations extraites ---' || {_N} || 'x' when 2 then text || {_N} || '-- Cotations extraites --' else text end",
    "adjacent": f"case doc_id % 3 when 1 then 'abc' || {_N} || ' abc ' || {_N} || {_N} || 'abc' || {_N} || text when 2 then 'abc' || {_N} || 'abd' || {_N} || 'abc' || {_N} || text else text end",
    "broken": f"case doc_id % 3 when 1 then text || {_N} || 'infir-' || {_N} || 'mier,' || {_N} || 'Suite' || {_N} || '1' when 2 then text || '.' || {_N} || 'é-' || {_N} || 'à' || {_N} || 'x' else text end",
    "articles": f"case doc_id % 3 when 1 then text || {_N} || 'Article 11 - Soins infirmiers à domicile pour un patient, quel que soit son âge x' || {_N} || 'y Article 12 – fin' when 2 then text || ' Article 11 - Soins infirmiers à domicile pour un patient, quel que soit son âge' else text end",
    "starts": f"case doc_id % 6 when 1 then ' Cet acte ' || text when 2 then 'Au-delà ' || text when 3 then 'chapitre ' || text when 4 then 'ARTICLE. ' || text when 5 then 'Articles ' || text else text end",
    "opens": f"case doc_id % 5 when 1 then text || ' lettre clé AMI ou' when 2 then text || ' Lettre clé' || {_N} || 'ami  ou AMX ou  ' when 3 then text || ' lettre clé AMI' when 4 then 'lettre clé AMI ou ' || text else text end",
    "codes": f"case doc_id % 5 when 1 then 'AMI' || {_N} || 'ou  ' || text || ' AMX;:' when 2 then text || ' sfi, AMI –' when 3 then '' when 4 then left(text, 30) || ' K K ou P' else text end",
    "hyphens": f"case doc_id % 4 when 1 then text || ' masseur-' || {_N} || 'kinésithérapeute infir-' || {_N} || ' mier a-' || {_N} || 'b-' || {_N} || 'c' when 2 then text || ' Ile-' || {_N} || 'Rousse DI-' || {_N} || 'x quatre-  ' || {_N} || 'dix 3-' || {_N} || 'x fin-' when 3 then 'pré-' || {_N} || 'avis x-' || {_N} || 'Social ' || text else text end",
    "sections": f"case doc_id % 5 when 1 then text || {_N} || 'Stations  thermales Orientations thérapeutiques a' || {_N} || 'b CHAPITRE V fin' when 2 then 'REFERENCES DES TEXTES REGLEMENTAIRES ' || repeat('mot ', 3000) || 'ANNEXE 1' || {_N} || text when 3 then text || {_N} || 'Tableau 2 : Règles de classement des forfaits BSI a' || {_N} || 'b' when 4 then text || ' REFERENCES DES TEXTES' || {_N} || 'REGLEMENTAIRES x ANNEXE 2 y' else text end",
    "structure": f"case doc_id % 4 when 0 then text when 1 then text || {_N} || '  TITRE II' || {_N} || 'Préambule court' || {_N} || {_N} || text || {_N} || 'Article 3 - objet' || {_N} || left(text, 90) || {_N} || 'ANNEXE' || {_N} || 'bref' when 2 then left(text, 700) || {_N} || {_N} || 'court' || {_N} || {_N} || text || {_N} || {_N} || {_N} || 'fin de document' else 'TITRE I' || {_N} || 'Article 2' || {_N} || left(text, 300) || {_N} || '- Soin : coefficient 1, lettre clé AMI' || {_N} || '- Bilan : coefficient 2,5, lettre clé SFI' || {_N} || 'CHAPITRE II' || {_N} || '===== PAGE 3' || {_N} || '- c : Coefficient 3' || {_N} || text end",
    "acts_only": f"'Chapitre I' || {_N} || case when doc_id % 2 = 0 then text || {_N} else '' end || '- a ' || doc_id || ' : coefficient 1, lettre clé AMI' || {_N} || 'suite' || {_N} || '- b : coefficient 2' || {_N} || 'Article 7' || {_N} || text || {_N} || '- c : coefficient 3, lettre clé SFI, AMX'",
    "signals": "case doc_id % 5 when 1 then text || ' AMI 4' when 2 then text || ' famille, coéfficient, Lettre  clé ngap' when 3 then text || ' AMX et SFI' else text end",
    "acts": f"case doc_id % 3 when 1 then text || {_N} || '- a : coefficient 1, lettre clé AMI' || {_N} || ' - b : coefficient 2,5' || {_N} || '- c : Coefficient 3' when 2 then text || {_N} || '- a : coefficient 1, lettre clé AMI sfi' else text end",
    "keys": "case doc_id % 6 when 0 then text || ' ami ou xyz AMX' when 1 then 'AMI ou' || chr(10) || ' AMI AMI , SFI; ' || text when 2 then text when 3 then 'TE2 ou ou K' || chr(10) || text when 4 then '' else text || ' pAMI AMIx' end",
    "numbers": "case doc_id % 7 when 0 then text || chr(10) || '1 5' when 1 then text || chr(10) || ' 2,5 ' || chr(10) || text when 2 then '3.' when 3 then text || chr(10) || 'a1' when 4 then '' when 5 then text else text || ' 12,5' end",
    "headers": "case doc_id % 5 when 0 then '  Désignation  de' || chr(10) || text when 1 then 'COEFFICIENT ' || text when 2 then text || ' Lettre clé Ë ' when 3 then left(text, 12) else text || ' ç ô ï' end",
    "reply": f"case doc_id % 6 when 0 then '- première question longue' || {_N} || '2) ' || text || {_N} || 'court' when 1 then '' when 2 then '  1. ... ' || left(text, 40) when 3 then text when 4 then ' - ' || {_N} || '...........' else {_N} || '•• -- 12 ' || text end",
    "files": "case doc_id % 4 when 0 then 'pdf_' || doc_id || '_x.pdf' when 1 then 'xpdf_1.pdf' when 2 then 'pdf_7' else 'note.pdf' end",
}
_LINES = "string_split(t, chr(10))"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def noised(spark, sf_dir, kind: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(NOISE[kind]).alias("t"))


def _digest(c: Column) -> list[Column]:
    return [F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("h")]


def _sql(kind: str, expression: str, more: str = "") -> str:
    return f"with d as (select doc_id, {NOISE[kind]} as t from documents){more}, r as (select doc_id, {expression} as x from d) select doc_id, length(x)::bigint as n, md5(x) as h from r"


def _line_sql(kind: str, drop: str) -> str:
    """``drop`` speaks of s (stripped line), p and n (its stripped neighbours)."""
    return f"""with d as (select doc_id, {NOISE[kind]} as t from documents),
l as (select doc_id, unnest({_LINES}) as x, unnest(range(0, len({_LINES}))) as i from d),
s as (select *, trim(x, {_WS}) as s from l),
k as (select *, coalesce(lag(s) over w, '') as p, coalesce(lead(s) over w, '') as n from s window w as (partition by doc_id order by i)),
r as (select doc_id, coalesce(string_agg(x, chr(10) order by i) filter (where not ({drop})), '') as x from k group by doc_id)
select doc_id, length(x)::bigint as n, md5(x) as h from r"""


def _cleaner(name: str, kind: str, function, sql: str):
    @query(name, sql)
    def run(spark, sf_dir):
        return noised(spark, sf_dir, kind).withColumn("x", function(F.col("t"))).select("doc_id", *_digest(F.col("x")))

    return run


_hints = " or ".join(f"contains(p || ' ' || n, '{w}')" for w in V.COTATION_HINTS)
_cleaner("page_number_removal", "pages", T.remove_page_numbers, _line_sql(
    "pages", f"regexp_matches(s, '^[-–]\\s*\\d+\\s*[-–]$') or regexp_matches(s, '(?i)^page\\s+\\d+') or regexp_matches(s, '^\\d+\\s*/\\s*\\d+$') or (regexp_matches(s, '^\\d{{1,4}}$') and not ({_hints}))"))
_cleaner("separator_removal", "separators", T.remove_separator_lines, _line_sql("separators", "length(s) >= 3 and translate(s, '-=_*~', '') = ''"))
_cleaner("single_char_removal", "symbols", T.remove_single_symbol_lines, _line_sql("symbols", "length(s) = 1 and not regexp_matches(s, '[\\pL\\pN]')"))
_cleaner("noise_line_removal", "markers", T.remove_noise_lines, _line_sql(
    "markers", "p = '' and n = '' and regexp_matches(s, '(?i)^(\\d{1,2}\\.|[a-z°]{1,3}\\)|ou|et|ou\\s+:|[-–•]\\s*|[ivxl]{1,5}\\.)$')"))
_cleaner("leading_ws_strip", "indents", T.strip_line_starts, _sql("indents", f"array_to_string([ltrim(x, ' ' || chr(9)) for x in {_LINES}], chr(10))"))
_cleaner("whitespace_normalize", "spaces", T.normalize_spaces, _sql(
    "spaces", f"trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t\\r\\f\\v]{{2,}}', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS})"))
_cleaner("unicode_normalize", "unicode", cleaning.normalize_unicode, _sql(
    "unicode", f"translate(replace(replace(replace(nfc_normalize(t), {_u('ad')}, ''), {_u('f0a7')}, ''), {_u('2015')}, {_u('2014')}), {_u('2019')} || {_u('201c')} || {_u('2212')} || {_u('a0')} || {_u('2009')}, '''\"-  ')"))
_cleaner("unicode_normalize_ingest", "ingest", T.ingest_characters, _sql(
    "ingest", f"replace(replace(replace(replace(replace(translate(t, {_u('a0')} || {_u('202f')}, '  '), {_u('ad')}, ''), {_u('2022')}, '- '), {_u('25ba')}, '- '), {_u('f0a7')}, '- '), chr(13), chr(10))"))
_cleaner("header_footer_removal", "running", T.remove_running_lines, _line_sql(
    "running", "regexp_matches(s, '^Version en vigueur du \\d{2}/\\d{2}/\\d{4}$') or regexp_matches(s, '^\\d{1,3}$') or regexp_matches(s, '^(Première|Deuxième|Troisième|Quatrième)\\s+partie\\s*[:\\-–]')").replace(
    "string_agg(x, chr(10)", "string_agg(case when s = '' then '' else x end, chr(10)"))
_cleaner("gazette_header_removal", "gazette", T.remove_gazette_headers, _line_sql(
    "gazette", "s in ('" + "', '".join(w.replace("'", "''") for w in [*V.GAZETTE_HEADERS, *V.CHECKBOX_WORDS, V.ANNEX_HEADER]) + "') or regexp_matches(s, '^Version\\s+en\\s+vigueur\\s+du\\s+\\d{2}/\\d{2}/\\d{4}\\s*$') or regexp_matches(s, '(?i)^premi.re\\s+partie\\s*:?\\s*dispositions\\s+g.n.rales\\s*$')").replace(
    "select doc_id, length(x)::bigint as n, md5(x) as h from r", "select doc_id, length(y)::bigint as n, md5(y) as h from (select doc_id, regexp_replace(x, '\\d{1,2}\\s+[\\w\\pL]+\\s+\\d{4}\\s+Texte\\s+\\d+\\s+sur\\s+\\d+', '', 'g') as y from r)"))
_cleaner("inline_condition_format", "conditions", T.split_inline_conditions, _sql(
    "conditions", "replace(replace(regexp_replace(t, '(?i)\\s*\\|\\s*(conditions?|remarque|note)\\s*:', chr(10) || '  \\1 :', 'g'), chr(10) || '  condition :', chr(10) || '  Condition :'), chr(10) || '  NOTE :', chr(10) || '  Note :')"))
_cleaner("marker_removal", "ingest_marks", T.remove_markers, _sql("ingest_marks", f"array_to_string([case when regexp_matches(x, '^---\\s*Cotations\\s+extraites\\s*---\\s*$') then '' else x end for x in {_LINES}], chr(10))"))
_cleaner("legislative_metadata_removal", "notes", T.remove_legislative_notes, f"""with recursive d as (select doc_id, {_LINES} as l from (select doc_id, {NOISE['notes']} as t from documents)),
f(doc_id, i, inside, kept) as (
  select doc_id, 0, false, []::varchar[] from d
  union all
  select f.doc_id, i + 1, case when inside or regexp_matches(l[i + 1], '(?i)^\\s*\\((modifi[eé]|cr[eé]{{1,2}}|abrog[eé])') then not contains(l[i + 1], ')') else false end,
         case when inside or regexp_matches(l[i + 1], '(?i)^\\s*\\((modifi[eé]|cr[eé]{{1,2}}|abrog[eé])') then kept else list_append(kept, l[i + 1]) end
  from f join d using (doc_id) where i < len(l)),
r as (select doc_id, array_to_string(arg_max(kept, i), chr(10)) as x from f group by doc_id)
select doc_id, length(x)::bigint as n, md5(x) as h from r""")
_cleaner("dedupe_adjacent_lines", "adjacent", T.dedupe_adjacent_lines, f"""with d as (select doc_id, {NOISE['adjacent']} as t from documents),
l as (select doc_id, unnest({_LINES}) as x, unnest(range(0, len({_LINES}))) as i from d),
k as (select *, trim(x, {_WS}) as s from l),
m as (select *, last_value(nullif(s, '') ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as p from k),
r as (select doc_id, trim(coalesce(string_agg(x, chr(10) order by i) filter (where s = '' or p is null or s <> p), ''), {_WS}) as x from m group by doc_id)
select doc_id, length(x)::bigint as n, md5(x) as h from r""")


_cleaner("broken_line_join", "broken", T.join_broken_lines, _sql(
    "broken", "regexp_replace(regexp_replace(t, '([\\w\\pL])-\\n([\\w\\pL])', '\\1\\2', 'g'), '(?i)([a-zàâçéèêëîïôûùüÿñæœ,;])\\n([a-zàâçéèêëîïôûùüÿñæœ])', '\\1 \\2', 'g')"))
_cleaner("obsolete_article_removal", "articles", T.remove_obsolete_articles, _sql(
    "articles", "regexp_replace(t, '(?s)Article\\s+11\\s*[-–—]\\s*Soins\\s+infirmiers\\s+.{0,5}domicile\\s+pour\\s+un\\s+patient,\\s+quel\\s+que\\s+soit\\s+son\\s+.ge.*?(Article\\s+12\\s*[-–—])', '\\1', 'g')"))


_PAGE_KINDS = ("ingest", "running", "broken", "spaces", "indents", "pages")
_PAGE = f"case (doc_id // 12) % {len(_PAGE_KINDS)} " + " ".join(f"when {i} then {NOISE[k]}" for i, k in enumerate(_PAGE_KINDS)) + " end"


@query("page_text_normalize", oracles.page_normalized(f"select doc_id, {_PAGE} as t from documents"))
def page_text_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PAGE.replace("(doc_id // 12)", "(doc_id div 12)")).alias("t"))
    return rows.withColumn("x", T.normalize_page_text(F.col("t"))).select("doc_id", *_digest(F.col("x")))


# --- recognisers and small parsers ------------------------------------------


def _flag(name: str, kind: str, function, expression: str, kind_sql: str = ""):
    @query(name, f"with d as (select doc_id, {NOISE[kind]} as t from documents) select doc_id, {expression} as v from d")
    def run(spark, sf_dir):
        return noised(spark, sf_dir, kind).select("doc_id", function(F.col("t")).alias("v"))

    return run


_fold = f"translate(regexp_replace(lower(trim(t, {_WS})), '\\s+', ' ', 'g'), 'éèêàâçùîïô', 'eeeaacuiio')"
_flag("ngap_doc_detect", "signals", T.is_billing_document, "(" + " + ".join(f"contains(upper({_fold}), '{w}')::int" for w in V.DOCUMENT_SIGNALS) + ") >= 2")
_flag("act_text_detect", "acts", T.is_act_text, "((" + " + ".join(f"contains(lower(t), '{w}')::int" for w in V.ACT_SIGNALS) + f") >= 3) and len([x for x in {_LINES} if regexp_matches(x, '(?i)^\\s*-\\s+.+?:\\s*coefficient\\s+\\d+')]) >= 3")
_flag("header_name_normalize", "headers", T.header_name, _fold)
_flag("lettre_cle_detect", "keys", T.has_letter_key, f"regexp_matches(upper(t), '(^|[^\\pL\\pN_])({'|'.join(V.LETTER_KEYS)})($|[^\\pL\\pN_])')")
_flag("numeric_coeff_detect", "numbers", T.is_numeric_coefficient, f"len([x for x in {_LINES} if regexp_matches(replace(trim(x, {_WS}), ' ', ''), '^\\d+[,.]?\\d*$')]) > 0")
_flag("lk_normalize", "keys", T.normalize_letter_keys, "array_to_string([k[i] for i in range(1, len(k) + 1) if i = 1 or k[i] <> k[i - 1]], ' ')")
ORACLE_SQL["lk_normalize"] = f"""with d as (select doc_id, {NOISE['keys']} as t from documents),
k as (select doc_id, [case when lower(x) = 'ou' then 'ou' else upper(x) end for x in regexp_split_to_array(trim(t, {_WS}), '\\s+') if lower(x) = 'ou' or upper(x) in ('{"', '".join(V.LETTER_KEYS)}')] as k from d)
select doc_id, array_to_string([k[i] for i in range(1, len(k) + 1) if i = 1 or k[i] <> k[i - 1]], ' ') as v from k"""
_flag("pdf_name_extract", "files", T.pdf_name, "nullif(regexp_extract(t, '^(pdf_\\d+)', 1), '')")


_flag("condition_line_detect", "starts", T.is_condition_line, " or ".join(f"starts_with(trim(t, {_WS}), '{w.replace(chr(39), chr(39) * 2)}')" for w in V.CONDITION_LINE_STARTERS))
_flag("header_line_detect", "starts", T.is_header_line, f"regexp_matches(trim(t, {_WS}), '(?i)^((TITRE|CHAPITRE|PARTIE|SECTION)\\s|Article\\b)')")
_flag("partial_code_extract", "opens", T.open_code, r"nullif(regexp_extract(t, '(?i)(lettre clé\s+[A-Z]{1,4}\s+ou(?:\s+[A-Z]{1,4}\s+ou)*)\s*$', 1), '')")
_flag("lk_clean", "codes", T.clean_letter_keys, "''")
ORACLE_SQL["lk_clean"] = f"""with d as (select doc_id, {NOISE['codes']} as t from documents),
s as (select doc_id, trim(regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g'), {_WS}), '[;,:\\-–—]+$', ''), {_WS}) as t from d),
k as (select doc_id, [case when lower(x) = 'ou' then 'ou' else upper(x) end for x in string_split(t, ' ') if lower(x) = 'ou' or upper(x) in ('{"', '".join(V.LETTER_KEYS)}')] as k from s)
select doc_id, array_to_string([k[i] for i in range(1, len(k) + 1) if i = 1 or k[i] <> k[i - 1]], ' ') as v from k"""


@query("subquery_parse", f"""with d as (select doc_id, {NOISE['reply']} as t from documents),
p as (select doc_id, [ltrim(trim(x, {_WS}), '{T.PREFIX_CHARACTERS}') for x in {_LINES} if length(trim(x, {_WS})) > 10] as k from d),
q as (select doc_id, case when len(k) > 0 then k else ['question'] end as k from p)
select doc_id, unnest(range(0, len(k))) as sq_idx, unnest(k) as text from q""")
def subquery_parse(spark, sf_dir):
    rows = noised(spark, sf_dir, "reply").select("doc_id", F.posexplode(T.reply_lines(F.col("t"), F.lit("question"))).alias("sq_idx", "text"))
    return rows.withColumn("sq_idx", F.col("sq_idx").cast("long"))


_flag("rewrite_parse", "reply", lambda c: T.rewritten_question(c, F.lit("question")), f"coalesce(nullif(ltrim(trim(string_split(trim(t, {_WS}), chr(10))[1], {_WS}), '{T.PREFIX_CHARACTERS}'), ''), 'question')")


@query("detect_mode", f"""with p as (select conv_id, turn, text || case when conv_id % 3 = 0 and turn < 2 then ' AMI Coéfficient' when conv_id % 3 = 1 and turn > 3 then ' AMI NGAP' else '' end as t, row_number() over (partition by conv_id order by turn, role, text) as n from conversations),
j as (select conv_id, string_agg(t, chr(10) order by n) as t from p where n <= 3 group by conv_id)
select conv_id as doc_id, case when (""" + " + ".join(f"contains(upper({_fold}), '{w}')::int" for w in V.DOCUMENT_SIGNALS) + """) >= 2 then 'ngap' else 'generic' end as mode from j""")
def detect_mode(spark, sf_dir):
    more = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") < 2), F.lit(" AMI Coéfficient")).when((F.col("conv_id") % 3 == 1) & (F.col("turn") > 3), F.lit(" AMI NGAP")).otherwise(F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.row_number().over(order).alias("page_no"), F.concat("text", more).alias("text"))
    return tables.document_mode(rows)


# --- joins and caches -------------------------------------------------------


@query("cache_key_md5", "select item_id, md5(text) as cache_key from benchmark")
def cache_key_md5(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", store.cache_key(F.col("text")).alias("cache_key"))


def _cache(spark, sf_dir) -> DataFrame:
    """Every third benchmark text is cached; its vector is that of the same number."""
    texts = table(spark, sf_dir, "benchmark").where("item_id % 3 = 0")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), vector.doubles(F.col("embedding")).alias("embedding"))
    return texts.join(vectors, "item_id").select(store.cache_key(F.col("text")).alias("cache_key"), F.lit("m").alias("model"), "embedding")


_CACHE = "c as (select md5(b.text) as cache_key, any_value(e.embedding) as embedding from benchmark b join embeddings e on e.vec_id = b.item_id where b.item_id % 3 = 0 group by 1)"


@query("cache_left_join", f"with {_CACHE} select b.item_id, c.cache_key is not null as hit, len(c.embedding)::bigint as dims from benchmark b left join c on c.cache_key = md5(b.text)")
def cache_left_join(spark, sf_dir):
    out = store.probe(table(spark, sf_dir, "benchmark"), _cache(spark, sf_dir), "m", "text")
    return out.select("item_id", F.col("embedding").isNotNull().alias("hit"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dims"))


@query("cache_misses_anti_join", f"with {_CACHE} select distinct md5(text) as cache_key, text from benchmark where md5(text) not in (select cache_key from c)")
def cache_misses_anti_join(spark, sf_dir):
    return store.misses(table(spark, sf_dir, "benchmark"), _cache(spark, sf_dir), "m", "text")


@query("cache_counts", f"with {_CACHE} select count_if(c.cache_key is not null)::bigint as hits, count_if(c.cache_key is null)::bigint as misses from benchmark b left join c on c.cache_key = md5(b.text)")
def cache_counts(spark, sf_dir):
    return store.cache_counts(store.probe(table(spark, sf_dir, "benchmark"), _cache(spark, sf_dir), "m", "text"))


def _registry(spark, sf_dir) -> DataFrame:
    """``labels`` as a registry: two rows for every seventh document, the later one of another year."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("pos"))
    return rows.select(
        "pos", F.col("doc_id").cast("int").alias("id"), F.lit("loi").alias("type_document"), F.concat(F.lit("t"), F.col("doc_id")).alias("titre"),
        (F.lit(2000) + F.col("doc_id") % 20 + F.col("pos")).cast("int").alias("annee"), F.lit("s").alias("source"), F.lit("u").alias("url"),
        F.concat(F.lit("pdf_"), F.col("doc_id")).alias("nom_pdf"), F.lit("th").alias("theme"), F.col("quality").cast("int").alias("priorite"), F.lit("").alias("commentaire"))


@query("registry_dedup_last_wins", "select 'pdf_' || doc_id as nom_pdf, (2000 + doc_id % 20 + (doc_id % 7 = 0)::int)::int as annee from labels")
def registry_dedup_last_wins(spark, sf_dir):
    return reg.last_wins(_registry(spark, sf_dir), "pos").select("nom_pdf", "annee")


_LABEL = "case when p is null or p = 0 then 'Non classé' when p = 1 then 'Loi' else 'Inconnu' end"


@query("registry_left_join", f"""with r as (select doc_id, quality::int as p from labels), d as (select doc_id, {NOISE['files']} as source from documents),
j as (select d.doc_id, d.source, r.doc_id as rid, r.p from d left join r on 'pdf_' || r.doc_id = nullif(regexp_extract(d.source, '^(pdf_\\d+)', 1), ''))
select doc_id, rid::int as registry_id, coalesce('t' || rid, '') as titre, p as priorite, {_LABEL} as label, rid is not null as is_enriched,
       case when rid is null then null else (2000 + rid % 20 + (rid % 7 = 0)::int)::int end as annee from j""")
def registry_left_join(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(NOISE["files"]).alias("source"))
    out = reg.enrich(files, reg.last_wins(_registry(spark, sf_dir), "pos"))
    return out.select("doc_id", "registry_id", "titre", "priorite", T.priority_label(F.col("priorite")).alias("label"), F.col("registry_id").isNotNull().alias("is_enriched"), "annee")


@query("ingest_counts", "select count(*)::bigint as loaded, count(l.doc_id)::bigint as enriched, 0::bigint as skipped from documents d left join labels l on l.doc_id = d.doc_id and d.doc_id % 4 = 0")
def ingest_counts(spark, sf_dir):
    from quillstone.sources.documents import ingest_counts as count

    files = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("pdf_"), "doc_id")).otherwise(F.lit("x")).alias("source"), F.lit(None).cast("string").alias("error"))
    return count(reg.enrich(files, reg.last_wins(_registry(spark, sf_dir), "pos")))


@query("metadata_json", f"""with r as (select doc_id, quality::int as p from labels), d as (select doc_id, {NOISE['files']} as source, n_chars from documents),
j as (select d.*, r.doc_id as rid, r.p from d left join r on 'pdf_' || r.doc_id = nullif(regexp_extract(d.source, '^(pdf_\\d+)', 1), ''))
select doc_id, json_object('source', source, 'filepath', '/x/' || source, 'extension', '.pdf', 'size_bytes', n_chars, 'modified_time', null, 'registry_id', rid::int, 'type_document', case when rid is null then '' else 'loi' end,
  'titre', coalesce('t' || rid, ''), 'annee', case when rid is null then null else (2000 + rid % 20 + (rid % 7 = 0)::int)::int end, 'source_juridique', case when rid is null then '' else 's' end, 'url', case when rid is null then '' else 'u' end,
  'nom_pdf', coalesce('pdf_' || rid, ''), 'theme', case when rid is null then '' else 'th' end, 'priorite', p, 'commentaire', '', 'extraction_mode', 'generic')::varchar as meta from j""")
def metadata_json(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(NOISE["files"]).alias("source"), F.col("n_chars").alias("size_bytes"))
    files = files.withColumns({"filepath": F.concat(F.lit("/x/"), "source"), "extension": F.lit(".pdf"), "extraction_mode": F.lit("generic")})
    out = reg.enrich(files, reg.last_wins(_registry(spark, sf_dir), "pos"))
    return out.select("doc_id", store.metadata_json(out).alias("meta"))


_YEARS = "case doc_id % 6 when 0 then '2019' when 1 then '2020.0' when 2 then 'inconnue' when 3 then null when 4 then '' else ' 1998 ' end"


@query("registry_checked", f"""with r as (select doc_id, {_YEARS} as y, case doc_id % 4 when 0 then '3' when 1 then 'x' when 2 then '7.0' end as p, case when doc_id % 2 = 0 then 'c' || doc_id end as c from labels)
select doc_id::int as id, 'pdf_' || doc_id as nom_pdf, try_cast(y as double)::int as annee, try_cast(p as double)::int as priorite, coalesce(c, '') as commentaire from r""")
def registry_checked(spark, sf_dir):
    text = lambda v, name: F.lit(v).alias(name)
    priority = F.when(F.col("doc_id") % 4 == 0, "3").when(F.col("doc_id") % 4 == 1, "x").when(F.col("doc_id") % 4 == 2, "7.0")
    raw = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), text("loi", "type_document"), text("t", "titre"), F.expr(_YEARS).alias("annee"), text("s", "source"), text("u", "url"),
        F.concat(F.lit("pdf_"), "doc_id").alias("nom_pdf"), text("th", "theme"), priority.alias("priorite"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c"), "doc_id")).alias("commentaire"))
    return reg.checked(raw).select("id", "nom_pdf", "annee", "priorite", "commentaire")


@query("rerank_candidates", """with r as (select conv_id, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as vec_id from conversations),
q as (select conv_id, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) as w from r where vec_id = 0),
d as (select conv_id, vec_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') as x from r)
select conv_id as query_id, vec_id, round(len([y for y in w if list_contains(x, y)]) / greatest(1, len(w)), 6) as relevance_score from d join q using (conv_id)""")
def rerank_candidates(spark, sf_dir):
    from quillstone.sources.providers import LexicalReranker
    from quillstone.sources.providers import rerank_candidates as rerank

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("chunk"), (F.row_number().over(order) - 1).cast("long").alias("vec_id"))
    asked = rows.where("vec_id = 0").select("query_id", F.col("chunk").alias("query"))
    return rerank(rows.join(asked, "query_id"), LexicalReranker()).withColumn("relevance_score", F.round("relevance_score", 6))


# --- prompts ----------------------------------------------------------------


@query("context_assembly", """with b as (select conv_id, string_agg('--- Extrait ' || (rn) || ' [' || case when turn % 2 = 0 then 'Titre: t' || turn || ' | Type: loi (priorité: Loi) | Année: 2020 | Source: s | URL: u' else 'Fichier: ' || role end || '] ---' || chr(10) || text || chr(10), chr(10) order by rn) as context
from (select *, row_number() over (partition by conv_id order by turn, role, text) as rn from conversations) group by conv_id)
select conv_id, md5(context) as h, (length(context) // 4)::bigint as tokens from b""")
def context_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    h = prompt.header(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string")), F.lit("loi"), F.lit(1), F.lit(2020), F.lit("s"), F.lit("u"), F.col("role"))
    out = prompt.build_context(rows.withColumns({"position": F.row_number().over(order), "header": h}), "conv_id", text_col="text")
    return out.select("conv_id", F.md5(F.col("context").cast("binary")).alias("h"), prompt.token_estimate(F.col("context")).alias("tokens"))


@query("prompt_user", """select doc_id, md5('Extraits des documents :' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question posée : ' || source || chr(10) || chr(10)
|| 'Répondre d''abord en quelques phrases, puis préciser au besoin. S''en tenir aux extraits et citer le titre, le type et l''année de chaque source.') as h from documents""")
def prompt_user(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt.user_prompt(F.col("source"), F.col("text")).cast("binary")).alias("h"))


@query("prompt_token_estimate", "select doc_id, (length(text) // 4)::bigint as tokens from documents")
def prompt_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompt.token_estimate(F.col("text")).alias("tokens"))


@query("source_listing", "select doc_id, case when doc_id % 2 = 0 then format('[{}] {}...', doc_id + 1, left(text, 65)) || chr(10) || 'loi | P1 (Loi) | 2020' || chr(10) || 'Score: cos=0.5000 final=0.2500' || chr(10) || 'URL: u' else format('[{}] {} (score=0.5000)', doc_id + 1, source) end as listing from documents")
def source_listing(spark, sf_dir):
    c = prompt.source_listing(F.col("doc_id") % 2 == 0, F.col("text"), F.lit("loi"), F.lit(1), F.lit(2020), F.lit(0.5), F.lit(0.25), F.lit("u"), F.col("source"), F.col("doc_id") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("listing"))


# --- tables and pages -------------------------------------------------------


@query("bbox_anti_join", """select l_orderkey, l_linenumber, l_partkey from lineitem l
where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and l_quantity >= o_custkey % 20 - 2 and l_quantity + 5 <= o_custkey % 20 + 32 and l_linenumber >= 1 - 2 and l_linenumber + 1 <= 4 + 2)""")
def bbox_anti_join(spark, sf_dir):
    objects = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"), F.col("l_linenumber").cast("double").alias("top"), (F.col("l_linenumber") + 1).cast("double").alias("bottom"))
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 20).cast("double").alias("x0"), (F.col("o_custkey") % 20 + 30).cast("double").alias("x1"), F.lit(1.0).alias("top"), F.lit(4.0).alias("bottom"))
    return tables.outside_boxes(objects, boxes, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


def _grids(spark, sf_dir) -> DataFrame:
    """A grid of four rows per order, made from its fields; some codes, prices and names are not what a format wants."""
    key = F.col("o_orderkey")
    code = lambda i: F.concat(F.when((key + i) % 4 == 1, F.lit("1")).otherwise(F.lit("00")), ((key + i) % 90 + 10).cast("string"))
    name = lambda i: F.concat(F.lit("acte "), F.col("o_orderpriority"), F.when((key + i) % 5 == 2, F.lit(" jour")).otherwise(F.lit(" Séance")))
    price = lambda i: F.concat(((key * (i + 1)) % 7).cast("string"), F.when((key + i) % 7 == 3, F.lit(" x")).otherwise(F.lit("")))
    row = lambda i: F.array(code(i), name(i), F.when((key + i) % 3 == 0, F.lit(None)).otherwise(F.lit("AMI")), price(i))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[row(i) for i in range(4)]).alias("grid"))


_GRID = """g as (select o_orderkey, i, case when (o_orderkey + i) % 4 = 1 then '1' else '00' end || ((o_orderkey + i) % 90 + 10) as c0, 'acte ' || o_orderpriority || case when (o_orderkey + i) % 5 = 2 then ' jour' else ' Séance' end as c1,
 case when (o_orderkey + i) % 3 = 0 then null else 'AMI' end as c2, ((o_orderkey * (i + 1)) % 7)::varchar || case when (o_orderkey + i) % 7 = 3 then ' x' else '' end as c3 from orders, range(0, 4) r(i))"""


@query("anatpath_format", f"""with {_GRID} select o_orderkey, '- Acte ' || c0 || ' : ' || c1 || ' — coefficient P ' || c3 as line, (row_number() over (partition by o_orderkey order by i) - 1)::bigint as i
from g where regexp_matches(c0, '^0{{1,2}}\\d{{2,3}}$') and regexp_matches(replace(c3, ' ', ''), '^\\d+[,.]?\\d*$')""")
def anatpath_format(spark, sf_dir):
    return _grids(spark, sf_dir).select("o_orderkey", F.posexplode(tables.pathology_lines(F.col("grid"))).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


@query("thermal_format", f"with {_GRID} select o_orderkey, '- ' || c0 || ' : honoraires ' || c1 as line, (row_number() over (partition by o_orderkey order by i) - 1)::bigint as i from g where contains(lower(c1), 'séance')")
def thermal_format(spark, sf_dir):
    return _grids(spark, sf_dir).select("o_orderkey", F.posexplode(tables.spa_lines(F.col("grid"))).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


@query("table_role_scores", f"""with {_GRID}, u as (select o_orderkey, unnest([0, 1, 2, 3]) as col, unnest([c0, c1, coalesce(c2, ''), c3]) as v from g),
f as (select *, regexp_matches(replace(v, ' ', ''), '^\\d+[,.]?\\d*$') as num, regexp_matches(upper(v), '\\b({"|".join(V.LETTER_KEYS)})\\b') as lk from u)
select o_orderkey, col::int as col, sum(num::int)::bigint as coeff_score, sum(lk::int)::bigint as lk_score, sum((v <> '' and not num and not lk)::int)::bigint as text_score from f group by o_orderkey, col""")
def table_role_scores(spark, sf_dir):
    return tables.role_scores(_grids(spark, sf_dir), "o_orderkey", "grid")


# --- steps that depend on one another ----------------------------------------


@query("fix_hyphenation", f"with d as (select doc_id, {NOISE['hyphens']} as t from documents), {oracles.hyphens('r', 'd')} {oracles.DIGEST} from r")
def fix_hyphenation(spark, sf_dir):
    return noised(spark, sf_dir, "hyphens").select("doc_id", *_digest(cleaning.fix_hyphenation("t")))


@query("section_removal", f"with d as (select doc_id, {NOISE['sections']} as t from documents), {oracles.sections('r', 'd')} {oracles.DIGEST} from r2")
def section_removal(spark, sf_dir):
    return noised(spark, sf_dir, "sections").select("doc_id", *_digest(cleaning.remove_sections("t")))


#: Each document with the cases of one kind.
_KINDS = ("pages", "separators", "markers", "notes", "conditions", "gazette", "spaces", "hyphens", "sections", "articles", "unicode", "ingest_marks", "symbols", "indents")
_EVERYTHING = f"case (doc_id // 20) % {len(_KINDS)} " + " ".join(f"when {i} then {NOISE[k]}" for i, k in enumerate(_KINDS)) + " end"


@query("clean_text_full", oracles.cleaned(f"select doc_id, {_EVERYTHING} as t from documents"))
def clean_text_full(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EVERYTHING.replace("(doc_id // 20)", "(doc_id div 20)")).alias("text"))
    return cleaning.clean_documents(rows)


def _structured(spark, sf_dir, kind: str) -> DataFrame:
    out = chunking.chunk_documents(noised(spark, sf_dir, kind).withColumnRenamed("t", "text"), "semantic")
    return out.withColumns({c: F.col(c).cast("long") for c in ("chunk_index", "total_chunks")})


@query("chunk_semantic", oracles.chunked(f"select doc_id, {NOISE['structure']} as t from documents"))
def chunk_semantic(spark, sf_dir):
    """Windows, sections, paragraphs and acts."""
    return _structured(spark, sf_dir, "structure")


@query("chunk_ngap_acts", oracles.chunked(f"select doc_id, {NOISE['acts_only']} as t from documents"))
def chunk_ngap_acts(spark, sf_dir):
    return _structured(spark, sf_dir, "acts_only")


def _pages(spark, sf_dir) -> DataFrame:
    """Eight orders are the pages of a document; see ``oracles.PAGE_TEXT``."""
    key, name = F.col("o_orderkey"), F.col("o_orderpriority")
    row = lambda *cells: F.array(*[F.lit(c) if c is None or isinstance(c, str) else c for c in cells]).cast("array<string>")
    said = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    grids = {
        1: [row("Désignation de l'acte", "Coefficient", "Lettre clé"), row(said("Pansement ", name), F.concat((key % 7).cast("string"), F.lit(",5")), "AMI"),
            row("Injection", "2", "ami ou AMX"), row("Par dérogation au tarif", None, None), row("suite du texte", "", "")],
        2: [row("", "", "SFI"), row(said("Bilan ", name), "3\n4", "AMK\nAMO"), row("", "6", "")],
        3: [row("Groupe 1", "x", "AMI"), row("Acte", "2", "AMI")],
        4: [row("Code", "Libellé", "x", "P"), row(said("00", key % 90 + 10), said("Examen ", name), "", (key % 5).cast("string")), row("0x", "non", "", "3"), row("0012", "Frottis\nsanguin", "", "1,5")],
        5: [row(said("Soin ", name), "maximum de 3 séances"), row("Bain", "Une Séance"), row("x", "rien"), row("", "séance")],
    }
    found = F.array().cast("array<array<array<string>>>")
    for k, rows in grids.items():
        found = F.when(key % 8 == k, F.array(F.array(*rows))).otherwise(found)
    text = F.expr(oracles.PAGE_TEXT.replace("o_orderkey // 8", "(o_orderkey div 8)"))
    return table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 8").alias("doc_id"), (key % 8).cast("int").alias("page_no"), text.alias("text"), found.alias("tables"))


@query("table_classify", oracles.CLASSES)
def table_classify(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_no", F.array_join(tables.classify("tables"), ",").alias("kinds"))


@query("table_roles", oracles.ROLES)
def table_roles(spark, sf_dir):
    rows = _pages(spark, sf_dir).where("size(tables) > 0").withColumn("r", F.element_at(tables.roles("tables"), 1))
    return rows.select("doc_id", "page_no", "r.designation", "r.coefficient", "r.lettre_cle", "r.header_row")


@query("page_leading_code", oracles.LEADING)
def page_leading_code(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_no", tables.leading_code("tables").alias("code"))


@query("table_format_cotation", oracles.BILLING)
def table_format_cotation(spark, sf_dir):
    billing = _pages(spark, sf_dir).withColumn("_k", tables.classify("tables")).where(F.array_contains("_k", "cotation_ngap"))
    return billing.select("doc_id", "page_no", F.array_join(tables.format_billing("tables"), "\n").alias("lines"))


@query("page_fold", oracles.FOLD)
def page_fold(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 5 == 4, F.lit("generic")).otherwise(F.lit("ngap"))
    return tables.fold_pages(_pages(spark, sf_dir), mode).select("doc_id", F.coalesce("text", "error").alias("text"))
