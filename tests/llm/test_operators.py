"""Every operator against brute force on small fixtures with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import gzip
import hashlib
import html as html_module
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import common, decontam, media, mixing, pii, quality, secretscan, sharding, simhash, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, size long, fp string, shard int, rate double, spans string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with nulls, blanks, copies, near copies, a shared passage and one long text."""
    rng = random.Random(seed)
    shared = words(rng, 40)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", "   \n\t ", "x", texts[0], texts[0], texts[1].upper()]
    texts += [f"{words(rng, 5)} {shared}\n{words(rng, 6)}" for _ in range(12)]
    base = words(rng, 300).split()
    texts += [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in (3, 100, 250)]
    texts += [words(rng, 6000), "one two three"]
    return texts


def frame(spark, texts, schema=DOCS, start=0):
    rows = [(start + i, t, "en", f"s{i % 3}" if i % 5 else None, len(t) if t else None, "c", 7, "z", 99, 0.5, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# --- 1 media ----------------------------------------------------------------


def test_html_sequence_keeps_order_positions_and_captions():
    html = "<p>One<script>no</script></p><figure><img src='sha256:ab' alt='a'><figcaption>Cap <b>x</b></figcaption></figure>two<img src=b alt=C>three<p>four"
    items = media.parse_html(html)
    assert [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [
        (0, "text", "One", None, None), (1, "media", None, "sha256:ab", "Cap x"), (2, "text", "two", None, None),
        (3, "media", None, "b", "C"), (4, "text", "three", None, None), (5, "text", "four", None, None)]
    assert media.parse_html(None) == [] and media.parse_html("<<p><img") is not None


@pytest.mark.parametrize("html, expect", [
    ("<figure><img src=a><figcaption>cap</figure><p>rest", ["a=cap", "rest"]),
    ("<figure><figcaption>cap</figcaption><img src=a></figure>rest", ["a=cap", "rest"]),
    ("<figcaption>loose</figcaption><img src=a>", ["loose", "a=None"]),
    ("<figure><figure><img src=a><figcaption>in</figcaption></figure><img src=b><figcaption>out</figcaption></figure>", ["a=in", "b=out"]),
    ("<figure><figcaption>first</figcaption><figure><img src=a></figure><img src=b alt=x></figure>", ["a=None", "b=first"]),
    ("one<script/>two<style/>three", ["onetwothree"]),
    ("<p>one<script>var a='<p>no</p>'</script>two", ["onetwo"]),
    ("one<noscript>no</noscript>two<template>kept", ["onetwo", "kept"]),
    ("<figure><img src=a><img src=b alt=x><figcaption>both <p>of</p>them", ["a=both of them", "b=both of them"]),
    ("<figure><figcaption>alone</figcaption></figure>x", ["alone", "x"]),
    ("</figure></figcaption><p>x</p></p><figure/>y<img src=''><img alt=z>", ["x", "y"]),
    ("a &amp; b &#233;<br>c<!-- no -->", ["a & b \u00e9", "c"]), ("", []), (None, []), ("<figure><figcaption>", []),
])
def test_figures_captions_and_unclosed_markup(html, expect):
    items = media.parse_html(html)
    assert [i["text"] if i["kind"] == "text" else f"{i['ref']}={i['caption']}" for i in items] == expect
    assert [i["position"] for i in items] == list(range(len(items)))


def test_no_text_of_the_pages_is_lost(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in media.interleave(pages, ["page_id", "html"]).collect():
        bare = re.sub(r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ", r.html or "")
        text = "".join(x["text"] for x in r["items"] if x["kind"] == "text")
        assert "".join(text.split()) == "".join(html_module.unescape(bare).split())
    assert media.interleave(pages.limit(0), ["page_id"]).count() == 0


def test_media_of_nothing_and_of_null_ids(spark, empty):
    payload = empty.select("doc_id", F.lit(b"x").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    features = media.store_features(spark, media.write_store(payload.select("digest", "payload")))
    assert features.count() == 0
    page = f"<img src='sha256:{'0' * 64}'><img src=x>"
    seq = media.interleave(spark.createDataFrame([(None, page), (None, page), (1, None)], "doc_id long, html string"), ["doc_id"])
    rows = media.resolve(seq, ["doc_id"], features).collect()
    assert len(rows) == 4 and not any(r.resolved for r in rows)
    assert media.resolve(media.interleave(empty.select("doc_id", F.col("text").alias("html")), ["doc_id"]), ["doc_id"], features).count() == 0


def test_media_round_trip(spark, docs):
    texts = texts_of(docs)
    payload = docs.select("doc_id", common.text_or_empty().cast("binary").alias("payload")).withColumn("digest", F.sha2(media.padded(F.col("payload")), 256))
    features = media.store_features(spark, media.write_store(payload.select("digest", "payload")))
    pages = payload.select("doc_id", F.concat(F.lit("<p>t</p><img src='sha256:"), "digest", F.lit("' alt='c'><img src='sha256:none'>")).alias("html"))
    seq = media.interleave(pages, ["doc_id"])
    rows = media.resolve(seq, ["doc_id"], features).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        if r.position == 1:
            raw = texts[r.doc_id].encode()
            full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            stored = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
            assert (r.media_bytes, r.media_sha256, r.resolved) == (len(stored), hashlib.sha256(stored).hexdigest(), True)
        else:
            assert r.position == 2 and not r.resolved and r.media_sha256 is None
    whole = media.assemble(seq, "doc_id", media.resolve(seq, ["doc_id"], features)).collect()
    assert all([i["position"] for i in r["items"]] == [0, 1, 2] and r["items"][1]["media_sha256"] for r in whole)


# --- 2 decontamination ------------------------------------------------------


def test_wand_finds_all_above_threshold():
    rng = random.Random(5)
    items = [(i, ". ".join(words(rng, 12) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    index = decontam.Index(items)
    for trial in range(40):
        parts = [items[rng.randrange(60)][1].split() for _ in range(3)]
        passage = sum((p[rng.randrange(len(p)):][:rng.randint(5, 60)] for p in parts), []) + words(rng, 20).split()
        numbers = index.term_numbers(decontam.tokenize(" ".join(passage)))
        terms = [int(t) for t in np.unique(numbers) if t < len(index.terms)]
        scores = collections.Counter()
        for t in terms:
            for p, w in zip(index.docs[t], index.impacts[t]):
                scores[p] += w
        for threshold in (0.05, 0.3, 0.5, 0.9):
            expect = {p for p, s in scores.items() if s >= threshold - 1e-9}
            assert {p for p, _ in index.search(terms, threshold)} == expect


def test_leaks_are_found_and_clean_documents_stay(spark, docs):
    rng = random.Random(9)
    items = [(i, f"{words(rng, 30)}. {words(rng, 8)}.") for i in range(20)] + [(90, None), (91, ""), (92, "too short")]
    items += [(93, f"{words(rng, 300)}. {words(rng, 20)}")]
    clean = [t for t in corpus()]
    leaky = [f"{words(rng, 200)} {items[3][1]} {words(rng, 30)}", items[7][1].upper(), f"{words(rng, 70)} {items[23][1]}"]
    leaky.append(" ".join("changed" if k == 4 else w for k, w in enumerate(items[5][1].split())))
    both = frame(spark, clean + leaky)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_matches(both, bench).collect()}
    n = len(clean)
    assert found == {(n, 3), (n + 1, 7), (n + 2, 93), (n + 3, 5)}
    kept = decontam.decontaminate(both, bench)
    assert kept.columns == both.columns and {r.doc_id for r in kept.collect()} == set(range(n))
    assert decontam.decontaminate(both, bench.limit(0)).count() == n + 4
    assert decontam.find_matches(both.limit(0), bench).count() == 0


def matches_by_force(items, text):
    """(place, score) of the items that a text holds: every window against every part, without an index."""
    split = [decontam.tokenize(t) for _, t in items]
    parts = [(k, p) for k, ws in enumerate(split) for p in decontam.parts_of(ws)]
    pairs = [list(zip(p, p[1:])) for _, p in parts]
    df = collections.Counter(x for p in pairs for x in set(p))
    mean = sum(map(len, pairs)) / max(1, len(pairs))
    idf = {x: np.log(1 + (len(pairs) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    own, best = decontam.tokenize(text), {}
    for k, ws in enumerate(split):
        if len(ws) == 1 and ws[0] in own:
            best[k] = 1.0
    for start in range(0, max(1, len(own) - decontam.WINDOW + decontam.STRIDE), decontam.STRIDE):
        held = set(zip(own[start:start + decontam.WINDOW + 1], own[start + 1:start + decontam.WINDOW + 1]))
        for (k, _), p in zip(parts, pairs):
            raw = {x: idf[x] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(p) / mean)) for x, f in collections.Counter(p).items()}
            score = sum(w for x, w in raw.items() if x in held) / sum(raw.values())
            if score < 0.5 - 1e-9:
                continue
            around = own[max(0, start - len(split[k])):start + 128 + len(split[k])]
            if len(split[k]) < 8:
                good = " ".join(split[k]) in [" ".join(around[i:i + len(split[k])]) for i in range(len(around))]
            else:
                good = all(decontam.coverage(part, around) >= 0.6 for part in decontam.question_answer(items[k][1]))
            if good:
                best[k] = max(best.get(k, 0), score)
    return best


@pytest.mark.parametrize("block", [20000, 3])
def test_every_item_is_indexed_whatever_its_size_and_id(spark, monkeypatch, block):
    rng = random.Random(14)
    long = [f"{words(rng, n)}. {words(rng, 5)}" for n in (9, 12, 30, 70, 140, 30)]
    items = [(1, "What is the capital of France? Paris."), (None, "Who wrote it? Nobody."), (1, long[0]), (1, long[1]), (None, long[2]), (None, long[2]),
             (7, long[3]), (8, long[4]), (9, "Quokka"), (10, "two tokens"), (11, "..."), (12, None), (13, ""), (14, long[5]), (15, "\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059\u304b\uff1f\u306f\u3044\u3002")]
    texts = [f"{words(rng, 20)} {t or ''} {words(rng, 150)}" for _, t in items] + [
        "what is the capital of France", "the capital of france paris what is", "a quokka, two  TOKENS!", "two other tokens", None, "", "x" * 5000,
        f"{words(rng, 9)} {' '.join(long[3].split()[:40])} {words(rng, 9)}", long[1] + " " + long[1], "\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd"]
    rows = frame(spark, texts).withColumn("item_id", F.lit(5)).withColumn("score", F.lit("x"))
    bench = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, doc_id int").repartition(3)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    got = collections.Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.find_matches(rows, bench).collect())
    expect = collections.Counter((d, items[k][0], round(s, 9)) for d, t in enumerate(texts) if t for k, s in matches_by_force(items, t).items())
    assert got == expect
    assert {(d, items[d][0]) for d in range(15) if d not in (10, 11, 12)} <= {k[:2] for k in got}
    kept = decontam.decontaminate(rows, bench)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k[0] for k in got}


def test_items_by_single_words_are_found_by_pairs():
    """Whatever single-word BM25 retrieves and the overlaps confirm, the pairs retrieve too."""
    rng = random.Random(15)
    bag = [words(rng, 1) for _ in range(300)]
    items = [(i, f"{' '.join(rng.choices(bag, k=rng.randint(10, 50)))}. {' '.join(rng.choices(bag, k=7))}") for i in range(40)]
    index, total, found = decontam.Index(items), 0, 0
    for _, t in items:
        for share in (0.02, 0.05, 0.1):
            ws = [w if rng.random() > share else "other" for w in t.split()]
            text = " ".join(rng.choices(bag, k=60) + ws + rng.choices(bag, k=60))
            own = decontam.tokenize(text)
            sure = {k for k, (_, i) in enumerate(items) if all(decontam.coverage(p, own) >= 0.6 for p in decontam.question_answer(i))}
            total, found = total + len(sure), found + len(sure & {m[0] for m in index.matches(text)})
    assert total > 60 and found == total


# --- 3 sharding -------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_balanced_and_slots_gapless(spark, hot):
    texts = corpus(3, 600) + (["hot copy of a text"] * 400 if hot else [])
    docs = frame(spark, texts)
    rows = sharding.shard_rows(docs, 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    by = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        by[r.shard].append(r)
    size = [sum(r["size"] for r in v) for v in by.values()]
    biggest = max(len((t or "").encode()) for t in texts)
    assert len(by) == 8 and max(size) - min(size) <= biggest
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    if not hot:
        where = collections.defaultdict(set)
        for r in rows:
            where[texts[r.doc_id] or ""].add(r.shard)
        assert all(len(v) == 1 for v in where.values())
    whole = sharding.shard_documents(docs, 8)
    assert whole.columns == [*[c for c in docs.columns if c != "shard"], "shard"]
    assert {(r.doc_id, r.shard) for r in whole.collect()} == {(r.doc_id, r.shard) for r in rows}


def test_sharding_of_nothing_and_of_null_ids(spark, empty):
    assert sharding.shard_rows(empty, 24).count() == 0
    twice = frame(spark, ["a", "b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sharding.shard_rows(twice, 3).count() == 2


# --- 4 personal data --------------------------------------------------------

NASTY = [
    "a@b.c_d@e.f .@x.y", "mail me: jo.e+x@mail.example.com, or A@B.C.D.", "x@y.z..w@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "+1 (702) 555-4777 +12 3 ++1-2-3-4-5-6-7-8-9 + 1",
    "é😀 +33 1 23 45 67 89 é a@é.b q@r.s 12345678901234567890123 378282246310005", "12.34.56.78901 1.1.1.1" + "9" * 3000 + " " + "1-" * 5000 + "2",
    "a" * 5000 + "@b.c" + ".d" * 4000, "ssn 123-45-6789 call (702) 555-4777 born 1990-03-12", None, "", "4" * 16, "0" * 12 + " " + "0 " * 10,
]
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= digits(m) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15),
]


def digits(m):
    return sum(c.isascii() and c.isdigit() for c in m)


def luhn(m):
    total = 0
    for i, c in enumerate(reversed([int(c) for c in m if c.isdigit()])):
        total += c if i % 2 == 0 else 2 * c - 9 * (c > 4)
    return total % 10 == 0


def base_spans(rules, text):
    out = []
    for k, (kind, rx, ok) in enumerate(rules):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(rx, text) if ok(m[0] if kind != "assign" else m)]
    return sorted(out)


def test_base_spans_of_personal_data(spark, docs):
    rows = frame(spark, NASTY + corpus())
    texts = texts_of(rows)
    found = pii.find_spans(rows, ["doc_id"]).collect()
    assert len(found) == len(texts)
    for r in found:
        own = [(s.start, s.kind_order, s.end, s.kind) for s in r.spans]
        assert [s for s in own if s[3] in pii.BASE] == base_spans(PII, texts[r.doc_id])
        assert own == sorted(own)


def test_scored_spans_and_redaction(spark):
    text = "my ssn 123-45-6789 mail jo@x.org, order 123-45-6789"
    rows = frame(spark, [text, None])
    found = {r.doc_id: r for r in pii.find_spans(rows, ["doc_id"]).collect()}
    assert ("national_id", 7, 18) in {(s.kind, s.start, s.end) for s in found[0].spans}
    assert ("national_id", 40, 51) not in {(s.kind, s.start, s.end) for s in found[0].spans}
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean == {0: "my ssn [national_id] mail [email], order 123-45-6789", 1: None}
    assert pii.redact(rows).columns == rows.columns and pii.find_spans(rows.limit(0), ["doc_id"]).count() == 0


#: Contexts that the training texts lack, in the languages of the documents.
PLANTED = {
    "iban": ["please transfer to my bank account {}", "Virement sur le compte {}", "Überweisung auf Konto {}", "ingreso en la cuenta {}", "{}"],
    "national_id": ["my social security number is {}", "numéro de sécurité sociale {}", "meine Sozialversicherungsnummer lautet {}", "mi número de seguridad social {}"],
    "local_phone": ["you can call {}", "mon téléphone est le {}", "mein Telefon {}", "su teléfono {}", "{}"],
    "masked_email": ["send a mail to {}", "par courriel à {}", "Kontakt über {}", "mi correo {}", "{}"],
    "birth_date": ["he was born on {}", "elle est née le {}", "geboren am {}", "nacido en Madrid el {}"],
}
DECOYS = {
    "iban": ["serial code {}", "référence produit {}", "Seriennummer {}"], "national_id": ["invoice number {}", "facture numéro {}", "Rechnung {}", "pedido {}"],
    "local_phone": ["build version {}", "numéro de lot {}", "Rechnung {}"], "masked_email": ["she looked {}", "il regarda {}", "er sah {}"],
    "birth_date": ["last updated {}", "document publié le {}", "veröffentlicht am {}", "actualizado el {}", "since {}"],
}


def planted_values(kind, good, rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "iban":
        return pii.account(rng) if good else f"QX{d(2)}" + "".join(rng.choice("ABCDEFG0123456789") for _ in range(14))
    if kind == "national_id":
        return f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "local_phone":
        return f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{d(4)}" if good else f"0{d(2)}.{d(3)}.{d(4)}"
    if kind == "masked_email":
        return "jo.doe [at] example [dot] org" if good else "it (at) home. then"
    return f"{rng.randint(1930, 2005) if good else rng.randint(2015, 2025)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"


def test_precision_and_recall_of_each_kind_on_the_documents(spark):
    rng = random.Random(77)
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and n_chars > 200 and text not rlike '[0-9]'").orderBy("doc_id").limit(400).collect()]
    rows, truth = [], []
    for i in range(1200):
        kind, good = rng.choice(sorted(PLANTED)), rng.random() < 0.5
        value = planted_values(kind, good, rng)
        base = rng.choice(prose)
        cut = base.find(" ", rng.randint(0, len(base) - 100)) + 1
        said = rng.choice((PLANTED if good else DECOYS)[kind])
        head = base[:cut] + said[:said.index("{}")]
        rows.append((i, head + value + said[said.index("{}") + 2:] + " " + base[cut:]))
        truth.append((kind, good, len(head), len(head) + len(value)))
    found = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    figures = {}
    for kind in sorted(PLANTED):
        hits = [(good, (kind, a, b) in found[i]) for i, (k, good, a, b) in enumerate(truth) if k == kind]
        figures[kind] = (round(sum(g and h for g, h in hits) / max(1, sum(h for _, h in hits)), 3), round(sum(g and h for g, h in hits) / sum(g for g, _ in hits), 3), len(hits))
    print(figures)
    assert all(p >= 0.9 and r >= 0.8 for p, r, _ in figures.values()), figures


@pytest.mark.parametrize("text, span", [
    ("my ssn 123-45-6789", ("national_id", 7, 18)), ("numéro de sécurité sociale 123-45-6789", ("national_id", 27, 38)), ("he was born 1990-03-12", ("birth_date", 12, 22)),
    ("né le 1990-03-12", ("birth_date", 6, 16)), ("geboren am 1990-03-12", ("birth_date", 11, 21)), ("IBAN DE89370400440532013000 Please", ("iban", 5, 27)),
    ("compte DE89 3704 0044 0532 0130 00 Merci", ("iban", 7, 34)), ("mail " + "a" * 90 + " [at] example [dot] org", ("masked_email", 5, 118)),
])
def test_kinds_in_several_languages(spark, text, span):
    got = pii.find_spans(spark.createDataFrame([(0, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert span in {(s.kind, s.start, s.end) for s in got.spans}


def test_very_many_spans_in_one_text(spark):
    text = "é a@b.cd 1.2.3.4, " * 20000
    got = pii.find_spans(spark.createDataFrame([(0, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert [(s.start, s.end, s.kind) for s in got.spans] == [x for i in range(20000) for x in ((18 * i + 2, 18 * i + 8, "email"), (18 * i + 9, 18 * i + 16, "ip"))]


def test_overlapping_spans_are_redacted_once(spark):
    rows = frame(spark, ["call +1 (702) 555-4777 now", "mail a@b.cd,e@f.gh born 1990-03-12"])
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_spans(rows, ["doc_id"]).collect()}
    assert spans[0] == [("phone", 5, 22), ("local_phone", 8, 22)]
    assert {r.doc_id: r.text for r in pii.redact(rows).collect()} == {0: "call [phone] now", 1: "mail [email],[email] born [birth_date]"}


def test_account_sums(spark):
    rng = random.Random(1)
    rows = [(pii.account(rng), True) for _ in range(50)] + [("DE89370400440532013001", False), ("GB82WEST12345698765432", True), ("GB82WEST12345698765433", False)]
    got = spark.createDataFrame(rows, "v string, good boolean").select("good", (pii.mod97(F.col("v")) == 1).alias("ok")).collect()
    assert all(r.good == r.ok for r in got)


# --- 5 secrets --------------------------------------------------------------

SECRETS = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m) >= 32),
]


def test_secrets_against_brute_force(spark):
    texts = [
        'PassWord = "abcdefgh1" token:short Api_Key="0123456789abcdef0123456789abcdef"', "AKIA" + "B" * 12 + " AKIAB xAKIA" + "9" * 16, "é😀 secret=é passwd:'12345678'",
        "f" * 31 + " " + "f" * 32 + "g" + "0" * 40, "tok", "en=", None, "", "ſecret=12345678 toKen=12345678", "secret: secret: abcdefgh", "passwo" + "rd==longvalue", "a" * 20000,
    ] + corpus()
    rows = frame(spark, texts)
    for r in secretscan.scan(rows).collect():
        own = [(s.start, s.kind_order, s.end, s.kind) for s in r.spans]
        assert [s for s in own if s[3] in ("assign", "access", "hex")] == base_spans(SECRETS, texts[r.doc_id] or "")
    assert secretscan.scan(rows.limit(0)).count() == 0


def test_secrets_of_null_and_repeated_ids(spark):
    text = "token=abcdefgh1"
    rows = spark.createDataFrame([(None, text), (None, None), (5, text), (5, "x"), (5, text)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, len(r.spans)) for r in secretscan.scan(rows).collect())
    assert got == collections.Counter({(None, 1): 1, (None, 0): 1, (5, 1): 2, (5, 0): 1})


def test_every_rule_against_plain_matching(spark):
    rules = secretscan.RULES + [secretscan.Rule("dotted", "é.{2}[0-9]+", 0, 0, 6), secretscan.Rule("run", "[A-Z]+", 0, 0, 50)]
    texts = [f"{head} gh{c}_{'aB3' * 20}"[:len(head) + 1 + n] + tail for c in "pousr" for n in (39, 40, 43, 44) for head, tail in (("key", " end"), ("é", ""))]
    texts += ["ééa12345", "é😀é123", "Z" * 49, "Z" * 50, None, "", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "AIza" + "x" * 35]
    found = {r.doc_id: [(s.start, s.kind_order, s.end, s.kind) for s in r.spans] for r in secretscan.scan(frame(spark, texts), rules).collect()}
    for i, t in enumerate(texts):
        plain = [(m.start(), k, m.end(), r.kind) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t or "", r.flags | re.ASCII) if len(m[r.group]) >= r.least]
        assert found[i] == sorted(plain)
    assert sum(s[3] == "forge" for x in found.values() for s in x) == 30


def test_trigram_queries_are_necessary_conditions():
    assert secretscan.trigram_query("[0-9a-f]+") == secretscan.ANY
    assert secretscan.trigrams(secretscan.trigram_query("AKIA[A-Z0-9]+")) == {"aki", "kia"}
    assert secretscan.trigram_query("(abc)?x*") == secretscan.ANY
    query = secretscan.trigram_query("(?:foo|ba[rz]s)q+")
    assert query[0] == "or" or query[0] == "and"
    index = secretscan.Index(secretscan.RULES)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["secret", "pass", "word", "=", "AKIA", "Z9", " ", "eyJabcdefgh.", "tok", "en", "aaaa", "1" * 9]) for _ in range(12))
        import pyarrow as pa

        spans = index.spans(pa.array([text, text + "x"]))
        plain = [(m.start(), k, m.end(), r.kind) for k, (r, rx, _) in enumerate(index.rules) for m in rx.finditer(text) if len(m[r.group]) >= r.least]
        assert spans[0] == sorted(plain)


# --- 6 substrings -----------------------------------------------------------


def removed_by_force(texts, ids):
    first = {}
    split = [(t or "").encode().split() for t in texts]
    for i, w in sorted(zip(ids, split), key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    out = []
    for i, w in zip(ids, split):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def pieces_by_force(texts):
    """Pieces of nonbranching paths per document, from the graph of all repeated windows of distinct documents 0, 1, ..."""
    split = [(t or "").encode().split() for t in texts]
    starts = collections.defaultdict(list)
    for i, w in enumerate(split):
        for k in range(len(w) - 12):
            starts[tuple(w[k:k + 13])].append((i, k))
    repeated = {e: min(at) for e, at in starts.items() if len({i for i, _ in at}) > 1}
    enters, leaves = collections.defaultdict(set), collections.defaultdict(set)
    for e in repeated:
        leaves[e[:-1]].add(e)
        enters[e[1:]].add(e)
    out = []
    for i, w in enumerate(split):
        n, last = 0, None
        for k in range(len(w) - 12):
            e = tuple(w[k:k + 13])
            source = repeated.get(e)
            if source is None or source[0] >= i:
                last = None
                continue
            node = e[:-1]
            n += not (last == (source[0], source[1] - 1) and len(enters[node]) == 1 and len(leaves[node]) == 1)
            last = source
        out.append(n)
    return out


def test_substrings_against_brute_force(spark, docs, empty, monkeypatch):
    texts = corpus(4, 80)
    rng = random.Random(8)
    loop = words(rng, 13)
    texts += [" ".join([loop] * 5), loop, loop + " tail", " ".join(["same"] * 60), " ".join(["same"] * 20)]
    shared = words(rng, 50).split()
    texts += [" ".join(shared[:a] + words(rng, 4).split() + shared[b:]) for a, b in ((30, 30), (20, 25), (50, 50), (0, 0), (40, 10))]
    rows = frame(spark, texts)
    for size in (substring.CHUNK_BYTES, 2000):
        monkeypatch.setattr(substring, "CHUNK_BYTES", size)
        monkeypatch.setattr(substring, "BUCKET_BYTES", size)
        got = substring.remove_repeats(rows).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed_by_force(texts, range(len(texts)))
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
        assert [r.n_segments for r in sorted(got)] == pieces_by_force(texts)
    assert substring.remove_repeats(empty).count() == 0


def test_edges_of_equal_hashes_are_told_apart(monkeypatch):
    """With 64-bit hashes cut to a few bits the check still decides."""
    monkeypatch.setattr(substring, "mixed", lambda x, plain=substring.mixed: plain(x) & np.uint64(0xFF))
    monkeypatch.setattr(substring.Tokens, "checks", lambda self, at, k: np.array([zlib.crc32(b" ".join(self.split(int(self.doc[i]))[int(i - self.first[self.doc[i]]):][:k])) for i in at], dtype=np.uint32))
    rng = random.Random(5)
    texts = [words(rng, 40).encode() for _ in range(4)]
    texts.append(texts[1])
    tokens = substring.Tokens(texts)
    own = np.flatnonzero(tokens.doc[:len(tokens.word) - 12] == tokens.doc[12:])
    own = own[tokens.doc[own] < 4].astype(np.int32)
    repeated = own, np.zeros(len(own), np.int32), own, np.zeros(len(own), bool)
    at, edges, home, there = substring.repeated_paths(np.arange(5), tokens, repeated, np.empty(0, np.uint64), 4)
    assert edges.sum() == 28 and (there == at - (tokens.first[4] - tokens.first[1])).all() and (tokens.doc[at] == 4).all()


def test_substrings_of_repeated_and_null_ids(spark):
    text = words(random.Random(1), 30)
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in substring.remove_repeats(rows).collect()}
    assert got == {(5, 0), (9, 30), (None, 30)}


# --- 7 WARC -----------------------------------------------------------------


def test_warc_round_trip_rejects_magic_in_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>é</p>", None, "", "same", "same", inner, inner * 3 + "x", "WARC/1.1\r\n", "a\r\n\r\n" * 5, "", "same"]
    rows = spark.createDataFrame([(i, f"http://x/{i}\r\ny" if i % 2 else None, h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, payload_bytes int").repartition(3)
    got = sorted(warc.round_trip(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    expect = []
    for i, h in enumerate(html):
        raw = (h or "").encode()
        f = first[h or ""]
        expect.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert [tuple(r) for r in got] == expect
    assert warc.round_trip(rows.limit(0)).count() == 0


def test_files_are_bounded_and_damage_is_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 1 << 13)
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 15)
    html = ["a" * 100] + [f"{i}" * 3000 for i in range(9)] + [chr(97 + i) * 40000 for i in range(3)] + [None, "z" * 200000]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)] + [(None, None, "n" * 10)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write(pages, path)
    files = sorted((tmp_path / "w").glob("part-*"))
    data = {f.name: warc.unzipped(f.read_bytes()) for f in files}
    counts = {n: x.count(b"WARC/1.1\r\n") for n, x in data.items()}
    assert sum(counts.values()) == 16 and all(len(x) <= 1 << 15 or counts[n] == 1 for n, x in data.items())
    got = warc.read(spark, path)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got.collect()) == sorted((i >= 15, i if i < 15 else 0, len(h or "")) for i, h in enumerate([*html, "n" * 10]))
    assert warc.damage(spark, path).count() == 0
    big = max(files, key=lambda f: counts[f.name])
    whole, starts = data[big.name], [m.start() for m in re.finditer(b"WARC/1.1\r\n", data[big.name])]
    broken = whole[:starts[2] + 5] + b"?" + whole[starts[2] + 6:]
    other = tmp_path / "broken"
    other.mkdir()
    (other / "x.gz").write_bytes(gzip.compress(broken))
    (other / "y.gz").write_bytes(gzip.compress(b"no archive"))
    assert warc.read(spark, str(other)).count() == 2
    assert sorted((r.file[-4:], r.position, r.successor) for r in warc.damage(spark, str(other)).collect()) == [("x.gz", starts[2], len(whole)), ("y.gz", 0, 10)]


def test_pointer_jumping():
    position, successor = np.array([0, 5, 10, 12, 40]), np.array([10, 9, 40, 40, 99])
    assert warc.reachable(position, successor).tolist() == [True, False, True, False, True]
    assert warc.reachable(np.array([], dtype=int), np.array([], dtype=int)).tolist() == []
    assert warc.unzipped(gzip.compress(b"ab") + gzip.compress(b"c")) == b"abc"


# --- 8 SimHash --------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    made = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in made) > len(made))


def force_components(points, radius):
    points = sorted(set(points))
    label = {p: p for p in points}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_simhash_components_against_brute_force(spark, docs, empty):
    texts = texts_of(docs)
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = force_components(fps.values(), 4)
    smallest = {}
    for i, f in fps.items():
        smallest[root[f]] = min(i, smallest.get(root[f], i))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fp % (1 << 64) == fps[r.doc_id] and r.component_id == smallest[root[fps[r.doc_id]]]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_similar_documents_go_and_others_stay(spark, docs):
    rng = random.Random(12)
    texts = [words(rng, rng.randint(60, 300)) for _ in range(80)]
    near, far = [], []
    for t in texts[:40]:
        w = t.split()
        for k in rng.sample(range(5, len(w) - 5), max(1, len(w) // 120)):
            w[k] = "other"
        near.append(" ".join(w))
    for t in texts[40:]:
        far.append(" ".join(t.split()[: len(t.split()) // 2]) + " " + words(rng, 100))
    rows = frame(spark, texts + near + far + texts[:5] + [None, "", "  "])
    kept = simhash.deduplicate(rows)
    got = {r.doc_id for r in kept.collect()}
    assert kept.columns == rows.columns
    shingles = lambda t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}
    similarity = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    expect_gone = {80 + i for i in range(40) if similarity(texts[i], near[i]) >= 0.85}
    assert len(expect_gone) > 25 and not got & expect_gone
    assert set(range(80)) <= got and set(range(120, 160)) <= got and got & set(range(160, 170)) == {165}


def test_many_copies_that_only_the_original_links(spark):
    rng = random.Random(31)
    base = [f"w{rng.getrandbits(40)}" for _ in range(304)]
    copies = []
    for i in range(300):
        w = list(base)
        for j, k in enumerate(sorted(rng.sample(range(1, 60), 6))):
            w[k * 5 - 1] = f"edit{i}_{j}"
        copies.append(" ".join(w))
    got = simhash.similar(frame(spark, [" ".join(base)] + copies)).collect()
    assert len(got) == 301 and sum(r.component_id == 0 for r in got) >= 298


def test_pairs_just_under_the_similarity_are_no_rows(spark, monkeypatch):
    """In a group all of whose pairs must be compared, no table grows with the pairs; any blocks give the same."""
    rng, base, texts = random.Random(4), [f"w{i}" for i in range(600)], []
    for i in range(80):
        words = list(base)
        for at in rng.sample(range(600), 8):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    texts += [t.replace("w300 w301", "w300 y") for t in texts[:20]]  # linked with their originals
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    alike = {(i, j): simhash.jaccard(sets[i], sets[j]) for i in range(100) for j in range(i)}
    assert sum(0.74 < x < 0.8 for x in alike.values()) > 3000
    root = list(range(100))
    for _ in range(100):
        for (i, j), x in alike.items():
            if x >= 0.8:
                root[i] = root[j] = min(root[i], root[j])
    written, plain = [], simhash.materialize

    def count(df, name, **kw):
        made = plain(df, name, **kw)
        written.append((made.count(), name))
        return made

    monkeypatch.setattr(simhash, "materialize", count)
    for block in (2048, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.similar(frame(spark, texts)).collect()
        assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == [root[i] for i in range(100)]
    assert max(written)[0] < 2000, max(written)  # the nominated pairs: one partner a point and sample


def test_block_links_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    sets = [np.unique(np.r_[np.arange(40)[rng.random(40) < 0.85], rng.integers(1000, 1004, 2)]).astype(np.uint64) for _ in range(60)]
    nodes, labels, side, none = rng.permutation(60), rng.integers(0, 200, 60), rng.integers(0, 2, 60), np.zeros((60, 1), np.uint64)
    for alone in (True, False):
        a, b = simhash.block_links(np.zeros(60, np.int64), nodes, labels, side, np.full(60, alone), none, sets, 0, 0.8)
        like = [(i, j) for i in range(60) for j in range(i) if labels[i] == labels[j] or ((alone or side[i] != side[j]) and simhash.jaccard(sets[i], sets[j]) >= 0.8)]
        same = [(i, j) for i in range(60) for j in range(i) if labels[i] == labels[j]]
        at = {x: i for i, x in enumerate(nodes.tolist())}
        found = same + [(at[x], at[y]) for x, y in zip(a.tolist(), b.tolist())]
        parts = []
        for edges in (like, found):
            root = list(range(60))
            for _ in range(60):
                for i, j in edges:
                    root[i] = root[j] = min(root[i], root[j])
            parts.append(root)
        assert parts[0] == parts[1] and len(a) and len(set(parts[0])) > 1


def test_open_pairs_are_all_near_pairs_of_two_labels():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    wide = np.stack([base ^ np.packbits(rng.random(512) < 0.1).view(np.uint64) for _ in range(60)])
    nodes, labels, keys = np.arange(60), rng.integers(0, 5, 60), np.repeat([1, 2, 3], [30, 29, 1])
    bits = lambda a, b: int(np.bitwise_count(a ^ b).sum())
    near = {(i, j) for i in range(60) for j in range(i) if keys[i] == keys[j] and labels[i] != labels[j] and bits(wide[i], wide[j]) <= 90}
    assert {tuple(x) for x in simhash.open_pairs(keys, nodes, labels, wide, 90).tolist()} == near and near
    a, b, left = simhash.nominated(keys, nodes, wide, labels, 90)
    paired = {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert paired <= near and set(left.tolist()) == {x for pair in near - paired for x in pair}


def test_samples_follow_from_the_points_and_meet_pairs_of_the_similarity():
    assert [simhash.sampling(n, 0.8) for n in (0, 200_000, 10**6, 10**10)] == [(10, 33), (10, 33), (12, 47), (26, 491)]
    rng = np.random.default_rng(8)
    for points in (1000, 10**7):
        bits, tables = simhash.sampling(points, 0.8)
        met = 0
        for _ in range(150):
            fp = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
            other = fp ^ np.packbits(rng.random(512) < simhash.differing(0.8)).view(np.uint64)
            keys = simhash.sampled_keys(np.stack([fp, other]), bits, tables)
            met += bool((keys[0] == keys[1]).any())
        assert met >= 148
    text = " ".join(f"w{i}" for i in range(400)).encode()
    other = text.replace(b"w200 ", b"x ")
    a, b = (simhash.signature(simhash.shingle_digests(t, 5), 32) for t in (text, other))
    share = simhash.differing(391 / 401)
    assert abs(int(simhash.differ(a, b)) - 2048 * share) < 6 * np.sqrt(2048 * share)
    assert (simhash.signature(simhash.shingle_digests(text, 5), 8) == a[:8]).all()


def test_short_texts_are_compared_exactly(spark):
    rng = random.Random(32)
    texts = [" ".join(f"s{rng.getrandbits(30)}" for _ in range(rng.choice([8, 8, 9, 13, 18]))) for _ in range(60)]
    rows = frame(spark, texts + [t + " more" for t in texts] + ["a", "a b", None, ""])
    got = {r.doc_id: r.component_id for r in simhash.similar(rows).collect()}
    assert all(got[i] == got[60 + i] == i for i in range(60)) and [got[120 + i] for i in range(4)] == [120, 121, 122, 122]
    few = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in few]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    small = spark.createDataFrame([(i, bytearray(simhash.shingle_set(t.encode(), 5).tobytes())) for i, t in enumerate(few)], "fp long, shingles binary")
    edges = [(r.a, r.b) for r in simhash.small_links(small, 0.8).collect()]
    found = list(range(150))
    for i, j in edges:
        found = [min(found[i], found[j]) if r in (found[i], found[j]) else r for r in found]
    assert found == root and edges


def test_links_of_dense_and_chained_points(spark):
    rng = random.Random(6)
    points = [rng.getrandbits(64) for _ in range(300)]
    center = rng.getrandbits(64)
    points += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)]
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        points.append(chain)
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(points)], "doc_id long, fp long")
    root = force_components(points, 4)
    smallest = {}
    for i, p in enumerate(points):
        smallest[root[p]] = min(i, smallest.get(root[p], i))
    got = {r.fp % (1 << 64): r.component_id for r in simhash.classes(rows).collect()}
    assert got == {p: smallest[root[p]] for p in points}
    own = np.array(sorted(set(points)), dtype=np.uint64)
    a, b = simhash.shard_links(own, 4)
    assert {int(x): int(y) for x, y in zip(a, b)} == {p: r for p, r in root.items() if p != r}


def test_components_of_null_and_repeated_ids(spark):
    a, b, c = (words(random.Random(i), 40) for i in range(3))
    rows = spark.createDataFrame([(None, a), (9, a), (4, a.replace(" ", "\n")), (None, b), (None, b), (7, c), (7, c), (7, None), (2, ""), (None, "  ")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == collections.Counter({(None, 4): 1, (9, 4): 1, (4, 4): 1, (None, None): 2, (7, 7): 2, (7, 2): 1, (2, 2): 1, (None, 2): 1})


def test_trees_hold_the_points_and_find_all_links(spark):
    """On a whole table: the links come through trees, and equal those of all pairs."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = sorted({r.fp % (1 << 64) for r in simhash.fingerprints(table, ["doc_id"]).select("fp").collect()})
    own = np.array(fps, dtype=np.uint64)
    masks = simhash.shard_masks(4, len(own))
    assert len(masks) == 5
    inner = outer = 0
    for m in masks:
        keys = own & np.uint64(m)
        for key in np.unique(keys):
            tree = simhash.Tree(own, np.flatnonzero(keys == key), 4)
            inner, outer = inner + tree.nodes(), outer + (len(tree.own) if not tree.sides else 0)
    assert inner > 2000 and outer == 0
    pairs = []
    for i in range(len(own)):
        near = i + 1 + np.flatnonzero(simhash.distance(own[i + 1:], own[i]) <= 4)
        pairs += [(i, j) for j in near.tolist()]
    label = list(range(len(own)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    points = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in fps], "fp long")
    place = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(fps)}
    got = list(range(len(own)))
    edges = [(place[r.a], place[r.b]) for r in simhash.links(points).collect()]
    assert all(find(a) == find(b) for a, b in edges)
    truth, label = [find(i) for i in range(len(own))], got
    for i, j in edges:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(own))] == truth and len(pairs) >= 10


@pytest.mark.parametrize("points", [1, 2048, 100_000, 10**7, 10**10])
def test_blocks_follow_from_the_points(points):
    rng = random.Random(points)
    masks = simhash.shard_masks(4, points)
    fixed = min(bin(m).count("1") for m in masks)
    assert points / 2**fixed <= simhash.SHARD
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 4))
        assert any(x & m == y & m for m in masks)


def test_near_duplicates_without_or_with_equal_ids(spark):
    rng = random.Random(33)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(5, a), (5, b), (3, b), (None, a), (None, c), (None, c), (None, c + " more"), (7, d), (7, d), (8, ''.join(c.upper() if c.isascii() else c for c in d)), (None, None), (None, ""), (9, None)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, _key string, _id int, n int").repartition(3)
    kept = simhash.deduplicate(df)
    got = collections.Counter((r.doc_id, (r.text or "")[:20]) for r in kept.collect())
    assert kept.columns == df.columns
    same = [(5, a[:20]), (3, b[:20]), (None, c[:20]), (7, d[:20]), (9, "")]
    assert got == collections.Counter({x: 2 if x[0] == 7 else 1 for x in same})


# --- 9 mixing ---------------------------------------------------------------


def test_poisson_counts_and_shares(spark, docs, empty):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, words(rng, 3), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)], "doc_id long, text string, source string")
    mixed = mixing.mix(rows, weights={"hot": 1.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0}).collect()
    share = collections.Counter(r.source for r in mixed)
    assert all(abs(share[s] / 600 - 1) < 0.15 for s in ("hot", "s0", "s1", "s2", "s3"))
    counts = collections.Counter(r.doc_id for r in mixed)
    rate = {r.source: r.rate for r in mixed}
    for i in range(0, 3000, 7):
        source = "hot" if i % 3 else f"s{i % 4}"
        u = int(hashlib.md5(f"mix-1:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = float(np.exp(-rate[source]))
        k = 0
        while c <= u:
            k += 1
            p *= rate[source] / k
            c += p
        assert counts.get(i, 0) == k
    again = mixing.mix(rows.repartition(7), weights={"hot": 1.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0})
    assert collections.Counter(r.doc_id for r in again.collect()) == counts
    assert mixing.mix(empty).count() == 0
    assert set(mixing.mix(docs).columns) == {*docs.columns, "copy", "mix_rate", "mix_key"}
    rare = spark.createDataFrame([(0, "a", "r")] + [(i, "b", "c") for i in range(1, 2001)], "doc_id long, text string, source string")
    assert abs(mixing.mix(rare, weights={"r": 1.0, "c": 1.0}).where("source = 'r'").count() - 1000) < 150


# --- 10 quality -------------------------------------------------------------


def labelled(spark, n=900):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        t = words(rng, rng.randint(20, 90))
        if bad:
            t = rng.choice([t.upper().replace(" ", "!! "), " | ".join(t.split()), " ".join([t.split()[0]] * 60), t.replace(" ", "### ")])
        rows.append((i, t, bad))
        marks.append((i, int(not bad), 0))
    docs = frame(spark, [t for _, t, _ in rows] + [None, ""])
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), [b for _, _, b in rows]


def test_quality_on_held_out_rows(spark, empty):
    docs, labels, bad = labelled(spark)
    got = quality.score(docs, labels, ["doc_id"]).collect()
    assert len(got) == len(bad) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    rest = [r for r in got if r.held_out and r.doc_id < len(bad)]
    assert np.mean([r.predicted == int(not bad[r.doc_id]) for r in rest]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    none = quality.score(docs, labels.limit(0), ["doc_id"]).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.score(empty, labels, ["doc_id"]).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score(docs, labels, ["doc_id"]).collect()}
    assert a == {r.doc_id: r.score for r in quality.score(docs, flipped, ["doc_id"]).collect()}
