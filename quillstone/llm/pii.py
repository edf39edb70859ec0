"""Personal data: high-recall generators, boosted trees, calibrated redactions.

Generators propose spans, which may overlap.  The four base kinds (email, ip,
card, phone) are decided by their formats alone and always stay.  The further
kinds come from looser generators; gradient-boosted trees score each candidate
on its format and its context, and a span is selected where its score reaches
the threshold calibrated for its kind.  The trees are compiled to CASE WHEN.

Format means shares of characters and the kind's own check (the mod-97 sum of an
account, the ranges of an identity number or a phone, a real date).  Context
means what stands beside the candidate, and a learned weight of each word before it:
log-odds of the words of the training contexts, not a list in a pattern.

Native: column expressions only, no shuffle, whole texts.  A span's start is
the summed length of the gaps and matches before it, so positions are exact in
code points; the sums run over blocks of matches, so a text of very many spans
costs hardly more than its length.  Patterns use possessive quantifiers and guards at the start of a
run, so a very long run of digits or letters costs linear time and no stack.

There are no labelled spans, so the model is fitted on the driver on ``TRAIN``
synthetic candidates with a fixed seed, in contexts of five languages: a third
teaches the word weights, a third the trees, a third the thresholds.  Tests
measure precision and recall per kind on planted spans in the given documents.

Null text counts as empty and has no spans; repeated rows get equal results;
``doc_id`` may be null or repeated, as rows are never matched by it.  An empty
table gives an empty one.  ``find_spans`` returns the columns of ``keep`` and
``spans``; ``redact`` keeps columns of any name.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import rules as R
from quillstone.llm.common import text_or_empty

#: Bound on the synthetic training candidates.
TRAIN = 6000
TREES, DEPTH = 24, 3
#: Precision at which each kind's threshold is set on candidates that nothing else was fitted on.
PRECISION = 0.97
#: Characters of context on each side; matches whose lengths are summed at once.
CONTEXT, BLOCK = 40, 256

# Fixed formats. An atom guarded by \G or a lookbehind starts only where a run starts or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

BASE = ["email", "ip", "card", "phone"]
#: Looser generators: kind, pattern, a substring pattern that any match contains.
LOOSE = [
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("local_phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("masked_email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?i:dot)[\])]|\.)\x20?[A-Za-z0-9-]{2,}+){1,3}", r"[\[(](?i:at)[\])]"),
    ("birth_date", r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])", r"(?:19|20)[0-9]{2}-[01][0-9]-"),
]
ORDER = BASE + [kind for kind, _, _ in LOOSE]
FEATURES = ["kind", "length", "digits", "letters", "luhn", "valid", "words", "marked", "glued", "zeros", "first", "year", "address_near", "digits_before"]


def candidates(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, end, value, before, after>> of the leftmost non-overlapping matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(values)
    heads = F.zip_with(values, F.slice(gaps, F.lit(1), n), lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before")))
    parts = F.zip_with(heads, F.slice(gaps, F.lit(2), n), lambda a, g: F.struct(a["value"].alias("value"), a["gap"].alias("gap"), a["before"].alias("before"), F.left(g, F.lit(CONTEXT)).alias("after")))
    kind = "struct<at:int,found:array<struct<start:int,end:int,value:string,before:string,after:string>>>"

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found")).cast(kind)

    def placed(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), F.array().alias("found")).cast(kind), step, lambda a: a["found"])

    def in_blocks(all_parts):
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_parts) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(all_parts, i + 1, F.lit(BLOCK)))
        length = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["value"]))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, _starts(F.transform(b, length)), placed)))

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(kind)["found"]
    return F.when(gate, _let(parts, in_blocks)).otherwise(empty)


def _let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once."""
    return F.element_at(F.transform(F.array(c), body), 1)


def _starts(lengths: Column) -> Column:
    """Where each block starts."""
    sums = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.slice(sums, F.lit(1), F.size(lengths))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    d = F.reverse(_digits(value))

    def weigh(i):
        x = F.substring(d, i, F.lit(1)).try_cast("int")
        twice = x * 2
        return F.when(i % 2 == 1, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))
    return F.coalesce(F.aggregate(places, F.lit(0), lambda a, i: a + F.coalesce(weigh(i), F.lit(0))) % 10 == 0, F.lit(False))


def base_candidates(text: Column, digit: Column) -> dict[str, Column]:
    """Candidates of the base kinds; ``digit`` tells whether the text has one, so that the others are passed over at once."""
    digit_count = lambda s: F.length(_digits(s["value"]))
    found = {
        "email": candidates(text, EMAIL, text.contains("@")),
        "ip": F.filter(candidates(text, IP, digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(candidates(text, CARD, digit & text.rlike(CARD)), lambda s: luhn(s["value"])),
        "phone": F.filter(candidates(text, PHONE, digit & text.contains("+")), lambda s: digit_count(s).between(9, 15)),
    }
    return found


def mod97(value: Column) -> Column:
    """The mod-97 sum of an account number; 1 if it is sound."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4)), "")
    number = lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97))


def sound(kind: int, value: Column) -> Column:
    """The kind's own check."""
    name = LOOSE[kind][0]
    if name == "iban":
        return mod97(value) == 1
    if name == "national_id":
        return value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    if name == "local_phone":
        return _digits(value).rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    if name == "masked_email":
        return value.rlike(r"(?i)(?:[\[(]dot[\])]|\.)\x20?[a-z]{2,6}$")
    return value.try_cast("date").isNotNull()


def features(kind: int, s: Column, weights: dict[str, float]) -> Column:
    value, before, after = s["value"], s["before"], s["after"]
    digits = _digits(value)
    n = F.length(value).cast("double")
    words = F.split(F.lower(before), r"[^\p{L}]++")
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else None
    score = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(table, w), F.lit(0.0))) if weights else F.lit(0.0)
    columns = [
        F.lit(float(kind)), n, F.length(digits) / n, F.length(F.regexp_replace(value, "[^A-Za-z]", "")) / n, luhn(value), F.coalesce(sound(kind, value), F.lit(False)),
        score, before.rlike(r"[:=#(]\x20*$"), before.rlike("[A-Za-z0-9_/.-]$") | after.rlike("^[A-Za-z0-9_/]"),
        (F.length(digits) - F.length(F.regexp_replace(digits, "0", ""))) / n, F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)),
        F.coalesce(F.substring(value, 1, 4).try_cast("double"), F.lit(0.0)), F.concat(before, after).contains("@"), F.length(_digits(before)),
    ]
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[c.cast("double").alias(f) for f, c in zip(FEATURES, columns)])


def loose_candidates(text: Column, weights: list[dict[str, float]], digit: Column) -> dict[str, Column]:
    scored = lambda i: lambda s: features(i, s, weights[i])
    gates = [text.rlike(gate) if kind == "masked_email" else digit & text.rlike(gate) for kind, _, gate in LOOSE]
    return {kind: F.transform(candidates(text, p, gate), scored(i)) for i, ((kind, p, _), gate) in enumerate(zip(LOOSE, gates))}


#: Training contexts: what people write before data of a kind, and before what only looks like it.
CONTEXTS = {
    "iban": ("iban|account|bank account|compte|compte bancaire|rib|konto|kontonummer|bankverbindung|cuenta|cuenta bancaria|conto|rekening", "serial|model|sku|lot|série|modèle|référence|seriennummer|artikel|serie|modelo|pieza|matricola"),
    "national_id": ("ssn|social security|social security number|tax id|sécurité sociale|numéro de sécurité sociale|numéro fiscal|sozialversicherungsnummer|steuernummer|seguridad social|número de identidad|codice fiscale", "order|invoice|part|ref|commande|facture|pièce|bestellung|rechnung|teil|pedido|factura|ordine|fattura"),
    "local_phone": ("call|tel|phone|mobile|call me at|téléphone|appelez|portable|appeler le|telefon|handy|rufen sie|teléfono|llame al|móvil|telefono|chiamare", "version|build|part|invoice|isbn|lot|facture|pièce|teil|rechnung|versión|pieza|factura|versione"),
    "masked_email": ("mail|contact|write to|email|courriel|écrire à|contactez|schreiben an|kontakt|correo|escriba a|contacto|scrivere a|posta", "looked|sat|stayed|regarda|resta|dort|sah|blieb|miró|estaba|guardò|rimase"),
    "birth_date": ("born|dob|birthday|date of birth|born on|né le|née le|date de naissance|geboren|geboren am|geburtsdatum|nacido el|nacida el|fecha de nacimiento|nato il|nata il", "published|updated|version|since|valid until|publié le|modifié le|mise à jour|veröffentlicht am|aktualisiert|stand|publicado el|actualizado|desde|pubblicato il|aggiornato"),
}
#: Words that stand everywhere and so tell nothing.
PLAIN = "the of and to in is was on at for with a by de la le les des du et est un une der die das und den dem am im ist ein eine el los las en y que del por con es il di e che per il da è"
LINKS = [" ", " ", ": ", " : ", " = ", " is ", " est ", " ist ", " es ", " no. ", " n° ", " nr. "]


def account(rng: random.Random) -> str:
    """An account number with a sound mod-97 sum."""
    country, rest = rng.choice(["DE", "FR", "GB", "ES", "IT", "NL"]), "".join(rng.choice("0123456789") for _ in range(rng.choice([14, 16, 18, 20])))
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    whole = f"{country}{98 - number % 97:02d}{rest}"
    return whole if rng.random() < 0.5 else " ".join(whole[i:i + 4] for i in range(0, len(whole), 4))


def training_texts(seed: int = 11, count: int = TRAIN) -> list[tuple[str, int, float]]:
    """(text, generator number, label) made from formats and contexts."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    plain = PLAIN.split()
    word = lambda: rng.choice(plain) if rng.random() < 0.4 else "".join(rng.choice("abcdefghilmnoprstué") for _ in range(rng.randint(2, 9)))
    high = lambda n: rng.choice("23456789") + d(n - 1)
    out = []
    for _ in range(count):
        k, good = rng.randrange(len(LOOSE)), rng.random() < 0.5
        name = LOOSE[k][0]
        # sound accounts, phones and masked addresses are personal without a telling context; numbers and dates are not
        plain_format = name in ("iban", "local_phone", "masked_email")
        told = rng.random() < (0.7 if plain_format else 1.0) if good else rng.random() < 0.5
        if name == "iban":
            value = account(rng) if good else "".join(rng.choice("ABQXZ") for _ in range(2)) + d(2) + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(rng.randint(11, 20)))
        elif name == "national_id":
            value = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if good or rng.random() < 0.7 else f"{d(3)}-{d(2)}-{d(4)}"
        elif name == "local_phone":
            form = rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"])
            value = form.format(high(3), high(3), d(4)) if good or (told and rng.random() < 0.5) else rng.choice(["{}.{}.{}", "{}-{}-{}", "{} {} {}"]).format(rng.choice("01") + d(2), d(3), d(4))
        elif name == "masked_email":
            at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", ".")])
            value = f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'fr', 'de', 'es', 'net'])}" if good else f"{word()} (at) {word()}. {word()}"
        else:
            year = rng.randint(1925, 2012) if good else rng.choice([rng.randint(1950, 2026), rng.randint(2010, 2026)])
            value = f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
        cue = rng.choice(CONTEXTS[name][not good].split("|")) if told else word()
        cue = cue.capitalize() if rng.random() < 0.3 else cue.upper() if rng.random() < 0.1 else cue
        before = " ".join(word() for _ in range(rng.randint(1, 6)))
        out.append((f"{before}{rng.choice([' ', '. ', ', '])}{cue}{rng.choice(LINKS)}{value}{rng.choice([' ', '. ', ', '])}{word()}", k, float(good)))
    return out


class Model:
    """Word weights, trees by Newton boosting, and a score threshold for each loose kind."""

    _fitted: "Model | None" = None

    def __init__(self, spark: SparkSession):
        made = training_texts()
        third = len(made) // 3
        self.weights = self._word_weights(made[:third])
        df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(made) if i >= third], "i long, text string")
        found = loose_candidates(F.col("text"), self.weights, F.lit(True))
        x, y, kinds, fitted = [], [], [], []
        for r in sorted(df.select("i", *[c.alias(k) for k, c in found.items()]).collect(), key=lambda r: r["i"]):
            _, k, label = made[r["i"]]
            for s in r[LOOSE[k][0]][:1]:
                x.append([s[f] for f in FEATURES])
                y.append(label)
                kinds.append(k)
                fitted.append(r["i"] < 2 * third)
        x, y, kinds, fitted = np.array(x), np.array(y), np.array(kinds), np.array(fitted)
        self.bias, self.trees = R.boost(x[fitted], y[fitted], TREES, DEPTH, rate=0.4)
        z, good, kinds = self.bias + 0.4 * sum(R.predict_tree(t, x[~fitted]) for t in self.trees), y[~fitted], kinds[~fitted]
        self.thresholds = [self._threshold(z[kinds == k], good[kinds == k]) for k in range(len(LOOSE))]

    @staticmethod
    def _word_weights(made: list[tuple[str, int, float]]) -> list[dict[str, float]]:
        """Per kind, the log-odds of the words that stand before its candidates."""
        out = []
        for k, (_, pattern, _) in enumerate(LOOSE):
            seen = [Counter(), Counter()]
            rx = regex.compile(pattern)
            for text, kind, label in made:
                if kind == k and (m := rx.search(text)):
                    seen[int(label)].update(set(regex.split(r"[^\p{L}]+", text[max(0, m.start() - CONTEXT):m.start()].lower())) - {""})
            no, yes = (sum(kind == k and label == x for _, kind, label in made) + 2 for x in (0.0, 1.0))
            odds = {w: float(np.log((seen[1][w] + 0.5) / yes) - np.log((seen[0][w] + 0.5) / no)) for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= 3}
            out.append({w: round(x, 4) for w, x in odds.items() if abs(x) >= 0.7})
        return out

    @staticmethod
    def _threshold(z: np.ndarray, good: np.ndarray) -> float:
        """The lowest score from which on the precision holds."""
        order = np.argsort(-z, kind="stable")
        precise = np.cumsum(good[order]) / np.arange(1, len(z) + 1)
        last = np.r_[z[order][1:] != z[order][:-1], True]
        held = np.flatnonzero((precise >= PRECISION) & last)
        return float(z[order][held[-1]]) - 1e-9 if len(held) else float("inf")

    @classmethod
    def get(cls, spark: SparkSession) -> "Model":
        if cls._fitted is None:
            cls._fitted = cls(spark)
        return cls._fitted

    def selected(self, kind: int) -> str:
        """SQL of whether the candidate ``s`` reaches its kind's threshold."""
        if not np.isfinite(self.thresholds[kind]):
            return "false"
        trees = " + ".join(f"0.4D * {R.tree_sql(t, lambda j: f's.{FEATURES[j]}')}" for t in self.trees)
        return f"{self.bias!r}D + {trees} >= {self.thresholds[kind]!r}D"


def find_spans(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``spans``: array<struct<start, kind_order, end, kind>> in order of start, then kind."""
    model = Model.get(docs.sparkSession)
    text = F.col("_text")
    found = {**base_candidates(text, F.col("_digit")), **loose_candidates(text, model.weights, F.col("_digit"))}
    plain = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER.index(k)).alias("kind_order"), s["end"].alias("end"), F.lit(k).alias("kind"))
    chosen = lambda i, k: F.expr(f"transform(filter(`_{k}`, s -> {model.selected(i)}), s -> named_struct('start', s.start, 'kind_order', {ORDER.index(k)}, 'end', s.`end`, 'kind', '{k}'))")
    raw = docs.select(*keep, text_or_empty(text_col).alias("_text")).withColumn("_digit", text.rlike("[0-9]")).select(*keep, *[c.alias(f"_{k}") for k, c in found.items()])
    arrays = [F.transform(F.col(f"_{k}"), plain(k)) for k in BASE]
    arrays += [chosen(i, k) for i, (k, _, _) in enumerate(LOOSE)]
    return raw.select(*keep, F.array_sort(F.concat(*arrays)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every selected span replaced by its kind in brackets;
    of overlapping spans the first covers the others."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(text_col)]
    spanned = find_spans(docs.toDF(*names), names, own)
    text = text_or_empty(own)

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), cut.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return spanned.withColumn(own, F.when(F.col(own).isNotNull(), clean)).select(*names).toDF(*docs.columns)
