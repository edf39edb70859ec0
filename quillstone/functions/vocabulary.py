"""Fixed values that results depend on: word lists, lookup tables, formats.

They are configuration; every operator takes its list from here.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

LETTER_KEYS = [
    "AMI", "AMX", "SFI", "AIS", "AMK", "AMO", "AMY", "AMP", "K", "SF", "SP", "Z", "TO", "ORT", "POD", "POT", "BSA", "BSB",
    "BSC", "DI", "PAI", "ARL", "NMI", "RAB", "RAV", "TER", "PLL", "RPE", "RPB", "DRA", "APM", "RAM", "RAO", "RSC", "RSM",
    "RIC", "RIM", "VIC", "VIM", "VSC", "VSM", "TMP", "TMO", "TMK", "FMN", "RQD", "TE2", "KMB", "P", "TLS", "TLD", "TLL",
]

EXCLUDED_TABLE_WORDS = [
    "stations thermales", "orientations thérapeutiques", "annees", "décisions uncam", "decisions uncam",
    "publication au journal", "forfait bsi pour", "combinaisons", "groupe 1", "groupe 2", "groupe 3", "groupe 4",
    "interventions",
]

CONDITION_STARTERS = [
    "Par dérogation", "Une séance", "Ce bilan", "Cet acte", "La cotation", "Le contrôle", "En cas de", "Pour ", "Lorsque ",
    "Au-delà", "Toute", "Il est", "Les ", "Sous réserve", "Cette cotation", "Facturation", "La facturation",
    "La prescription", "Prescription", "Indications", "Ce protocole", "Conditions",
]
CONTEXT_STARTER = "Dans le cadre"

CONTINUATION_STARTERS = [
    "de ", "la ", "par ", "y compris", "sur ", "et ", "à ", "ou ", "des ", "d'", "du ", "avec ", "dans ", "en ", "au ",
    "aux ", "chez ", "dont ", "pour ", "sous ", "sans ", "entre ",
]

CONDITION_LINE_STARTERS = [
    "Condition :", "Conditions :", "Cet acte", "Cette cotation", "Dans le cadre", "Lorsque", "Par dérogation",
    "Les deux cotations", "L'acte comprend", "Prescription", "Indications", "Au-delà", "facturés,",
]

GAZETTE_HEADERS = [
    "JOURNAL OFFICIEL DE LA RÉPUBLIQUE FRANÇAISE", "Décrets, arrêtés, circulaires", "Avis et communications",
    "SOMMAIRE ANALYTIQUE", "textes généraux", "Sommaire", "mesures nominatives", "conventions collectives", "avis divers",
    "Informations parlementaires", "Assemblée nationale", "avis de concours et de vacance d'emplois",
    "République française.", "publié au Journal officiel de la République française.",
    "Journal officiel de la République française.", "Pour le ministre et par délégation :", "TEXTES GÉNÉRAUX",
]
CHECKBOX_WORDS = ["Nouveau", "Modificatif", "Complémentaire", "Suivi"]
ANNEX_HEADER = "Annexes"

COTATION_HINTS = ["AMI", "AMX", "SFI", "AIS", "AMK", "coefficient", "lettre clé", "Désignation", "séance", "forfait"]

COMPOUND_PREFIXES = [
    "vice", "sous", "demi", "semi", "anti", "auto", "co", "contre", "entre", "extra", "hyper", "infra", "inter", "intra",
    "macro", "méta", "micro", "mini", "multi", "néo", "non", "outre", "para", "poly", "post", "pré", "pro", "pseudo",
    "quasi", "re", "ré", "socio", "sub", "super", "supra", "sur", "trans", "tri", "ultra", "médico", "chirurgico",
    "technico",
]
COMPOUND_WORDS = [
    "masseur-kinésithérapeute", "chirurgien-dentiste", "sage-femme", "anesthésiste-réanimateur", "pédicure-podologue",
    "maxillo-faciale", "psycho-comportemental", "neuro-développement", "neuro-psychologique", "neuro-ophtalmologique",
    "neuro-visuelles", "oesophago-gastrique", "médico-social", "médico-sociales", "médico-sociaux", "ostéo-articulaire",
    "ostéo-articulaires", "cardio-vasculaire", "cardio-vasculaires", "cardio-circulatoire", "bucco-dentaire",
    "bucco-dentaires", "bucco-linguales", "dento-faciale", "dento-faciales", "temporo-maxillaire", "tibio-tarsienne",
    "tibio-tarsiennes", "périnéo-sphinctériennes", "hygiéno-diététiques", "cognitivo-linguistiques",
    "musculo-articulaire", "musculo-articulaires", "vélo-tubo-tympanique", "vélo-tubo-tympaniques",
    "oro-myo-faciales", "oro-oesophagiennes", "trachéo-oesophagienne", "avant-bras", "avant-pied", "avant-pieds",
    "lombo-sacré", "pyélo-urétérale", "ci-dessus", "ci-dessous", "ci-après", "ci-contre", "celui-ci", "celle-ci",
    "ceux-ci", "peut-être", "c'est-à-dire", "lève-malade", "nutri-pompe", "comptes-rendus", "compte-rendu",
]
COMPOUND_SECONDS = [
    "ci", "dessus", "dessous", "après", "contre", "même", "femme", "dentiste", "kinésithérapeute", "réanimateur",
    "podologue", "faciale", "social", "sociale", "sociaux", "dentaire", "dentaires", "vasculaire", "vasculaires",
    "articulaire", "articulaires", "bras", "pied", "pieds", "malade",
]
NUMBER_WORDS = ["dix", "vingt", "trente", "quarante", "cinquante", "soixante", "quatre", "cent"]

#: Cleaning: character to replacement, after NFC.
CLEAN_CHARACTERS = {
    "\u2019": "'", "\u2018": "'", "\u201c": '"', "\u201d": '"', "\u2212": "-", "\u2015": "\u2014", "\u00ad": "", "\u00a0": " ", "\u2009": " ",
    "\uf0fc": "", "\uf0a7": "", "\uf0d8": "", "\uf0b7": "", "\uf075": "", "\uf0cc": "", "\uf0b6": "", "\uf0a0": "",
}
#: Ingestion: character to replacement.
INGEST_CHARACTERS = {
    "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u00ad": "",
    "\u2022": "- ", "\u25e6": "- ", "\u25aa": "- ", "\u25a0": "- ", "\u25ba": "- ", "\uf0b6": "- ", "\uf0a7": "- ", "\r": "\n",
}

DOCUMENT_SIGNALS = ["NGAP", "LETTRE CLE", "COEFFICIENT", "AMI", "AMK", "AIS", "SFI", "AMX"]
ACT_SIGNALS = ["lettre clé", "coefficient", "soins infirmiers", "article 1er", "ami", "sfi", "amx", "chapitre i - soins de pratique courante"]

#: Longest section that a guarded deletion removes, in characters.
GUARDS = {"stations": 25_000, "references": 10_000, "bundles": 10_000}
MARKER = "--- Cotations extraites ---"

PRIORITY_LABELS = {1: "Loi", 2: "Code", 3: "Décret", 4: "Arrêté", 6: "Avenant / Décision", 7: "Circulaire", 8: "Charte", 9: "Avis"}
UNKNOWN_LABEL, NO_LABEL = "Inconnu", "Non classé"
PRIORITY_SCORES = {1: 1.0, 2: 0.8, 3: 0.7, 4: 0.6, 6: 0.5, 7: 0.4, 8: 0.3, 9: 0.2}
RECENCY_STEPS = [(2, 1.0), (5, 0.8), (10, 0.6)]
CURRENT_YEAR = 2026

#: What an obsolete article starts with, up to the one after it; (?U) or re decides which letters count.
OBSOLETE_ARTICLE = r"Article\s+11\s*[-–—]\s*Soins\s+infirmiers\s+.{0,5}domicile\s+pour\s+un\s+patient,\s+quel\s+que\s+soit\s+son\s+.ge.*?(?=Article\s+12\s*[-–—])"
LEGISLATIVE_START = r"^\s*\((?:Modifi[eé]|Cr[eé]{1,2}|Abrog[eé])\b"
GAZETTE_PATTERNS = [
    r"^Version\s+en\s+vigueur\s+du\s+\d{2}/\d{2}/\d{4}\s*\z", r"(?iud)^Premi.re\s+partie\s*:?\s*Dispositions\s+G.n.rales\s*\z",
    r"(?iud)^Deuxi.me\s+partie\s*:?.*radiations\s+ionisantes\s*\z", r"(?iud)^Cinqui.me\s+partie\s*:?.*biologie\s+m.dicale\s*\z",
]
GAZETTE_MARKS = [
    r"\d{1,2}\s+\w+\s+\d{4}\s+Texte\s+\d+\s+sur\s+\d+", r"\d{1,2}\s+\w+\s+\d{4}\s*\n\s*Texte\s+\d+\s+sur\s+\d+", r"(?md)^Texte\s+\d+\s+sur\s+\d+\s*$",
]

REGISTRY_COLUMNS = ["id", "type_document", "titre", "annee", "source", "url", "nom_pdf", "theme", "priorite"]

# --- end of fixed values ----------------------------------------------------
