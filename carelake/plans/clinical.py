"""Configuration of the clinical tables: columns, limits, bands, weights and texts.

Operators take these as arguments; nothing below is read by them directly except as a default.
"""

from __future__ import annotations

import math

INF = math.inf

# Column names of the patient table.
VITALS = [
    "dob", "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak", "glukoza_u_krvi",
    "tjelesna_temp", "BMI", "otkucaji_srca",
]
FLAGS = ["komplikacije_u_proslosti", "dijabetes", "gestacijski_dijabetes", "mentalno_zdravlje"]
FEATURES = [
    "dob", "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak", "glukoza_u_krvi",
    "tjelesna_temp", "BMI", "komplikacije_u_proslosti", "dijabetes",
    "gestacijski_dijabetes", "mentalno_zdravlje", "otkucaji_srca",
]
SKEW_COLUMNS = [
    "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak", "glukoza_u_krvi", "BMI",
    "komplikacije_u_proslosti", "dijabetes", "otkucaji_srca",
]
TARGET = "nivo_rizika"

# Cleaning rules.
AGE_SENTINEL = 325
AGE_MIN, AGE_MAX = 15, 50
FAHRENHEIT_ABOVE = 50
TARGET_CODES = {"Low": 0, "High": 1}

# Inclusive form limits per field.
FORM_LIMITS = {
    "dob": (15, 60),
    "height": (100, 220),
    "weight": (30, 200),
    "systolic": (70, 200),
    "diastolic": (40, 130),
    "glucose": (2, 20),
    "temperature": (35, 40),
    "heart_rate": (50, 150),
}

# Measurement classes, half-open [lo, hi), first match wins.
BANDS = {
    "glukoza": [
        ("normalna", 3.9, 5.5), ("blago povisena", 5.5, 7.8), ("visoka", 7.8, 11.0),
        ("kriticna", 11.0, INF),
    ],
    "sistolicki": [
        ("optimalan", 0, 120), ("normalan", 120, 130), ("normalno_visok", 130, 140),
        ("hipertenzija_1", 140, 160), ("hipertenzija_2", 160, 180), ("hipertenzija_3", 180, INF),
    ],
    "dijastolicki": [
        ("optimalan", 0, 80), ("normalan", 80, 85), ("normalno_visok", 85, 90),
        ("hipertenzija_1", 90, 100), ("hipertenzija_2", 100, 110), ("hipertenzija_3", 110, INF),
    ],
    "bmi": [
        ("normalan", 18.5, 25.0), ("prekomjeran", 25.0, 30.0), ("gojaznost_1", 30.0, 35.0),
        ("gojaznost_2", 35.0, 40.0), ("gojaznost_3", 40.0, INF),
    ],
    "temp": [("normalna", 36.0, 37.5), ("subfebrilan", 37.5, 38.0), ("febrilna", 38.0, INF)],
    "otkucaji": [("bradikardija", 0, 60), ("normalan", 60, 100), ("tahikardija", 100, INF)],
}
UNKNOWN_CLASS = "nepoznato"
BAND_COLUMNS = {
    "glukoza": "glukoza_u_krvi",
    "sistolicki": "sistolicki_krvni_tlak",
    "dijastolicki": "dijastolicki_krvni_tlak",
    "bmi": "BMI",
    "temp": "tjelesna_temp",
    "otkucaji": "otkucaji_srca",
}

# Blood-pressure classes from mild to severe, with their display text.
PRESSURE_ORDER = [
    ("optimalan", "optimalan"),
    ("normalan", "normalan"),
    ("normalno_visok", "normalno visok"),
    ("hipertenzija_1", "blaga hipertenzija"),
    ("hipertenzija_2", "umjerena hipertenzija"),
    ("hipertenzija_3", "teška hipertenzija"),
]

# Display range and zones per vital, half-open; a value in no zone shows the last.
ZONES = {
    "glukoza_u_krvi": (2, 20, [
        ("Niska", 2, 3.9), ("Normalna", 3.9, 5.5), ("Blago povišena", 5.5, 7.8),
        ("Visoka", 7.8, 11.0), ("Kritična", 11.0, 20)]),
    "sistolicki_krvni_tlak": (70, 200, [
        ("Optimalan", 70, 120), ("Normalan", 120, 130), ("Normalno visok", 130, 140),
        ("Blaga hiper.", 140, 160), ("Umjerena hiper.", 160, 180), ("Teška hiper.", 180, 200)]),
    "dijastolicki_krvni_tlak": (40, 130, [
        ("Optimalan", 40, 80), ("Normalan", 80, 85), ("Normalno visok", 85, 90),
        ("Blaga hiper.", 90, 100), ("Umjerena hiper.", 100, 110), ("Teška hiper.", 110, 130)]),
    "BMI": (14, 45, [
        ("Pothranjenost", 14, 18.5), ("Normalan", 18.5, 25), ("Prekomjeran", 25, 30),
        ("Gojaznost I", 30, 35), ("Gojaznost II", 35, 40), ("Gojaznost III", 40, 45)]),
    "otkucaji_srca": (40, 150, [
        ("Bradikardija", 40, 60), ("Normalan", 60, 100), ("Blaga tahikardija", 100, 120),
        ("Tahikardija", 120, 150)]),
    "tjelesna_temp": (35, 40, [
        ("Niska", 35, 36.0), ("Normalna", 36.0, 37.5), ("Subfebrilan", 37.5, 38.0),
        ("Febrilna", 38.0, 40)]),
}

# Risk factors in report order. A "band" rule maps the classes of one measurement,
# a "worst" rule the worse class of two, a "flag" rule a 0/1 column; each entry is
# class -> (factor, weight). "normal" names the parameter when no class of the rule applies.
FACTOR_RULES = [
    ("band", "glukoza", {
        "kriticna": ("glukoza_kriticna", 4),
        "visoka": ("glukoza_visoka", 3),
        "povisena": ("glukoza_povisena", 2)}, "glukoza"),
    ("flag", "dijabetes", ("dijabetes_tip1_2", 3), None),
    ("flag", "gestacijski_dijabetes", ("gestacijski_dijabetes", 3), None),
    ("worst", ("sistolicki", "dijastolicki"), {
        "hipertenzija_3": ("hipertenzija_3", 5),
        "hipertenzija_2": ("hipertenzija_2", 4),
        "hipertenzija_1": ("hipertenzija_1", 3),
        "normalno_visok": ("normalno_visok_tlak", 1)}, "krvni_tlak"),
    ("band", "bmi", {
        "gojaznost_3": ("gojaznost_teska", 3),
        "gojaznost_2": ("gojaznost_teska", 3),
        "gojaznost_1": ("gojaznost", 2),
        "prekomjeran": ("prekomjerna_tezina", 1)}, "bmi"),
    ("band", "temp", {"febrilna": ("febrilno_stanje", 3), "subfebrilan": ("subfebrilan", 1)}, None),
    ("band", "otkucaji", {"tahikardija": ("tahikardija", 2), "bradikardija": ("bradikardija", 1)}, None),
    ("flag", "mentalno_zdravlje", ("mentalno_zdravlje", 2), None),
    ("flag", "komplikacije_u_proslosti", ("komplikacije_proslost", 2), None),
]
# The corrected glucose rule also counts the mild class, which the fixed rule above names differently.
MILD_GLUCOSE_CLASS = "blago povisena"
MAX_WEIGHT = 27

# Query phrases per factor; v and w are the measured values.
QUERY_PHRASES = {
    "glukoza_kriticna": [
        "kritično povišena glukoza u krvi {v:.1f} mmol/L trudnoća hitna intervencija",
        "hiperglikemija liječenje inzulin trudnoća",
        "visoka glukoza komplikacije prevencija"],
    "glukoza_visoka": [
        "povišena glukoza {v:.1f} mmol/L gestacijski dijabetes",
        "kontrola šećera u krvi preporuke trudnoća",
        "dijeta glukoza trudnoća ishrana"],
    "glukoza_povisena": [
        "granično povišena glukoza {v:.1f} mmol/L",
        "prevencija gestacijskog dijabetesa ishrana fizička aktivnost"],
    "dijabetes_tip1_2": [
        "dijabetes tip 1 tip 2 trudnoća liječenje kontrola",
        "insulin dijabetes trudnoća preporuke",
        "komplikacije dijabetesa trudnoća praćenje"],
    "gestacijski_dijabetes": [
        "gestacijski dijabetes dijeta terapija insulin",
        "GDM liječenje preporuke monitoring glukoze",
        "gestacijski dijabetes ishrana fizička aktivnost"],
    "hipertenzija_3": [
        "teška hipertenzija trudnoća {v:.0f}/{w:.0f} mmHg hitna intervencija",
        "hipertenzija 3 stupnja preeklampsija eklampsija liječenje",
        "antihipertenzivna terapija trudnoća visok rizik"],
    "hipertenzija_2": [
        "umjerena hipertenzija trudnoća {v:.0f}/{w:.0f} mmHg liječenje",
        "preeklampsija krvni pritisak terapija antihipertenzivi",
        "hipertenzija trudnoća komplikacije praćenje"],
    "hipertenzija_1": [
        "blaga hipertenzija trudnoća {v:.0f}/{w:.0f} mmHg praćenje",
        "hipertenzija 1 stupnja trudnoća preporuke monitoring"],
    "normalno_visok_tlak": [
        "normalno visok krvni tlak trudnoća {v:.0f}/{w:.0f} mmHg praćenje",
        "granično povišen tlak trudnoća preporuke"],
    "gojaznost_teska": [
        "teška gojaznost BMI {v:.1f} trudnoća komplikacije",
        "gojaznost trudnoća visok rizik praćenje liječenje",
        "BMI iznad 35 trudnoća preporuke"],
    "gojaznost": [
        "gojaznost BMI {v:.1f} trudnoća preporuke",
        "gojaznost trudnoća ishrana fizička aktivnost",
        "komplikacije gojaznosti trudnoća prevencija"],
    "prekomjerna_tezina": [
        "prekomjerna težina trudnoća kontrola tjelesne mase",
        "ishrana prekomjerna težina trudnoća preporuke"],
    "febrilno_stanje": [
        "febrilno stanje temperatura {v:.1f}°C trudnoća liječenje",
        "infekcija temperatura trudnoća intervencija"],
    "subfebrilan": ["subfebrilan temperatura trudnoća praćenje"],
    "tahikardija": [
        "tahikardija otkucaji srca {v:.0f} trudnoća",
        "ubrzani rad srca trudnoća uzroci liječenje"],
    "bradikardija": ["bradikardija otkucaji srca {v:.0f} trudnoća praćenje"],
    "mentalno_zdravlje": [
        "mentalno zdravlje depresija anksioznost trudnoća podrška",
        "psihološka podrška trudnoća liječenje preporuke"],
    "komplikacije_proslost": [
        "komplikacije prethodne trudnoće praćenje prevencija",
        "visokorizična trudnoća prethodni problemi monitoring"],
}
NO_FACTOR_PHRASES = [
    "zdrava trudnoća prenatalna njega preporuke",
    "antenatalna zaštita redovni pregledi",
]
NO_FACTOR_AGE = (35, "trudnoća starosna dob {v:d} preporuke praćenje")

# Summary and advice texts.
SUMMARY_NONE = (
    "Na osnovu unesenih parametara, vaša trudnoća je uredna. Nastavite s redovnim pregledima.\n\n"
)
SUMMARY_HEAD = "Na osnovu vaših parametara, uočeni su sljedeći faktori koji zahtijevaju pažnju:\n"
SUMMARY_TAIL = "\n\nPreporučene smjernice iz kliničkog vodiča:\n\n"
# parameter, classes not shown, line with value(s) and class text c
SUMMARY_LINES = [
    ("glukoza", ["normalna"], "  • Glukoza u krvi: {v:.1f} mmol/L ({c})"),
    ("krvni_tlak", ["normalan", "optimalan"], "  • Krvni tlak: {v:.0f}/{w:.0f} mmHg ({c})"),
    ("bmi", ["normalan"], "  • BMI: {v:.1f} kg/m² ({c})"),
    ("temp", ["normalna"], "  • Tjelesna temperatura: {v:.1f}°C ({c})"),
    ("otkucaji", ["normalan"], "  • Otkucaji srca: {v:.0f}/min ({c})"),
]
SUMMARY_FLAG_LINES = [
    ("dijabetes", "  • Dijagnoza dijabetesa tip 1 ili tip 2"),
    ("gestacijski_dijabetes", "  • Gestacijski dijabetes"),
    ("mentalno_zdravlje", "  • Problemi s mentalnim zdravljem"),
    ("komplikacije_u_proslosti", "  • Komplikacije u prethodnim trudnoćama"),
]
BANNER_HIGH = "VISOK RIZIK – Prioritetne preporuke za kliničku intervenciju\n\n"
BANNER_STANDARD = "STANDARDNA NJEGA – Preporuke za zdravu trudnoću\n\n"
ADVICE_NONE = (
    "Trenutno nema specifičnih preporuka za unesene parametre. "
    "Savjetujemo konsultaciju s ljekarom ili odabranim ginekologom."
)
ADVICE_EMPTY = (
    "Nije pronađen dovoljno relevantan sadržaj. Obratite se svom ginekologu za detaljne smjernice."
)
ADVICE_ITEM = "**Preporuka {n}** (relevantnost: {p}%):"

# Chunking and retrieval parameters.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MIN_CHARS = 600, 100, 40
CHUNK_SEPARATORS = [". ", "? ", "! ", "\n\n", "\n", "; "]
# words that mention a table or figure, matched anywhere and in any case; \d is a digit
TABLE_TERMS = [
    "tabela", "tablica", "tabla", "table", "slika", "grafikon", "prilog", "aneks", "appendix",
    "vidjeti tabelu", "prema tabeli", "u tabeli", r"tabeli \d", r"tabela \d", r"tablica \d", r"grafikon \d", r"slika \d",
]
RELEVANCE_FLOOR = 0.45
HITS_PER_SEARCH, HITS_PER_QUERY, ADVICE_ITEMS = 10, 6, 4
DEDUP_PREFIX = 80
WEIGHT_STEP = 0.1

# Value maps of the second table.
ORDINAL_CODES = {"1st": 1, "2nd": 2, "3rd": 3}
YES_NO_CODES = {"Yes": 1, "No": 0}
POSITIVE_CODES = {"Positive": 1, "Negative": 0}
ALBUMIN_CODES = {"Normal": 0, "Minimal": 1, "Medium": 2, "Higher": 3}
ANAEMIA_CODES = {"None": 0, "Minimal": 1, "Medium": 2}
POSITION_CODES = {"Normal": 0, "Abnormal": 1}
CM_PER_FOOT = 30.48
MOSTLY_NULL = 0.98

# Feedback loop and forest parameters.
RETRAIN_THRESHOLD = 10
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2,
          "featureSubsetStrategy": "sqrt", "seed": 42}
# Rows a node needs to be cut.
FOREST_MIN_SPLIT = 5
