"""Lists, tables and patterns whose content decides results. All are defaults of parameters."""

import unicodedata

#: letters that name cleaning keeps as their base letter, case preserved (fixed values)
KEEP_FROM = "àáâãäåāąạèéêëēėęìíîïīįòóôõöøōùúûüūñçßæÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÑÇ–— "
KEEP_TO = "aaaaaaaaaeeeeeeeiiiiiiooooooouuuuuncsaAAAAAAEEEEIIIIOOOOOOUUUUNC-- "

#: letters without a canonical decomposition, and signs, in text folding (fixed values)
FOLD_EXTRA = {
    "Æ": "a", "æ": "a", "Ø": "o", "ø": "o", "Þ": "t", "þ": "t", "ß": "s", "Ð": "d", "ð": "d", "Đ": "d", "đ": "d",
    "Ħ": "h", "ħ": "h", "ı": "i", "Ŀ": "l", "ŀ": "l", "Ł": "l", "ł": "l", "Œ": "o", "œ": "o", "Ŧ": "t", "ŧ": "t",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ω": "o",
    "–": "-", "—": "-", "‑": "-", "‘": "'", "’": "'", "`": "'", "“": '"', "”": '"',
    "…": ".", "•": "*", "≥": ">", "≤": "<",
}


def _fold_table() -> dict[str, str]:
    """All letters of Latin-1 and Latin Extended-A that decompose to an ASCII letter, lowered."""
    out = {}
    for code in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            out[chr(code)] = base.lower()
    return out | FOLD_EXTRA


FOLD = _fold_table()
FOLD_FROM, FOLD_TO = "".join(FOLD), "".join(FOLD.values())

#: values that stand for a missing one (fixed values)
EMPTY_CATEGORY = ("", "-", "'-'")
NO_BRAND = ("", "unbranded", "none", "none reformulated")
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: words and patterns of the extraction (fixed values)
CATEGORIES = ("antibiotic", "analgesic", "anti-inflammatory", "antiviral", "antifungal", "antihypertensive", "anticoagulant", "antidiabetic", "antidepressant", "antipsychotic", "anticancer", "immunosuppressant", "bronchodilator", "diuretic", "corticosteroid", "statin", "beta-blocker", "nsaid")
CATEGORY = rf"(?:is a|is an)\s+({'|'.join(CATEGORIES)})"
MECHANISMS = (
    r"(?:mechanism of action|works by|acts by|exerts its effects? by)\s+([^.;]+)",
    r"inhibit(?:s|or of)\s+([^.;]+)",
    r"(?:agonist|antagonist|modulator) of\s+([^.;]+)",
    r"binds to\s+([^.;]+)",
)
INDICATIONS = (
    r"indicated for(?: the)?(?: treatment of)?\s+([^.;]+)",
    r"used (?:for|to treat|in the treatment of)\s+([^.;]+)",
    r"for the (?:treatment|management) of\s+([^.;]+)",
    r"treats?\s+([^.;]+)",
)
REJECT = ("consult your doctor", "if symptoms persist", "may cause side effects", "dosage is", "one tablet", "capsule", "storage", "keep out of reach", "mg", "dosage", "administration")
RELEVANT = ("treat", "disease", "infection", "condition", "disorder", "patient", "therapy", "inhibit", "receptor", "enzyme", "pain", "fever", "pressure", "diabetes", "inflammatory")

#: default phrases to remove, in order (fixed values)
PHRASES = (
    "the treatment of", "in combination with", "adult patients with", "in patients with", "of age and", "years of age",
    "in adults and", "as well as", "age and older", "caused by susceptible", "in patients who", "for the treatment",
    "in the treatment", "and pediatric patients", "mild to moderate", "the management of", "in adult patients",
    "infections caused by", "or in combination", "with or without", "epidermal growth factor receptor",
    "non-steroidal anti-inflammatory drug nsaid", "non-small cell lung cancer", "prevention and treatment of",
    "reduce the risk of", "antineoplastic cell cycle-specific agent;", "antineoplastic agent protein kinase",
    "advanced or metastatic breast cancer", "of oral blood glucose lowering", "oral blood glucose lowering drugs",
    "patients with type 2 diabetes", "angiotensin ii receptor blocker arb",
)

#: cohorts: name, column searched, substring, sample size (fixed values)
COHORTS = (
    ("amoxicillin_exact", "generic_name", "amoxicillin", 110),
    ("adapalene", "generic_name", "adapalene", 10),
    ("nsaid", "description", "nsaid", 150),
    ("corticosteroid", "description", "corticosteroid", 250),
    ("asthma", "description", "asthma", 100),
)
