"""Porter's stemmer (1980) as column expressions, the same text for Spark and for DuckDB.

Apply it to a table of distinct terms and join: each word is then stemmed once. A y behind a consonant is written Y while it counts as a vowel.
"""

from pyspark.sql import functions as F

_V, _C = "[aeiouY]", "[^aeiouY]"
#: What the part before a suffix must look like: m > 0, m > 1, a vowel in it, m = 1 with consonant, vowel, consonant (not w, x, y) at its end.
M0, M1, VOWEL, SHORT = f"{_C}*{_V}+{_C}.*", f"{_C}*{_V}+{_C}+{_V}+{_C}.*", f".*{_V}.*", f"{_C}+{_V}[^aeiouYwxy]"
ANY = ".*"


def _same(condition, pairs):
    return [(suffix, [(condition, new)]) for suffix, new in pairs]


#: The published rules. Of each step the first suffix that fits decides; its first condition that holds replaces it.
STEPS = (
    _same(ANY, [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]),
    [("eed", [(M0, "ee")]), ("ed", [(VOWEL, "+")]), ("ing", [(VOWEL, "+")])],
    [(r"at\+", [(ANY, "ate")]), (r"bl\+", [(ANY, "ble")]), (r"iz\+", [(ANY, "ize")]), *[(rf"{c}{c}\+", [(ANY, c)]) for c in "bcdfghjkmnpqrtvwxy"], (r"\+", [(SHORT, "e"), (ANY, "")])],
    [("[yY]", [(VOWEL, "i")])],
    _same(M0, [
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
        ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ]),
    _same(M0, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]),
    [*_same(M1, [(s, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent")]), ("ion", [(f"{M1[:-2]}.*[st]|{_C}*{_V}+{_C}+{_V}+[st]", "")]), *_same(M1, [(s, "") for s in ("ou", "ism", "ate", "iti", "ous", "ive", "ize")])],
    [("e", [(M1, ""), (SHORT, "e"), (M0, "")])],
    [("ll", [(f"{_C}*{_V}+{_C}+{_V}+", "l"), (M1, "l")])],
)


def _step(word, rules, matches):
    cases = []
    for suffix, conditions in rules:
        inner = " ".join(f"WHEN {matches}({word}, '^(?:{condition}){suffix}$') THEN regexp_replace({word}, '{suffix}$', '{new}')" for condition, new in conditions)
        cases.append(f"WHEN {matches}({word}, '{suffix}$') THEN CASE {inner} ELSE {word} END")
    return f"CASE {' '.join(cases)} ELSE {word} END"


def stems(terms, column="term"):
    """``terms`` with ``stem``: of words of three and more letters a-z; other terms are their own stem."""
    plain = F.col(column).rlike("^[a-z]{3,}$")
    x = terms.withColumn("_stem", F.regexp_replace(column, "([^aeiou])y", "$1Y"))
    for rules in STEPS:
        x = x.withColumn("_stem", F.expr(_step("_stem", rules, "regexp_like").replace("\\", "\\\\")))
    return x.withColumn("stem", F.when(plain, F.lower("_stem")).otherwise(F.col(column))).drop("_stem")


def stems_sql(table, column="term"):
    """SELECT of DuckDB: column and stem of a table of terms."""
    x = f"SELECT {column}, regexp_replace({column}, '([^aeiou])y', '\\1Y', 'g') AS w FROM {table}"
    for rules in STEPS:
        x = f"SELECT {column}, {_step('w', rules, 'regexp_matches')} AS w FROM ({x})"
    return f"SELECT {column}, CASE WHEN regexp_matches({column}, '^[a-z]{{3,}}$') THEN lower(w) ELSE {column} END AS stem FROM ({x})"
