"""English suffix stripping (M12) after the published 1980 algorithm, with the small changes that common
toolkits make to it. It runs over distinct tokens only; the result is joined back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the published suffix rules and the usual irregular words ---------------------
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
             "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
             "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("entli", "ent"),
          ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# -------------------------------------------------------------------------------------------------


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel; y after a consonant)."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    s = _shape(word)
    return s.endswith("cvc") and word[-1] not in "wxy" or s == "vc"


def _replace(word: str, rules) -> str:
    """The longest suffix that fits is replaced where what is left has a measure above 0."""
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """Stem of a lower-case token; tokens of up to three characters stay."""
    if len(word) <= 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word
    if w.endswith("ies") or w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if not word.endswith("ied"):
        if w.endswith("eed"):
            w = w[:-1] if _measure(w[:-3]) > 0 else w
        else:
            for suffix in ("ed", "ing"):
                left = w[:-len(suffix)]
                if w.endswith(suffix) and "v" in _shape(left):
                    w = left
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                    break
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _replace(w, STEP_2)
    w = _replace(w, STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            left = w[:-len(suffix)]
            if _measure(left) > 1 and (suffix != "ion" or left[-1:] in ("s", "t")):
                w = left
            break
    if w.endswith("e"):
        left = w[:-1]
        if _measure(left) > 1 or _measure(left) == 1 and not _short_end(left):
            w = left
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem_tokens(vocabulary: DataFrame, token: str = "tok") -> DataFrame:
    """(token, stem) for a table of distinct tokens, in Arrow batches."""
    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(stem)
    return vocabulary.select(token, stems(token).alias("stem"))
