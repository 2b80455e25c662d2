"""Text scalar functions: tokenizer, answer normalisation, ROUGE tokenizer.

Everything except canonical decomposition (M1) is a built-in Column expression, so it stays in
whole-stage codegen. M1 has no JVM built-in and runs as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's behaviour -------------------------------
# Token pattern: a run of letters/digits/marks, or any single non-space, non-control char.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
# The 32 ASCII punctuation characters removed before exact match.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Articles removed before exact match.
ARTICLE_PATTERN = r"(?U)\b(a|an|the)\b"
# ---------------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Bind a per-row value once for use inside higher-order lambdas.

    The optimizer inlines projected expressions into the lambdas that reference them, which
    would re-evaluate a whole-row expression (a token array, a mark string) once per element.
    Passing it as the argument of a one-element ``transform`` evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_UDFS: dict = {}


def _lazy_udf(name, fn, rtype):
    """pandas UDFs are created on first use (creation needs an active session)."""
    if name not in _UDFS:
        _UDFS[name] = F.pandas_udf(fn, rtype)
    return _UDFS[name]


def _nfd_series(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFD", v))


def _nfc_series(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def _nfd_array_series(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        return [x if x is None or x.isascii() else unicodedata.normalize("NFD", x) for x in v]
    return s.map(one)


def nfd(c) -> Column:
    """M1: Unicode canonical decomposition (Arrow-batched). ASCII strings pass through."""
    return _lazy_udf("nfd", _nfd_series, "string")(_c(c))


def nfc(c) -> Column:
    """Canonical composition; used to present decomposed results in a comparable form."""
    return _lazy_udf("nfc", _nfc_series, "string")(_c(c))


def nfd_array(c) -> Column:
    """M1 applied to every element of an array column."""
    return _lazy_udf("nfd_array", _nfd_array_series, "array<string>")(_c(c))


def tokenize(s, uncased: bool = False) -> Column:
    """M9: array of tokens; lower-cased when ``uncased``."""
    t = F.regexp_extract_all(_c(s), F.lit(TOKEN_PATTERN), 0)
    return F.transform(t, lambda x: F.lower(x)) if uncased else t


def remove_punc(s) -> Column:
    """M3: delete the ASCII punctuation characters only."""
    return F.translate(_c(s), PUNCTUATION, "")


def remove_articles(s) -> Column:
    """M4: whole-word a / an / the replaced by a space (Unicode word boundaries)."""
    return F.regexp_replace(_c(s), ARTICLE_PATTERN, " ")


def strip(s) -> Column:
    """Leading and trailing white space of any kind removed (``trim`` removes blanks only)."""
    return F.regexp_replace(_c(s), r"(?U)^\s+|\s+$", "")


def white_space_fix(s) -> Column:
    """M5: split on whitespace and join with one space."""
    return F.trim(F.regexp_replace(_c(s), r"(?U)\s+", " "))


def ascii_rows(src: str) -> Column:
    """Whether a text (null counts) has ASCII characters only."""
    return F.col(src).isNull() | F.col(src).rlike(r"^[\x00-\x7F]*$")


def with_normalized(df, src: str, out: str):
    """Add ``out`` = normalize_answer(``src``). ASCII rows stay in the JVM and take the same patterns without Unicode
    classes, which are equal on ASCII."""
    spaced = F.regexp_replace(remove_punc(F.lower(F.col(src))), ARTICLE_PATTERN.removeprefix("(?U)"), " ")
    a = df.filter(ascii_rows(src)).withColumn(out, F.trim(F.regexp_replace(spaced, r"\s+", " ")))
    return a.unionByName(df.filter(~ascii_rows(src)).withColumn(out, normalize_answer(F.col(src))))


def normalize_answer(s, decompose: bool = True) -> Column:
    """M6: NFD -> lower -> remove punctuation -> remove articles -> fix whitespace."""
    x = nfd(_c(s)) if decompose else _c(s)
    return white_space_fix(remove_articles(remove_punc(F.lower(x))))


def exact(a, b, decompose: bool = True) -> Column:
    """M7: normalised equality as 0/1."""
    return (normalize_answer(a, decompose) == normalize_answer(b, decompose)).cast("int")


def single_ans_em(pred, gold, decompose: bool = True) -> Column:
    """M8: 1 when the prediction equals any gold answer after normalisation; empty gold -> 0.

    ``gold`` is an array column; wrap a scalar with ``F.array`` first.
    """
    npred = normalize_answer(pred, decompose)
    g = nfd_array(_c(gold)) if decompose else _c(gold)
    normed = F.transform(g, lambda x: normalize_answer(x, decompose=False))
    return F.coalesce(F.array_contains(normed, npred).cast("int"), F.lit(0))


def nfd_rows(df, src: str, out: str):
    """Add ``out`` = NFD(``src``) sending only non-ASCII rows through Python: ASCII rows are
    unchanged by NFD, so they take a JVM-only branch and the two branches are unioned."""
    ascii_ = ascii_rows(src)
    a = df.filter(ascii_).withColumn(out, F.col(src))
    b = df.filter(~ascii_).withColumn(out, nfd(F.col(src)))
    return a.unionByName(b)


def with_nfd(df, cols: dict):
    """Add NFD versions of columns ({out: in}); array columns are decomposed element-wise.

    The decomposed values are materialised as plain columns of the DataFrame so later
    higher-order expressions can reference them.
    """
    for out, src in cols.items():
        dt = df.schema[src].dataType.simpleString()
        df = df.withColumn(out, nfd_array(F.col(src)) if dt.startswith("array") else nfd(F.col(src)))
    return df


def token_string(tokens) -> Column:
    """Tokens joined by one space and padded with a space at both ends.

    Tokens never contain white space, so ``contains`` on two padded strings is exactly
    "is a contiguous run of tokens" (M10 row form).
    """
    return F.concat(F.lit(" "), F.array_join(_c(tokens), " "), F.lit(" "))


def has_correct_answer(doc, answers) -> Column:
    """M10 row form: 1 when any answer's uncased token list is a contiguous run of the doc's.

    An answer with no tokens always matches (the reference compares two empty lists). Inputs
    must already be NFD (``with_nfd``): a Python UDF cannot sit inside the lambda.
    """
    d = _c(doc)
    a = _c(answers)
    hit = let(token_string(tokenize(d, uncased=True)), lambda dstr: F.exists(
        a, lambda x: (F.size(tokenize(x, True)) == 0) | F.contains(dstr, token_string(tokenize(x, True)))))
    return F.coalesce(hit.cast("int"), F.lit(0))


def rouge_tokens(s) -> Column:
    """ROUGE tokenizer without stemming: lower, non [a-z0-9] runs -> space, split, drop empties."""
    t = F.split(F.trim(F.regexp_replace(F.lower(_c(s)), "[^a-z0-9]+", " ")), " ")
    return F.filter(t, lambda x: x != "")


def classify_query(s) -> Column:
    """P12 re-aimed as rules taken from the classification prompt's label descriptions.

    question: ends with '?' or starts with a question word; chat: refers to the previous
    conversation; conversational: greeting or an imperative request; else neither.
    """
    x = F.lower(strip(s))
    return (F.when(x.rlike(r"\?$") | x.rlike(QUESTION_START), "question")
            .when(x.rlike(CHAT_WORDS), "chat")
            .when(x.rlike(CONVERSATIONAL_START), "conversational")
            .otherwise("neither"))


# ---- fixed values for the P12 rules (derived from the prompt's label descriptions) ----------
QUESTION_START = r"^(who|what|when|where|why|how|which|whom|whose|is|are|can|does|do|did|could|would|should)\b"
CHAT_WORDS = r"\b(previous|earlier|chat|conversation|you said|last answer)\b"
CONVERSATIONAL_START = r"^(hi|hello|hey|thanks|thank you|good morning|good evening|tell me|please)\b"
# ---------------------------------------------------------------------------------------------
