"""Text normalisation and parsing as Spark Column expressions.

All but ``preprocess`` stays JVM-side (``regexp_*``, higher-order array
functions), so it runs inside whole-stage codegen and never ships rows to
Python.  Regular expressions are Java regexes; where the reference relies
on Python's Unicode ``\\s`` we spell the whitespace class out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.stopwords import default_stop_words

# The characters Python's ``str.isspace`` accepts, used where
# the reference applies ``\s`` to str objects.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = "[" + PY_WHITESPACE + "]"
NON_ASCII_RUN = "[^\\x00-\\x7F]+"

# Tokenizer patterns and thresholds of the reference.
PREPROCESS_STRIP = "[^A-Za-z0-9 ]+"      # deleted after lower-casing
MIN_TOKEN_CHARS = 3                        # tokens need len > 2
TERM_TOKEN = "^[a-z]{5,}$"                 # (?u)\b[a-zA-Z]{5,}\b on clean text
# the same words, found by Python in a whole text (Java's $ leaves out a line end)
TERM_WORDS = r"(?<![^ ])[a-z]{5,}(?:\r\n|[\n\r\x85\u2028\u2029])?(?![^ ])"
VECTOR_NUMBER = r"([-+]?\d*\.\d+e[-+]?\d+|[-+]?\d*\.\d+|\d+)"
SUBTHEME_MARK = r"Subtheme \d+: "
SENTENCE_END = r"([.!?])" + WS_CLASS + "+"
SENTENCE_SEP = "\u0001"
YEAR_PATTERN = r"(19|20)\d{2}"
NULL_SENTINELS = ("None", "0", "2", "3", "4")
REPEATED_WORD = r"(?i)\b(\w+)([\s,]+(\1\b))+"
DOT_RUN = r"(\.[" + PY_WHITESPACE + "]*)"
QUOTED_NUMBER = r"'\d+'"
QUOTED_LABEL = r"(?s)^'([^']+)'(.+)"
LABEL_TRAILER = r"(?s)\n[^\n]* -\s*$"
PROMPT_REMNANT = r"(?i)(Avoid repetition and fragmented sentences\.?" + WS_CLASS + "*)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Corpus normalisation and n-grams
# --------------------------------------------------------------------------

def clean_tokens(text, stop_words: Iterable[str] | None = None) -> Column:
    """F2 tokens: lower, delete ``[^A-Za-z0-9 ]+``, split, drop stop words
    and tokens of length <= 2.  Null text gives null."""
    stop = list(default_stop_words() if stop_words is None else stop_words)
    cleaned = F.regexp_replace(F.lower(_col(text)), PREPROCESS_STRIP, "")
    toks = F.split(cleaned, " ")
    if stop:
        return F.filter(toks, lambda t: (F.length(t) >= MIN_TOKEN_CHARS) & ~t.isin(stop))
    return F.filter(toks, lambda t: F.length(t) >= MIN_TOKEN_CHARS)


def _normaliser(stop_words: Iterable[str]):
    """The UDF of ``preprocess`` on lower-cased texts."""
    stop = frozenset(w.encode() for w in stop_words)
    # of UTF-8, every byte outside ASCII belongs to a character that goes
    strip = bytes(c for c in range(256) if re.match(PREPROCESS_STRIP, chr(c)))
    least = MIN_TOKEN_CHARS

    @F.arrow_udf("string")
    def normalise(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.cast(pa.binary()):
            t = text.as_py()
            out.append(None if t is None else b" ".join(
                [w for w in t.translate(None, strip).split() if len(w) >= least and w not in stop]))
        return pa.array(out, pa.binary()).cast(pa.string())

    return normalise


def preprocess(text, stop_words: Iterable[str] | None = None,
               lemmas: dict[str, str] | None = None) -> Column:
    """normalised document as one space-separated string.

    Lower-case, without ``[^A-Za-z0-9 ]+``, without tokens of one or two
    characters or in the stop list (tokens are delimited by spaces).  Without
    lemmas an Arrow UDF does this text by text: deleting bytes and splitting
    cost far less there than a regex that looks at every character.
    ``lemmas`` is an optional small form->lemma mapping applied after the
    stop-word and length tests (as the reference does); large lemma tables go
    through ``operators.terms.lemmatise``.
    """
    if not lemmas:
        stop = default_stop_words() if stop_words is None else list(stop_words)
        return _normaliser(stop)(F.lower(_col(text)))
    toks = clean_tokens(text, stop_words)
    m = F.create_map(*[F.lit(x) for kv in sorted(lemmas.items()) for x in kv])
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), t)), " ")


# Fixed: the noun endings and what stands in their place in the base form.
DETACHMENTS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
               ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
SHORTEST_PLURAL = 4


def noun_bases(token) -> Column:
    """the base forms that a token may be the plural of (none for short
    tokens and those in ``ss``); which are words is for the corpus to say."""
    t = _col(token)
    made = F.array(*[F.when(t.endswith(end), F.concat(F.left(t, F.length(t) - len(end)), F.lit(base)))
                     for end, base in DETACHMENTS])
    return F.when((F.length(t) < SHORTEST_PLURAL) | t.endswith("ss"), F.array().cast("array<string>")).otherwise(
        F.array_compact(made))


def term_tokens(clean_text) -> Column:
    """F4 on normalised text: whole words of at least 5 ASCII letters."""
    return F.filter(F.split(_col(clean_text), " "), lambda t: t.rlike(TERM_TOKEN))


def ngrams(tokens, n: int) -> Column:
    """adjacent n-grams of a token array, joined by one space."""
    toks = _col(tokens)
    return F.when(
        F.size(toks) >= n,
        F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)),
                    lambda i: F.array_join(F.slice(toks, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens, lo: int, hi: int) -> Column:
    parts = [ngrams(tokens, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


# --------------------------------------------------------------------------
# Cleaning of generated and raw text
# --------------------------------------------------------------------------

def py_strip(text) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends
    (``btrim`` with the explicit character set, no regex)."""
    return F.btrim(_col(text), F.lit(PY_WHITESPACE))


def clean_text(text) -> Column:
    """collapse whitespace, dot runs to '. ', non-ASCII runs to ' ', strip."""
    t = F.regexp_replace(_col(text), WS_CLASS + "+", " ")
    t = F.regexp_replace(t, DOT_RUN + "+", ". ")
    t = F.regexp_replace(t, NON_ASCII_RUN, " ")
    return py_strip(t)


def clean_final_summary(text) -> Column:
    """ASCII only, whitespace collapsed, repeated words collapsed,
    closing punctuation ensured.  Uses a back-reference (Java regex)."""
    t = F.regexp_replace(_col(text), NON_ASCII_RUN, " ")
    t = py_strip(F.regexp_replace(t, WS_CLASS + "+", " "))
    t = F.regexp_replace(t, REPEATED_WORD, "$1")
    return F.when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def postprocess_summary(text) -> Column:
    """F8: whitespace, 2+ dot runs, quoted numbers, prompt remnant, then F7."""
    t = F.regexp_replace(_col(text), WS_CLASS + "+", " ")
    t = F.regexp_replace(t, DOT_RUN + "{2,}", ". ")
    t = F.regexp_replace(t, QUOTED_NUMBER, "")
    t = F.regexp_replace(t, PROMPT_REMNANT, "")
    return clean_final_summary(t)


# --------------------------------------------------------------------------
# Sentences, word counts, title case
# --------------------------------------------------------------------------

def split_sentences(text) -> Column:
    """F9 (rule based): split after . ! ? followed by whitespace."""
    marked = F.regexp_replace(_col(text), SENTENCE_END, "$1" + SENTENCE_SEP)
    return F.filter(F.split(marked, SENTENCE_SEP), lambda s: F.length(s) > 0)


def word_count(text) -> Column:
    """number of whitespace-separated words (Python ``len(s.split())``)."""
    parts = F.split(_col(text), WS_CLASS + "+")
    return F.size(F.filter(parts, lambda w: F.length(w) > 0))


def title_case(text) -> Column:
    """Python ``str.title`` (a letter run starts upper, rest lower)."""
    pieces = F.regexp_extract_all(_col(text), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    # A word-initial sharp s title-cases to 'Ss' (Unicode special casing).
    return F.array_join(F.transform(pieces, lambda p: F.when(
        p.rlike(r"^\p{L}"),
        F.concat(F.when(F.substring(p, 1, 1) == "\u00df", F.lit("Ss"))
                 .otherwise(F.upper(F.substring(p, 1, 1))),
                 F.lower(F.substring(p, 2, 1 << 30))),
    ).otherwise(p)), "")


# --------------------------------------------------------------------------
# Summary text layout
# --------------------------------------------------------------------------

def split_subthemes(text) -> Column:
    """pieces after each 'Subtheme N: ' marker (piece 0 dropped)."""
    parts = F.split(_col(text), SUBTHEME_MARK)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def subtheme_label(piece) -> Column:
    """F13 label: quoted form -> text in quotes without trailing '-';
    else text before the first ' - '; else ''."""
    p = _col(piece)
    quoted = F.regexp_replace(
        F.trim(F.regexp_extract(p, QUOTED_LABEL, 1)), r"[\s-]+$", "")
    dash = F.split(p, " - ", 2)
    return (F.when(p.startswith("'") & p.rlike(QUOTED_LABEL), quoted)
            .when(F.size(dash) > 1, F.trim(dash[0]))
            .otherwise(F.lit("")))


def subtheme_body(piece, strip_trailer: bool = False) -> Column:
    """F13 body: text after the label; optional removal of the trailing
    '\\n<label> -' that every piece but the last carries."""
    p = _col(piece)
    quoted = F.trim(F.regexp_extract(p, QUOTED_LABEL, 2))
    dash = F.split(p, " - ", 2)
    body = (F.when(p.startswith("'") & p.rlike(QUOTED_LABEL), quoted)
            .when(F.size(dash) > 1, F.trim(dash[1]))
            .otherwise(F.trim(p)))
    if strip_trailer:
        body = F.regexp_replace(body, LABEL_TRAILER, "")
    return body


def prefix_label(label, text, subtheme_no=None, subtheme=None) -> Column:
    """'{label}: {text}' or '{label} - Subtheme i: {sub} - {text}'."""
    if subtheme_no is None:
        return F.concat_ws(": ", _col(label), _col(text))
    return F.concat(_col(label), F.lit(" - Subtheme "), _col(subtheme_no).cast("string"),
                    F.lit(": "), _col(subtheme), F.lit(" - "), _col(text))


# --------------------------------------------------------------------------
# Parsing, keys, labels
# --------------------------------------------------------------------------

def parse_vector(text) -> Column:
    """every number matched in the text form of a vector, as double."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(VECTOR_NUMBER), 1),
                       lambda x: x.cast("double"))


def vector_text(vec) -> Column:
    """Text form of a vector, '[x y ...]' with 8-digit scientific numbers."""
    return F.concat(F.lit("["), F.array_join(F.transform(
        _col(vec), lambda x: F.format_string("%.8e", x.cast("double"))), " "), F.lit("]"))


def count_substring(text, term: str) -> Column:
    """F14 for one literal term: non-overlapping count in lower(text)."""
    t = F.lower(_col(text))
    return ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / len(term)).cast("long")


def join_key(title, abstract) -> Column:
    """strip+lower title and abstract, no separator; null if either is."""
    return F.concat(F.lower(py_strip(_col(title))), F.lower(py_strip(_col(abstract))))


def safe_name(text) -> Column:
    """' ' and '/' become '_'."""
    return F.translate(_col(text), " /", "__")


def truncate_label(text, max_chars: int = 30, keep: int = 20) -> Column:
    """labels of >= 30 characters become first 20 + '...'."""
    t = _col(text)
    return F.when(F.length(t) >= max_chars, F.concat(F.substring(t, 1, keep), F.lit("..."))).otherwise(t)


def default_label(topic, words=None) -> Column:
    """'Topic-{id}: w1 w2 ...' or 'Topic-{id}'."""
    base = F.concat(F.lit("Topic-"), _col(topic).cast("string"))
    if words is None:
        return base
    return F.concat(base, F.lit(": "), _col(words))


def extract_year(date_text) -> Column:
    """first 19xx/20xx in a display date, else null."""
    y = F.regexp_extract(_col(date_text), YEAR_PATTERN, 0)
    return F.when(y == "", F.lit(None)).otherwise(y.cast("int"))


def null_sentinels(text, sentinels=NULL_SENTINELS) -> Column:
    """placeholder strings written for failed records become NULL."""
    t = _col(text)
    return F.when(t.isin(list(sentinels)), F.lit(None).cast("string")).otherwise(t)


def fallback_text(summary, source, chars: int = 500) -> Column:
    """a failed summary falls back to the first 500 characters."""
    return F.coalesce(_col(summary), F.substring(_col(source), 1, chars),
                      F.lit("[SUMMARY FAILED]"))
