"""Sentence ends learned from the corpus.

A period ends a sentence unless what precedes it is an abbreviation, an
initial, a number or an ellipsis, and even these may stand at an end.  Which
words are abbreviations, which pairs belong together over a period and which
words begin sentences is learned without labels, by the published log-
likelihood tests of Kiss and Strunk (2006):

1. One pass counts the tokens by (kind of the token before, type, period,
   case).  It is the only aggregate over tokens, combined on the map side.
2. A type is an *abbreviation* if the likelihood that its period belongs to
   it, weighted by its length, inner periods and occurrences without a
   period, reaches ``ABBREVIATION``.
3. A type is a *starter* if it follows ends of sentences more often than by
   chance (``STARTER``); a pair over the period of an abbreviation, initial
   or number is a *collocation* likewise (``COLLOCATION``).
4. Each distinct pair around a special period is judged once, with the
   orthography of the word behind it.  Pairs that do not break a sentence are
   a table, by which texts are split where they are (``rewrite``).

Statistics cover all texts; nothing is collected but that table, and only if
it is small.  Null texts give null, empty ones no sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.rewrite import MAX_ITEMS, replace_items
from quarry.session import written_table

# Fixed values of the published method.
ABBREVIATION = 0.3
COLLOCATION = 7.88
STARTER = 30.0
OWN_PERIOD = 0.99  # how surely an abbreviation has its period
LEAST_PAIRS = 2  # occurrences of a collocation

OPENERS = "[\"'(\\[{«“‘„]"
CLOSERS = "[\"')\\]}»”’]"
TRAILERS = "[\"')\\]}»”’,;:!?]"
CORE = f"^{OPENERS}+|{TRAILERS}+$"
NUMBER = "^[-+]?[0-9][0-9.,]*$"
INITIAL = r"^\p{L}$"
LETTER = r"\p{L}"
ELLIPSIS = r"^\.+$"
UPPER, LOWER = r"^\p{Lu}", r"^\p{Ll}"
EXCLAIMED_END = f"[!?]{CLOSERS}*$"
BOUNDARY = f"([.!?]{CLOSERS}*)({T.WS_CLASS}+)"
NON_WS = f"[^{T.PY_WHITESPACE}]"
LAST_TOKEN, FIRST_TOKEN = f"({NON_WS}+)$", f"^{T.WS_CLASS}*({NON_WS}+)"
CUT, END = "\u0001", "\u0002"
NUMBER_TYPE = "##"
FIRST, MID, EXCLAIMED = "^", "", "!"  # kinds of the token before that have no period
UNBROKEN = "-"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


# -- types of tokens --------------------------------------------------------------

def token_type(token: Column) -> tuple[Column, Column, Column]:
    """(type, has period, case) of a token: the lower-cased core without its
    last period, numbers being one type; case of its first character: U, L or -."""
    core = F.regexp_replace(token, CORE, "")
    dot = core.endswith(".")
    bare = F.when(dot, F.left(core, F.length(core) - 1)).otherwise(core)
    case = F.when(core.rlike(UPPER), "U").when(core.rlike(LOWER), "L").otherwise("-")
    return F.when(bare.rlike(NUMBER), F.lit(NUMBER_TYPE)).otherwise(F.lower(bare)), dot, case


def kind_before(token: Column) -> Column:
    """What a token is to the one behind it: its type with the period, an
    exclamation, a word inside a sentence, or none (the text begins)."""
    kind, dot, _ = token_type(token)
    return (F.when(token.isNull(), FIRST).when(dot, F.concat(kind, F.lit(".")))
            .when(token.rlike(EXCLAIMED_END), EXCLAIMED).otherwise(MID))


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(before, type, dot, cased, n) of all tokens, as a table."""
    tokens = F.array_remove(F.split(F.col(text_col), T.WS_CLASS + "+"), "")
    pairs = docs.where(F.col(text_col).isNotNull()).select(tokens.alias("t")).select(F.inline(F.arrays_zip(
        F.concat(F.array(F.lit(None).cast("string")), F.col("t")).alias("prev"), F.col("t").alias("token")))).where(
        "token IS NOT NULL")
    # a token without any of . ! ? is a word inside a sentence, whichever it is
    ends = F.contains("prev", F.lit(".")) | F.contains("prev", F.lit("!")) | F.contains("prev", F.lit("?"))
    raw = pairs.select(F.when(ends | F.col("prev").isNull(), F.col("prev")).otherwise(F.lit(MID)).alias("prev"), "token")
    # the patterns run once for a distinct pair, not for each token
    kind, dot, cased = token_type(F.col("token"))
    typed = raw.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n")).select(
        kind_before(F.col("prev")).alias("before"), kind.alias("type"), dot.alias("dot"), cased.alias("cased"), "n")
    return written_table(typed.groupBy("before", "type", "dot", "cased").agg(F.sum("n").cast("double").alias("n")))


# -- statistics -------------------------------------------------------------------

def _times_ln(x: Column, p: Column) -> Column:
    """x ln p, and 0 where x is 0."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(x * F.ln(p))


def association(both: Column, a: Column, b: Column, n: float) -> Column:
    """Dunning's log-likelihood ratio of b behind a against b anywhere (a and
    b occurrences, ``both`` of them together, of n)."""
    rest, alone, neither = b - both, a - both, n - a - b + both
    p, p_behind, p_else = b / n, both / a, rest / F.greatest(n - a, F.lit(1.0))
    apart = _times_ln(both, p_behind) + _times_ln(alone, 1 - p_behind) + _times_ln(rest, p_else) + _times_ln(neither, 1 - p_else)
    alike = _times_ln(both, p) + _times_ln(alone, 1 - p) + _times_ln(rest, p) + _times_ln(neither, 1 - p)
    return 2 * (apart - alike)


def _n(where: Column) -> Column:
    return F.sum(F.when(where, F.col("n")).otherwise(0.0))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, n_period, n_bare, score) of the types that are abbreviations."""
    n, dots = counts.agg(F.sum("n"), _n(F.col("dot"))).first()
    share = min((dots or 0.0) / (n or 1.0), OWN_PERIOD) or 1.0
    types = (counts.where(F.col("type").rlike(LETTER) & ~F.col("type").rlike(INITIAL)).groupBy("type")
             .agg(_n(F.col("dot")).alias("n_period"), _n(~F.col("dot")).alias("n_bare")).where("n_period > 0"))
    letters = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    ratio = 2 * (F.col("n_period") * F.ln(F.lit(OWN_PERIOD / share))
                 + F.col("n_bare") * F.ln(F.lit((1 - OWN_PERIOD) / (1 - share or 1.0))))
    inner = F.length("type") - letters + 1
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -F.col("n_bare"))
    return types.select("*", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def contexts(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Token counts with the role of the token before, as a table: (role,
    before, type, cased, n); role A abbreviation, I initial, N number, E
    ellipsis, R any other period, B no period but a beginning, M none."""
    dotted = counts.where(F.col("before").endswith(".")).withColumn(
        "__type", F.left("before", F.length("before") - 1))
    marked = dotted.join(known.select(F.col("type").alias("__type"), F.lit(True).alias("__known")), "__type", "left")
    role = (F.when(F.col("__known"), "A").when(F.col("__type").rlike(INITIAL), "I").when(F.col("__type") == NUMBER_TYPE, "N")
            .when(F.col("__type").rlike(ELLIPSIS), "E").otherwise("R"))
    other = counts.where(~F.col("before").endswith("."))
    columns = ["before", "type", "cased", "n"]
    return written_table(marked.select(role.alias("role"), *columns).unionByName(
        other.select(F.when(F.col("before") == MID, "M").otherwise("B").alias("role"), *columns)))


def unbroken_pairs(counts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(item, value): the pairs around a period that do not break a sentence."""
    around = contexts(counts, abbreviations(counts) if known is None else known)
    totals = around.agg(F.sum("n"), _n(F.col("role") == "R")).first()
    n, ends = totals[0] or 1.0, totals[1] or 0.0
    cased, role = F.col("cased"), F.col("role")
    begins = role.isin("R", "B")
    word = (around.groupBy("type").agg(
        F.sum("n").alias("n_type"), _n(role == "R").alias("n_begin"), _n(cased == "L").alias("lower"),
        _n(cased == "U").alias("upper"), _n((cased == "U") & (role == "M")).alias("upper_mid"),
        _n((cased == "L") & begins).alias("lower_begin")))
    begin = F.col("n_begin")
    by_chance = begin * n <= F.lit(ends) * F.col("n_type")
    word = written_table(word.withColumn("starter", F.coalesce(
        F.col("type").rlike(LETTER) & ~by_chance
        & (association(begin, F.lit(max(ends, 1.0)), F.col("n_type"), n) >= STARTER), F.lit(False))))
    special = around.where(role.isin("A", "I", "N", "E")).withColumn("first", F.left("before", F.length("before") - 1))
    joined = (special.join(word, "type")
              .join(word.select(F.col("type").alias("first"), F.col("n_type").alias("n_first")), "first"))
    same = Window.partitionBy("before", "type")  # at most three rows, one a case
    together = F.sum("n").over(same)
    belongs = ((role != "E") & F.col("type").rlike(LETTER) & ~F.col("starter") & (F.col("together") >= LEAST_PAIRS)
               & (F.col("together") * n > F.col("n_first") * F.col("n_type"))
               & (association(F.col("together"), F.col("n_first"), F.col("n_type"), n) >= COLLOCATION))
    opens = (cased == "U") & (F.col("lower") > 0) & (F.col("upper_mid") == 0)
    goes_on = (cased == "L") & ((F.col("upper") > 0) | (F.col("lower_begin") == 0))
    name = (role == "I") & (cased == "U") & (F.col("lower") == 0)
    whole = F.when(role.isin("A", "E"), ~(opens | ((cased == "U") & F.col("starter")))).otherwise(goes_on | name)
    return joined.withColumn("together", together).where(F.coalesce(belongs, F.lit(False)) | whole).select(
        F.concat("before", F.lit(" "), "type", "cased").alias("item"), F.lit(UNBROKEN).alias("value")).distinct()


# -- splitting --------------------------------------------------------------------

def split_at(docs: DataFrame, unbroken: DataFrame, text_col: str = "text", out: str = "sentences",
             max_items: int = MAX_ITEMS) -> DataFrame:
    """``docs`` with its texts' sentences in ``out`` (array of strings)."""
    pieces = F.split(F.regexp_replace(F.col(text_col), BOUNDARY, f"$1{CUT}$2"), CUT)

    def key(before: Column, after: Column) -> Column:
        def named(tokens: Column) -> Column:
            kind, _, cased = token_type(tokens["after"])
            return F.concat(kind_before(tokens["before"]), F.lit(" "), kind, cased)
        return bind(F.struct(F.element_at(F.split(before, T.WS_CLASS + "+"), -1).alias("before"),
                             F.regexp_extract(after, FIRST_TOKEN, 1).alias("after")), named)

    keys = bind(pieces, lambda ps: F.transform(ps, lambda p, i: F.when(i < F.size(ps) - 1, key(p, F.get(ps, i + 1)))))
    cut = docs.withColumns({"__pieces": pieces, "__keys": keys})
    judged = replace_items(cut, "__keys", unbroken, max_items)
    ended = bind(F.col("__keys"), lambda keys: F.array_join(F.transform("__pieces", lambda p, i: F.when(
        F.get(keys, i).eqNullSafe(F.lit(UNBROKEN)), p).otherwise(F.concat(p, F.lit(END)))), ""))
    sentences = F.filter(F.transform(F.split(ended, END), T.py_strip), lambda s: s != "")
    return judged.withColumn(out, sentences).drop("__pieces", "__keys")


def learned_sentences(docs: DataFrame, text_col: str = "text", out: str = "sentences",
                      corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with the sentences of its texts, by what ``corpus`` (or
    ``docs`` themselves) teaches about periods."""
    counts = token_counts(docs if corpus is None else corpus, text_col)
    return split_at(docs, unbroken_pairs(counts), text_col, out)


# -- the same as SQL ---------------------------------------------------------------

def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _typed_sql(token: str, prefix: str) -> str:
    core = f"regexp_replace({token}, {_sql(CORE)}, '', 'g')"
    bare = f"regexp_replace({core}, '[.]$', '')"
    return (f"CASE WHEN regexp_matches({bare}, {_sql(NUMBER)}) THEN '{NUMBER_TYPE}' ELSE lower({bare}) END AS {prefix}type, "
            f"ends_with({core}, '.') AS {prefix}dot, CASE WHEN regexp_matches({core}, {_sql(UPPER)}) THEN 'U' "
            f"WHEN regexp_matches({core}, {_sql(LOWER)}) THEN 'L' ELSE '-' END AS {prefix}cased")


def _kind_sql(token: str, prefix: str) -> str:
    return (f"CASE WHEN {token} IS NULL THEN '{FIRST}' WHEN {prefix}dot THEN {prefix}type || '.' "
            f"WHEN regexp_matches({token}, {_sql(EXCLAIMED_END)}) THEN '{EXCLAIMED}' ELSE '{MID}' END")


def _association_sql(both: str, a: str, b: str) -> str:
    def part(x: str, p: str) -> str:
        return f"CASE WHEN {x} <= 0 THEN 0 ELSE ({x}) * ln({p}) END"
    rest, alone, neither = f"({b} - {both})", f"({a} - {both})", f"(n_all - {a} - {b} + {both})"
    p, q, e = f"({b} / n_all)", f"({both} / {a})", f"({rest} / greatest(n_all - {a}, 1))"
    apart = [part(both, q), part(alone, f"1 - {q}"), part(rest, e), part(neither, f"1 - {e}")]
    alike = [part(both, p), part(alone, f"1 - {p}"), part(rest, p), part(neither, f"1 - {p}")]
    return f"2 * ({' + '.join(apart)} - ({' + '.join(alike)}))"


def sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs ``abbr`` (type, n_period, n_bare, score) and ``sents`` (key, s)."""
    ws = T.WS_CLASS
    return f"""toks AS (SELECT {key}, list_filter(string_split_regex({text}, '{ws}+'), lambda x: x <> '') AS t FROM {table} WHERE {text} IS NOT NULL),
pairs AS (SELECT unnest(t) AS token, unnest(list_prepend(NULL, t[1:len(t) - 1])) AS prev FROM toks WHERE len(t) > 0),
typed AS (SELECT {_typed_sql('token', '')}, {_typed_sql('prev', 'p_')}, prev FROM pairs),
counts AS (SELECT {_kind_sql('prev', 'p_')} AS before, type, dot, cased, CAST(count(*) AS DOUBLE) AS n FROM typed GROUP BY ALL),
whole AS (SELECT sum(n) AS n_all, least(sum(CASE WHEN dot THEN n ELSE 0 END) / sum(n), {OWN_PERIOD}) AS share FROM counts),
types AS (SELECT type, sum(CASE WHEN dot THEN n ELSE 0 END) AS n_period, sum(CASE WHEN dot THEN 0 ELSE n END) AS n_bare FROM counts
  WHERE regexp_matches(type, '{LETTER}') AND NOT regexp_matches(type, '{INITIAL}') GROUP BY type),
scored AS (SELECT type, n_period, n_bare, length(replace(type, '.', '')) AS letters,
  2 * (n_period * ln({OWN_PERIOD} / share) + n_bare * ln({1 - OWN_PERIOD} / (1 - share))) * exp(-letters)
  * (length(type) - letters + 1) * pow(letters, -n_bare) AS score FROM types, whole WHERE n_period > 0),
abbr AS (SELECT type, n_period, n_bare, score FROM scored WHERE score >= {ABBREVIATION}),
around AS (SELECT before, left(before, length(before) - 1) AS first_, type, cased, n,
  CASE WHEN NOT ends_with(before, '.') THEN CASE WHEN before = '{MID}' THEN 'M' ELSE 'B' END
       WHEN first_ IN (SELECT type FROM abbr) THEN 'A' WHEN regexp_matches(first_, '{INITIAL}') THEN 'I'
       WHEN first_ = '{NUMBER_TYPE}' THEN 'N' WHEN regexp_matches(first_, '{ELLIPSIS}') THEN 'E' ELSE 'R' END AS role FROM counts),
ends AS (SELECT sum(n) FILTER (WHERE role = 'R') AS n_ends FROM around),
word0 AS (SELECT type, sum(n) AS n_type, coalesce(sum(n) FILTER (WHERE role = 'R'), 0) AS n_begin,
  bool_or(cased = 'L') AS lower_, bool_or(cased = 'U') AS upper_, bool_or(cased = 'U' AND role = 'M') AS upper_mid,
  bool_or(cased = 'L' AND role IN ('R', 'B')) AS lower_begin FROM around GROUP BY type),
word AS (SELECT *, coalesce(regexp_matches(type, '{LETTER}') AND n_begin * n_all > n_ends * n_type
  AND {_association_sql('n_begin', 'n_ends', 'n_type')} >= {STARTER}, false) AS starter FROM word0, whole, ends),
tied AS (SELECT first_, a.type FROM (SELECT first_, type, sum(n) AS both_ FROM around WHERE role IN ('A', 'I', 'N') GROUP BY ALL) a
  JOIN word w ON w.type = a.type JOIN (SELECT type AS first_, n_type AS n_first FROM word) USING (first_)
  WHERE regexp_matches(a.type, '{LETTER}') AND NOT starter AND both_ >= {LEAST_PAIRS} AND both_ * n_all > n_first * n_type
    AND {_association_sql('both_', 'n_first', 'n_type')} >= {COLLOCATION}),
unbroken AS (SELECT DISTINCT before || ' ' || a.type || cased AS k FROM around a JOIN word w USING (type)
  WHERE role IN ('A', 'I', 'N', 'E') AND ((role <> 'E' AND (first_, a.type) IN (SELECT first_, type FROM tied)) OR
    CASE WHEN role IN ('A', 'E') THEN NOT (cased = 'U' AND (starter OR (lower_ AND NOT upper_mid)))
         ELSE (cased = 'L' AND (upper_ OR NOT lower_begin)) OR (role = 'I' AND cased = 'U' AND NOT lower_) END)),
cut AS (SELECT {key}, string_split(regexp_replace({text}, {_sql(BOUNDARY)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM {table}),
piece AS (SELECT {key}, i, p[i] AS piece, CASE WHEN i < len(p) THEN regexp_extract(p[i], '{LAST_TOKEN}', 1) END AS prev,
  CASE WHEN i < len(p) THEN regexp_extract(p[i + 1], '{FIRST_TOKEN}', 1) END AS token FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut)),
ptyped AS (SELECT {key}, i, piece, prev, {_typed_sql('token', '')}, {_typed_sql('prev', 'p_')} FROM piece),
judged AS (SELECT {key}, i, piece, coalesce({_kind_sql('prev', 'p_')} || ' ' || type || cased IN (SELECT k FROM unbroken), false) AS on_ FROM ptyped),
sents AS (SELECT {key}, list_filter(list_transform(string_split(string_agg(piece || CASE WHEN on_ THEN '' ELSE chr(2) END, '' ORDER BY i), chr(2)),
  lambda x: regexp_replace(x, '^{ws}+|{ws}+$', '', 'g')), lambda x: x <> '') AS s FROM judged GROUP BY {key})"""
