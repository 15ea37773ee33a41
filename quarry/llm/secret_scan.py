"""Secret scans: fixed patterns and sliding-window Shannon entropy.

*Patterns* (leftmost, non-overlapping per kind): assignments of a value of 6
or more characters to a password-like name, access keys, runs of 24 or more
lower-case hex digits.

*Entropy.*  Candidate strings are runs of 20 or more characters of the base64
alphabets.  A candidate's class (hex, digits and one letter case, mixed)
sets the alphabet and so the entropy that random characters show.  A window
of ``WINDOW`` characters slides over it; its entropy is ``log2 W - S / W``
with ``S = sum c log2 c`` over the counts c of its characters, and S moves
with the one character that leaves and the one that enters.  The stretch of
windows at or above the class's threshold is a span of kind ``entropy``.

*Allow list.*  Candidates without a digit (words, identifiers) and UUIDs are
suppressed.  So are the placeholder words inside a candidate and the digest
that follows the name of a checksum, but no more than these: the stretches
between them are scanned on their own, each with its class.

All of it is built-in column functions on one row: no shuffle, no Python.
Places are code points, ends exclusive.  Work is linear in the text for
texts with few matches; running places are summed chunk by chunk, so many
matches in one text stay cheap.

Defined results: null and empty texts have no spans and stay as they are;
equal texts give equal spans; an empty table gives none; spans of several
kinds may overlap and are all reported; redaction merges them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bind, whole_text

# Fixed patterns of the base kinds, in the order that ties are listed in.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Least entropy in bits of a window of each class: about the lowest that 20
# random characters of 16, 36 and 62 show.
HEX_BITS, CASE_BITS, MIXED_BITS = 2.9, 3.5, 3.7
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]?|xxxx|0123456789|abcdefghij"
CHECKSUM_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|crc32|checksum|integrity|commit)[\"']?\x20*[:=-]?\x20*[\"']?$"
# The digest that the name of a checksum stands for: hex up to a separator, or base64.
DIGEST = r"^(?:(?i:sha-?[0-9]+)[-_=])?(?:[0-9A-Fa-f]{7,}(?![0-9A-Za-z+])|[0-9A-Za-z+/]+={0,2})"
CONTEXT = 24  # characters before a candidate that may name a checksum
CHUNK = 256
MARK = "[SECRET]"

_SPAN = "array<struct<start:bigint,end:bigint,body:string,before:string>>"


def _placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, body, before) of all matches; ``before`` is the
    end of the text between the match and the one before."""
    def run(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["len"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), m["body"].alias("body"), m["before"].alias("before")))).alias("out"))

    empty = F.array().cast(_SPAN)

    def chunks(acc: Column, k: Column, steps: Column) -> Column:
        part = F.aggregate(F.slice(steps, k * CHUNK + 1, CHUNK), F.struct(acc["at"].alias("at"), empty.alias("out")), run)
        return bind(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = bind(gaps, lambda g: F.transform(found, lambda m, i: F.struct(
            F.char_length(F.get(g, i)).cast("long").alias("gap"), F.char_length(m).cast("long").alias("len"),
            m.alias("body"), F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"))))
        return bind(steps, lambda s: F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")),
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
            lambda acc, k: chunks(acc, k, s))["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(found, lambda f: F.when(F.size(f) == 0, empty).otherwise(located(f)))


def _spans(placed: Column, kind: str) -> Column:
    return F.transform(placed, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def hot_stretch(body: Column, least: Column) -> Column:
    """(first, upto): characters from the first to the end of the last window
    whose entropy is at least ``least`` bits; null without one."""
    import math

    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])

    def times(window: Column, ch: Column) -> Column:
        return F.size(F.filter(window, lambda x: x == ch))

    def of(chars: Column) -> Column:
        def moved(acc: Column, i: Column) -> Column:
            # the window from i - 1 becomes the one from i
            shared = F.slice(chars, i + 1, WINDOW - 1)
            out, new = times(shared, F.get(chars, i - 1)), times(shared, F.get(chars, i + (WINDOW - 1)))
            total = (acc["s"] - F.get(logs, out + 1) + F.get(logs, out)
                     + F.get(logs, new + 1) - F.get(logs, new))
            return noted(acc, total, i)

        def noted(acc: Column, total: Column, i: Column) -> Column:
            def state(s: Column) -> Column:
                hot = F.lit(math.log2(WINDOW)) - s / WINDOW >= least - 1e-9
                return F.struct(s.alias("s"),
                                F.when(hot, F.coalesce(acc["first"], i)).otherwise(acc["first"]).alias("first"),
                                F.when(hot, i + WINDOW).otherwise(acc["upto"]).alias("upto"))
            return bind(total, state)

        none = F.lit(None).cast("int")
        window = F.slice(chars, 1, WINDOW)
        # sum of log2 c over the characters is sum of c log2 c over the counts
        begin = F.aggregate(window, F.lit(0.0), lambda a, x: a + F.log2(times(window, x).cast("double")))
        start = noted(F.struct(none.alias("first"), none.alias("upto")), begin, F.lit(0))
        rest = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(rest, start, moved)

    return bind(F.split(body, ""), lambda c: bind(F.filter(c, lambda x: x != ""), of))


def entropy_spans(text: Column) -> Column:
    """Spans of kind ``entropy``."""
    def kept(s: Column) -> Column:
        return s["body"].rlike("[0-9]") & ~s["body"].rlike(UUID)

    def undigested(s: Column) -> Column:
        # the candidate behind the digest of a checksum
        n = F.when(s["before"].rlike(CHECKSUM_BEFORE), F.char_length(F.regexp_extract(s["body"], DIGEST, 0))).otherwise(F.lit(0))
        return bind(n, lambda n: F.struct((s["start"] + n).alias("start"),
                                          F.substring(s["body"], n + 1, F.char_length(s["body"])).alias("body")))

    def stretches(s: Column) -> Column:
        # (start, body) between the placeholders of a candidate
        def between(p: Column) -> Column:
            def stretch(i: Column) -> Column:
                lo = F.coalesce(F.get(p, i - 1)["end"], F.lit(0).cast("long"))
                hi = F.coalesce(F.get(p, i)["start"], F.char_length(s["body"]).cast("long"))
                return F.struct((s["start"] + lo).alias("start"),
                                F.substring(s["body"], (lo + 1).cast("int"), (hi - lo).cast("int")).alias("body"))
            return F.transform(F.sequence(F.lit(0), F.size(p)), stretch)

        return F.when(s["body"].rlike(PLACEHOLDER), bind(_placed(s["body"], PLACEHOLDER), between)).otherwise(F.array(s))

    def least(b: Column) -> Column:
        return (F.when(b.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), F.lit(HEX_BITS))
                .when(~b.rlike("[a-z]") | ~b.rlike("[A-Z]"), F.lit(CASE_BITS)).otherwise(F.lit(MIXED_BITS)))

    runs = F.transform(F.filter(_placed(text, CANDIDATE), kept), lambda s: bind(undigested(s), stretches))
    long = F.filter(F.flatten(runs), lambda s: F.char_length(s["body"]) >= WINDOW)
    hot = F.transform(long, lambda s: F.struct(
        s["start"].alias("start"), hot_stretch(s["body"], least(s["body"])).alias("hot")))
    return F.transform(F.filter(hot, lambda s: s["hot"]["first"].isNotNull()), lambda s: F.struct(
        (s["start"] + s["hot"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"),
        (s["start"] + s["hot"]["upto"]).alias("end")))


def all_spans(text: Column) -> Column:
    """All spans of a text: array of (start, kind, end), sorted."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = bind(values, lambda v: F.when(F.size(v) == 0, F.array().cast(_SPAN)).otherwise(
        F.filter(_placed(text, ASSIGN), lambda s, i: F.char_length(F.get(v, i)) >= MIN_VALUE)))
    return F.sort_array(F.concat(_spans(assign, "assign"), _spans(_placed(text, ACCESS), "access"),
                                 _spans(_placed(text, HEX), "hex"), entropy_spans(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_entropy per row."""
    rows = docs.select(F.col(id_col), all_spans(whole_text(text_col)).alias("__spans"))
    spans = F.col("__spans")

    def n(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] < KINDS.index("entropy"))
    return rows.select(F.col(id_col), n("assign"), n("access"), n("hex"),
                       F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), n("entropy"))


def redact(text: Column, mark: str = MARK) -> Column:
    """The text with every stretch that spans cover replaced by ``mark``."""
    def gaps(spans: Column) -> Column:
        # sorted spans: a gap opens where all spans before have ended
        def step(acc: Column, s: Column) -> Column:
            gap = F.struct(acc["at"].alias("from"), s["start"].alias("upto"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

        empty = F.array().cast("array<struct<from:bigint,upto:bigint>>")
        done = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)
        piece = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
        return bind(done, lambda d: F.concat(
            F.array_join(F.transform(d["out"], lambda g: F.concat(piece(g["from"], g["upto"] - g["from"]), F.lit(mark))), ""),
            piece(d["at"], F.char_length(text))))

    return bind(all_spans(text), lambda s: F.when(F.size(s) == 0, text).otherwise(gaps(s)))


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with redacted texts (null stays null) and their new length in
    ``length_col``; all other columns as they are."""
    new = docs.withColumn("__new", F.when(F.col(text_col).isNotNull(), redact(whole_text(text_col))))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("__new").alias(c))
        elif c == length_col:
            columns.append(F.when(F.col("__new").eqNullSafe(F.col(text_col)), F.col(c)).otherwise(
                F.char_length("__new")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return new.select(*columns)


def sql() -> str:
    """The same scan as DuckDB SQL over ``documents``: places from the pieces
    between matches, every window's entropy on its own.  It suppresses a
    candidate with a placeholder or behind a checksum's name wholly, so it
    lacks the entropy spans of what else is in such a candidate."""
    def lit(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def placed(kind: str, pattern: str, value: str = "0") -> str:
        p = lit(pattern)
        return f"""{kind}_all AS (
  SELECT row_, i, m[i] AS body, v[i] AS value, right(g[i], {CONTEXT}) AS before,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start_
  FROM (SELECT row_, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT row_, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {value}) AS v, string_split_regex(t, {p}) AS g FROM docs)))"""

    def spans(kind: str, where: str = "true") -> str:
        return (f"SELECT row_, start_, {KINDS.index(kind)} AS kind, start_ + length(body) AS end_, '{kind}' AS name "
                f"FROM {kind}_all WHERE {where}")

    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS t FROM documents),
{placed("assign", ASSIGN, "2")},
{placed("access", ACCESS)},
{placed("hex", HEX)},
{placed("candidate", CANDIDATE)},
chosen AS (
  SELECT row_, start_, body, CASE WHEN regexp_matches(body, '^[0-9a-f]+$|^[0-9A-F]+$') THEN {HEX_BITS}
    WHEN NOT regexp_matches(body, '[a-z]') OR NOT regexp_matches(body, '[A-Z]') THEN {CASE_BITS} ELSE {MIXED_BITS} END AS least_
  FROM candidate_all WHERE regexp_matches(body, '[0-9]') AND NOT regexp_matches(body, {lit(UUID)})
    AND NOT regexp_matches(body, {lit(PLACEHOLDER)}) AND NOT regexp_matches(before, {lit(CHECKSUM_BEFORE)})),
windows AS (SELECT row_, start_, body, least_, unnest(range(0, length(body) - {WINDOW - 1})) AS i FROM chosen),
hot AS (
  SELECT row_, start_, min(i) AS first_, max(i) AS last_ FROM windows
  WHERE list_entropy(string_split(substring(body, CAST(i + 1 AS BIGINT), {WINDOW}), '')) >= least_ - 1e-9 GROUP BY row_, start_),
spans AS (
  {spans("assign", f"length(value) >= {MIN_VALUE}")} UNION ALL {spans("access")} UNION ALL {spans("hex")}
  UNION ALL SELECT row_, start_ + first_, {KINDS.index("entropy")}, start_ + last_ + {WINDOW}, 'entropy' FROM hot),
said AS (SELECT row_, kind, start_, end_, name || ':' || CAST(CAST(start_ AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(end_ AS BIGINT) AS VARCHAR) AS s FROM spans)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start_, kind, end_) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start_, kind, end_), '') AS spans, count(*) FILTER (WHERE kind = 3) AS n_entropy
FROM docs LEFT JOIN said USING (row_) GROUP BY row_"""
