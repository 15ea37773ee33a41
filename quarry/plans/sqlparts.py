"""DuckDB SQL fragments shared by the oracle queries.

They restate the Spark column expressions of ``quarry.functions`` in
DuckDB's dialect so that every registered query has an independent
re-implementation to be compared against.
"""

from __future__ import annotations

from quarry.functions.stopwords import default_stop_words, sql_list
from quarry.functions.text import DETACHMENTS, SHORTEST_PLURAL
from quarry.sources.tables import corpus_sql

STOP = sql_list(default_stop_words())


def corpus_cte() -> str:
    return f"corpus AS ({corpus_sql()})"


def preprocess(col: str, stop: str = STOP) -> str:
    return ("array_to_string(list_filter(string_split(regexp_replace(lower({c}), "
            "'[^A-Za-z0-9 ]+', '', 'g'), ' '), lambda t: length(t) > 2 AND NOT "
            "list_contains({s}, t)), ' ')").format(c=col, s=stop)


def term_tokens(col: str) -> str:
    return f"list_filter(string_split({col}, ' '), lambda t: regexp_full_match(t, '[a-z]{{5,}}'))"


def ngrams(tok: str, n: int) -> str:
    return (f"list_transform(range(1, len({tok}) - {n} + 2), "
            f"lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))")


def ngram_range(tok: str, lo: int, hi: int) -> str:
    parts = [ngrams(tok, n) for n in range(lo, hi + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def topic_terms_ctes(n: int = 20, min_df: float = 0.05, max_df: float = 0.5,
                     lo: int = 2, hi: int = 3) -> str:
    """CTEs docs, counts, kept, scored, ranked (cluster, rank, term, score)."""
    return f"""{corpus_cte()},
docs AS (SELECT doc_id, cluster, {preprocess('abstract')} AS doc FROM corpus WHERE cluster <> -1),
toks AS (SELECT cluster, {term_tokens('doc')} AS tok FROM docs),
grams AS (SELECT cluster, unnest({ngram_range('tok', lo, hi)}) AS term FROM toks),
counts AS (SELECT cluster, term, count(*) AS tf FROM grams GROUP BY cluster, term),
ncls AS (SELECT count(DISTINCT cluster) AS c FROM docs),
per_term AS (SELECT term, count(*) AS n_classes, sum(tf) AS f FROM counts GROUP BY term),
kept AS (SELECT k.cluster, k.term, k.tf, p.n_classes, p.f FROM counts k JOIN per_term p USING (term), ncls
         WHERE p.n_classes >= {min_df} * ncls.c AND p.n_classes <= {max_df} * ncls.c),
totals AS (SELECT cluster, sum(tf) AS class_total FROM kept GROUP BY cluster),
avgt AS (SELECT floor(sum(tf) / (SELECT c FROM ncls)) AS a FROM kept),
scored AS (SELECT k.cluster, k.term, k.tf, k.tf / t.class_total * ln(1 + avgt.a / k.f) AS score
           FROM kept k JOIN totals t USING (cluster), avgt),
ranked AS (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INTEGER) AS rank,
           term, score FROM scored QUALIFY rank <= {n})"""


def encoder_ctes(name: str, src: str, key: str, text: str, dim: int = 64) -> str:
    """CTE ``name`` (key, v): the offline encoder's vector of each row of
    ``src``, from scratch: MD5 slots of words and word pairs, normalised."""
    return f"""{name}_tok AS (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '\\p{{L}}+|\\p{{N}}+') AS tok FROM {src}),
{name}_feat AS (SELECT {key}, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS f FROM {name}_tok),
{name}_slot AS (SELECT {key}, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % {2 * dim} AS h FROM {name}_feat),
{name}_sum AS (SELECT {key}, h % {dim} AS d, CAST(sum(CASE WHEN h < {dim} THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM {name}_slot GROUP BY ALL),
{name}_map AS (SELECT {key}, map(list(d), list(x)) AS m, sqrt(sum(x * x)) AS n FROM {name}_sum GROUP BY {key}),
{name} AS (SELECT s.{key}, CASE WHEN coalesce(n, 0) = 0 THEN list_transform(range({dim}), lambda d: 0.0::DOUBLE)
  ELSE list_transform(range({dim}), lambda d: coalesce(m[d], 0.0) / n) END AS v FROM {src} s LEFT JOIN {name}_map USING ({key}))"""


def cosine(a: str, b: str) -> str:
    """Cosine of two list columns, 0 for zero vectors, to 9 decimals."""
    return (f"round(CASE WHEN list_inner_product({a}, {a}) * list_inner_product({b}, {b}) > 0 "
            f"THEN list_cosine_similarity({a}, {b}) ELSE 0.0 END, 9)")


def mean_vector(v: str, dim: int = 64) -> str:
    """Element-wise mean of a group's list columns."""
    return "[" + ", ".join(f"avg({v}[{i + 1}])" for i in range(dim)) + "]"


def noun_bases(t: str) -> str:
    """The candidate bases of F3."""
    made = ", ".join(f"CASE WHEN ends_with({t}, '{end}') THEN left({t}, length({t}) - {len(end)}) || '{base}' END"
                     for end, base in DETACHMENTS)
    return (f"CASE WHEN length({t}) < {SHORTEST_PLURAL} OR ends_with({t}, 'ss') THEN [] "
            f"ELSE list_filter([{made}], lambda x: x IS NOT NULL) END")
