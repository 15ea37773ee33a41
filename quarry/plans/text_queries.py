"""Registered queries: text cleaning, keys, parsing, sentences, summary
layout, names and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import sentences as SE, similarity as S, terms as TM
from quarry.plans import sqlparts as Q
from quarry.plans.registry import register
from quarry.plans.vector_queries import CENT_CTE, _doc_topic
from quarry.sources.tables import TITLE_SQL, corpus, table, title_of

WS = T.PY_WHITESPACE


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _clean_sql(x: str) -> str:
    t = f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '(\\.[{WS}]*)+', '. ', 'g')"
    t = f"regexp_replace({t}, '[^\\x00-\\x7F]+', ' ', 'g')"
    return _strip_sql(t)


def _wc_sql(x: str) -> str:
    s = _strip_sql(x)
    return f"CASE WHEN length({s}) = 0 THEN 0 ELSE len(string_split_regex({s}, '[{WS}]+')) END"


@register("clean_text_docs", f"SELECT doc_id, {_clean_sql('text')} AS clean FROM documents")
def clean_text_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text("text").alias("clean"))


@register("join_key", f"""SELECT doc_id,
md5(lower({_strip_sql(TITLE_SQL)}) || lower({_strip_sql('text')})) AS key_md5 FROM documents""")
def join_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.join_key(title_of(), F.col("text"))).alias("key_md5"))


_VEC_TEXT = ("'[' || array_to_string(list_transform(embedding, lambda x: printf('%.8e', CAST(x AS DOUBLE))), ' ') || ']'")
_PARSED = (f"list_transform(regexp_extract_all({_VEC_TEXT}, '{T.VECTOR_NUMBER}', 1), "
           "lambda s: CAST(s AS DOUBLE))")


@register("parse_vector", f"""SELECT vec_id, len(p) AS n_values, round(list_sum(p), 6) AS checksum,
round(list_max(list_transform(list_zip(p, embedding), lambda z: abs(z[1] - CAST(z[2] AS DOUBLE)))), 6) AS max_err
FROM (SELECT vec_id, embedding, {_PARSED} AS p FROM embeddings)""")
def parse_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", F.col("embedding").cast("array<double>").alias("e"),
                 T.parse_vector(T.vector_text(F.col("embedding"))).alias("p"))
    err = F.array_max(F.zip_with("p", "e", lambda a, b: F.abs(a - b)))
    total = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x)
    return p.select("vec_id", F.size("p").alias("n_values"), F.round(total, 6).alias("checksum"),
                    F.round(err, 6).alias("max_err"))


_SENTS = (f"list_filter(string_split(regexp_replace(text, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)), "
          "lambda s: length(s) > 0)")


@register("split_sentences", f"""SELECT doc_id, len(s) AS n_sentences,
len(list_filter(s, lambda x: ({_wc_sql('x')}) < 5)) AS n_short, {_wc_sql('text')} AS n_words
FROM (SELECT doc_id, text, {_SENTS} AS s FROM documents)""")
def split_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.split_sentences("text").alias("s"))
    short = F.size(F.filter("s", lambda x: T.word_count(x) < 5))
    return d.select("doc_id", F.size("s").alias("n_sentences"), short.alias("n_short"),
                    T.word_count("text").alias("n_words"))


@register("learned_sentences", f"""WITH {SE.sql()}
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM documents LEFT JOIN sents USING (doc_id)""")
def learned_sentences(spark, sf_dir):
    """F9 by learned abbreviations, collocations and sentence starters."""
    d = SE.learned_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size("sentences").alias("n_sentences"),
                    F.md5(F.array_join("sentences", "\n")).alias("digest"))


@register("abbreviations", f"""WITH {SE.sql()}
SELECT type, n_period, n_bare, round(score, 6) AS score FROM abbr""")
def abbreviations(spark, sf_dir):
    """The abbreviations that F9 learns from all documents."""
    counts = SE.token_counts(table(spark, sf_dir, "documents"))
    return SE.abbreviations(counts).withColumn("score", F.round("score", 6))


@register("safe_name", "SELECT page_id, translate(url, ' /', '__') AS safe FROM pages")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name("url").alias("safe"))


@register("title_case", """SELECT doc_id, array_to_string(list_transform(
  regexp_extract_all(text, '(\\p{L}+|\\P{L}+)', 1),
  lambda p: CASE WHEN regexp_matches(p, '^\\p{L}') THEN (CASE WHEN substring(p, 1, 1) = chr(223) THEN 'Ss' ELSE upper(substring(p, 1, 1)) END) || lower(substring(p, 2)) ELSE p END), '') AS title
FROM documents""")
def title_case(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.title_case("text").alias("title"))


@register("extract_year", """SELECT CAST(regexp_extract(strftime(o_orderdate, '%-d %B %Y'), '(19|20)\\d{2}', 0) AS INTEGER) AS year,
count(*) AS n FROM orders GROUP BY 1""")
def extract_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shown = F.date_format("o_orderdate", "d MMMM yyyy")
    return o.groupBy(T.extract_year(shown).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@register("topic_labels", f"""WITH {Q.topic_terms_ctes(n=20)},
topics AS (SELECT DISTINCT cluster FROM corpus),
sizes AS (SELECT cluster, count(*) AS n FROM corpus WHERE cluster <> -1 GROUP BY cluster),
sel AS (SELECT cluster FROM sizes ORDER BY n DESC, cluster LIMIT 15),
w5 AS (SELECT cluster, string_agg(term, ' ' ORDER BY rank) AS w FROM ranked WHERE rank <= 5 GROUP BY cluster),
w9 AS (SELECT cluster, string_agg(term, ' ' ORDER BY rank) AS w FROM ranked WHERE rank <= 9 GROUP BY cluster),
lab AS (SELECT t.cluster,
   CASE WHEN t.cluster = -1 OR t.cluster NOT IN (SELECT cluster FROM sel) THEN 'Unlabelled'
        ELSE 'Topic-' || CAST(t.cluster AS VARCHAR) || ': ' || coalesce(w5.w, '') END AS label,
   CAST(t.cluster AS VARCHAR) || CASE WHEN w9.w IS NULL THEN '' ELSE ' ' || w9.w END AS aspect
   FROM topics t LEFT JOIN w5 USING (cluster) LEFT JOIN w9 USING (cluster))
SELECT cluster, label, CASE WHEN length(aspect) >= 30 THEN substring(aspect, 1, 20) || '...' ELSE aspect END AS aspect_label
FROM lab""")
def topic_labels(spark, sf_dir):
    c = corpus(spark, sf_dir)
    tt = TM.topic_terms(c, n=TM.TOP_N_WORDS)

    # the terms are planned once: both label lengths are cut from one list
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
    words = (tt.where(F.col("rank") <= 9).groupBy("cluster").agg(ranked.alias("terms"))
             .select("cluster", F.array_join(F.slice("terms", 1, 5), " ").alias("w5"), F.array_join("terms", " ").alias("w9")))
    sizes = c.where(F.col("cluster") != -1).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sel = sizes.orderBy(F.desc("n"), F.asc("cluster")).limit(15).select("cluster", F.lit(True).alias("sel"))
    topics = c.select("cluster").distinct()
    j = topics.join(words, "cluster", "left").join(sel, "cluster", "left")
    label = F.when((F.col("cluster") == -1) | F.col("sel").isNull(), F.lit("Unlabelled")).otherwise(
        T.default_label(F.col("cluster"), F.coalesce(F.col("w5"), F.lit(""))))
    aspect = F.concat(F.col("cluster").cast("string"),
                      F.when(F.col("w9").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("w9"))))
    return j.select("cluster", label.alias("label"), T.truncate_label(aspect).alias("aspect_label"))


@register("concat_by_cluster", f"""WITH {CENT_CTE},
rep AS (SELECT CAST(topic AS INTEGER) AS topic, doc_id,
        row_number() OVER (PARTITION BY topic ORDER BY round(sim, 6) DESC, doc_id) AS rank FROM dsim QUALIFY rank <= 100)
SELECT r.topic, count(*) AS n_docs, md5(string_agg(d.text, ' ' ORDER BY r.rank)) AS text_md5,
       sum(length(d.text)) + count(*) - 1 AS n_chars
FROM rep r JOIN documents d ON d.doc_id = r.doc_id GROUP BY r.topic""")
def concat_by_cluster(spark, sf_dir):
    """A1 over each topic's 100 representative documents (the bounded set
    the summariser reads), joined in rank order."""
    rep = S.top_members(_doc_topic(spark, sf_dir, S.TOP_DOCS), "sim", S.TOP_DOCS, group_col="topic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = rep.join(docs, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    g = j.groupBy("topic").agg(ordered.alias("s"), F.count(F.lit(1)).alias("n_docs"))
    joined = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    return g.select("topic", "n_docs", F.md5(joined).alias("text_md5"),
                    F.length(joined).cast("long").alias("n_chars"))


def _layout(spark, sf_dir):
    """per document, a summary text with a 'Subtheme i: label - body'
    part for every sentence of its whole text; the label is the sentence's
    beginning.  Row-local."""
    piece = F.transform(T.split_sentences("text"), lambda s, i: F.concat(
        F.lit("Subtheme "), (i + 1).cast("string"), F.lit(": "), F.substring(s, 1, 20), F.lit(" - "), s))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(piece, "\n").alias("summary"))


_Q = "''"
_LABEL_SQL = (f"CASE WHEN starts_with(p, {_Q}{_Q}) AND regexp_matches(p, '(?s)^{_Q}([^{_Q}]+){_Q}(.+)') "
              f"THEN regexp_replace(trim(regexp_extract(p, '(?s)^{_Q}([^{_Q}]+){_Q}(.+)', 1)), '[ \\t\\n\\r\\f-]+$', '') "
              "WHEN strpos(p, ' - ') > 0 THEN trim(split_part(p, ' - ', 1)) ELSE '' END")
_BODY_SQL = (f"CASE WHEN starts_with(p, {_Q}{_Q}) AND regexp_matches(p, '(?s)^{_Q}([^{_Q}]+){_Q}(.+)') "
             f"THEN trim(regexp_extract(p, '(?s)^{_Q}([^{_Q}]+){_Q}(.+)', 2)) "
             "WHEN strpos(p, ' - ') > 0 THEN trim(substring(p, strpos(p, ' - ') + 3)) ELSE trim(p) END")


@register("split_subthemes", f"""WITH sents AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0) AS s FROM documents),
layout AS (SELECT doc_id, array_to_string(list_transform(s, lambda x, i: 'Subtheme ' || CAST(i AS VARCHAR) || ': ' || substring(x, 1, 20) || ' - ' || x), chr(10)) AS summary
           FROM sents),
parts AS (SELECT doc_id, string_split_regex(summary, 'Subtheme \\d+: ') AS parts FROM layout),
ex AS (SELECT doc_id, unnest(parts[2:]) AS p, unnest(generate_series(1, len(parts) - 1)) AS subtheme_no FROM parts)
SELECT doc_id, CAST(subtheme_no AS INTEGER) AS subtheme_no, {_LABEL_SQL} AS label, {_BODY_SQL} AS body FROM ex""")
def split_subthemes(spark, sf_dir):
    """F12/F13 over every sentence of every document."""
    lay = _layout(spark, sf_dir)
    ex = lay.select("doc_id", F.posexplode(T.split_subthemes("summary")).alias("i", "p"))
    return ex.select("doc_id", (F.col("i") + 1).cast("int").alias("subtheme_no"),
                     T.subtheme_label("p").alias("label"), T.subtheme_body("p").alias("body"))


def _final_sql() -> str:
    """F7 in DuckDB without back-references (reads CTE ``src(doc_id, text)``).

    The ASCII, whitespace-collapsed text is cut into word / non-word pieces;
    a word equal (ignoring case) to the previous word, with only spaces or
    commas between them, is dropped together with that separator -- what
    the back-reference regex does to repeated runs."""
    ascii_ws = (f"regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g'), "
                f"'[{WS}]+', ' ', 'g')")
    return f""",
base AS (SELECT doc_id, {_strip_sql(ascii_ws)} AS s FROM src),
pieces AS (SELECT doc_id, unnest(l) AS p, unnest(generate_series(1, len(l))) AS i
           FROM (SELECT doc_id, regexp_extract_all(s, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS l FROM base)),
marked AS (SELECT doc_id, p, i,
           regexp_full_match(p, '[A-Za-z0-9_]+')
             AND coalesce(regexp_full_match(lag(p, 1) OVER w, '[ ,]+'), false)
             AND coalesce(lower(p) = lower(lag(p, 2) OVER w), false) AS dup
           FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
kept AS (SELECT doc_id, p, i FROM
           (SELECT *, lead(dup, 1) OVER (PARTITION BY doc_id ORDER BY i) AS next_dup FROM marked)
         WHERE NOT dup AND NOT coalesce(next_dup, false)),
joined AS (SELECT b.doc_id, coalesce(string_agg(k.p, '' ORDER BY k.i), '') AS t
           FROM base b LEFT JOIN kept k USING (doc_id) GROUP BY b.doc_id)
SELECT doc_id, CASE WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS clean FROM joined"""


_POST_SRC = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
             f"'[{WS}]+', ' ', 'g'), '(\\.[{WS}]*){{2,}}', '. ', 'g'), '''\\d+''', '', 'g'), "
             f"'(Avoid repetition and fragmented sentences\\.?[{WS}]*)', '', 'gi')")


@register("clean_final_summary", "WITH src AS (SELECT doc_id, text FROM documents)" + _final_sql())
def clean_final_summary(spark, sf_dir):
    """F7 on every document (Java back-reference regex; the oracle restates
    it without back-references)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean_final_summary("text").alias("clean"))


@register("postprocess_summary",
          f"WITH src AS (SELECT doc_id, {_POST_SRC} AS text FROM documents)" + _final_sql())
def postprocess_summary(spark, sf_dir):
    """F8 on every document, then F7 (oracle as for F7)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.postprocess_summary("text").alias("clean"))


_DIGEST_SQL = ("count(*) AS n_docs, CAST(sum(length(abstract)) + count(*) - 1 AS BIGINT) AS n_chars, "
               "CAST(sum(CAST('0x' || substr(md5(abstract), 1, 8) AS BIGINT)) AS BIGINT) AS digest")


@register("cluster_texts", f"""WITH {Q.corpus_cte()}
SELECT 'cluster' AS by, cluster AS key, {_DIGEST_SQL} FROM corpus GROUP BY cluster
UNION ALL SELECT 'year', year, {_DIGEST_SQL} FROM corpus GROUP BY year""")
def cluster_texts(spark, sf_dir):
    """A1 over all documents of each cluster and of each year: what their
    joined text holds (documents, characters with the blanks between, and a
    digest that no order changes), without building it."""
    c = corpus(spark, sf_dir)
    number = F.conv(F.substring(F.md5("abstract"), 1, 8), 16, 10).cast("long")

    def by(column: str):
        return c.groupBy(F.lit(column).alias("by"), F.col(column).alias("key")).agg(
            F.count(F.lit(1)).alias("n_docs"),
            (F.sum(F.length("abstract")) + F.count(F.lit(1)) - 1).cast("long").alias("n_chars"),
            F.sum(number).alias("digest"))

    return by("cluster").unionByName(by("year"))


@register("lemmatised_docs", f"""WITH toks AS (
  SELECT doc_id, unnest(t) AS form, unnest(range(1, len(t) + 1)) AS i FROM (
    SELECT doc_id, string_split({Q.preprocess('text')}, ' ') AS t FROM documents)),
forms AS (SELECT form, count(DISTINCT doc_id) AS n FROM toks GROUP BY form),
table_ AS (SELECT lower(n_name) AS form, 'nation' AS lemma FROM nation),
bases AS (SELECT form, n AS n_form, unnest({Q.noun_bases('form')}) AS base FROM forms),
rule AS (SELECT b.form, first(base ORDER BY length(base), base) AS lemma
         FROM bases b JOIN forms f ON f.form = b.base AND f.n * {TM.MIN_SHARE} >= b.n_form GROUP BY b.form),
pairs AS (SELECT * FROM table_ UNION ALL SELECT * FROM rule WHERE form NOT IN (SELECT form FROM table_)),
done AS (SELECT doc_id, string_agg(coalesce(lemma, form), ' ' ORDER BY i) AS doc
         FROM toks LEFT JOIN pairs USING (form) GROUP BY doc_id)
SELECT doc_id, doc FROM documents LEFT JOIN done USING (doc_id)""")
def lemmatised_docs(spark, sf_dir):
    """F2 with F3: normalised documents, lemmas from a table (here the
    nations' names), else by the corpus' own vocabulary."""
    lemmas = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("form"), F.lit("nation").alias("lemma"))
    toks = table(spark, sf_dir, "documents").select("doc_id", F.split(T.preprocess("text"), " ").alias("tok"))
    return TM.lemmatise(toks, "tok", lemmas).select("doc_id", F.array_join("tok", " ").alias("doc"))
