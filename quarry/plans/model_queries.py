"""Registered queries of the model half: embedding, reduction, density
clustering, sub-themes, keyword ranking, sentence dedupe, summaries, topic
report.

The offline encoder is a portable hash, so embedding, ranking by vector, MMR,
keyword labels, sentence dedupe and extractive summaries are restated in SQL
(the greedy ones as recursive queries).  What depends on a fitted PCA or on
seeded k-means has property tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import density, hierarchy, models, similarity as S, summaries as SM, terms as TM, topics
from quarry.functions import text as T
from quarry.functions.stopwords import label_stop_words, sql_list
from quarry.plans import sqlparts as Q
from quarry.plans.registry import register
from quarry.session import reliable_checkpoint
from quarry.sources.tables import corpus, table

# Fixed values of the reference clustering used on the driver tables.
MIN_SAMPLES = 5
MIN_CLUSTER_SIZE = 10
LABEL_STOP = sql_list(label_stop_words())


@register("embed", f"""WITH {Q.encoder_ctes('e', 'documents', 'doc_id', 'text')}
SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(round(x * 1000000) AS BIGINT)), ' ') AS embedding FROM e""")
def embed(spark, sf_dir):
    """M1 over every document; vectors as text, in millionths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    millionths = F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("long").cast("string"))
    return models.embed(docs, "text").select("doc_id", F.array_join(millionths, " ").alias("embedding"))


def _axis_sql(name: str, matrix: str, dim: int = 64, squarings: int = 18) -> str:
    """CTE ``name`` (v, lam): the leading eigenvector of the one-row matrix
    CTE, by repeated squaring; its largest loading is positive."""
    return f"""{name}_pow(k, m) AS (
  SELECT 0, m FROM {matrix}
  UNION ALL
  SELECT k + 1, list_transform(p, lambda r: list_transform(r, lambda x: x / t)) FROM (
    SELECT k, p, list_sum(list_transform(range(1, {dim} + 1), lambda i: p[i][i])) AS t FROM (
      SELECT k, list_transform(m, lambda r: list_transform(m, lambda q: list_inner_product(r, q))) AS p FROM {name}_pow WHERE k < {squarings}))),
{name}_row AS (SELECT m[list_position(n, list_max(n))] AS r FROM (
  SELECT m, list_transform(m, lambda r: list_inner_product(r, r)) AS n FROM {name}_pow WHERE k = {squarings})),
{name}_unit AS (SELECT list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) AS u FROM {name}_row),
{name} AS (SELECT v, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS lam FROM (
  SELECT list_transform(u, lambda x: x * sign(u[list_position(list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))])) AS v
  FROM {name}_unit), {matrix})"""


PCA_CTES = f"""unit AS (SELECT doc_id, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS v FROM corpus),
cell AS (SELECT doc_id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM unit),
mean AS (SELECT i, avg(x) AS mu, count(*) AS n FROM cell GROUP BY i),
cov AS (SELECT a.i, b.i AS j, sum((a.x - ma.mu) * (b.x - mb.mu)) / (any_value(ma.n) - 1) AS c
        FROM cell a JOIN cell b USING (doc_id) JOIN mean ma ON ma.i = a.i JOIN mean mb ON mb.i = b.i GROUP BY a.i, b.i),
c1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),
{_axis_sql('one', 'c1')},
c2 AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][j] - lam * v[i] * v[j])) AS m FROM c1, one),
{_axis_sql('two', 'c2')}"""


@register("reduce_dim", f"""WITH RECURSIVE {Q.corpus_cte()},
{PCA_CTES}
SELECT doc_id, round(list_inner_product(unit.v, one.v), 6) AS x, round(list_inner_product(unit.v, two.v), 6) AS y FROM unit, one, two""")
def reduce_dim(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", "embedding")
    return models.reduce_dim(c).select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


DENSITY_CTES = f"""pd AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM pts a JOIN pts b ON a.id <> b.id),
core AS (SELECT a AS id, d AS core FROM pd QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = {MIN_SAMPLES - 1}),
eps AS (SELECT quantile_cont(core, 0.5) AS eps FROM core),
cores AS (SELECT id FROM core, eps WHERE core <= eps),
edges AS (SELECT pd.a AS src, pd.b AS dst FROM pd JOIN cores ca ON ca.id = pd.a JOIN cores cb ON cb.id = pd.b, eps WHERE pd.d <= eps),
reach(id, root) AS (SELECT id, id FROM cores UNION SELECT e.dst, r.root FROM reach r JOIN edges e ON e.src = r.id),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
sizes AS (SELECT root, count(*) AS size FROM comp GROUP BY root),
labels AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) - 1 AS label FROM sizes WHERE size >= {MIN_CLUSTER_SIZE})"""
DENSITY_SQL = f"""WITH RECURSIVE
pts AS (SELECT d.doc_id AS id, CAST(e.embedding AS DOUBLE[]) AS v FROM documents d JOIN embeddings e
  ON d.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id),
{DENSITY_CTES}
SELECT p.id AS doc_id, CAST(coalesce(l.label, -1) AS INTEGER) AS cluster, round(c.core, 6) AS core
FROM pts p LEFT JOIN comp ON comp.id = p.id LEFT JOIN labels l ON l.root = comp.root LEFT JOIN core c ON c.id = p.id"""


@register("density_cluster", DENSITY_SQL)
def density_cluster(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", "embedding")
    out = density.density_cluster(c, MIN_SAMPLES, None, MIN_CLUSTER_SIZE,
                                  id_col="doc_id", vec_col="embedding")
    return out.select("doc_id", "cluster", F.round("core", 6).alias("core"))


@register("density_hierarchy")
def density_hierarchy(spark, sf_dir):
    """M4 with its condensed tree, over every vector; held against a plain
    recursion over all thresholds in the tests."""
    return hierarchy.hierarchy_cluster(table(spark, sf_dir, "embeddings"), MIN_SAMPLES, MIN_CLUSTER_SIZE,
                                       id_col="vec_id", vec_col="embedding")


def _text_vectors(docs):
    """(doc_id, cluster, embedding) of the texts: inference runs once, and
    what is stored for the readers has no text."""
    return reliable_checkpoint(models.embed(docs.select("doc_id", "cluster", "abstract"), "abstract").drop("abstract"))


def _topic_top_docs(spark, sf_dir):
    """W1 input of the summariser: each topic's top documents, with text
    vectors from the encoder (M1), as the reference embeds its abstracts."""
    m = corpus(spark, sf_dir).where(F.col("cluster") != -1)
    vectors = _text_vectors(m)
    ranked = S.top_members(S.own_centroid_cosine(vectors, S.centroids(vectors)), "sim", S.TOP_DOCS)
    # only the top documents take their texts along
    return ranked.join(m.select("doc_id", "abstract"), "doc_id").select(
        F.col("cluster").alias("topic"), "doc_id", "rank", F.col("abstract").alias("text"), "embedding")


_KMEANS_SQL = f"""WITH RECURSIVE {Q.corpus_cte()},
tdocs AS (SELECT doc_id, cluster AS topic, abstract FROM corpus WHERE cluster <> -1),
{Q.encoder_ctes('de', 'tdocs', 'doc_id', 'abstract')},
placed AS (SELECT t.topic, t.doc_id, de.v FROM tdocs t JOIN de USING (doc_id)),
mid AS (SELECT topic, {Q.mean_vector('v')} AS c FROM placed GROUP BY topic),
top AS (SELECT topic, doc_id, v, row_number() OVER (PARTITION BY topic ORDER BY round({Q.cosine('v', 'c')}, 6) DESC, doc_id) AS rank
        FROM placed JOIN mid USING (topic) QUALIFY rank <= {S.TOP_DOCS}),
seeds(topic, k, cs) AS (
  SELECT topic, 1, [v] FROM top WHERE rank = 1
  UNION ALL
  SELECT topic, k + 1, list_append(any_value(cs), arg_min(v, struct_pack(g := -gap, r := rank))) FROM (
    SELECT s.topic, s.k, s.cs, t.v, t.rank, list_min(list_transform(s.cs, lambda c: round(list_distance(t.v, c), 9))) AS gap
    FROM seeds s JOIN top t USING (topic) WHERE s.k < {models.SUBTHEMES}) GROUP BY topic, k),
rounds(topic, k, cs) AS (
  SELECT topic, 0, arg_max(cs, k)[1:(SELECT count(*) FROM top t WHERE t.topic = seeds.topic)] FROM seeds GROUP BY topic
  UNION ALL
  SELECT topic, k + 1, list(coalesce(c, cs[j]) ORDER BY j) FROM (
    SELECT r.topic, r.k, r.cs, r.j AS j, m.c FROM (SELECT topic, k, cs, unnest(range(1, len(cs) + 1)) AS j FROM rounds WHERE k < {models.KMEANS_ROUNDS - 1}) r
    LEFT JOIN (SELECT topic, j, {Q.mean_vector('v')} AS c FROM (
      SELECT t.topic, t.v, list_position(d, list_min(d)) AS j FROM (
        SELECT t.topic, t.v, list_transform(r.cs, lambda c: round(list_distance(t.v, c), 9)) AS d FROM rounds r JOIN top t USING (topic)) t)
      GROUP BY topic, j) m ON m.topic = r.topic AND m.j = r.j) GROUP BY topic, k),
final AS (SELECT topic, arg_max(cs, k) AS cs FROM rounds GROUP BY topic),
named AS (SELECT topic, doc_id, rank, list_position(d, list_min(d)) AS j FROM (
  SELECT t.*, list_transform(f.cs, lambda c: round(list_distance(t.v, c), 9)) AS d FROM top t JOIN final f USING (topic)))
SELECT topic, CAST(dense_rank() OVER (PARTITION BY topic ORDER BY j) AS INTEGER) AS subtheme, doc_id, CAST(rank AS INTEGER) AS rank FROM named"""


@register("subtheme_groups", _KMEANS_SQL)
def subtheme_groups(spark, sf_dir):
    return models.subtheme_groups(_topic_top_docs(spark, sf_dir))


RANKED_CTES = f"""{Q.topic_terms_ctes(n=TM.TOP_N_WORDS)},
tdocs AS (SELECT doc_id, cluster, abstract FROM corpus WHERE cluster <> -1),
{Q.encoder_ctes('de', 'tdocs', 'doc_id', 'abstract')},
tvec AS (SELECT cluster, {Q.mean_vector('v')} AS tv FROM de JOIN tdocs USING (doc_id) GROUP BY cluster),
uterm AS (SELECT DISTINCT term FROM ranked),
{Q.encoder_ctes('te', 'uterm', 'term', 'term')},
scoredt AS (SELECT r.cluster AS topic, r.term, te.v, {Q.cosine('te.v', 'tvec.tv')} AS sim
            FROM ranked r JOIN te USING (term) JOIN tvec USING (cluster))"""


@register("rank_terms_by_vector", f"""WITH {RANKED_CTES}
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY sim DESC, term) AS INTEGER) AS rank, term, round(sim, 6) AS sim
FROM scoredt""")
def rank_terms_by_vector(spark, sf_dir):
    """Each topic's keyword candidates ordered by cosine to the topic
    vector (mean text vector of its documents)."""
    c = corpus(spark, sf_dir)
    tt = TM.topic_terms(c, n=TM.TOP_N_WORDS)
    tv = models.embed(tt, "term", "term_vec")
    m = c.where(F.col("cluster") != -1)
    topic_vec = S.centroids(_text_vectors(m).drop("doc_id")).select(
        F.col("cluster"), F.col("centroid").alias("topic_vec"))
    scored = tv.join(topic_vec, "cluster").withColumn("sim", S.cosine("term_vec", "topic_vec"))
    return models.rank_by_vector(scored, "cluster").select(
        F.col("cluster").alias("topic"), "rank", "term", F.round("sim", 6).alias("sim"))


MMR_SQL = f"""WITH RECURSIVE {RANKED_CTES},
pairs AS (SELECT a.topic, a.term, map(list(b.term), list({Q.cosine('a.v', 'b.v')})) AS m
          FROM scoredt a JOIN scoredt b ON a.topic = b.topic GROUP BY a.topic, a.term),
picks(topic, k, chosen) AS (
  SELECT topic, 1, [arg_min(term, struct_pack(s := -sim, t := term))] FROM scoredt GROUP BY topic
  UNION ALL
  SELECT topic, k + 1, list_append(any_value(chosen), arg_min(term, struct_pack(s := -score, t := term)))
  FROM (SELECT p.topic, p.k, p.chosen, s.term,
               round((1 - {models.MMR_DIVERSITY}) * s.sim - {models.MMR_DIVERSITY} * list_max(list_transform(p.chosen, lambda c: q.m[c])), 9) AS score
        FROM picks p JOIN scoredt s ON s.topic = p.topic AND NOT list_contains(p.chosen, s.term)
        JOIN pairs q ON q.topic = s.topic AND q.term = s.term WHERE p.k < 10)
  GROUP BY topic, k)
SELECT topic, CAST(unnest(range(1, len(chosen) + 1)) AS INTEGER) AS rank, unnest(chosen) AS term
FROM (SELECT topic, arg_max(chosen, k) AS chosen FROM picks GROUP BY topic)"""


@register("mmr", MMR_SQL)
def mmr(spark, sf_dir):
    c = corpus(spark, sf_dir)
    tt = TM.topic_terms(c, n=TM.TOP_N_WORDS)
    tv = reliable_checkpoint(models.embed(tt, "term", "term_vec"))
    m = c.where(F.col("cluster") != -1)
    topic_vec = S.centroids(_text_vectors(m).drop("doc_id")).select(
        F.col("cluster"), F.col("centroid").alias("topic_vec"))
    cands = tv.join(topic_vec, "cluster").withColumnRenamed("cluster", "topic")
    return models.mmr(cands.select("topic", "term", "term_vec", "topic_vec"), "topic", 10)


@register("keyword_labels", f"""WITH toks AS (
  SELECT item_id, list_filter(regexp_extract_all(lower(text), '{SM.KEYWORD_TOKEN}'), lambda t: NOT list_contains({LABEL_STOP}, t)) AS tok FROM benchmark),
cands AS (SELECT DISTINCT item_id, keyword FROM (SELECT item_id, unnest({Q.ngram_range('tok', 1, 3)}) AS keyword FROM toks)),
phrases AS (SELECT DISTINCT keyword FROM cands),
{Q.encoder_ctes('pe', 'phrases', 'keyword', 'keyword')},
{Q.encoder_ctes('be', 'benchmark', 'item_id', 'text')},
scored AS (SELECT item_id, keyword, {Q.cosine('pe.v', 'be.v')} AS sim FROM cands JOIN pe USING (keyword) JOIN be USING (item_id))
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, keyword) AS INTEGER) AS rank, keyword, sim
FROM scored QUALIFY rank <= 5""")
def keyword_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text"))
    return SM.keyword_labels(docs, "item_id", "text")


_SENTENCES = f"""sents AS (
  SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (
    SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[{T.PY_WHITESPACE}]+', '\\1' || chr(1), 'g'), chr(1)),
                                 lambda x: length(x) > 0) AS s FROM documents))),
counted AS (SELECT *, len(list_filter(string_split_regex(sentence, '[{T.PY_WHITESPACE}]+'), lambda w: length(w) > 0)) AS n_words FROM sents),
texts AS (SELECT DISTINCT sentence FROM sents),
{Q.encoder_ctes('se', 'texts', 'sentence', 'sentence')}"""


@register("dedupe_sentences", f"""WITH RECURSIVE {_SENTENCES},
longs AS (SELECT doc_id, sentence, v, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
          FROM counted JOIN se USING (sentence) WHERE n_words >= {SM.MIN_SENTENCE_WORDS}),
near AS (SELECT a.doc_id, b.i, list(a.i) AS earlier FROM longs a JOIN longs b ON a.doc_id = b.doc_id AND a.i < b.i
         WHERE {Q.cosine('a.v', 'b.v')} > {SM.REFINE_THRESHOLD} GROUP BY a.doc_id, b.i),
walk(doc_id, k, dropped) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM near
  UNION ALL
  SELECT w.doc_id, n.i, CASE WHEN len(list_filter(n.earlier, lambda e: NOT list_contains(w.dropped, e))) > 0
                             THEN list_append(w.dropped, n.i) ELSE w.dropped END
  FROM walk w JOIN (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM near) n
    ON n.doc_id = w.doc_id AND n.before = w.k),
gone AS (SELECT doc_id, arg_max(dropped, k) AS dropped FROM walk GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.sentence, ' ' ORDER BY l.i) AS refined FROM longs l LEFT JOIN gone g USING (doc_id)
         WHERE g.dropped IS NULL OR NOT list_contains(g.dropped, l.i) GROUP BY l.doc_id),
has AS (SELECT DISTINCT doc_id FROM sents)
SELECT d.doc_id, CASE WHEN h.doc_id IS NULL THEN d.text ELSE coalesce(k.refined, '') END AS refined
FROM documents d LEFT JOIN has h USING (doc_id) LEFT JOIN kept k USING (doc_id)""")
def dedupe_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return SM.dedupe_sentences(docs, "doc_id", "text", SM.REFINE_THRESHOLD)


@register("extractive_summary", f"""WITH {_SENTENCES},
placed AS (SELECT doc_id, pos, sentence, n_words, v FROM counted JOIN se USING (sentence)),
mid AS (SELECT doc_id, {Q.mean_vector('v')} AS c FROM placed GROUP BY doc_id),
scored AS (SELECT p.*, {Q.cosine('p.v', 'mid.c')} AS score FROM placed p JOIN mid USING (doc_id)),
ordered AS (SELECT *, row_number() OVER w AS r, coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY score DESC, pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scored
            WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, pos)),
picked AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM ordered
           WHERE before < {SM.MIN_LENGTH} AND (before + n_words <= {SM.MAX_LENGTH} OR r = 1) GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.summary, substring(d.text, 1, 500), '[SUMMARY FAILED]') AS summary
FROM documents d LEFT JOIN picked p USING (doc_id)""")
def extractive_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return SM.summarise(docs, "doc_id", "text")


@register("extractive_summary_no_repeat")
def extractive_summary_no_repeat(spark, sf_dir):
    """M16 with no run of three words twice; held against a plain greedy pass
    in the tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return SM.summarise(docs, "doc_id", "text", no_repeat=SM.NO_REPEAT)


@register("topic_report")
def topic_report(spark, sf_dir):
    return SM.topic_report(_topic_top_docs(spark, sf_dir))


_BASE = Q.corpus_cte().replace("corpus AS", "base0 AS", 1)
_FIT_SQL = f"""WITH RECURSIVE {_BASE},
{PCA_CTES.replace("FROM corpus", "FROM base0")},
pts AS (SELECT doc_id AS id, [list_inner_product(unit.v, one.v), list_inner_product(unit.v, two.v)] AS v FROM unit, one, two),
{DENSITY_CTES},
corpus AS (SELECT b.doc_id, b.abstract, b.embedding, CAST(coalesce(l.label, -1) AS INTEGER) AS cluster
           FROM base0 b LEFT JOIN comp ON comp.id = b.doc_id LEFT JOIN labels l ON l.root = comp.root),
{RANKED_CTES.split(Q.corpus_cte() + ",", 1)[1].lstrip()},
{MMR_SQL.split(RANKED_CTES + ",", 1)[1].rsplit('SELECT topic, CAST(unnest', 1)[0].strip()},
named AS (SELECT topic, unnest(chosen) AS term FROM (SELECT topic, arg_max(chosen, k) AS chosen FROM picks GROUP BY topic)),
kw AS (SELECT topic, string_agg(term, ', ' ORDER BY sim DESC, term) AS keywords FROM named JOIN scoredt USING (topic, term) GROUP BY topic),
mid AS (SELECT cluster, {Q.mean_vector('embedding')} AS c FROM corpus WHERE cluster <> -1 GROUP BY cluster)
SELECT doc_id, cluster AS topic, round(CASE WHEN c IS NULL THEN 0.0 ELSE {Q.cosine('embedding', 'c')} END, 6) AS probability, keywords
FROM corpus LEFT JOIN mid USING (cluster) LEFT JOIN kw ON kw.topic = cluster"""


@register("fit_topics", _FIT_SQL)
def fit_topics(spark, sf_dir):
    """PCA -> density clustering -> class TF-IDF -> MMR -> ranking by
    vector -> membership scores; per document its topic and the topic's
    keywords."""
    c = corpus(spark, sf_dir).select("doc_id", "abstract", "embedding")
    info, _, keywords = topics.fit_topics(c)
    named = keywords.groupBy("topic").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda k: k["term"]), ", ").alias("keywords"))
    return info.join(named, "topic", "left").select("doc_id", "topic", "probability", "keywords")


@register("topic_keywords", f"""{MMR_SQL.rsplit('SELECT topic, CAST(unnest', 1)[0].rstrip()},
named AS (SELECT topic, unnest(chosen) AS term FROM (SELECT topic, arg_max(chosen, k) AS chosen FROM picks GROUP BY topic))
SELECT n.topic, CAST(row_number() OVER (PARTITION BY n.topic ORDER BY s.sim DESC, n.term) AS INTEGER) AS rank, n.term, round(s.sim, 6) AS sim
FROM named n JOIN scoredt s ON s.topic = n.topic AND s.term = n.term""")
def topic_keywords(spark, sf_dir):
    """M9 -> M10: the diverse keywords of each topic, ranked by vector."""
    c = corpus(spark, sf_dir)
    return topics.topic_keywords(c, TM.topic_terms(c, n=TM.TOP_N_WORDS))
