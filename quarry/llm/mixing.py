"""Mixing sources to target weights by Sainte-Lague apportionment.

1. *Targets.*  Sources share the corpus' words by weight; a source stops at
   ``max_repeats`` times its own words and the excess is shared again by
   weight.  That water level has a closed form over the sources in order of
   size per weight, so it takes one pass over one row per source.
2. *Quotas.*  The mix is cut into blocks of ``block_words`` words and the
   blocks into shards.  Seats go to sources by highest quotient
   ``target / (2 j - 1)`` (Sainte-Lague; ties to the earlier source), and
   shard k takes the seats from rank ``N_k`` to ``N_k+1``.  A source's seats
   among the first N differ from its rounded share by at most ``share *
   sources / 2 + 1``, so only quotients in that window are ranked: about five
   rows per source and shard, whatever the number of blocks.  A source that
   wins no seat has one shorter block of its target's words.
3. *Selection.*  A source's documents are put in seeded order and form one
   circular stream of words.  Blocks are cut from it beginning at a seeded
   block, and a quota of q blocks is the first ``q * block_words`` words
   around the circle: full rounds repeat every document, the rest takes a run
   of whole documents and parts of the two at its ends.  Offsets come from
   two prefix sums, over the hash ranges of a source and inside each range,
   so the rows of a large source spread over many tasks.

Defined results: null text has size 0; a null source is a source (the last);
documents of size 0 take nothing; an empty table gives none; equal ids are
ordered by their text's digest; rows equal in id, text and source stand side
by side in the stream, in ``mix`` in order of a digest of their other columns
(``plan`` leaves open which of them takes what), and every row keeps its own
values.  ``plan`` reads only id, text and source; a source's words differ from
its target by less than two blocks, and no document is taken more than
``max_repeats`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, WORD, whole_text, words
from quarry.session import reliable_checkpoint

SEED = 7
BLOCK_WORDS = 64
MAX_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)  # in order of source, repeating
SHARDS = 8
RANGE_DOCS = 1_000  # documents of a hash range, about


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, place, target) from one row per source.

    The windows see the table of sources, never documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    # sources that stop come first: the least words per weight
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy((F.col("cap") / F.col("weight")).desc(), F.desc("place")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (sizes.withColumn("place", F.row_number().over(order) - 1)
              .withColumn("weight", weight)
              .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
              .withColumn("total", F.sum("source_size").over(every))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / F.sum("weight").over(rest)))
    # the water level: that of the first source that does not stop
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("k"), "place", "level"))).over(every)["level"]
    return placed.withColumn("free", free).select(
        "source", "source_size", "n_docs", "place",
        F.least("cap", F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target"))


def quotas(goals: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(place, shard, seats): blocks that each source gives to each shard."""
    every = Window.partitionBy()
    blocks = F.round(F.sum("target").over(every) / block_words).cast("long")
    house = (goals.withColumn("all_target", F.sum("target").over(every)).withColumn("blocks", blocks)
             .withColumn("n_sources", F.count(F.lit(1)).over(every))
             .where((F.col("target") > 0) & (F.col("blocks") > 0))
             .select("place", "target", "n_sources", "all_target",
                     F.explode(F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.struct(
                         (k - 1).alias("shard"), F.floor(F.col("blocks") * k / shards).alias("upto")))).alias("s"))
             .select("place", "target", "s.shard", "s.upto",
                     (F.col("target") / F.col("all_target")).alias("share"), "n_sources"))
    exact = F.col("share") * F.col("upto")
    slack = F.ceil(F.col("share") * F.col("n_sources") / 2) + 2
    window = (house.withColumn("sure", F.greatest(F.floor(exact) - slack, F.lit(0)).cast("long"))
              .withColumn("most", (F.ceil(exact) + slack).cast("long")))
    seats = window.select("place", "shard", "upto", "target", "sure", F.explode(
        F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat"))
    left = window.groupBy("shard").agg((F.max("upto") - F.sum("sure")).alias("left"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(
        (F.col("target") / (2 * F.col("seat") - 1)).desc(), "place"))
    won = (seats.withColumn("rank", rank).join(left, "shard").where(F.col("rank") <= F.col("left"))
           .groupBy("shard", "place").agg(F.count(F.lit(1)).alias("won")))
    upto = (window.join(won, ["shard", "place"], "left")
            .select("place", "shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats")))
    earlier = F.lag("seats", 1, 0).over(Window.partitionBy("place").orderBy("shard"))
    return upto.select("place", "shard", (F.col("seats") - earlier).alias("seats"))


def seeded(seed: int, *parts: Column) -> Column:
    """MD5 (hex) of the seed and the parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def seeded_number(digest: Column) -> Column:
    """The first 8 hex digits of a digest as a number below 2^32."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _streams(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows joined to their source, with ``__at``: the place of their first
    word in the source's stream."""
    n_ranges = F.greatest(F.ceil(F.col("n_docs") / RANGE_DOCS), F.lit(1))
    dealt = rows.join(goals, F.col("__source").eqNullSafe(F.col("source"))).drop("source").withColumn(
        "__range", F.floor(seeded_number(F.col("__order")) * n_ranges / F.lit(2.0 ** 32)))
    order = [c for c in ("__order", "__rest") if c in rows.columns]
    inside = Window.partitionBy("place", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("place").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("place", "__range").agg(F.sum("size").alias("__in_range"))
              .select("place", "__range", F.coalesce(F.sum("__in_range").over(ahead), F.lit(0)).alias("__start")))
    return (dealt.withColumn("__inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(starts, ["place", "__range"])
            .withColumn("__at", F.col("__start") + F.col("__inner")))


def _overlap(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.least(hi, end) - F.greatest(lo, start), F.lit(0).cast("long"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
         block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source", rest: Column | None = None) -> DataFrame:
    """Per row: ``id_col``, __digest, __rest (if ``rest`` is given, which orders
    rows equal in id, text and source), __source, size, source_size, target,
    taken, and where its words lie: __at, __rounds (times it is taken whole),
    __from and __upto (the run that is taken once more, in the stream; it may
    pass the stream's end and go on at 0)."""
    digest = F.md5(whole_text(text_col))
    # one small row per document: every later step reads these, not the texts
    rows = reliable_checkpoint(docs.select(
        F.col(id_col), F.col(source_col).alias("__source"), n_words(whole_text(text_col)).alias("size"),
        digest.alias("__digest"), *([] if rest is None else [rest.alias("__rest")]), seeded(seed, F.col(id_col), digest).alias("__order")))
    goals = targets(rows.groupBy(F.col("__source").alias("source")).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_repeats)
    seats = quotas(goals, block_words, shards).groupBy("place").agg(F.sum("seats").alias("seats"))
    blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1))
    goals = (goals.join(seats, "place", "left")
             .withColumn("__words", F.least(F.when(F.col("seats") > 0, F.col("seats") * block_words)
                                            .when(F.col("target") > 0, F.greatest(F.round("target"), F.lit(1.0)).cast("long"))
                                            .otherwise(F.lit(0)), F.col("source_size") * max_repeats))
             .withColumn("__rounds", F.when(F.col("source_size") > 0, F.floor(F.col("__words") / F.col("source_size")))
                         .otherwise(F.lit(0)))
             .withColumn("__from", F.pmod(seeded_number(seeded(seed, F.col("source"))), blocks) * block_words)
             .withColumn("__upto", F.col("__from") + F.col("__words") - F.col("__rounds") * F.col("source_size")))
    found = _streams(rows, goals)
    lo, hi = F.col("__at"), F.col("__at") + F.col("size")
    once = (_overlap(lo, hi, F.col("__from"), F.col("__upto"))
            + _overlap(lo, hi, F.lit(0).cast("long"), F.col("__upto") - F.col("source_size")))
    return found.select(
        id_col, "__digest", *([] if rest is None else ["__rest"]), "__source", "size", "source_size", "target",
        (F.col("__rounds") * F.col("size") + once).alias("taken"), "__at", "__rounds", "__from", "__upto")


def other_columns(docs: DataFrame, *known: str) -> Column:
    """MD5 (hex) of all columns but the ``known`` ones."""
    left = [F.col(f"`{c}`") for c in docs.columns if c not in known]
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.md5(F.to_json(F.struct(*left), {"ignoreNullFields": "false", "timestampFormat": exact + "XXX",
                                             "timestampNTZFormat": exact})) if left else F.lit("")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a document that is
    taken n times whole gives n rows as they are, and a part that is taken
    once more gives a row with that part's words (and its length in
    ``length_col``)."""
    rest = other_columns(docs, id_col, text_col, source_col)
    planned = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, rest=rest, **options)
    keys = ["__key_id", "__key_source", "__digest", "__rest"]
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    same = (planned.withColumns({"__key_id": named(id_col), "__key_source": named("__source")})
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"),
                                *[F.first(c).alias(c) for c in ("size", "source_size", "__rounds", "__from", "__upto")])
            .withColumnsRenamed({"size": "__size", "source_size": "__source_size"}))
    keyed = docs.withColumns({"__key_id": named(id_col), "__key_source": named(source_col),
                              "__digest": F.md5(whole_text(text_col)), "__rest": rest})
    # rows equal in all columns lie side by side in the stream: row j begins j sizes after the first
    rows = (keyed.join(same, keys).dropDuplicates(keys).where("__size > 0")
            .withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
            .withColumn("__at", F.col("__first") + F.col("__j") * F.col("__size")))
    lo, hi = F.col("__at"), F.col("__at") + F.col("__size")
    one, two = (F.col("__from"), F.col("__upto")), (F.lit(0).cast("long"), F.col("__upto") - F.col("__source_size"))
    runs = F.array(*[F.struct((F.greatest(lo, a) - lo).alias("skip"), _overlap(lo, hi, a, b).alias("n"))
                     for a, b in (one, two)])
    whole = F.lit(-1).cast("long")
    copies = F.concat(
        F.array_repeat(F.struct(F.lit(0).cast("long").alias("skip"), whole.alias("n")), F.col("__rounds").cast("int")),
        F.filter(runs, lambda r: r["n"] > 0))
    part = F.array_join(F.slice(words(whole_text(text_col), WORD + f"(?:{SPACE})?"),
                                (F.col("__copy.skip") + 1).cast("int"), F.col("__copy.n").cast("int")), "")
    is_whole = (F.col("__copy.n") == whole) | (F.col("__copy.n") == F.col("__size"))
    out = rows.withColumn("__copy", F.explode(copies)).withColumn(
        "__text", F.when(is_whole, F.col(text_col)).otherwise(part))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("__text").alias(c))
        elif c == length_col:
            columns.append(F.when(is_whole, F.col(c)).otherwise(F.char_length("__text")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def sql(weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS,
        shards: int = SHARDS, seed: int = SEED) -> str:
    """The same mix as DuckDB SQL over ``documents``: blocks won one by one
    by highest quotient, with one prefix sum per source.  Here a source
    without a seat takes nothing."""
    cases = " ".join(f"WHEN {i} THEN {float(w)!r}" for i, w in enumerate(weights))
    return f"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM src),
weighed AS (
  SELECT *, CASE place % {len(weights)} {cases} END AS weight, CAST(source_size * {max_repeats} AS DOUBLE) AS cap,
         sum(source_size) OVER () AS total FROM placed),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size, place, least(cap, coalesce(
    (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, place LIMIT 1) * weight, cap)) AS target
  FROM levels),
house AS (SELECT CAST(round(sum(target) / {block_words}) AS BIGINT) AS blocks FROM goals),
quotients AS (
  SELECT place, seat, target / (2 * seat - 1) AS q
  FROM goals, house, unnest(range(1, CAST(blocks + 1 AS BIGINT))) AS t(seat)
  WHERE target > 0 AND seat <= target / {block_words} + (SELECT count(*) FROM goals) + 2),
won AS (
  SELECT place, count(*) AS seats FROM (
    SELECT place, row_number() OVER (ORDER BY q DESC, place) AS r FROM quotients), house
  WHERE r <= blocks GROUP BY place),
runs AS (
  SELECT g.*, w, CASE WHEN source_size > 0 THEN w // source_size ELSE 0 END AS rounds,
         CAST('0x' || substr(md5('{seed}:' || coalesce(source, '')), 1, 8) AS BIGINT)
           % greatest(CAST(ceil(source_size / {block_words}) AS BIGINT), 1) * {block_words} AS begins
  FROM (SELECT g.*, least(coalesce(seats, 0) * {block_words}, source_size * {max_repeats}) AS w
        FROM goals g LEFT JOIN won USING (place)) g),
streams AS (
  SELECT r.doc_id, r.size, s.*, begins + w - rounds * s.source_size AS ends,
         coalesce(sum(r.size) OVER (PARTITION BY s.place ORDER BY r.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM rows_ r JOIN runs s ON r.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(rounds * size + greatest(least(pos + size, ends) - greatest(pos, begins), 0)
            + greatest(least(pos + size, ends - source_size) - pos, 0) AS BIGINT) AS taken
FROM streams"""
