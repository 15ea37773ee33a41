"""Dedupe, fallback join, dictionaries, lookups, row index, batches."""

from pyspark.sql import functions as F

from quarry.operators import records as R


def test_keep_first_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text: (r.doc_id, r.n_copies) for r in R.keep_first(df, ["text"], "doc_id").collect()}
    assert got["hot"] == (1, 200)
    assert got["k0"] == (0, 1) and len(got) == 101


def test_combine_drops_nulls_and_dupes(spark):
    a = spark.createDataFrame([(1, "10.1/a", "T"), (2, None, "T"), (3, "10.1/a", "T")], "o long, doi string, title string")
    b = spark.createDataFrame([(0, "10.1/a", "T"), (4, "10.1/a", "Other")], "o long, doi string, title string")
    got = {(r.doi, r.title): r.o for r in R.combine([a, b], ["doi", "title"], ["doi", "title"], "o").collect()}
    assert got == {("10.1/a", "T"): 0, ("10.1/a", "Other"): 4}


def test_fallback_join_cases(spark):
    left = spark.createDataFrame([
        (1, "d1", "Title A", "Abstract A"),     # doi match
        (2, None, " title b ", "ABSTRACT B"),   # key match, other case/space
        (3, "dX", "Nothing", "Matches"),        # dropped
    ], "lid long, doi string, title string, abstract string")
    right = spark.createDataFrame([
        (10, "d1", "x", "y"), (20, "d2", "Title B", "abstract b"), (15, "d3", "TITLE B", "abstract b"),
    ], "rid long, doi string, title string, abstract string")
    got = {r.lid: (r.matched_id, r.matched_by) for r in R.fallback_join(left, right, "lid", "rid").collect()}
    assert got == {1: (10, "doi"), 2: (15, "key")}


def test_last_wins_and_lookup(spark):
    d = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "k string, v string, o int")
    m = R.last_wins(d, "k", "v", "o")
    base = spark.createDataFrame([("a",), ("c",)], "k string")
    got = {r.k: r.v for r in R.lookup(base, m, "k", "v").collect()}
    assert got == {"a": "y", "c": "Unknown"}


def test_dense_index_and_batches(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "doc_id long").repartition(5)
    idx = R.dense_index(df, "doc_id")
    got = sorted((r.doc_id, r.idx) for r in idx.collect())
    assert [i for _, i in got] == list(range(101))
    assert all(d == i for d, i in got)
    br = sorted(tuple(r) for r in R.batch_ranges(idx, size=40).collect())
    assert br == [(0, 0, 40, 40), (1, 40, 80, 40), (2, 80, 101, 21)]
    sl = R.index_slice(idx, 10, 20)
    assert sl.count() == 10 and R.index_slice(idx, 10, 20, inclusive=True).count() == 11


def test_cast_all_string_and_topic_info(spark):
    from quarry.operators import topics

    df = spark.createDataFrame([(1, 2.5, None), (2, 3.0, True)], "a long, b double, c boolean")
    out = R.cast_all_string(df)
    assert all(t == "string" for _, t in out.dtypes)
    assert sorted(tuple(r) for r in out.collect()) == [("1", "2.5", None), ("2", "3.0", "true")]
    info = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.8), (3, -1, 0.0)], "doc_id long, topic int, probability double")
    assert {r.topic: r.n for r in topics.topic_info(info).collect()} == {0: 2, -1: 1}


def test_dense_index_of_whole_rows_beyond_the_sampler(spark):
    """Rows with payload columns, hot keys and nulls, more rows than the range
    sampler reads: every index once, in the order of the keys."""
    n = 60_000
    df = (spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 101 == 0, F.lit(None))
                                    .otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))))
          .withColumn("payload", F.repeat(F.lit("x"), 20)).repartition(40))
    got = R.dense_index(df, ["k", "id"])
    assert got.columns == ["id", "k", "payload", "idx"]
    s = got.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    assert (s.n, s.d, s.lo, s.hi) == (n, n, 0, n - 1)
    rows = got.orderBy("idx").select("k", "id").collect()
    key = [(r.k is not None, r.k or 0, r.id) for r in rows]
    assert key == sorted(key)
    assert R.dense_index(df.limit(0), "k").count() == 0
