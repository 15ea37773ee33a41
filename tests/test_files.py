"""Sources and sinks round trips."""

import os

import pytest

from quarry.sources import files as IO


def test_csv_multiline_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 'line one\nline "two"\n'), (2, "plain")], "id int, txt string")
    p = os.path.join(tmpdir_path, "csv")
    IO.write_csv(df, p)
    back = IO.read_csv(spark, p, "id int, txt string", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_parquet_tree_tolerant_and_stage(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "tree", "a")
    b = os.path.join(tmpdir_path, "tree", "x", "b")
    IO.write_parquet(spark.createDataFrame([(1,)], "v int"), a)
    IO.write_parquet(spark.createDataFrame([(2,)], "v int"), b)
    # gzip parts end with .gz.parquet, glob on the part name
    tree = IO.read_parquet_tree(spark, os.path.join(tmpdir_path, "tree"), "*.parquet")
    assert sorted(r.v for r in tree.collect()) == [1, 2]
    bad = os.path.join(tmpdir_path, "bad.parquet")
    with open(bad, "wb") as fh:
        fh.write(b"not parquet")
    ok = IO.read_parquet_tolerant(spark, [a, bad], exclude=b)
    assert [r.v for r in ok.collect()] == [1]
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(5,)], "v int")

    st = os.path.join(tmpdir_path, "stage")
    assert IO.stage(spark, st, build).first().v == 5
    assert IO.stage(spark, st, build).first().v == 5 and len(calls) == 1


def test_per_group_and_stopwords(spark, tmpdir_path):
    df = spark.createDataFrame([(0, "a"), (-1, "n"), (1, "b")], "cluster int, doc string")
    p = os.path.join(tmpdir_path, "groups")
    IO.write_per_group(df, p, "cluster")
    names = set(os.listdir(p))
    assert {"cluster=0", "cluster=1"} <= names and "cluster=-1" not in names
    sw = os.path.join(tmpdir_path, "stop.txt")
    with open(sw, "w") as fh:
        fh.write("The\nof\nof\nlife cycle\ndon't\n")
    assert IO.stopword_list(spark, sw) == ["The", "don't", "life cycle", "of"]
    ck = os.path.join(tmpdir_path, "chunks")
    for i in (10, 2):
        IO.write_csv(spark.createDataFrame([(i,)], "v int"), os.path.join(ck, f"Embeddings_Chunk_{i}"))
    got = IO.with_chunk_index(IO.read_csv(spark, os.path.join(ck, "*"), "v int"))
    assert sorted((r.chunk, r.v) for r in got.collect()) == [(2, 2), (10, 10)]


def test_group_csv_round_trip(spark, tmpdir_path):
    rows = [(1, ' a, "quoted"\nsecond line, more ', 0), (2, "x", 0), (3, "", 1), (4, "noise", -1)]
    p = os.path.join(tmpdir_path, "groups_csv")
    IO.write_per_group(spark.createDataFrame(rows, "id int, txt string, cluster int"), p, "cluster")
    back = IO.read_csv(spark, p, "id int, txt string, cluster int", multi_line=True)
    assert sorted((r.id, r.txt or "", r.cluster) for r in back.collect()) == rows[:3]


def test_append_reads_as_one_table(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "appended")
    for i in range(3):
        IO.append_csv(spark.createDataFrame([(i, "t")], "id int, txt string"), p)
    assert sorted(r.id for r in IO.read_csv(spark, p, "id int, txt string").collect()) == [0, 1, 2]


def test_tolerant_reader_siblings_and_empty(spark, tmpdir_path):
    out, sib = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "out_2020")
    IO.write_parquet(spark.createDataFrame([(1,)], "v int"), out)
    IO.write_parquet(spark.createDataFrame([(2,)], "v int"), sib)
    assert [r.v for r in IO.read_parquet_tolerant(spark, [out, sib], exclude=out).collect()] == [2]
    empty = os.path.join(tmpdir_path, "empty")
    IO.write_parquet(spark.createDataFrame([], "v int"), empty)
    assert IO.read_parquet_tolerant(spark, [empty]).collect() == []
    bad = os.path.join(tmpdir_path, "bad.parquet")
    with open(bad, "wb") as fh:
        fh.write(b"not parquet")
    for paths, exclude in (([bad], None), ([out], out)):
        with pytest.raises(FileNotFoundError):
            IO.read_parquet_tolerant(spark, paths, exclude)


def test_half_written_stage_is_built_again(spark, tmpdir_path):
    st = os.path.join(tmpdir_path, "half")
    IO.write_parquet(spark.createDataFrame([(1,)], "v int"), st)
    os.remove(os.path.join(st, "_SUCCESS"))
    assert [r.v for r in IO.stage(spark, st, lambda: spark.createDataFrame([(7,)], "v int")).collect()] == [7]


def test_stop_words_of_file_and_list(spark, tmpdir_path):
    sw = os.path.join(tmpdir_path, "stop2.txt")
    with open(sw, "w") as fh:
        fh.write("plastic\nthe\n\n")
    assert sorted(r.word for r in IO.all_stopwords(spark, sw, ["the", "of"]).collect()) == ["of", "plastic", "the"]
    assert {"plastic", "the", "and"} <= {r.word for r in IO.all_stopwords(spark, sw).collect()}


def test_chunks_in_order(spark, tmpdir_path):
    ck = os.path.join(tmpdir_path, "ordered")
    for i in (10, 2, 1):
        IO.write_csv(spark.createDataFrame([(i,)], "v int"), os.path.join(ck, f"Embeddings_Chunk_{i}"))
    assert [r.chunk for r in IO.read_chunks(spark, os.path.join(ck, "*"), "v int").collect()] == [1, 2, 10]


def test_bad_files_are_listed_and_never_half_read(spark, tmpdir_path):
    root, other = os.path.join(tmpdir_path, "root"), os.path.join(tmpdir_path, "other")
    rows = spark.range(0, 9000).selectExpr("id AS v", "repeat(md5(cast(id AS string)), 3) AS s", "id % 3 AS part")
    rows.repartition(1).write.option("parquet.block.size", 1 << 16).option("parquet.page.size", 1 << 12).partitionBy("part").parquet(root)
    rows.where("v < 10").write.parquet(other)
    files = {n: os.path.join(root, f"part={n}", f) for n in range(3) for f in os.listdir(os.path.join(root, f"part={n}"))
             if f.endswith(".parquet")}
    with open(files[1], "r+b") as fh:  # the footer stays good, pages in the middle do not
        size = os.path.getsize(files[1])
        fh.seek(size // 3)
        fh.write(b"\xff" * (size // 3))
    with open(files[2], "r+b") as fh:
        fh.truncate(os.path.getsize(files[2]) // 2)
    for crc in (c for n in (1, 2) for c in os.listdir(os.path.join(root, f"part={n}")) if c.endswith(".crc")):
        for n in (1, 2):
            if os.path.exists(os.path.join(root, f"part={n}", crc)):
                os.remove(os.path.join(root, f"part={n}", crc))
    got, bad = IO.read_parquet_checked(spark, [root, other, os.path.join(tmpdir_path, "missing")])
    why = {r.path.rsplit("/", 2)[1]: r.reason for r in bad.collect()}
    assert why.keys() == {"part=1", "part=2"}
    assert why["part=1"].startswith("row group") and why["part=2"].startswith("footer")
    assert sorted((r.v, r.part) for r in got.select("v", "part").collect()) == sorted(
        [(v, 0) for v in range(0, 9000, 3)] + [(v, v % 3) for v in range(10)])
    # the same verdict where files are opened in place
    opened = IO.check_parquet(spark, [root, other], in_memory_bytes=0)
    assert {r.path: r.reason for r in opened.collect()} == {
        r.path: r.reason for r in IO.check_parquet(spark, [root, other]).collect()}
