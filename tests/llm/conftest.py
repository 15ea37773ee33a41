import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators use as names of their own
CLASH = ("n_tokens", "fp", "size", "key", "pos", "kept", "shard", "slot", "ids", "label", "at", "place",
         "target", "root", "score", "part", "spans", "bucket", "weight")


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows and null ids."""
    r = random.Random(5)
    vocab = ["the", "of", "house", "river", "Green", "naïve", "über", "año", "12", "run!", "x"] + [
        "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(r.choice(vocab) + ("\n" if r.random() < 0.05 else "") for _ in range(n))

    base = [prose(n) for n in (1, 2, 3, 60, 80, 120, 200, 400)]
    texts = [None, "", " \n\t ", "x" * 300, "日本語テキスト", *base, base[4], base[4], base[5] + " tail", prose(20_000)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((None, base[6], None, "src1", len(base[6])))
    rows.append((None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), COLUMNS)
    return df.withColumns({c: F.lit(-7) for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def real(spark):
    """All documents of the smallest given table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def real_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
