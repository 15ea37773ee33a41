"""File sources and sinks.

All paths are shared-storage URIs (the cluster's file system); nothing is
written to a machine-local folder.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stopwords import default_stop_words
from quarry.session import reliable_checkpoint

CHECK_SCHEMA = "path string, length long, rows long, reason string"
IN_MEMORY_BYTES = 256 << 20
CHUNK_INDEX = r".*_(\d+)[./]"


# One set of options for every CSV source and sink: quotes are doubled,
# blanks and newlines inside fields survive.
CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """Header CSV.  Files are split over tasks unless fields may hold
    line breaks (``multi_line``): then one file is one task, so convert such
    files to Parquet once."""
    r = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", False)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3: one Parquet file or folder."""
    return spark.read.parquet(path)


def read_parquet_tree(spark: SparkSession, root: str, glob: str = "*.gzip") -> DataFrame:
    """Every matching Parquet file below ``root``, unioned by name."""
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .option("mergeSchema", True).parquet(root))


def is_below(path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or lies in it (not a sibling that
    begins with the same letters)."""
    path, folder = path.rstrip("/"), folder.rstrip("/")
    return path == folder or path.startswith(folder + "/")


def _parquet_fault(source) -> tuple[int, str | None]:
    """(rows, why the file cannot be used): its footer, then every row group is
    decoded, one at a time."""
    try:
        file = pq.ParquetFile(source)
    except Exception as e:  # noqa: BLE001  a broken footer raises many kinds
        return 0, f"footer: {type(e).__name__}"
    try:
        for i in range(file.num_row_groups):
            file.read_row_group(i)
    except Exception as e:  # noqa: BLE001  as a broken page does
        return 0, f"row group {i}: {type(e).__name__}"
    return file.metadata.num_rows, None


def check_parquet(spark: SparkSession, paths: list[str], in_memory_bytes: int = IN_MEMORY_BYTES) -> DataFrame:
    """(path, length, rows, reason) of every data file below ``paths``,
    reason null where the whole file can be read.  One row a file, checked by
    the tasks; missing paths are no error here.

    Files up to ``in_memory_bytes`` come through Spark's file systems; larger
    ones are opened where they lie, so that a task holds one row group."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], CHECK_SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)

    def check(batches):
        for batch in batches:
            out = []
            for one in batch.to_dict("records"):
                if "content" in one:
                    rows, reason = _parquet_fault(pa.BufferReader(one["content"]))
                else:
                    system, name = pa_fs.FileSystem.from_uri(one["path"])
                    with system.open_input_file(name) as source:
                        rows, reason = _parquet_fault(source)
                out.append((one["path"], one["length"], rows, reason))
            yield pd.DataFrame(out, columns=["path", "length", "rows", "reason"])

    small = files.where(F.col("length") <= in_memory_bytes).select("path", "length", "content")
    large = files.where(F.col("length") > in_memory_bytes).select("path", "length")
    return small.mapInPandas(check, CHECK_SCHEMA).unionByName(large.mapInPandas(check, CHECK_SCHEMA))


def read_parquet_checked(spark: SparkSession, paths: list[str], exclude: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the good files, the bad files with their reason).

    A file is read whole or not at all.  The job's own output path is excluded
    from its inputs; nothing readable is an error, a readable file without rows
    is fine.  While no file of a path is bad the path is read as it is; else
    its good files are named to the reader, whose file index lists them anyway."""
    keep = [p for p in paths if exclude is None or not is_below(p, exclude)]
    checked = reliable_checkpoint(check_parquet(spark, keep))
    bad = checked.where("reason IS NOT NULL")
    if checked.where("reason IS NULL").isEmpty():
        raise FileNotFoundError("no readable input file")
    bad_paths = {r["path"] for r in bad.select("path").collect()}
    parts = []
    for p in keep:
        if not _exists(spark, p):
            continue
        reader = spark.read.option("mergeSchema", True)
        root = _qualified(spark, p)
        if not any(is_below(_qualified(spark, b), root) for b in bad_paths):
            parts.append(reader.parquet(p))
            continue
        good = [r["path"] for r in checked.where("reason IS NULL").select("path").collect()
                if is_below(_qualified(spark, r["path"]), root)]
        if good:
            parts.append(reader.option("basePath", p).parquet(*good))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, bad


def read_parquet_tolerant(spark: SparkSession, paths: list[str], exclude: str | None = None) -> DataFrame:
    """The rows of ``read_parquet_checked``."""
    return read_parquet_checked(spark, paths, exclude)[0]


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as file listings name it."""
    p, fs = _hadoop_path(spark, path)
    return fs.makeQualified(p).toString()


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per line -> distinct words (column ``word``)."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()


def all_stopwords(spark: SparkSession, path: str, base: list[str] | None = None) -> DataFrame:
    """The file's words and the English list (or ``base``), each once."""
    words = default_stop_words() if base is None else base
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    return read_stopwords(spark, path).union(listed).where("word <> ''").distinct()


def stopword_list(spark: SparkSession, path: str, max_words: int = 100_000) -> list[str]:
    """Stop words as a list for column expressions.  ``max_words`` bounds
    what reaches the driver; a longer list is an error, to be joined instead."""
    rows = read_stopwords(spark, path).limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"stop-word list longer than {max_words}")
    return sorted(r.word for r in rows)


def with_chunk_index(df: DataFrame) -> DataFrame:
    """K5: numeric chunk number parsed from each row's file name."""
    num = F.regexp_extract(F.input_file_name(), CHUNK_INDEX, 1)
    return df.withColumn("chunk", F.when(num == "", None).otherwise(num).try_cast("int"))


def read_chunks(spark: SparkSession, paths: str, schema=None) -> DataFrame:
    """K5: all chunk files in one table, with their chunk number and sorted by
    it (O3); files without a number come last."""
    return with_chunk_index(read_csv(spark, paths, schema)).orderBy(F.col("chunk").asc_nulls_last())


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: gzip-compressed Parquet."""
    df.write.mode(mode).option("compression", "gzip").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: header CSV (quoted multi-line fields round-trip with read_csv)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_per_group(df: DataFrame, path: str, key: str, noise=-1, fmt: str = "csv") -> None:
    """K3: one folder per group value, noise excluded."""
    out = df.where(F.col(key) != noise) if noise is not None else df
    w = out.write.mode("overwrite").partitionBy(key)
    w.options(**CSV_OPTIONS).csv(path) if fmt == "csv" else w.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """K4: append; every part file has its header, which read_csv drops."""
    write_csv(df, path, "append")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer has committed ``path`` (its ``_SUCCESS`` mark)."""
    return _exists(spark, path.rstrip("/") + "/_SUCCESS")


def stage(spark: SparkSession, path: str, build) -> DataFrame:
    """K6: resume a stage from its Parquet output if that is complete, else
    build and persist it, then read it back (lineage is cut at the stage)."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
