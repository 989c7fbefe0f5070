"""Lists and formats of input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import FASTA, FASTQ, file_format

MAX_PATH = 256
SUFFIXES = (*FASTA, *FASTQ, "co")


def path_list(spark: SparkSession, list_path: str) -> DataFrame:
    """(path, format) of a list with a path a line. Leading blanks and empty lines are skipped; a path that is too long or of
    no known format fails the query."""
    rows = spark.read.text(list_path).select(F.regexp_replace("value", r"^\s+", "").alias("path")).filter("path <> ''")
    return checked(rows)


def checked(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("format", file_format(F.col("path")))
    wrong = F.when(F.length("path") > MAX_PATH, F.concat(F.lit("path too long: "), "path")).when(F.col("format").isNull(), F.concat(F.lit("format not known: "), "path"))
    return out.withColumn("path", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("path")))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, format) of the files in a directory, by path; others than sequences and sketches are skipped."""
    glob = "*.{" + ",".join(f"{s},{s}.gz,{s}.bz2" for s in SUFFIXES) + "}"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("length").alias("size"), file_format(F.col("path")).alias("format")).orderBy("path")


def _status(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise ValueError(f"no such file: {path}")
    return fs.getFileStatus(where)


def _known(path: str) -> bool:
    bare = path.removesuffix(".gz").removesuffix(".bz2")
    return bare.rsplit(".", 1)[-1] in SUFFIXES and "." in bare


def arguments(spark: SparkSession, paths: list[str], check: bool = True) -> DataFrame:
    """(path, format) of files and directories named one by one: a directory stands for the files in it whose format is known.
    A path that does not exist, or with `check` a file of no known format, is refused."""
    if not paths:
        raise ValueError("no input is named")
    out = None
    for path in paths:  # as many as a caller names
        if _status(spark, path).isDirectory():
            rows = directory(spark, path).select("path", "format")
        elif check and not _known(path):
            raise ValueError(f"format not known: {path}")
        else:
            rows = spark.createDataFrame([(path,)], "path string").withColumn("format", file_format(F.col("path")))
        out = rows if out is None else out.unionByName(rows)
    return out


def query_source(spark: SparkSession, list_path: str | None = None, paths: list[str] | None = None, piped: bool = False) -> DataFrame:
    """(path, format) of the queries: a list of paths if there is one, else paths named one by one. Formats are not checked
    where a pipe command makes the sequences."""
    if not list_path:
        return arguments(spark, paths or [], not piped)
    if piped:
        return spark.read.text(list_path).select(F.regexp_replace("value", r"^\s+", "").alias("path")).filter("path <> ''").withColumn("format", file_format(F.col("path")))
    return path_list(spark, list_path)


def reference_source(spark: SparkSession, path: str) -> DataFrame:
    """(path, format) of the references: a directory or a sequence file stands for itself, another file is a list of paths."""
    return arguments(spark, [path]) if _status(spark, path).isDirectory() or _known(path) else path_list(spark, path)


def census(files: DataFrame) -> DataFrame:
    """How many files there are of each format; files of no known format fail the query."""
    return files.groupBy(F.when(F.col("format").isNull(), F.raise_error(F.lit("a file of no known format")).cast("string")).otherwise(F.col("format")).alias("format")).agg(F.count("*").alias("n_files"))
