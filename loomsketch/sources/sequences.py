"""FASTA and FASTQ as DataFrames. Compressed files (.gz, .bz2) are read through Spark's codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..held import held


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, header, seq) of every record; a sequence is its lines joined."""
    rows = spark.read.option("lineSep", ">").text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = rows.filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"[\r\n]", "")
    return rows.select("path", head.alias("header"), body.alias("seq"))


#: Blocks of input whose line counts are sent to every task, about 100 bytes each; beyond it they are joined by shuffle.
BLOCKS = 50_000


def fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, record, id, seq, quality) of every record of four lines; the last one needs no line end.

    Files are read in splits, however large they are. A first pass counts the lines of each split; what the splits before it
    in the file hold gives every line its number, and the number its record and place. Only records that lie across two tasks
    have lines that meet after the shuffle. Lines that make no whole record at the end of a file are left out. The settings of
    spark.sql.files must stay as they are until the result has been computed.
    """
    block = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    # numbers follow one another within a split, and both passes deal the splits out alike
    lines = spark.read.option("lineSep", "\n").text(paths).select(*block, F.monotonically_increasing_id().alias("i"), "value")
    counted = lines.groupBy("path", "block").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    counted = held(counted.select("path", "block", (before - F.col("first")).alias("shift")))
    few = counted.limit(BLOCKS + 1).count() <= BLOCKS
    line = F.col("i") + F.col("shift")
    rows = lines.join(F.broadcast(counted) if few else counted, ["path", "block"]).select("path", F.floor(line / 4).alias("record"), F.pmod(line, F.lit(4)).alias("k"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    part = lambda k, name: F.max(F.when(F.col("k") == k, F.col("value"))).alias(name)
    records = rows.groupBy("path", "record").agg(part(0, "id"), part(1, "seq"), part(3, "quality"), F.count("*").alias("n"))
    return records.filter("n = 4").select("path", F.col("record").cast("long").alias("record"), "id", "seq", "quality")


def piped(spark: SparkSession, paths: list[str], command: str, allow: bool = False) -> DataFrame:
    """FASTQ records from `command path` for each path. Runs programs on executors, so it must be allowed."""
    if not allow:
        raise PermissionError("a pipe command runs programs on executors; pass allow=True")
    import shlex
    import subprocess

    import pyarrow as pa

    words = shlex.split(command)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                lines = subprocess.run([*words, path], capture_output=True, check=True, text=True).stdout.splitlines()
                for i in range(0, len(lines) - 3, 4):
                    yield pa.RecordBatch.from_pylist([{"path": path, "record": i // 4, "id": lines[i], "seq": lines[i + 1], "quality": lines[i + 3]}])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, "path string, record long, id string, seq string, quality string")
