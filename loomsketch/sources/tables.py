"""Sketches, indexes, vectors and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name
from ..operators.composite import norms
from ..params import SketchParams, load_params, save_params


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_sketch(spark: SparkSession, sketch: DataFrame, catalog: DataFrame, params: SketchParams, path: str, components: int = 1) -> None:
    """A sketch directory: parameters, catalog (sketch_id, name, n_codes) and codes, in parts by code if components > 1."""
    save_params(spark, params, path)
    catalog.write.mode("overwrite").parquet(f"{path}/catalog")
    if components > 1:
        sketch.withColumn("component", F.pmod("code", F.lit(components)).cast("int")).write.mode("overwrite").partitionBy("component").parquet(f"{path}/codes")
    else:
        sketch.write.mode("overwrite").parquet(f"{path}/codes")


def read_sketch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, SketchParams]:
    """The codes, the catalog and the parameters of a sketch directory."""
    params, _ = load_params(spark, path)
    codes = spark.read.parquet(f"{path}/codes")
    return codes.drop("component"), spark.read.parquet(f"{path}/catalog"), params


def write_index(sketch: DataFrame, name: str, buckets: int) -> None:
    """An index: the sketch as a table in buckets by code, which a search joins without shuffling it again."""
    sketch.write.mode("overwrite").bucketBy(buckets, "code").sortBy("code").saveAsTable(name)


def read_index(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def write_table(df: DataFrame, path: str) -> None:
    """Pan sketches, abundance vectors, shared counts: any table. What a query reads is never deleted."""
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as tab-separated text with a header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_kmers(decoded: DataFrame, path: str, catalog: DataFrame | None = None) -> None:
    """A folder of k-mers, one a line, for each sketch; with a catalog (sketch_id, name) under the last part of its name."""
    key = "sketch_id"
    if catalog is not None:
        decoded, key = decoded.join(catalog.select("sketch_id", base_name(F.col("name")).alias("name")), "sketch_id"), "name"
    decoded.select(key, "kmer").write.mode("overwrite").partitionBy(key).text(path)


def write_abundance_index(vectors: DataFrame, names: DataFrame, path: str) -> None:
    """An index of abundance vectors (sample_id, ref_id, pct): the vectors sorted by reference, which a search joins on, their
    norms, and the samples' names (sample_id, name)."""
    vectors.repartition("ref_id").sortWithinPartitions("ref_id", "sample_id").write.mode("overwrite").parquet(f"{path}/vectors")
    norms(read_table(vectors.sparkSession, f"{path}/vectors")).write.mode("overwrite").parquet(f"{path}/norms")  # not made again
    names.select("sample_id", "name").write.mode("overwrite").parquet(f"{path}/names")


def read_abundance_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors, their norms and the names of an index."""
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("vectors", "norms", "names"))


def category_table(spark: SparkSession, path: str) -> DataFrame:
    """(sketch_id, category, category_name) of a list whose line i, from 0, is the category and perhaps a name of sketch i."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("sketch_id", "line"))
    parts = F.split("line", "\t")
    return rows.select(F.col("sketch_id").cast("long").alias("sketch_id"), F.get(parts, 0).cast("long").alias("category"), F.get(parts, 1).alias("category_name"))
