"""Sketches: (sketch_id, code, n), one row for each distinct sampled code of a sequence with its number of occurrences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kmer
from ..params import ARRAY_S, SketchParams, kept_ranks, permutation
from .order import cumulative

#: Bases that are coded at once; longer sequences in pieces.
CHUNK = 1 << 18
MAX_ABUNDANCE = 65535


def _spread(rows: DataFrame) -> DataFrame:
    """Deals rows out where the scan has fewer tasks than the session has cores: a file of one row group is one task."""
    want = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(want) if rows.rdd.getNumPartitions() < want else rows


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes where Arrow has them, and where each row begins and ends there; null is empty."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).fill_null(b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends


def kmer_rows(rows: DataFrame, sketch_id: str, seq: str, params: SketchParams, folded: bool = False, drop_zero: bool = False, quality: str | None = None, min_quality: int = 0, phred_offset: int = 0) -> DataFrame:
    """(sketch_id, code, n) of every row by itself. Null sequences have no codes.

    folded: any text is taken as DNA. drop_zero: code 0 is lost, as in a table whose empty slot is 0. quality: a column of
    base qualities; bases whose character minus phred_offset is below min_quality break a run.
    """
    kind = rows.schema[sketch_id].dataType.simpleString()
    cols = [F.col(sketch_id).alias("sketch_id"), F.col(seq).cast("string").alias("seq"), *([F.col(quality).cast("string").alias("q")] if quality else [])]
    if params.s > ARRAY_S:
        return _native(rows.select(*cols), params, folded, drop_zero, quality is not None, min_quality + phred_offset)
    run = _coder(params, folded, drop_zero, quality is not None, min_quality + phred_offset)
    return _spread(rows.select(*cols)).mapInArrow(run, f"sketch_id {kind}, code long, n long")


def _coder(params: SketchParams, folded: bool, drop_zero: bool, masked: bool, least: int):
    """What a task does with its batches (sketch_id, sequence, perhaps qualities). Beside a batch it holds what CHUNK bases need."""
    ranks = kept_ranks(params)

    width = params.length

    def coded(x: np.ndarray) -> np.ndarray:
        x = kmer.folded_bases(x) if folded else kmer.dna_bases(x)
        if len(x) <= CHUNK:
            return kmer.codes(x, params, ranks)
        return np.concatenate([kmer.codes(x[a : a + CHUNK + width - 1], params, ranks) for a in range(0, len(x) - width + 1, CHUNK)])

    def run(batches):
        for batch in batches:
            data, ends = _bytes(batch.column(1))
            marks, marked = _bytes(batch.column(2)) if masked else (None, None)
            a = 0
            while a < batch.num_rows:
                rows_, found, count, b, size = [], [], [], a, 0
                while b < batch.num_rows and (b == a or size < CHUNK):
                    x = data[ends[b] : ends[b + 1]]
                    if marks is not None and marked[b] < marked[b + 1]:
                        q = marks[marked[b] : marked[b + 1]][: len(x)]
                        x = x.copy()
                        x[: len(q)][q < least] = ord("N")
                    c, n = np.unique(coded(x), return_counts=True)
                    if drop_zero and len(c) and c[0] == 0:
                        c, n = c[1:], n[1:]
                    rows_.append(np.full(len(c), b)), found.append(c), count.append(n)
                    size += len(x)
                    b += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows_))), pa.array(np.concatenate(found)), pa.array(np.concatenate(count).astype(np.int64))], ["sketch_id", "code", "n"])
                a = b

    return run


def _native(rows: DataFrame, params: SketchParams, folded: bool, drop_zero: bool, masked: bool, least: int) -> DataFrame:
    """The same in column expressions, for a permutation too large to send to every task."""
    seq = F.col("seq")
    if masked:
        pairs = F.arrays_zip(F.split("seq", "").alias("b"), F.split("q", "").alias("q"))
        seq = F.array_join(F.transform(pairs, lambda z: F.when(F.ascii(z["q"]) < least, "N").otherwise(F.coalesce(z["b"], F.lit("")))), "")
    runs = F.array(kmer.fold(seq)) if folded else F.split(F.upper(F.regexp_replace(seq, r"[\r\n]", "")), "[^ACGT]+")
    width = params.length
    one = rows.select("sketch_id", F.explode(runs).alias("r")).filter(F.length("r") >= width)
    one = one.select("sketch_id", "r", F.explode(F.sequence(F.lit(1), F.length("r") - width + 1)).alias("p"))
    u = one.select("sketch_id", kmer.as_number(kmer.canonical(F.substring("r", F.col("p"), F.lit(width)))).alias("u"))
    u = u.withColumn("inner", kmer.inner_of(F.col("u"), params))
    kept = permutation(rows.sparkSession, params).filter(F.col("rk") < params.kept)
    found = u.join(kept, "inner").select("sketch_id", kmer.code_of(F.col("u"), F.col("rk"), params).alias("code"))
    if drop_zero:
        found = found.filter("code <> 0")
    return found.groupBy("sketch_id", "code").agg(F.count("*").alias("n"))


def counts(rows: DataFrame, sketch_id: str, seq: str, params: SketchParams, **how) -> DataFrame:
    """(sketch_id, code, n) over all rows of a sketch_id: a file has many records."""
    return kmer_rows(rows, sketch_id, seq, params, **how).groupBy("sketch_id", "code").agg(F.sum("n").alias("n"))


def distinct(found: DataFrame) -> DataFrame:
    return found.select("sketch_id", "code")


def unique(found: DataFrame) -> DataFrame:
    """Codes that occur exactly once in their sketch."""
    return found.filter("n = 1").select("sketch_id", "code")


def at_least(found: DataFrame, m: int) -> DataFrame:
    """Codes that occur at least m times; m is held between 1 and 14."""
    return found.filter(F.col("n") >= min(max(m, 1), 14)).select("sketch_id", "code")


def abundance(found: DataFrame) -> DataFrame:
    """Codes with their abundance, which saturates."""
    return found.select("sketch_id", "code", F.least("n", F.lit(MAX_ABUNDANCE)).cast("int").alias("abundance"))


def by_record(rows: DataFrame, record: str, seq: str, params: SketchParams, **how) -> DataFrame:
    """A sketch for each record, with repeats: n says how often a code stands in it."""
    return kmer_rows(rows, record, seq, params, **how)


def meta(sketch: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(sketch_id, n_codes) of every sketch; with `ids`, also of those without codes."""
    sizes = sketch.groupBy("sketch_id").agg(F.count("*").alias("n_codes"))
    if ids is None:
        return sizes
    return ids.select("sketch_id").join(sizes, "sketch_id", "left").select("sketch_id", F.coalesce("n_codes", F.lit(0).cast("long")).alias("n_codes"))


def postings(sketch: DataFrame) -> DataFrame:
    """The inverted index: code, its sketches in order, and how many there are."""
    lists = sketch.groupBy("code").agg(F.array_sort(F.collect_set("sketch_id")).alias("sketch_ids"))
    return lists.withColumn("n_sketches", F.size("sketch_ids").cast("long"))


def total(sketch: DataFrame) -> DataFrame:
    return sketch.agg(F.count("*").alias("n_codes"), F.count_distinct("sketch_id").alias("n_sketches"))


def offsets(sizes: DataFrame) -> DataFrame:
    """Cumulative end of each sketch in a concatenation of all of them by sketch_id, which is a number."""
    return cumulative(sizes, "sketch_id", "n_codes", "end_offset")
