"""The abundance sketch of a stream of reads: a running count of each code, kept as state by Structured Streaming."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from ..functions import kmer
from ..operators.sketch import MAX_ABUNDANCE
from ..params import SketchParams, kept_ranks


def stream_codes(reads: DataFrame, sketch_id: str, seq: str, params: SketchParams, folded: bool = False) -> DataFrame:
    """(sketch_id, code, n) of each read of a stream; further columns such as an event time are not carried."""
    ranks = kept_ranks(params)
    kind = reads.schema[sketch_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, found, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, x in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                bases = (kmer.folded_bases if folded else kmer.dna_bases)(np.frombuffer(x or b"", np.uint8))
                c, n = np.unique(kmer.codes(bases, params, ranks), return_counts=True)
                rows.append(np.full(len(c), i)), found.append(c), count.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found)), pa.array(np.concatenate(count).astype(np.int64))], ["sketch_id", "code", "n"])

    return reads.select(F.col(sketch_id).alias("sketch_id"), F.col(seq).cast("string").alias("seq")).mapInArrow(run, f"sketch_id {kind}, code long, n long")


def running_abundance(reads: DataFrame, sketch_id: str, seq: str, params: SketchParams, folded: bool = False) -> DataFrame:
    """For output mode complete or update: each code's abundance so far."""
    found = stream_codes(reads, sketch_id, seq, params, folded)
    return found.groupBy("sketch_id", "code").agg(F.least(F.sum("n"), F.lit(MAX_ABUNDANCE)).cast("int").alias("abundance"))
