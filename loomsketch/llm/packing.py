"""Best-fit packing by a length histogram (operator 9).

The plan is made over counts of lengths, never over documents: there are at most `capacity` lengths, so the histogram and
the plan are of bounded size however many documents there are. Documents then take the planned slots by joining on their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import default_path, encoded

CAPACITY, END_ID = 4096, 1
#: Pieces of one length that are ranked together in one window, on average.
GROUP = 1000


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only beyond `capacity`."""
    path, end = path or default_path(), np.array([end_id], "<u4")

    def run(batches):
        crc = zlib.crc32
        for batch in batches:
            for a, ids, at in encoded(batch.column(1), path):
                rows, piece, start, length, sums = [], [], [], [], []
                for row, (u, v) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), a):
                    own = np.append(ids[u:v], end)
                    for k, x in enumerate(range(0, len(own), capacity)):
                        part = own[x : x + capacity]
                        rows.append(row), piece.append(k), start.append(x), length.append(len(part)), sums.append(crc(part.astype("<u4", copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, sums))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots as runs (length, first_rank, n, sequence, offset, each): the n pieces of that length from first_rank on go to
    sequences from `sequence` on, `each` of them one after the other from `offset` in every sequence.

    Best fit, decreasing: a sequence opens with the longest length left and is filled with the longest that fits until
    none does. The composition is then repeated as often as the counts allow, so that every step uses up at least one
    length's count but for less than one sequence's share.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is not between 1 and the capacity")
    lengths, rank, out, sequence = sorted(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        room, used = capacity, {}
        while room:
            at = bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] - used.get(lengths[at], 0) <= 0:
                at -= 1
            if at < 0:
                break
            size = lengths[at]
            take = min(room // size, left[size] - used.get(size, 0)) if used else 1
            used[size] = used.get(size, 0) + take
            room -= take * size
        times, offset = min(left[k] // n for k, n in used.items()), 0
        for size, n in used.items():
            out.append((size, rank[size], n * times, sequence, offset, n))
            rank[size] += n * times
            left[size] -= n * times
            offset += n * size
            if not left[size]:
                lengths.remove(size)
        sequence += times
    return out


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (a stored table with `length`) and, for each row, its sequence_id and offset."""
    counts = parts.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most `capacity` rows
    runs = sorted(plan(histogram, capacity))
    # a common length is ranked in many groups, a rare one in one
    groups = counts.select("length", F.ceil(F.col("n") / GROUP).alias("__k"))
    names = parts.columns
    # the place of a row in its file tells equal rows apart and stays the same when a task runs again
    rows = parts.select(*names, F.col("_metadata.file_name").alias("__f"), F.col("_metadata.row_index").alias("__i"))
    rows = rows.join(F.broadcast(groups), "length").withColumn("__g", F.pmod(F.xxhash64("__f", "__i"), F.col("__k"))).drop("__k")
    before = rows.groupBy("length", "__g").agg(F.count("*").alias("__n"))
    before = before.select("length", "__g", (F.sum("__n").over(Window.partitionBy("length").orderBy("__g")) - F.col("__n")).alias("__before"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__g").orderBy("__f", "__i")) - 1)
    ranked = ranked.join(before, ["length", "__g"]).select(*names, (F.col("__r") + F.col("__before")).alias("__rank"))
    size, first, _, seq, offset, each = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 6
    keys, at = (size << 48) + first, names.index("length")

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, len(names)))
            k = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            step = rank - first[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq[k] + step // each[k]), pa.array(offset[k] + step % each[k] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens; a row for each piece.

    Null text counts as empty (the end id alone); a null doc_id is kept; repeated rows are packed each for itself; other
    columns are ignored; an empty table gives no rows. Only documents of more than `capacity` tokens are cut.
    """
    return place(stored(pieces(docs, path, capacity, end_id), "pieces"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
