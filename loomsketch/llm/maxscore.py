"""Exact top-k search by MaxScore (operator 6).

A vector's components are its terms. For every query and block of candidates each term has a bound, the most that it can
add to a score there. Terms of the smallest bounds are non-essential as long as together they stay below the k-th best
score so far: a candidate that no essential term raises above zero cannot enter. Essential terms are traversed first; the
others are probed, largest bound first, for those candidates that are still competitive. Each shard of the candidates gives
its k best for every query, and the shards are merged. Bounds are compared strictly, so ties are kept for the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K, EVERY = 5, 50
#: Vectors of a candidate block; queries of a query block.
BLOCK, QUERIES = 4096, 1024
#: Candidates of a shard and queries of a group, about: a task takes one group through one shard.
SHARD, GROUP = 8192, 8192
#: Non-essential terms probed between two looks at who is still competitive.
STEP = 8


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q, floor(256 * x) of each component; without rows that are null or hold a null or non-finite component."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of numbers; a shorter vector counts as zero where it has no component."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    n = np.diff(off)
    out = np.zeros((len(lists), max(dim, int(n.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(lists)), n)
    out[row, np.arange(off[0], off[-1]) - np.repeat(off[:-1], n)] = flat[off[0] : off[-1]]
    return out


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of `size` vectors at most: n, dim, ids (int64) and m (int64, row by row), as bytes."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                m = _matrix(part.column(1), 0)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([ids.tobytes()]), pa.array([m.tobytes()])], ["n", "dim", "ids", "m"])

    return stored(vectors.mapInArrow(run, "n int, dim int, ids binary, m binary"), name)


def _block(n: int, dim: int, ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64).reshape(n, dim)


class Best:
    """The k best (score, id) of one query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, None, np.zeros(0, np.int64)

    def bound(self):
        return self.score[-1] if len(self.id) == self.k else None

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.score is not None:
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        keep = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[keep], ids[keep]


def maxscore(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, high: np.ndarray, low: np.ndarray, best: Best) -> None:
    """Adds to `best` what a block of candidates has: `columns` is terms by candidates, `high` and `low` its extremes."""
    bound = np.maximum(np.where(query > 0, query * high, query * low), 0)
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], np.zeros(1, bound.dtype)])  # what the terms from there on can add
    theta = best.bound()
    essential = len(order) if theta is None else int(np.count_nonzero(rest[:-1] >= theta))
    if not essential:
        return  # all terms together stay below the k-th best
    at, done = None, essential
    score = query[order[:essential]] @ columns[order[:essential]]
    while True:
        if theta is not None:
            alive = np.flatnonzero(score + rest[done] >= theta)
            if len(alive) < len(score):
                at, score = alive if at is None else at[alive], score[alive]
        if done == len(order) or not len(score):
            break
        terms = order[done : done + STEP]
        score = score + query[terms] @ (columns[terms] if at is None else columns[np.ix_(terms, at)])
        done = min(len(order), done + STEP)
    found = ids if at is None else ids[at]
    other = found != own
    found, score = found[other], score[other]
    if len(score) > 4 * best.k:
        cut = np.partition(score, len(score) - best.k)[len(score) - best.k]
        found, score = found[score >= cut], score[score >= cut]
    if len(score):
        best.add(score, found)


def _numbers(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where every sum of products is exact in them, else as Python's integers."""
    top = max(int(np.abs(m).max(initial=0)), 1) * max(int(np.abs(q).max(initial=0)), 1) * max(m.shape[1], 1)
    kind = float if top < 1 << 52 else object
    return m.astype(kind), q.astype(kind)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k others of highest score.

    Vectors that are null, or hold a null or non-finite component, and rows with a null vec_id take no part. A vector of
    fewer components counts as zero beyond its end. Repeated ids: every row but those of the query's own id is a candidate;
    a repeated query id is searched once, with its smallest vector. Fewer than k candidates: all of them. Ties go to the
    smaller vec_id. Queries are moved in blocks to every shard of the candidates; vectors never meet as rows of a join.
    """
    rows = quantised(vectors)
    asked = blocks(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")), QUERIES, "queries")
    shelf = blocks(rows, BLOCK, "candidates")
    count = lambda df, size: int(max(1, -(-(df.agg(F.sum("n")).first()[0] or 0) // size)))
    groups, shards = count(asked, GROUP), count(shelf, SHARD)
    part = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("long")
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(part(groups).alias("g"), every_of(shards).alias("s"), F.lit(0).alias("kind"), "n", "dim", "ids", "m")
    right = shelf.select(every_of(groups).alias("g"), part(shards).alias("s"), F.lit(1).alias("kind"), "n", "dim", "ids", "m")
    cell = (F.col("g") * shards + F.col("s")).alias("shard")

    def run(batches):
        """A cell, one group by one shard, at a time: query blocks come first, then the candidate blocks stream by."""
        shard, waiting = None, []

        def flush():
            for ids, _, bests in waiting:
                rows_ = [(q, s, i) for q, b in zip(ids, bests, strict=True) if len(b.id) for s, i in zip(b.score, b.id, strict=True)]
                if rows_:
                    q, s, i = zip(*rows_, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(q, np.int64)), pa.array(np.array(i, np.int64)), pa.array([int(x) for x in s], pa.int64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    yield from flush()
                    shard, waiting = r["shard"], []
                ids, m = _block(r["n"], r["dim"], r["ids"], r["m"])
                if r["kind"] == 0:
                    waiting.append((ids, m, [Best(k) for _ in ids]))
                    continue
                for qids, qm, bests in waiting:
                    dim = max(m.shape[1], qm.shape[1])
                    wide = lambda x, dim=dim: np.pad(x, ((0, 0), (0, dim - x.shape[1])))
                    c, q = _numbers(wide(m), wide(qm))
                    columns = np.ascontiguousarray(c.T)
                    high, low = c.max(0), c.min(0)
                    for i, b in enumerate(bests):
                        maxscore(q[i], qids[i], ids, columns, high, low, b)
        yield from flush()

    both = left.unionAll(right).select(cell, "kind", "n", "dim", "ids", "m").repartition(min(groups * shards, 100_000), "shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP6_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s
) WHERE r <= {K}
"""


def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
