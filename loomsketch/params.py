"""Sketch parameters and the permutation of the inner-substring space that decides which k-mers are kept."""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: At least so many inner substrings are kept, whatever the level.
FLOOR = 4096
#: Up to this s the kept ranks are sent to every task as an array of 16**s numbers (4 MB at 5); beyond it they are joined.
ARRAY_S = 5


@dataclass(frozen=True)
class SketchParams:
    """k: half the k-mer's length; s: half the inner substring's; level: the sampling rate is 16**-level; seed: of the permutation."""

    k: int = 8
    s: int = 5
    level: int = 2
    seed: int = 42

    def __post_init__(self) -> None:
        if not 2 <= self.k <= 15:
            raise ValueError("k must be between 2 and 15, so that a code fits a signed 64-bit number")
        if not 1 <= self.s < 8 or self.s > self.k:
            raise ValueError("s must be between 1 and 7 and not above k")
        if not 0 <= self.level <= self.s:
            raise ValueError("level must be between 0 and s")
        if self.s - self.level < 3:
            warnings.warn("s - level is below 3: codes of different k-mers can be equal, and more than 16**-level is kept", stacklevel=3)

    @property
    def length(self) -> int:
        return 2 * self.k

    @property
    def outer(self) -> int:
        return self.k - self.s

    @property
    def space(self) -> int:
        return 16**self.s

    @property
    def kept(self) -> int:
        """Inner substrings of a rank below this are kept."""
        return min(self.space, max(16 ** (self.s - self.level), FLOOR))

    @property
    def rank_bits(self) -> int:
        return 4 * (self.s - self.level)

    @property
    def reversible(self) -> bool:
        return self.kept <= 1 << self.rank_bits

    def identity(self) -> str:
        """What two sketches must share to be compared."""
        return hashlib.md5(f"{self.k}:{self.s}:{self.level}:{self.seed}".encode()).hexdigest()[:16]


def default_params(level: int = 2, k: int = 8, seed: int = 42) -> SketchParams:
    """The parameters of a bare level: an inner substring three longer than the level, which makes codes reversible."""
    if not 0 <= level <= k - 3:
        raise ValueError("level must be between 0 and k - 3")
    return SketchParams(k, level + 3, level, seed)


@lru_cache(maxsize=4)
def kept_ranks(params: SketchParams) -> np.ndarray:
    """The rank of each inner substring, or -1 where it is not kept."""
    if params.s > ARRAY_S:
        raise ValueError(f"for s above {ARRAY_S} join permutation() instead")
    keys = [hashlib.md5(f"{params.seed}:{i}".encode()).hexdigest() for i in range(params.space)]
    ranks = np.empty(params.space, np.int64)
    ranks[np.array(sorted(range(params.space), key=keys.__getitem__))] = np.arange(params.space)
    return np.where(ranks < params.kept, ranks, -1)


def permutation(spark: SparkSession, params: SketchParams) -> DataFrame:
    """inner, rk of the whole space: its order is that of md5(seed:inner).

    Ranks are made in 256 parts by the hash's first two digits and shifted by what stands before, so that no task sorts it all.
    """
    rows = spark.range(params.space).select(F.col("id").alias("inner"), F.md5(F.concat(F.lit(f"{params.seed}:"), F.col("id").cast("string")).cast("binary")).alias("m"))
    rows = rows.withColumn("part", F.substring("m", 1, 2))
    local = rows.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("m")) - 1)
    before = rows.groupBy("part").count()
    before = before.select("part", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("count")).alias("before"))
    return local.join(F.broadcast(before), "part").select("inner", (F.col("r") + F.col("before")).cast("long").alias("rk"))


def save_params(spark: SparkSession, params: SketchParams, path: str) -> None:
    """Writes the parameters and the permutation; a saved permutation is read again and not made anew."""
    spark.createDataFrame([(params.identity(), params.k, params.s, params.level, params.seed)], "id string, k int, s int, level int, seed int").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
    permutation(spark, params).write.mode("overwrite").parquet(f"{path}/permutation")


def load_params(spark: SparkSession, path: str) -> tuple[SketchParams, DataFrame]:
    row = spark.read.parquet(f"{path}/params").first()
    return SketchParams(row["k"], row["s"], row["level"], row["seed"]), spark.read.parquet(f"{path}/permutation")


def largest_prime_below(bits: int) -> int:
    """The largest prime below 2**bits."""
    n = (1 << bits) - 1
    while not _is_prime(n):
        n -= 1
    return n


def next_prime(n: int) -> int:
    """The smallest prime not below n."""
    while not _is_prime(n):
        n += 1
    return n


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2**64."""
    if n < 2:
        return False
    for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        if n % p == 0:
            return n == p
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True
