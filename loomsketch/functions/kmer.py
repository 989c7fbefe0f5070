"""K-mer coding: in arrays for whole texts, and as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SketchParams

BREAK = 4
_DNA = np.full(256, BREAK, np.uint8)
for _i, _c in enumerate("ACGT"):
    _DNA[ord(_c)] = _DNA[ord(_c.lower())] = _i
_SKIP = np.isin(np.arange(256), [10, 13])
_FOLD = np.full(256, BREAK, np.uint8)
for _i in range(26):
    _FOLD[65 + _i] = _FOLD[97 + _i] = _i % 4
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FOLDED = "".join("ACGT"[i % 4] for i in range(26))


def dna_bases(buf: np.ndarray) -> np.ndarray:
    """0 to 3 for A, C, G, T of either case, BREAK for anything else; line ends are left out."""
    return _DNA[buf[~_SKIP[buf]]]


def folded_bases(buf: np.ndarray) -> np.ndarray:
    """Letters a to z of either case as A, C, G, T in turn; everything else is left out."""
    x = _FOLD[buf]
    return x[x != BREAK]


def codes(bases: np.ndarray, params: SketchParams, ranks: np.ndarray) -> np.ndarray:
    """The codes of all kept k-mers, in order and with repeats. A k-mer never spans a BREAK."""
    width = params.length
    n = len(bases) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    broken = np.concatenate([[0], np.cumsum(bases == BREAK)])
    whole = broken[width:] == broken[:-width]
    b = bases.astype(np.int64) & 3
    forward, backward = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(width):
        x = b[j : j + n]
        forward = forward << 2 | x
        backward |= (3 - x) << (2 * j)
    u = np.minimum(forward, backward)
    h = params.outer
    rank = ranks[(u >> (2 * h)) & (params.space - 1)]
    keep = whole & (rank >= 0)
    u, rank = u[keep], rank[keep]
    sides = (u >> (2 * (params.k + params.s))) << (2 * h) | u & ((1 << (2 * h)) - 1)
    return (sides << params.rank_bits) + rank


def fold(text: Column) -> Column:
    """A text as DNA: the letters a to z, in turn, as A, C, G, T."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]+", "")), LETTERS, FOLDED)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; in ACGT order that of strings is that of numbers."""
    return F.least(kmer, reverse_complement(kmer))


def as_number(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def as_kmer(number: Column, length: int) -> Column:
    return F.lpad(F.translate(F.conv(number.cast("string"), 10, 4), "0123", "ACGT"), length, "A")


def inner_of(u: Column, params: SketchParams) -> Column:
    return F.shiftrightunsigned(u, 2 * params.outer).bitwiseAND(F.lit(params.space - 1).cast("long"))


def code_of(u: Column, rk: Column, params: SketchParams) -> Column:
    h = params.outer
    left = F.shiftleft(F.shiftrightunsigned(u, 2 * (params.k + params.s)), 2 * h)
    return F.shiftleft(left.bitwiseOR(u.bitwiseAND(F.lit((1 << 2 * h) - 1).cast("long"))), params.rank_bits) + rk


def component(code: Column, components: int) -> tuple[Column, Column]:
    """Which of `components` storage parts a code belongs to, and its id there."""
    return F.pmod(code, F.lit(components)), F.floor(code / components).cast("long")


def all_canonical(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """(kmer) every k-mer of the sequences once, the smaller of itself and its reverse complement as text. Other letters than
    those of DNA stay as they are; null and shorter sequences have none."""
    other = str.maketrans("ACGTacgt", "TGCAtgca")
    step = 1 << 16

    def run(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                for a in range(0, max(0, len(s or "") - k + 1), step):
                    part = s[a : a + step + k - 1]
                    back, n = part.translate(other)[::-1], len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(sorted({min(part[i : i + k], back[n - k - i : n - i]) for i in range(n - k + 1)}))], ["kmer"])

    return rows.select(F.col(seq).cast("string")).mapInArrow(run, "kmer string").distinct()


def by_read(decoded: DataFrame) -> DataFrame:
    """(sketch_id, text) of decoded records: a header line `>read` and the record's name, then its k-mers, a line each, in the
    order of their codes and as often as they stand in it."""
    lines = F.array_sort(F.collect_list(F.struct("code", F.repeat(F.concat("kmer", F.lit("\n")), F.col("n").cast("int")).alias("l"))))
    rows = decoded.groupBy("sketch_id").agg(lines.alias("l"))
    return rows.select("sketch_id", F.concat(F.lit(">read "), F.col("sketch_id").cast("string"), F.lit("\n"), F.array_join(F.transform("l", lambda z: z["l"]), "")).alias("text"))


def decode(sketch: DataFrame, params: SketchParams, dim: DataFrame) -> DataFrame:
    """sketch with the column `kmer`, the canonical k-mer behind each code."""
    if not params.reversible:
        raise ValueError("codes of these parameters can't be reversed: s - level is below 3")
    h, bits = params.outer, params.rank_bits
    rows = sketch.withColumn("rk", F.col("code").bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    rows = rows.join(F.broadcast(dim.filter(F.col("rk") < params.kept)) if params.kept <= 1 << 16 else dim.filter(F.col("rk") < params.kept), "rk")
    sides = F.shiftrightunsigned("code", bits)
    low = sides.bitwiseAND(F.lit((1 << 2 * h) - 1).cast("long"))
    u = F.shiftleft(F.shiftrightunsigned(sides, 2 * h), 2 * (params.k + params.s)).bitwiseOR(F.shiftleft("inner", 2 * h)).bitwiseOR(low)
    return rows.withColumn("kmer", as_kmer(u, params.length)).drop("rk", "inner")
