"""Set operations on sketches. Abundances, where a sketch has them, are carried along."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import SketchParams
from . import taxonomy


def check_compatible(a: SketchParams, b: SketchParams, policy: str = "abort") -> bool:
    """Whether two sketches may be combined; policy abort raises if not, warn and skip say so."""
    if a.identity() == b.identity():
        return True
    if policy == "abort":
        raise ValueError("the sketches were made with different parameters")
    if policy == "warn":
        import warnings

        warnings.warn("the sketches were made with different parameters", stacklevel=2)
        return True
    return False


def guard(params: Sequence[SketchParams] | None, policy: str = "abort") -> list[bool]:
    """Which of the sketches may be combined with the first; None: parameters are not known and nothing is checked."""
    return [check_compatible(params[0], p, policy) for p in params] if params else []


def union(sketch: DataFrame) -> DataFrame:
    """Codes of any sketch."""
    return sketch.select("code").distinct()


def unique_union(sketch: DataFrame) -> DataFrame:
    """Codes of exactly one sketch."""
    return sketch.select("sketch_id", "code").distinct().groupBy("code").agg(F.count("*").alias("n")).filter("n = 1").select("code")


def intersect(sketch: DataFrame, pan: DataFrame, params: Sequence[SketchParams] | None = None) -> DataFrame:
    """Each sketch's codes that the pan sketch has. params: those of both; sketches of different parameters are refused."""
    guard(params)
    return sketch.join(pan.select("code"), "code", "left_semi").select(*sketch.columns)


def subtract(sketch: DataFrame, pan: DataFrame, params: Sequence[SketchParams] | None = None) -> DataFrame:
    """Each sketch's codes that the pan sketch lacks. params: those of both; sketches of different parameters are refused."""
    guard(params)
    return sketch.join(pan.select("code"), "code", "left_anti").select(*sketch.columns)


def combine(pans: dict[str, DataFrame], params: Sequence[SketchParams] | None = None, policy: str = "abort") -> DataFrame:
    """Pan sketches as one sketch of many: each under its name, numbered in the order given. params: one for each pan; by
    policy, pans of other parameters than the first one's are refused, taken with a warning, or left out (skip)."""
    fine = guard(params, policy)
    if fine:
        pans = {k: v for (k, v), ok in zip(pans.items(), fine, strict=True) if ok}
    parts = [pan.select(F.lit(i).cast("long").alias("sketch_id"), F.lit(name).alias("name"), "code") for i, (name, pan) in enumerate(pans.items())]
    return reduce(DataFrame.unionByName, parts)


def combine_batches(batches: list[DataFrame], catalogs: list[DataFrame], params: Sequence[SketchParams] | None = None) -> DataFrame:
    """Batches of sketches with ids from 0 as one: each batch's ids begin behind those of the catalog before, which lists
    sketches without codes as well. params: one for each batch; batches of different parameters are refused."""
    guard(params)
    out, base = [], 0
    for i, (batch, catalog) in enumerate(zip(batches, catalogs, strict=True)):
        out.append(batch.withColumn("sketch_id", F.col("sketch_id") + F.lit(base).cast("long")))
        if i < len(batches) - 1:
            base += catalog.count()
    return reduce(DataFrame.unionByName, out)


def group(sketch: DataFrame, mapping: DataFrame, drop_zero: bool = False) -> DataFrame:
    """The union of the sketches of each category: (category, name, code); category 0 is left out. A mapping that gives a
    category two names, or a sketch two categories, is refused."""
    if not taxonomy.check_categories(mapping.select("category", "category_name").filter("category <> 0")).isEmpty():
        raise ValueError("a category has different names")
    if not mapping.groupBy("sketch_id").count().filter("count > 1").isEmpty():
        raise ValueError("a sketch has several categories")
    named = mapping.filter("category <> 0").select("sketch_id", "category", F.concat_ws("_", F.col("category").cast("string"), "category_name").alias("name"))
    rows = sketch.join(named, "sketch_id").select("category", "name", "code").distinct()
    return rows.filter("code <> 0") if drop_zero else rows


def names(catalog: DataFrame) -> DataFrame:
    return catalog.select("sketch_id", "name")
