"""Lookups and roll-ups around taxonomies and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..held import held
from .order import cumulative

def lookup(rows: DataFrame, table: DataFrame, key: Column | str, table_key: str, value: str, default: str = "0") -> DataFrame:
    """rows with `value` looked up by key, or the default. Of several values for a key the greatest is taken."""
    key = F.col(key) if isinstance(key, str) else key
    one = table.groupBy(F.col(table_key).alias("__k")).agg(F.max(value).alias("__v"))
    return rows.withColumn("__k", key).join(one, "__k", "left").withColumn(value, F.coalesce(F.col("__v").cast("string"), F.lit(default))).drop("__k", "__v")


def lookup_all(rows: DataFrame, table: DataFrame, key: Column | str, table_key: str, value: str, default: str = "0") -> DataFrame:
    """As lookup, with all different values of a key, in order, joined by |."""
    key = F.col(key) if isinstance(key, str) else key
    many = table.groupBy(F.col(table_key).alias("__k")).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), "|").alias("__v"))
    return rows.withColumn("__k", key).join(many, "__k", "left").withColumn(value, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def accession_key(name: Column) -> Column:
    return F.regexp_extract(name, r"(GC[AF]_[0-9.]+)", 1)


def species_key(lineage: Column) -> Column:
    return F.regexp_extract(lineage, r";s__(.+)", 1)


def with_metadata(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """Search hits (name, measure) with their run's project, sample and organism, NA where there is none or it is incomplete."""
    full = runs.filter("sample IS NOT NULL AND organism IS NOT NULL").dropDuplicates(["run"])
    out = hits.withColumn("run", F.regexp_replace("name", r"\.abv$", "")).join(full, "run", "left")
    return out.select("run", "measure", *[F.coalesce(c, F.lit("NA")).alias(c) for c in ("project", "sample", "organism")])


def subset(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed."""
    return rows.join(keys.select(key), key, "left_semi").select(*rows.columns)


def check_categories(mapping: DataFrame) -> DataFrame:
    """Categories that are given different names, a missing name being one; setops.group refuses a mapping with any."""
    return mapping.groupBy("category").agg(F.count_distinct(F.coalesce("category_name", F.lit(""))).alias("n_names")).filter("n_names > 1")


def best_support(rows: DataFrame, key: str, value: str, every: bool = False) -> DataFrame:
    """How many rows support each value of a key: the best one, ties to the smaller value, or all of them with their place."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("support"))
    ranked = n.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("support"), value)))
    return ranked if every else ranked.filter("place = 1").drop("place")


def depths(stats: DataFrame, more_than: int, floor: float, main: float = 3.0, median: int = 1, low: float = 2.0) -> DataFrame:
    """(sample, taxon, depth) of statistics (sample, taxon, n_shared, trimmed_mean, median) that pass the thresholds."""
    fine = stats.filter(F.col("n_shared") > more_than)
    over = F.col("trimmed_mean") - main
    depth = F.when((F.col("trimmed_mean") > main) & (F.col("median") > median), over).when(F.col("trimmed_mean") >= low, F.greatest(over, F.lit(floor)))
    return fine.select("sample", "taxon", depth.alias("depth")).filter("depth IS NOT NULL")


def percentages(found: DataFrame) -> DataFrame:
    return found.withColumn("percentage", F.col("depth") * 100 / F.sum("depth").over(Window.partitionBy("sample")))


def profile_depths(stats: DataFrame) -> DataFrame:
    return percentages(depths(stats, 7, 0.001))


def krona(stats: DataFrame, lineages: DataFrame) -> DataFrame:
    """(sample, percentage, taxon, lineage), deepest first."""
    out = percentages(depths(stats, 8, 0.1)).join(lineages.select("taxon", "lineage"), "taxon", "left")
    return out.select("sample", "taxon", "percentage", "lineage").orderBy("sample", F.desc("percentage"), "taxon")


def ancestors(nodes: DataFrame, root: int = 1, most: int | None = None) -> DataFrame:
    """(node, ancestor, steps) of nodes (node, parent), themselves included and the root left out.

    Paths are doubled in every round until none grows, so that a tree of depth d takes log2(d) rounds. Parents that form a
    circle are refused, and so are paths that are longer than `most` by the round that reaches it.
    """
    up = held(nodes.filter(F.col("node") != root).select("node", "parent"))
    paths = up.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    jump, size = up.select(F.col("node").alias("at"), F.col("parent").alias("to")), 1
    most = up.count() if most is None else most
    while not jump.isEmpty():
        if size > most:
            raise ValueError(f"paths of more than {most} nodes: the tree is deeper, or parents form a circle")
        further = paths.join(jump, paths["ancestor"] == jump["at"]).filter(F.col("to") != root).select("node", F.col("to").alias("ancestor"), (F.col("steps") + size).alias("steps"))
        paths = held(paths.unionByName(further))
        nxt = jump.select(F.col("at").alias("to"), F.col("to").alias("to2"))
        jump = held(jump.join(nxt, "to").select("at", F.col("to2").alias("to")))
        size *= 2
    return paths


def roll_up(profile: DataFrame, nodes: DataFrame, root: int = 1, most: int | None = None, add: bool = True) -> DataFrame:
    """(sample, taxon, rank, percentage): every taxon's own share and those below it.

    nodes: (node, parent, rank). Shares of one taxon are added up; with add=False the greatest stands for it, as where a
    later assignment replaces an earlier one.
    """
    own = profile.groupBy("sample", "taxon").agg((F.sum if add else F.max)("percentage").alias("percentage"))
    up = ancestors(nodes, root, most).select(F.col("node").alias("taxon"), "ancestor")
    out = own.join(up, "taxon").groupBy("sample", F.col("ancestor").alias("taxon")).agg(F.sum("percentage").alias("percentage"))
    return out.join(nodes.select(F.col("node").alias("taxon"), "rank"), "taxon").select("sample", "taxon", "rank", "percentage")


def lineage_paths(nodes: DataFrame, root: int = 1, most: int | None = None) -> DataFrame:
    """(node, path, names): ranked ancestors from the top down, joined by |. nodes: (node, parent, rank, name)."""
    up = ancestors(nodes, root, most)
    named = up.join(nodes.select(F.col("node").alias("ancestor"), "name", "rank"), "ancestor")
    items = F.reverse(F.array_sort(F.collect_list(F.struct("steps", F.col("ancestor").cast("string").alias("id"), "name"))))
    out = named.groupBy("node").agg(items.alias("items"))
    return out.select("node", F.array_join(F.transform("items", lambda z: z["id"]), "|").alias("path"), F.array_join(F.transform("items", lambda z: z["name"]), "|").alias("names"))


def otu_table(profile: DataFrame, samples: list[str]) -> DataFrame:
    """Taxa by samples, 0 where a sample lacks a taxon. profile: (sample, lineage, value)."""
    return profile.groupBy("lineage").pivot("sample", samples).agg(F.first("value")).na.fill(0)


def otu_ids(profile: DataFrame) -> DataFrame:
    """(lineage, otu): taxa numbered from 0 in the order in which they are first seen. profile has a column `position`."""
    first = profile.groupBy("lineage").agg(F.min("position").alias("position"))
    places = cumulative(first.select("position").distinct().withColumn("one", F.lit(1).cast("long")), "position", "one", "rank")
    return first.join(places, "position").select("lineage", (F.col("rank") - 1).alias("otu"))
