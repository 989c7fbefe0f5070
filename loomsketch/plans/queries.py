"""The engine's operators as queries over the given tables.

Texts stand in for genomes: their letters are taken as DNA. Customers and nations, with the parts they bought, stand in for
samples with abundances, suppliers with their parts for references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmer, metrics, names
from ..held import scratch, stored
from ..operators import composite, search, setops, sketch, taxonomy
from ..params import SketchParams, permutation
from ..sources import files, sequences, tables

PARAMS = SketchParams(6, 4, 1, 42)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_counts(spark, d) -> DataFrame:
    return sketch.counts(table(spark, d, "documents"), "doc_id", "text", PARAMS, folded=True)


def item_counts(spark, d) -> DataFrame:
    return sketch.counts(table(spark, d, "benchmark"), "item_id", "text", PARAMS, folded=True)


def sizes(spark, d, name: str, key: str, found: DataFrame) -> DataFrame:
    return sketch.meta(found, table(spark, d, name).select(F.col(key).alias("sketch_id")))


def searched(spark, d, dense: bool = False) -> DataFrame:
    """Benchmark items as queries against documents."""
    q, r = sketch.distinct(item_counts(spark, d)), sketch.distinct(doc_counts(spark, d))
    return search.pairs(search.shared_counts(q, r, (PARAMS, PARAMS)), sizes(spark, d, "benchmark", "item_id", q), sizes(spark, d, "documents", "doc_id", r), dense)


def bought(spark, d) -> DataFrame:
    """(customer, nation, segment, part, quantity)"""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return rows.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_nationkey", "c_mktsegment", "l_partkey", "l_quantity")


def customers(spark, d) -> DataFrame:
    """Abundance sketches: a customer's parts by quantity."""
    g = bought(spark, d).groupBy(F.col("c_custkey").alias("sketch_id"), F.col("l_partkey").alias("code"))
    return g.agg(F.least(F.sum(F.col("l_quantity").cast("long")), F.lit(sketch.MAX_ABUNDANCE)).cast("int").alias("abundance"))


def nations(spark, d) -> DataFrame:
    g = bought(spark, d).groupBy(F.col("c_nationkey").cast("long").alias("sketch_id"), F.col("l_partkey").alias("code"))
    return g.agg(F.least(F.sum(F.col("l_quantity").cast("long")), F.lit(sketch.MAX_ABUNDANCE)).cast("int").alias("abundance"))


def suppliers(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sketch_id"), F.col("l_partkey").alias("code")).distinct()


def pan_parts(spark, d) -> DataFrame:
    """The parts of more than medium size, as a pan sketch."""
    return table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("code"))


def stats(spark, d) -> DataFrame:
    return composite.statistics(nations(spark, d), suppliers(spark, d))


def abv(spark, d) -> DataFrame:
    return composite.vectors(stats(spark, d))


@query
def sketch_codes(spark, d):
    return sketch.distinct(doc_counts(spark, d))


@query
def sketch_sizes(spark, d):
    return sizes(spark, d, "documents", "doc_id", doc_counts(spark, d))


@query
def sketch_total(spark, d):
    return sketch.total(doc_counts(spark, d))


@query
def sketch_offsets(spark, d):
    return sketch.offsets(sizes(spark, d, "benchmark", "item_id", item_counts(spark, d)))


@query
def sketch_uniq(spark, d):
    return sketch.unique(doc_counts(spark, d))


@query
def sketch_min_occ(spark, d):
    return sketch.at_least(doc_counts(spark, d), 2)


@query
def sketch_abundance(spark, d):
    return sketch.abundance(doc_counts(spark, d))


@query
def sketch_low_quality(spark, d):
    """Digits and signs as base qualities: a letter whose upper-case form is below B breaks the run."""
    rows = table(spark, d, "benchmark").select("item_id", kmer.fold(F.col("text")).alias("seq"), F.upper(F.regexp_replace("text", "[^A-Za-z]+", "")).alias("q"))
    return sketch.distinct(sketch.counts(rows, "item_id", "seq", PARAMS, quality="q", min_quality=ord("B")))


@query
def by_record_codes(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("record"), "text")
    return sketch.by_record(rows, "record", "text", PARAMS, folded=True)


@query
def code_components(spark, d):
    part, inside = kmer.component(F.col("code"), 16)
    return sketch.distinct(item_counts(spark, d)).select("sketch_id", "code", part.alias("component"), inside.alias("stored_id"))


@query
def shuffle_permutation(spark, d):
    return permutation(spark, PARAMS)


@query
def postings(spark, d):
    found = sketch.postings(sketch.distinct(doc_counts(spark, d)))
    return found.select("code", "n_sketches", F.array_join("sketch_ids", ",").alias("sketch_ids"))


@query
def shared_counts(spark, d):
    s = sketch.distinct(doc_counts(spark, d))
    return search.with_itself(search.self_counts(s), sketch.meta(s))


@query
def jaccard_mash(spark, d):
    return search.measure(searched(spark, d), PARAMS).select("qry", "ref", "xny", "x_size", "y_size", "metric", F.round("distance", 6).alias("distance"))


@query
def containment_aaf(spark, d):
    return search.measure(searched(spark, d), PARAMS, metrics.CONTAINMENT).select("qry", "ref", "xny", "x_size", "y_size", "metric", F.round("distance", 6).alias("distance"))


@query
def corrected_jaccard(spark, d):
    out = search.report(search.measure(searched(spark, d), PARAMS, correction=True))
    return out.select("qry", "ref", "counts", F.round("rs", 6).alias("rs"), F.round("metric", 6).alias("metric"))


@query
def jaccard_ci(spark, d):
    out = search.confidence(search.measure(searched(spark, d), PARAMS), PARAMS)
    return out.select("qry", "ref", "metric", *[F.round(c, 6).alias(c) for c in ("sd", "metric_low", "metric_high", "distance_low", "distance_high")])


@query
def pvalue(spark, d):
    n = table(spark, d, "documents").count() * table(spark, d, "benchmark").count()
    out = search.significance(search.confidence(search.measure(searched(spark, d), PARAMS), PARAMS), n)
    return out.select("qry", "ref", "metric", F.round("p_value", 12).alias("p_value"), F.round("q_value", 8).alias("q_value"))


@query
def report_lines(spark, d):
    """A report's text with intervals, its names made plain."""
    measured = search.confidence(search.measure(searched(spark, d), PARAMS), PARAMS).withColumns({"p_value": F.lit(None).cast("double"), "q_value": F.lit(None).cast("double")})
    out = search.formatted(measured, fields=2)
    return out.select("Qry", "Ref", F.col("`Shared_k|Ref_s|Qry_s`").alias("counts"), "Jaccard", "MashD", "Jaccard_CI", "MashD_CI")


@query
def dense_pairs(spark, d):
    return search.measure(searched(spark, d, dense=True), PARAMS).select("qry", "ref", "xny", "x_size", "y_size", "metric", F.round("distance", 6).alias("distance"))


@query
def top_n_neighbors(spark, d):
    s = sketch.distinct(doc_counts(spark, d))
    return search.measure(search.nearest(s, 3), PARAMS).select("qry", "rank", "ref", "xny", "metric", F.round("distance", 6).alias("distance"))


@query
def distance_threshold(spark, d):
    s = sketch.distinct(doc_counts(spark, d))
    z = sizes(spark, d, "documents", "doc_id", s)
    shared = search.near_counts(s, metrics.least_jaccard(0.05, PARAMS.length))
    near = search.within(search.measure(search.pairs(search.with_itself(shared, z), z, z), PARAMS), 0.05)
    return near.select("qry", "ref", "xny", F.round("distance", 6).alias("distance"))


@query
def set_union(spark, d):
    return setops.union(customers(spark, d))


@query
def set_uniq_union(spark, d):
    return setops.unique_union(suppliers(spark, d))


@query
def set_intersect(spark, d):
    return setops.intersect(customers(spark, d), pan_parts(spark, d))


@query
def set_subtract(spark, d):
    return setops.subtract(customers(spark, d), pan_parts(spark, d))


@query
def set_combine(spark, d):
    return setops.combine({"bought": setops.union(customers(spark, d)), "supplied": pan_parts(spark, d), "single": setops.unique_union(suppliers(spark, d))})


@query
def combine_batches(spark, d):
    """Customers' sketches, many of them empty, then suppliers'; ids follow the catalogs."""
    catalogs = [table(spark, d, "customer"), table(spark, d, "supplier")]
    return setops.combine_batches([customers(spark, d).select("sketch_id", "code"), suppliers(spark, d)], catalogs)


@query
def set_group(spark, d):
    mapping = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sketch_id"), F.col("s_nationkey").cast("long").alias("category"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("category_name"))
    return setops.group(suppliers(spark, d), mapping)


@query
def set_names(spark, d):
    return setops.names(table(spark, d, "supplier").select(F.col("s_suppkey").alias("sketch_id"), F.col("s_name").alias("name")))


@query
def category_conflicts(spark, d):
    mapping = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("category"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("category_name"))
    return taxonomy.check_categories(mapping)


@query
def decode_kmers(spark, d):
    return kmer.decode(sketch.distinct(doc_counts(spark, d)), PARAMS, permutation(spark, PARAMS)).select("sketch_id", "code", "kmer")


@query
def by_read_kmers(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("record"), "text")
    found = sketch.by_record(rows, "record", "text", PARAMS, folded=True)
    return kmer.by_read(kmer.decode(found, PARAMS, permutation(spark, PARAMS)))


@query
def canonical_kmers(spark, d):
    """All k-mers of 11 bases of the benchmark's items."""
    return kmer.all_canonical(table(spark, d, "benchmark").select(kmer.fold(F.col("text")).alias("seq")), "seq", 11)


@query
def composite_stats(spark, d):
    return stats(spark, d)


@query
def composite_order(spark, d):
    """References of a sample by shared codes."""
    # a sort reads its input twice, first for the ranges
    return stored(stats(spark, d).select("qry", "ref", "n_shared"), "order").orderBy("qry", F.desc("n_shared"), "ref")


@query
def abundance_vectors(spark, d):
    return abv(spark, d).select("sample_id", "ref_id", F.round("pct", 6).alias("pct"))


@query
def vector_norms(spark, d):
    return composite.norms(abv(spark, d)).select("sample_id", F.round("norm", 6).alias("norm"))


def _search(spark, d, how: str) -> DataFrame:
    vectors = stored(abv(spark, d), "vectors")  # read on both sides and for both norms
    found = composite.search(vectors, vectors, how)
    return found.select("qry", "sample_id", (F.round("measure", 6) + F.lit(0.0)).alias("measure"))  # no negative zero


@query
def search_cosine(spark, d):
    return _search(spark, d, "cosine")


@query
def search_l1(spark, d):
    return _search(spark, d, "l1")


@query
def search_l2(spark, d):
    return _search(spark, d, "l2")


@query
def lookup_default(spark, d):
    return taxonomy.lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select(F.col("doc_id").alias("k"), "quality"), "doc_id", "k", "quality")


@query
def lookup_concat(spark, d):
    return taxonomy.lookup_all(table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "customer"), "n_nationkey", "c_nationkey", "c_mktsegment")


@query
def lookup_regex(spark, d):
    """Order priorities by the digit in them, looked up among regions."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return taxonomy.lookup(rows, table(spark, d, "region"), F.expr("try_cast(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS int)"), "r_regionkey", "r_name")


@query
def metadata_join(spark, d):
    hits = _search(spark, d, "cosine").select(F.concat(F.col("sample_id").cast("string"), F.lit(".abv")).alias("name"), "measure")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("run"), F.col("n_regionkey").cast("string").alias("project"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("sample"), F.col("n_name").alias("organism"))
    return taxonomy.with_metadata(hits, n)


@query
def semi_subset(spark, d):
    return taxonomy.subset(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query
def best_support(spark, d):
    return taxonomy.best_support(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query
def all_support(spark, d):
    return taxonomy.best_support(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", every=True)


def _tree(spark, d) -> DataFrame:
    """nation -> region -> root 1, with ids that do not meet."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("node"), (F.col("n_regionkey") + 100).cast("long").alias("parent"), F.lit("species").alias("rank"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("node"), F.lit(1).cast("long").alias("parent"), F.lit("genus").alias("rank"), F.col("r_name").alias("name")))


def _taxa(spark, d) -> DataFrame:
    """Statistics of suppliers by the nation they are in."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), (F.col("s_nationkey") + 1000).cast("long").alias("taxon"))
    return stats(spark, d).join(s, "ref").select(F.col("qry").alias("sample"), "taxon", "n_shared", "trimmed_mean", "median")


@query
def taxon_rollup(spark, d):
    return taxonomy.roll_up(taxonomy.profile_depths(_taxa(spark, d)), _tree(spark, d)).select("sample", "taxon", "rank", F.round("percentage", 6).alias("percentage"))


@query
def lineage_paths(spark, d):
    return taxonomy.lineage_paths(_tree(spark, d))


@query
def krona_profile(spark, d):
    one = _taxa(spark, d).groupBy("sample", "taxon").agg(F.max("n_shared").alias("n_shared"), F.max("trimmed_mean").alias("trimmed_mean"), F.max("median").alias("median"))
    lines = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 1000).cast("long").alias("taxon"), F.concat_ws(";", "r_name", "n_name").alias("lineage"))
    return taxonomy.krona(one, lines).select("sample", "taxon", F.round("percentage", 6).alias("percentage"), "lineage")


@query
def otu_pivot(spark, d):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = bought(spark, d).groupBy(F.col("c_nationkey").alias("lineage"), F.col("c_mktsegment").alias("sample")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return taxonomy.otu_table(rows, segments)


@query
def otu_numbers(spark, d):
    return taxonomy.otu_ids(table(spark, d, "customer").select(F.col("c_mktsegment").alias("lineage"), F.col("c_custkey").alias("position")))


@query
def format_census(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".fa", ".fna.gz", ".fastq", ".fq.gz", ".co")]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("path"))
    return rows.groupBy(names.file_format(F.col("path")).alias("format")).agg(F.count("*").alias("n_files"))


@query
def archive_paths(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("GCA_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".1")).alias("ac"), F.col("p_name"))
    return rows.select("p_partkey", names.archive_path(F.col("ac"), F.col("p_name"), "archive:/all").alias("path"))


@query
def clean_names(spark, d):
    return table(spark, d, "pages").select("page_id", names.clean_name(F.col("url")).alias("name"), names.base_name(F.col("url")).alias("base"))


def _items_as_fasta(spark, d) -> str:
    """A folder with the benchmark's items as compressed FASTA, in lines of 60 bases."""
    path = scratch(spark, "fasta")
    lines = F.regexp_replace(kmer.fold(F.coalesce("text", F.lit(""))), "(.{1,60})", "$1\n")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit(">"), F.col("item_id").cast("string"), F.lit(" item\n"), lines).alias("value"))
    rows.write.mode("overwrite").option("compression", "gzip").text(path)
    return path


@query
def fasta_records(spark, d):
    """Records of compressed FASTA files."""
    found = sequences.fasta(spark, _items_as_fasta(spark, d))
    return found.select(F.split("header", " ")[0].cast("long").alias("item_id"), "header", "seq")


@query
def fasta_sketch(spark, d):
    """Sketches from FASTA files, with N in some places, in place of a table."""
    path = scratch(spark, "fasta")
    seq = F.translate(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "N" + "".join("ACGT"[i % 4] for i in range(1, 26)))
    table(spark, d, "benchmark").select(F.concat(F.lit(">"), F.col("item_id").cast("string"), F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)
    rows = sequences.fasta(spark, path).select(F.col("header").cast("long").alias("item_id"), "seq")
    return sketch.distinct(sketch.counts(rows, "item_id", "seq", PARAMS))


def _turns_as_fastq(spark, d) -> str:
    """A folder with the conversations' turns as FASTQ: letters as bases, and upper-case letters as their qualities."""
    path = scratch(spark, "fastq")
    text = F.coalesce("text", F.lit(""))
    letters = F.regexp_replace(text, "[^A-Za-z]+", "")
    rows = table(spark, d, "conversations").select(F.concat_ws("\n", F.concat_ws(":", F.lit("@"), "conv_id", "turn"), kmer.fold(text), F.lit("+"), F.upper(letters)).alias("value"))
    rows.write.mode("overwrite").text(path)
    return path


@query
def fastq_records(spark, d):
    return sequences.fastq(spark, _turns_as_fastq(spark, d)).select("id", "seq", "quality")


@query
def fastq_abundance(spark, d):
    """Abundances of codes over all FASTQ records, which are one sample."""
    rows = sequences.fastq(spark, _turns_as_fastq(spark, d)).withColumn("sample", F.lit(0).cast("long"))
    return sketch.abundance(sketch.counts(rows, "sample", "seq", PARAMS))


@query
def sketch_files(spark, d):
    """Abundance sketches and their catalog, written in four parts and read again."""
    path = scratch(spark, "sketch")
    made = customers(spark, d)
    catalog = sketch.meta(made, table(spark, d, "customer").select(F.col("c_custkey").alias("sketch_id"))).join(table(spark, d, "customer").select(F.col("c_custkey").alias("sketch_id"), F.col("c_name").alias("name")), "sketch_id")
    tables.write_sketch(spark, made, catalog, PARAMS, path, components=4)
    codes, names_, _ = tables.read_sketch(spark, path)
    return names_.join(codes, "sketch_id", "left").select("sketch_id", "name", "n_codes", "code", "abundance")


@query
def abundance_index(spark, d):
    """The cosine search over an index that was written with its norms and names."""
    path = scratch(spark, "vectors")
    made = abv(spark, d)
    tables.write_abundance_index(made, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("sample_id"), F.col("n_name").alias("name")), path)
    vectors, norms, names_ = tables.read_abundance_index(spark, path)
    found = composite.cosine(vectors, vectors, norms).join(names_, "sample_id")
    return found.select("qry", "name", F.round("measure", 6).alias("measure"))


@query
def shared_count_table(spark, d):
    """Shared counts, kept as a table and measured after reading it again."""
    path = scratch(spark, "shared")
    tables.write_table(searched(spark, d), path)
    return search.measure(tables.read_table(spark, path), PARAMS, metrics.CONTAINMENT).select("qry", "ref", "xny", "metric")


@query
def report_file(spark, d):
    """A report as text, read back as text."""
    path = scratch(spark, "report")
    tables.write_report(search.formatted(search.measure(searched(spark, d), PARAMS)), path)
    return spark.read.csv(path, sep="\t", header=True).select("Qry", "Ref", F.col("`Shared_k|Ref_s|Qry_s`").alias("counts"), "Jaccard", "MashD")


@query
def path_list_formats(spark, d):
    """A list of paths, with blanks before some and empty lines, by format."""
    path = scratch(spark, "list")
    end = F.element_at(F.array(*[F.lit(x) for x in (".fa", ".fna.gz", ".fastq", ".fq.gz", ".co")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    blank = F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise("")
    table(spark, d, "part").select(F.concat(blank, F.lit("/in/"), F.col("p_partkey").cast("string"), end, F.when(F.col("p_partkey") % 2 == 0, "\n").otherwise("")).alias("value")).write.mode("overwrite").text(path)
    return files.path_list(spark, path)


@query
def format_census_list(spark, d):
    """The census over the same kind of list."""
    rows = table(spark, d, "part").select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".fq.bz2").otherwise(".fas")).alias("path"))
    return files.census(files.checked(rows))
