"""Guards, running sums, reports, source pickers, k-mer files and the abundance index."""

import math

import pytest
from pyspark.sql import functions as F

from loomsketch.functions import kmer, metrics
from loomsketch.held import held
from loomsketch.operators import composite, search, setops, sketch, taxonomy
from loomsketch.operators.order import cumulative
from loomsketch.params import SketchParams
from loomsketch.sources import files, tables

A, B = SketchParams(6, 4, 1, 42), SketchParams(6, 4, 1, 43)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (3, 2)], "sketch_id long, code long")


def test_sketches_of_other_parameters_are_refused(codes):
    for f in (setops.intersect, setops.subtract, search.shared_counts):
        f(codes, codes, (A, A))
        with pytest.raises(ValueError):
            f(codes, codes, (A, B))
    pans = {"a": codes, "b": codes}
    with pytest.raises(ValueError):
        setops.combine(pans, (A, B))
    assert rows(setops.combine(pans, (A, B), "skip").select("name").distinct(), "name") == [("a",)]
    with pytest.warns(UserWarning):
        assert setops.combine(pans, (A, B), "warn").count() == 2 * codes.count()


def test_ids_follow_the_catalog_behind_an_empty_last_sketch(spark, codes):
    """The first batch has five sketches; sketches 2 and 4 have no codes."""
    catalog = spark.range(5).select(F.col("id").alias("sketch_id"))
    out = setops.combine_batches([codes, codes, codes], [catalog] * 3)
    assert rows(out.select("sketch_id").distinct(), "sketch_id") == [(i + k,) for k in (0, 5, 10) for i in (0, 1, 3)]


def test_mappings_that_contradict_themselves_are_refused(spark, codes):
    schema = "sketch_id long, category long, category_name string"
    for bad in ([(0, 7, "x"), (1, 7, "y")], [(0, 7, "x"), (0, 8, "z")]):
        with pytest.raises(ValueError):
            setops.group(codes, spark.createDataFrame(bad, schema))
    assert setops.group(codes, spark.createDataFrame([(0, 0, "x"), (1, 0, "y"), (3, 5, None)], schema)).count() == 1


def test_running_sums(spark):
    data = [(i * i * 7 % 1009, i) for i in range(200)] + [(10**12, 5), (-5, 2), (-5, 3)]
    df = spark.createDataFrame(data, "k long, v long").repartition(5)
    want = sorted((k, v, sum(y for x, y in data if x <= k)) for k, v in data)
    for parts in (1, 7, 256):
        assert rows(cumulative(df, "k", "v", "s", parts), "k", "v", "s") == want
    assert cumulative(df.filter("false"), "k", "v", "s").count() == 0
    assert rows(sketch.offsets(spark.createDataFrame([(0, 3), (1, 0), (2, 4)], "sketch_id long, n_codes long")), "sketch_id", "end_offset") == [(0, 3), (1, 3), (2, 7)]
    seen = spark.createDataFrame([("b", 5), ("a", 9), ("b", 2), ("c", 7)], "lineage string, position long")
    assert rows(taxonomy.otu_ids(seen), "lineage", "otu") == [("a", 2), ("b", 0), ("c", 1)]


def test_pairs_of_one_table_are_met_once(codes):
    sizes = sketch.meta(codes)
    assert rows(search.with_itself(search.self_counts(codes), sizes), "qry", "ref", "xny") == rows(search.shared_counts(codes, codes), "qry", "ref", "xny")


def test_upper_tail(spark):
    z = [i / 7 for i in range(0, 200)]
    for x, p in spark.createDataFrame([(x,) for x in z], "z double").select("z", metrics.upper_tail(F.col("z"))).collect():
        assert math.isclose(p, 0.5 * math.erfc(x * math.sqrt(0.5)), rel_tol=2e-7)


def test_report_columns(spark):
    found = spark.createDataFrame([("q", "r", 5, 10, 20), ("q", "s", 0, 10, 20)], "qry string, ref string, xny long, y_size long, x_size long")
    for metric, head in ((metrics.JACCARD, "Jaccard"), (metrics.CONTAINMENT, "ContainmentM")):
        full = search.significance(search.confidence(search.measure(found, A, metric), A, metric), 2)
        out = search.formatted(full, metric, 2)
        assert out.columns[:4] == ["Qry", "Ref", "Shared_k|Ref_s|Qry_s", head] and len(out.columns) == 9
        assert len(search.formatted(full, metric, 0).columns) == 5 and len(search.formatted(full, metric, 1).columns) == 7
    line = {r[1]: r for r in search.formatted(search.significance(search.confidence(search.measure(found, A), A), 2), fields=1).collect()}
    m = 5 / 25
    p = 0.5 * math.erfc(m / math.sqrt(m * (1 - m) / 25) * math.sqrt(0.5))
    assert line["r"][2:5] == ("5-0|20|10", "0.200000", f"{math.log(1 / (2 * m) + 0.5) / 12:.6f}")
    assert math.isclose(float(line["r"][5]), p, rel_tol=1e-6) and line["r"][5][-4] == "E" and math.isclose(float(line["r"][6]), 2 * p, rel_tol=1e-6)
    assert line["s"][5] == ""


def test_sources_are_picked(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.fa", "b.fq.gz", "notes.txt"):
        (folder / name).write_text(">x\nACGT\n")
    (tmp_path / "list").write_text(f"  {folder}/a.fa\n\n{folder}/b.fq.gz\n")
    fmt = lambda df: rows(df, "format")
    assert fmt(files.reference_source(spark, str(folder))) == [("fasta",), ("fastq",)]
    assert fmt(files.reference_source(spark, str(folder / "a.fa"))) == [("fasta",)]
    assert fmt(files.reference_source(spark, str(tmp_path / "list"))) == [("fasta",), ("fastq",)]
    assert fmt(files.query_source(spark, None, [str(folder), str(folder / "a.fa")])) == [("fasta",), ("fasta",), ("fastq",)]
    assert files.query_source(spark, str(tmp_path / "list"), [str(folder)]).count() == 2
    assert files.query_source(spark, None, [str(folder / "notes.txt")], piped=True).count() == 1
    for bad in ([str(folder / "notes.txt")], [str(folder / "missing.fa")], []):
        with pytest.raises(ValueError):
            files.query_source(spark, None, bad)


def test_canonical_kmers(spark):
    texts = ["ACGTNACG", None, "AC", "acgTT" * 30_000]
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    want = {min(t[i : i + 4], t[i : i + 4].translate(turn)[::-1]) for t in texts if t for i in range(len(t) - 3)}
    assert {r[0] for r in kmer.all_canonical(spark.createDataFrame([(t,) for t in texts], "s string"), "s", 4).collect()} == want


def test_kmers_by_read_and_by_name(spark, tmp_path):
    decoded = spark.createDataFrame([("r1", 5, 2, "CCC"), ("r1", 3, 1, "AAA"), ("r2", 1, 1, "GGG")], "sketch_id string, code long, n long, kmer string")
    assert rows(kmer.by_read(decoded), "sketch_id", "text") == [("r1", ">read r1\nAAA\nCCC\nCCC\n"), ("r2", ">read r2\nGGG\n")]
    catalog = spark.createDataFrame([("r1", "/in/one.fa"), ("r2", "two.fa")], "sketch_id string, name string")
    tables.write_kmers(decoded, str(tmp_path / "k"), catalog)
    assert sorted(p.name for p in (tmp_path / "k").glob("name=*")) == ["name=one.fa", "name=two.fa"]


def test_abundance_index_is_read_again(spark, tmp_path):
    abv = spark.createDataFrame([(0, 1, 60.0), (0, 2, 40.0), (1, 2, 100.0)], "sample_id long, ref_id long, pct double")
    names = spark.createDataFrame([(0, "x.abv"), (1, "y.abv")], "sample_id long, name string")
    tables.write_abundance_index(abv, names, str(tmp_path / "i"))
    vectors, norms, back = tables.read_abundance_index(spark, str(tmp_path / "i"))
    assert rows(back, "sample_id", "name") == [(0, "x.abv"), (1, "y.abv")]
    for a, b in zip(rows(composite.cosine(abv, vectors, norms), "qry", "sample_id", "measure"), rows(composite.cosine(abv, abv), "qry", "sample_id", "measure"), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2])


def test_inverted_index_and_report_file(spark, tmp_path, codes):
    tables.write_index(codes, "codes_index", 4)
    assert rows(tables.read_index(spark, "codes_index"), "sketch_id", "code") == rows(codes, "sketch_id", "code")
    tables.write_report(codes, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), sep="\t", header=True).count() == codes.count()


def test_held_survives(codes):
    assert held(codes).count() == codes.count()
