"""The engine's operators on small sequences, worked out by hand or by a plain model."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from loomsketch.functions import kmer, metrics, names
from loomsketch.operators import composite, search, setops, sketch, taxonomy
from loomsketch.params import SketchParams, default_params, kept_ranks, largest_prime_below, load_params, next_prime, permutation, save_params
from loomsketch.sources import files, sequences, tables
from loomsketch.streaming.abundance import running_abundance

P = SketchParams(6, 4, 1, 42)
SWAP = str.maketrans("ACGT", "TGCA")


def dna(n, seed=1):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def model(seq, params=P):
    """Codes with repeats, from strings."""
    rank = kept_ranks(params)
    out = []
    for p in range(len(seq) - params.length + 1):
        f = seq[p : p + params.length].upper()
        if set(f) <= set("ACGT"):
            c = min(f, f[::-1].translate(SWAP))
            h = params.outer
            value = lambda x: int("0" + x.translate(str.maketrans("ACGT", "0123")), 4)
            r = int(rank[value(c[h : len(c) - h])])
            if r >= 0:
                out.append((value(c[:h] + (c[-h:] if h else "")) << params.rank_bits) + r)
    return out


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def counted(seqs):
    return sorted((i, c, model(s).count(c)) for i, s in enumerate(seqs) for c in set(model(s)))


def test_codes_equal_the_model(spark):
    seqs = [dna(3000), dna(2000, 2).lower(), dna(100) + "N" + dna(100, 3), "ACGT", "", dna(11), dna(3000)[:1500] + "\n" + dna(3000)[1500:]]
    got = rows(sketch.counts(frame(spark, seqs), "id", "seq", P), "sketch_id", "code", "n")
    assert got == counted([s.replace("\n", "") for s in seqs])


def test_large_permutations_are_joined(spark):
    wide = SketchParams(8, 6, 3, 7)
    native = rows(sketch._native(frame(spark, [dna(500)]).withColumnsRenamed({"id": "sketch_id"}), P, False, False, False, 0), "sketch_id", "code", "n")
    assert native == counted([dna(500)])
    with pytest.raises(ValueError):
        kept_ranks(wide)


def test_strand_does_not_matter(spark):
    s = dna(2000, 5)
    got = rows(sketch.distinct(sketch.counts(frame(spark, [s, s[::-1].translate(SWAP)]), "id", "seq", P)), "sketch_id", "code")
    assert {c for i, c in got if i == 0} == {c for i, c in got if i == 1}


def test_decode_gives_canonical_kmers(spark):
    s = dna(1500, 6)
    found = sketch.distinct(sketch.counts(frame(spark, [s]), "id", "seq", P))
    out = kmer.decode(found, P, permutation(spark, P)).collect()
    every = {min(f, f[::-1].translate(SWAP)) for f in (s[i : i + 12] for i in range(len(s) - 11))}
    assert out and {r["kmer"] for r in out} <= every
    assert all(model(r["kmer"]) == [r["code"]] for r in out)


def test_quality_breaks_runs_and_zero_can_be_dropped(spark):
    s = dna(400, 8)
    df = spark.createDataFrame([(0, s, "I" * 200 + "!" + "I" * 199)], "id long, seq string, q string")
    got = rows(sketch.counts(df, "id", "seq", P, quality="q", min_quality=20, phred_offset=33), "code")
    assert got == sorted((c,) for c in set(model(s[:200] + "N" + s[201:])))
    dropped = sketch.counts(frame(spark, [s]), "id", "seq", P, drop_zero=True)
    assert dropped.filter("code = 0").count() == 0


def test_permutation_is_whole_and_seeded(spark, tmp_path):
    small = SketchParams(4, 3, 0, 9)
    ranks = rows(permutation(spark, small), "rk")
    assert ranks == [(i,) for i in range(small.space)]
    assert rows(permutation(spark, small), "inner", "rk") != rows(permutation(spark, SketchParams(4, 3, 0, 10)), "inner", "rk")
    save_params(spark, small, f"{tmp_path}/shuf")
    again, dim = load_params(spark, f"{tmp_path}/shuf")
    assert again == small and dim.count() == small.space


def test_parameters():
    assert default_params(3, 8).s == 6
    for wrong in ((16, 5, 2), (8, 8, 2), (5, 6, 2), (8, 5, 6)):
        with pytest.raises(ValueError):
            SketchParams(*wrong)
    with pytest.warns(UserWarning):
        assert not SketchParams(8, 5, 3).reversible
    assert largest_prime_below(8) == 251 and next_prime(90) == 97


def test_set_operations(spark):
    s = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 2, 7), (1, 3, 8), (2, 4, 9)], "sketch_id long, code long, abundance int")
    pan = spark.createDataFrame([(2,), (4,)], "code long")
    assert rows(setops.union(s), "code") == [(1,), (2,), (3,), (4,)]
    assert rows(setops.unique_union(s), "code") == [(1,), (3,), (4,)]
    inside, outside = setops.intersect(s, pan), setops.subtract(s, pan)
    assert rows(inside, "sketch_id", "code", "abundance") == [(0, 2, 6), (1, 2, 7), (2, 4, 9)]
    assert rows(inside.unionByName(outside), *s.columns) == rows(s, *s.columns)
    mapping = spark.createDataFrame([(0, 7, "x"), (1, 7, "x"), (2, 0, None)], "sketch_id long, category long, category_name string")
    assert rows(setops.group(s, mapping), "category", "name", "code") == [(7, "7_x", 1), (7, "7_x", 2), (7, "7_x", 3)]
    catalog = spark.createDataFrame([(i, str(i)) for i in range(4)], "sketch_id long, name string")
    assert rows(setops.combine_batches([s, s], [catalog, catalog]), "sketch_id", "code")[-1][1] == 4
    assert not setops.check_compatible(P, SketchParams(6, 4, 1, 43), "skip")
    with pytest.raises(ValueError):
        setops.check_compatible(P, SketchParams(6, 4, 1, 43))


def test_metrics_of_edges(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 5, 5), (5, 5, 5), (2, 4, 8)], "xny long, x_size long, y_size long")
    out = search.significance(search.confidence(search.measure(df, P), P), 10).collect()
    assert [r["metric"] for r in out] == [None, 0.0, 1.0, 0.2]
    assert out[1]["distance"] == 1.0 and out[2]["distance"] == 0.0 and out[2]["p_value"] == 0.0
    assert 0 < out[3]["p_value"] < 0.5 and abs(out[3]["q_value"] - 10 * out[3]["p_value"]) < 1e-12
    aaf = search.measure(df, P, metrics.CONTAINMENT, correction=True).collect()
    assert aaf[2]["rs"] == 0.0 and aaf[2]["metric"] == 1.0


def test_top_n_takes_the_lower_reference_at_ties(spark):
    df = spark.createDataFrame([(0, r, 2, 4, 4) for r in (3, 1, 2)] + [(0, 9, 0, 4, 4)], "qry long, ref long, xny long, x_size long, y_size long")
    assert rows(search.top_n(df, 2), "rank", "ref") == [(1, 1), (2, 2)]
    assert search.top_n(df, 9).count() == 3


@pytest.mark.parametrize("n", [6, 50, 100, 333])
def test_composite_statistics_equal_an_index_loop(spark, n):
    values = sorted(random.Random(n).choices(range(1, 200), k=n))
    q = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "sketch_id long, code long, abundance int")
    r = spark.createDataFrame([(1, i) for i in range(n)] + [(2, i) for i in range(5)], "sketch_id long, code long")
    (row,) = composite.statistics(q, r).collect()
    taken = [values[i - 1] for i in range(int(n * 0.98), n + 1) if 1 <= i <= n * 0.99]
    assert row["n_shared"] == n and row["median"] == values[n // 2 - 1] and row["peak"] == values[-1]
    assert row["trimmed_mean"] == (sum(taken) / len(taken) if taken else None)


def test_vector_search(spark):
    v = spark.createDataFrame([(0, 1, 60.0), (0, 2, 40.0), (1, 1, 60.0), (1, 2, 40.0), (2, 2, 100.0), (3, 9, 100.0)], "sample_id long, ref_id long, pct double")
    q = v.filter("sample_id = 0")
    assert [(r["sample_id"], round(r["measure"], 6)) for r in composite.search(q, v, "cosine").collect()] == [(0, 1.0), (1, 1.0), (2, 0.5547)]
    assert [(r["sample_id"], r["measure"]) for r in composite.search(q, v, "l1").collect()] == [(0, 0.0), (1, 0.0), (2, 120.0)]
    assert [(r["sample_id"], r["measure"]) for r in composite.search(q, v, "l2").collect()] == [(0, 0.0), (1, 0.0), (2, 60.0)]


def test_ancestors_of_a_deep_tree(spark):
    nodes = spark.createDataFrame([(i, i - 1, f"r{i}", f"n{i}") for i in range(2, 14)], "node long, parent long, rank string, name string")
    up = rows(taxonomy.ancestors(nodes, most=16), "node", "ancestor", "steps")
    assert up == sorted((i, j, i - j) for i in range(2, 14) for j in range(2, i + 1))
    assert {r["node"]: r["path"] for r in taxonomy.lineage_paths(nodes, most=16).collect()}[5] == "2|3|4|5"


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nACGA\n>two\r\nTTTT\r\n>three\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">z\nAC\nGT")
    (tmp_path / "c.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGGGG\n+\n!!!!")
    (tmp_path / "d.txt").write_text("no sequence")
    assert rows(sequences.fasta(spark, f"{tmp_path}/a.fa"), "header", "seq") == [("one first", "ACGTACGA"), ("three", ""), ("two", "TTTT")]
    assert rows(sequences.fasta(spark, f"{tmp_path}/b.fasta.gz"), "header", "seq") == [("z", "ACGT")]
    assert rows(sequences.fastq(spark, f"{tmp_path}/c.fq"), "record", "id", "seq", "quality") == [(0, "@r1", "ACGT", "IIII"), (1, "@r2", "GGGG", "!!!!")]
    assert rows(files.census(files.directory(spark, str(tmp_path))), "format", "n_files") == [("fasta", 2), ("fastq", 1)]
    with pytest.raises(PermissionError):
        sequences.piped(spark, ["x"], "cat")


def test_fastq_in_many_splits(spark, tmp_path):
    """Files of many splits, some of them smaller than a record, of few lines, empty, compressed and cut off."""
    whole = [(f"@r{i}", dna(1 + i * 37 % 150, i), "I" * (1 + i * 37 % 150)) for i in range(300)]
    text = "".join(f"{a}\n{s}\n+{a}\n{q}\n" for a, s, q in whole)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_bytes(text.replace("\n", "\r\n").encode() + b"@cut\r\nAC\r\n+\r\n")
    (tmp_path / "c.fq").write_text("")
    (tmp_path / "d.fq").write_text("@one\n\n+\n")
    (tmp_path / "e.fq").write_text("@one\n\n+\n\n")
    with gzip.open(tmp_path / "f.fq.gz", "wt") as f:
        f.write(text[:-1])
    want = [(i, *r) for i, r in enumerate(whole)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("100", "4000", before[0]):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found = sequences.fastq(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])
        by = {k: sorted(tuple(r)[1:] for r in found if r["path"].endswith(k)) for k in ("a.fq", "b.fq", "c.fq", "d.fq", "e.fq", "f.fq.gz")}
        assert by == {"a.fq": want, "b.fq": [(i, a, s, q) for i, a, s, q in want], "c.fq": [], "d.fq": [], "e.fq": [(0, "@one", "", "")], "f.fq.gz": want}


@pytest.mark.parametrize("least", [0.0, 0.05, 0.3, 0.5, 0.9, 1.0])
def test_near_counts_lose_no_pair(spark, least):
    """Against all pairs, with sketches of one code, copies, subsets and a code that all share."""
    r = random.Random(7)
    sets = [{0, *r.sample(range(1, 60), r.randint(1, 30))} for _ in range(40)]
    sets += [set(sets[0]), set(sets[0]), set(list(sets[1])[:-1]), {0}, {0}, set(range(60)), {77}]
    df = spark.createDataFrame([(i, c) for i, x in enumerate(sets) for c in x], "sketch_id long, code long")
    want = {(i, j): len(x & y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and x & y and len(x & y) / len(x | y) >= least}
    found = {(a, b): n for a, b, n in search.near_counts(df, least).collect()}
    assert {k: found.get(k) for k in want} == want
    assert all(n == len(sets[a] & sets[b]) for (a, b), n in found.items())


def test_tables_are_read_again(spark, tmp_path):
    found = sketch.distinct(sketch.counts(frame(spark, [dna(800)]), "id", "seq", P))
    catalog = spark.createDataFrame([(0, "one", found.count())], "sketch_id long, name string, n_codes long")
    tables.write_sketch(spark, found, catalog, P, f"{tmp_path}/s", components=4)
    codes, names_, params = tables.read_sketch(spark, f"{tmp_path}/s")
    assert params == P and rows(codes, "sketch_id", "code") == rows(found, "sketch_id", "code") and names_.count() == 1
    assert tables.exists(spark, f"{tmp_path}/s/catalog") and not tables.exists(spark, f"{tmp_path}/none")
    (tmp_path / "tax").write_text("7\tx\n0\n8")
    assert [tuple(r) for r in tables.category_table(spark, f"{tmp_path}/tax").orderBy("sketch_id").collect()] == [(0, 7, "x"), (1, 0, None), (2, 8, None)]
    bad = files.checked(spark.createDataFrame([("x.bam",)], "path string"))
    with pytest.raises(Exception, match="format not known"):
        bad.collect()


def test_formats_by_suffix(spark):
    df = spark.createDataFrame([("/a/x.fna.gz",), ("y.fq.bz2",), ("z.co",), ("w.txt",)], "p string")
    assert [r[0] for r in df.select(names.file_format(F.col("p"))).collect()] == ["fasta", "fastq", "co", None]


def test_streamed_abundance_equals_the_batch(spark, tmp_path):
    reads = frame(spark, [dna(300, i % 3) for i in range(9)]).select(F.lit(1).cast("long").alias("id"), "seq")
    reads.repartition(3).write.parquet(f"{tmp_path}/reads")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/reads")
    q = running_abundance(stream, "id", "seq", P).writeStream.outputMode("complete").format("memory").queryName("abundance_stream").start()
    q.processAllAvailable()
    q.stop()
    want = sketch.abundance(sketch.counts(reads, "id", "seq", P))
    assert rows(spark.table("abundance_stream"), "code", "abundance") == rows(want, "code", "abundance")


def test_ancestors_without_a_bound(spark):
    """A line of 100 nodes below the root, and a circle."""
    rows = [(i, i - 1, "r", f"n{i}") for i in range(2, 102)]
    nodes = spark.createDataFrame(rows, "node long, parent long, rank string, name string")
    paths = {r["node"]: r["path"] for r in taxonomy.lineage_paths(nodes).collect()}
    assert all(paths[i] == "|".join(map(str, range(2, i + 1))) for i in range(2, 102))
    profile = spark.createDataFrame([(0, 101, 60.0), (0, 50, 40.0)], "sample int, taxon long, percentage double")
    shares = {r["taxon"]: r["percentage"] for r in taxonomy.roll_up(profile, nodes).collect()}
    assert shares == {i: 100.0 if i <= 50 else 60.0 for i in range(2, 102)}
    with pytest.raises(ValueError):
        taxonomy.ancestors(spark.createDataFrame([(2, 3), (3, 2)], "node long, parent long"))
