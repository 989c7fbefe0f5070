"""SimHash near-duplicates by covering locality-sensitive hashing (operator 4).

For radius r every bit position gets a non-zero vector of r + 1 bits, and every non-zero vector v of r + 1 bits gives a table
whose mask keeps the positions whose vector has an odd inner product with v. The vectors of r differing positions cannot
span the whole space, so some v is orthogonal to them all: in its table the two fingerprints agree. Every pair within the
radius thus collides in some table; chance plays no part.

Fingerprints that collide with another one in some table are then linked exactly. Two fingerprints are at most 2 bits apart
if and only if some word is at most 1 bit from both, so each offers itself to the 65 words around it, and those who meet at
a word are linked to the smallest there. No list of pairs is made: a word has at most 65 neighbours.

keep_first also takes a Jaccard similarity of word shingles. Candidates are the texts that share a bucket of a covering table of
their fingerprints, which no pair within the radius escapes. At 0.8 about 10 of 64 bits differ, and covering those would take
thousands of tables, so pairs beyond the radius are candidates by bands of min-hashes too. An exact check follows: each bucket's
texts are compared by their sets of shingles, and only those that reach the similarity are linked. A bucket of more than GROUP
texts is split: its parts are linked on their own, each together with the same few pivots of the bucket, and then blocks of
texts that are in different components still are compared with each other. No task holds a whole bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, buffers, chunks, mix, stored, table, texts, word_hashes

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Shingles whose bits are summed at once.
BLOCK = 1 << 14
#: Bands of min-hashes, and min-hashes of a band: of pairs of similarity 0.8, about 3 in a million share no band.
BANDS, BAND = 32, 5
#: Texts of a bucket that one task compares, and pivots that the parts of a larger bucket have in common.
GROUP, PIVOTS = 2000, 16
_HALVES, _HALF = np.uint64(0x0000000100000001), np.uint64(0xFFFFFFFF)
_FACTORS = np.random.default_rng(20250118).integers(1, 1 << 63, (BANDS, BAND), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the whole text's word shingles, repeats included; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    if n == 1:
        return int.from_bytes(digest(line, seed), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    total = np.zeros(64, np.int64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        bits = b"".join([digest(line[s:e], seed) for s, e in zip(starts[a:b], ends[a + shingle - 1 : b + shingle - 1], strict=True)])
        total += np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text, which tells apart rows of one doc_id) and fp, signed."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(batch.column(2))], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of the covering tables, as signed 64-bit numbers."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    out = []
    for v in range(1, size):
        m = sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def company(prints: DataFrame) -> DataFrame:
    """Of distinct fingerprints `fp`, those that share a bucket of some covering table with another."""
    keys = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks())])
    rows = prints.select("fp", F.inline(keys))
    shared = rows.groupBy("t", "k").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("t", "k")
    return rows.join(shared, ["t", "k"], "left_semi").select("fp").distinct()


def links(candidates: DataFrame) -> DataFrame:
    """(u, v): each fingerprint u and the smallest v < u that meets it at a word at most one bit from both."""

    def around(c: Column) -> Column:
        return F.concat(F.array(c), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))

    rows = candidates.select("fp", F.explode(around(F.col("fp"))).alias("w"))
    met = rows.groupBy("w").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # at most 65 fingerprints
    pairs = met.select(F.array_min("all").alias("v"), F.explode("all").alias("u"))
    return pairs.filter("u > v").select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternates large-star and small-star steps: stars shrink to one a component in a number of rounds that grows as the
    square of the logarithm of the size. Each round is a table in the shared folder, and only its checksum comes to the driver.
    """
    edges, before = stored(edges.select("u", "v"), "edges"), None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th, fp, root (which names the component) and component_id of every row."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = stored(components(links(company(prints.select("fp")))), "roots")
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(least, "root").select("fp", "root", "component_id"), "fp")


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` lower-cased words, and where each text's begin; a shorter text is one run."""
    w = Words(buf, offsets)
    h = word_hashes(w, lower=True)
    count = np.maximum(w.count - size + 1, 1)
    begin = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(begin[-1]) - begin[:-1][text] + w.first[:-1][text]
    last = w.first[1:][text]
    out = np.zeros(begin[-1], np.uint64)
    for k in range(size):
        inside = at + k < last
        out[inside] = mix(out[inside] + h[at[inside] + k])
    return out, begin


def simhashes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes of its shingles, repeats included: a bit is 1 if set in over half of them."""
    n, out = np.diff(begin).astype(np.uint64), np.zeros(len(begin) - 1, np.uint64)
    for i in np.arange(32, dtype=np.uint64):  # bits i and i + 32 are counted in the two halves of a number
        ones = np.add.reduceat(h >> i & _HALVES, begin[:-1])
        for bit, count in ((i, ones & _HALF), (i + np.uint64(32), ones >> np.uint64(32))):
            out |= (count * np.uint64(2) > n).astype(np.uint64) << bit
    return out


def covering_keys(fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A key for each fingerprint and covering table; two fingerprints within the radius share one."""
    kept = np.array(masks(radius), np.int64).view(np.uint64)
    return mix(mix(fp[:, None] & kept) + np.arange(BANDS, BANDS + len(kept), dtype=np.uint64))


def band_keys(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A key for each text and band."""
    keys = np.empty((len(begin) - 1, BANDS), np.uint64)
    for b, factors in enumerate(_FACTORS):
        key = np.full(len(begin) - 1, b, np.uint64)
        for f in factors:
            key = mix(key + np.minimum.reduceat(h * f, begin[:-1]))
        keys[:, b] = key
    return keys


def linked(sets: list[np.ndarray], similarity: float, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all sets of at least that Jaccard similarity, directly or through others. Sets of equal labels, where
    there are any, are joined already.

    Each set in turn is compared with later ones. Left out are those in its component already, those too long or short, and
    those that the triangle inequality of the Jaccard distance tells apart by an earlier set; no pair that counts is lost.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    begin = np.append(0, np.cumsum(size))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    label, far, out = np.arange(n) if labels is None else np.unique(np.array(labels), return_inverse=True)[1], [], []
    for p in range(n - 1):
        c = label != label[p]
        if not c.any():
            break
        c[: p + 1] = False
        c &= np.minimum(size, size[p]) >= similarity * np.maximum(size, size[p]) - 1e-9
        for d in far:
            c &= ~(np.abs(d - d[p]) > 1 - similarity + 1e-9)
        at = np.flatnonzero(c)
        if not len(at):
            continue
        mark = np.zeros(len(values), np.int32)
        mark[place[begin[p] : begin[p + 1]]] = 1
        if len(at) * 4 > n:
            both = np.add.reduceat(mark[place], begin[:-1])[at]
        else:
            both = np.array([mark[place[begin[i] : begin[i + 1]]].sum() for i in at])
        j = both / (size[at] + size[p] - both)
        d = np.full(n, np.nan)
        d[at], d[p] = 1 - j, 0
        far = [*far[-7:], d]
        names, first = np.unique(label[at[j >= similarity - 1e-12]], return_index=True)
        out += [(p, int(i)) for i in at[j >= similarity - 1e-12][first]]
        label[np.isin(label, names)] = label[p]
    return out


def compared(grouped: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links within each group of (g, th, label, text), a group by one task; rows of equal labels are linked already."""

    def run(batches):
        group, names, sets, labels, edges = None, [], [], [], []
        for batch in batches:
            groups, ths, marks = (batch.column(i).to_pylist() for i in range(3))
            buf, off = buffers(batch.column(3))
            for a, b in chunks(off):
                h, begin = shingles(buf, off[a : b + 1], shingle)
                for i in range(a, b):
                    if groups[i] != group:
                        if names:
                            edges += [(names[x], names[y]) for x, y in linked(sets, similarity, labels)]
                        group, names, sets, labels = groups[i], [], [], []
                    names.append(ths[i])
                    labels.append(marks[i])
                    sets.append(np.unique(h[begin[i - a] : begin[i - a + 1]]))
            yield sent(edges)
            edges = []
        if names:
            yield sent([(names[x], names[y]) for x, y in linked(sets, similarity, labels)])

    def sent(edges):
        u, v = [max(e) for e in edges], [min(e) for e in edges]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows = grouped.select("g", "th", "label", "text").repartition("g").sortWithinPartitions("g", "th")
    return rows.mapInArrow(run, "u long, v long").distinct()


def _spread(n: Column, group: int) -> Column:
    """How many parts of about `group` rows n rows make."""
    return F.ceil(n / group).cast("long")


def _each_of(n: Column) -> Column:
    """A row for each number below n."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def parts(members: DataFrame, group: int = GROUP) -> DataFrame:
    """(g, th): the buckets (bucket, n, th) in parts of some `group` texts; those of one bucket share its pivots."""
    count = _spread(F.col("n"), group)
    own = members.select("bucket", F.pmod(F.xxhash64("th", F.lit(1)), count).alias("part"), "th")
    pivots = members.filter(F.col("n") > group).groupBy("bucket", "n", F.pmod(F.xxhash64("th", F.lit(2)), F.lit(PIVOTS))).agg(F.min("th").alias("th"))
    shared = pivots.select("bucket", _each_of(count).alias("part"), "th")
    return own.unionAll(shared).select(F.xxhash64("bucket", "part").alias("g"), "th").distinct()


def blocks(labelled: DataFrame, group: int = GROUP) -> DataFrame:
    """(g, th, label): of split buckets (bucket, th, label), the pairs of blocks that hold texts of different labels.

    A label of more than `group` texts makes a unit of its own, cut into blocks; the others of a bucket make one together, in
    which a label stays in one block. Units are paired, and of those pairs the blocks, but never a large label with itself.
    """
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    large = F.col("n") > group
    unit = F.when(large, F.struct(F.lit(True).alias("large"), F.col("label").alias("label"))).otherwise(F.struct(F.lit(False).alias("large"), F.lit(0).cast("long").alias("label")))
    sizes = stored(sizes.withColumn("unit", unit), "sizes")
    units = sizes.groupBy("bucket", "unit").agg(_spread(F.sum("n"), group).alias("k"))
    a, b = (units.select("bucket", F.col("unit").alias(f"unit_{x}"), F.col("k").alias(f"k_{x}")) for x in "ab")
    pairs = a.join(b, "bucket").filter((F.col("unit_a") < F.col("unit_b")) | ((F.col("unit_a") == F.col("unit_b")) & ~F.col("unit_a.large")))
    pairs = pairs.withColumn("i_a", _each_of(F.col("k_a"))).withColumn("i_b", _each_of(F.col("k_b"))).filter((F.col("unit_a") < F.col("unit_b")) | (F.col("i_a") <= F.col("i_b")))
    sides = F.array_distinct(F.array(*[F.struct(F.col(f"unit_{x}").alias("unit"), F.col(f"i_{x}").alias("i")) for x in "ab"]))
    wanted = pairs.select("bucket", F.xxhash64("bucket", "unit_a", "i_a", "unit_b", "i_b").alias("g"), F.inline(sides))
    rows = labelled.join(sizes.select("bucket", "label", "unit"), ["bucket", "label"]).join(units, ["bucket", "unit"])
    rows = rows.withColumn("i", F.pmod(F.when(F.col("unit.large"), F.xxhash64("th", F.lit(3))).otherwise(F.xxhash64("label", F.lit(3))), F.col("k")))
    return rows.join(wanted, ["bucket", "unit", "i"]).select("g", "th", "label").distinct()


def similar(docs: DataFrame, shingle: int, similarity: float, group: int = GROUP) -> DataFrame:
    """doc_id, th and root of every row; rows of one root are linked by sets of shingles of at least that similarity.

    A text is taken once however often it occurs. Buckets with the same texts in several tables or bands are compared once; a task
    holds the sets of some `group` of a bucket's different texts, or of two blocks of that size.
    """
    text = F.col("text").cast("string")
    all_texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))

    def keyed(batches):
        for batch in batches:
            buf, off = buffers(batch.column(1))
            for a, b in chunks(off):
                h, begin = shingles(buf, off[a : b + 1], shingle)
                keys = np.hstack([covering_keys(simhashes(h, begin)), band_keys(h, begin)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["th", "keys"])

    keys = stored(all_texts.mapInArrow(keyed, "th long, keys array<long>").dropDuplicates(["th"]), "keys")
    rows = keys.select("th", F.explode("keys").alias("k"))
    shared = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("th").alias("a"), F.max("th").alias("b"), F.bit_xor(F.xxhash64("th")).alias("x")).filter("n > 1")
    members = stored(rows.join(shared.select("k", "n", F.xxhash64("n", "a", "b", "x").alias("bucket")), "k").select("bucket", "n", "th").distinct(), "buckets")
    # copies go before the shuffle, so that a text which a third of all rows have makes no hot key
    once = all_texts.dropDuplicates(["th"])
    with_text = lambda rows: rows.join(once.join(rows.select("th").distinct(), "th", "left_semi"), "th")
    most = members.agg(F.max("n")).first()[0] or 0
    first = members.select(F.col("bucket").alias("g"), "th") if most <= group else stored(parts(members, group), "parts")
    edges = compared(with_text(first.withColumn("label", F.col("th"))), shingle, similarity)
    if most > group:
        edges = stored(edges, "links")
        roots = stored(components(edges), "roots")
        labelled = members.filter(F.col("n") > group).join(roots.withColumnRenamed("node", "th"), "th", "left").select("bucket", "th", F.coalesce("root", "th").alias("label"))
        open_still = labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("bucket")
        across = stored(blocks(stored(labelled.join(open_still, "bucket", "left_semi"), "labelled"), group), "blocks")
        edges = edges.unionAll(compared(with_text(across), shingle, similarity))
    roots = stored(components(edges), "roots")
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"))
    return names.join(roots.withColumnRenamed("node", "th"), "th", "left").select("doc_id", "th", F.coalesce("root", "th").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links, for every row.

    Null or empty text, or white space alone, has fingerprint zero and is linked like any other. A row with a null doc_id
    is linked too, but gives no component_id; where no row of a component has a doc_id, component_id is null. Repeated rows
    each give a row; other columns are ignored; an empty table gives no rows. No text is shuffled.
    """
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One document of each component, with the columns of docs: the one with the smallest doc_id.

    Documents are linked where their fingerprints are at most RADIUS bits apart or, with a similarity, where they share a covering
    table's bucket or a band and the Jaccard similarity of their sets of shingles reaches it.
    Rows of one doc_id and different texts are different documents; a row that is repeated as a whole stays once.
    """
    rows = classes(docs, shingle) if similarity is None else similar(docs, shingle, similarity)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("f"))
    first = first.select(F.coalesce("f.doc_id", F.lit(-1)).alias("__id"), F.col("f.n").alias("__null"), F.col("f.th").alias("__th"))
    names = docs.columns
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__null": F.col("doc_id").isNull(), "__th": F.xxhash64(F.col("text").cast("string"))})
    keys = ["__id", "__null", "__th"]
    kept = keyed.join(first, keys, "left_semi")
    once = Window.partitionBy(*keys).orderBy(F.lit(1))
    return kept.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select(*names)


def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
