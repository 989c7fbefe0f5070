import hashlib
from collections import defaultdict

import pytest
import xxhash

from loomsketch.llm import simhash, substring

from .conftest import lowered, rows_of, same, words


def brute_removed(given, window=50):
    first = defaultdict(list)
    for i, t, _ in given:
        w = words(t)
        for p in range(len(w) - window + 1) if i is not None else ():
            first[tuple(w[p : p + window])].append(i)
    least = {k: min(v) for k, v in first.items()}
    for i, t, _ in given:
        w = words(t)
        cut = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[p : p + window])] < i:
                cut.update(range(p, p + window))
        kept = [x for p, x in enumerate(w) if p not in cut]
        yield i, len(w), len(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_removed_equals_brute_force(docs, given):
    same(rows_of(substring.removed(docs), "doc_id", "n_words", "n_removed", "kept_sha256"), brute_removed(given))


def test_passages_of_every_place_and_length(spark):
    base = [f"p{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        rows.append((i, " ".join([f"a{i}.{j}" for j in range(i)] + base[i % 11 : i % 11 + 40 + i % 20] + [f"b{i}.{j}" for j in range(7)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(rows_of(substring.removed(docs), "doc_id", "n_words", "n_removed", "kept_sha256"), brute_removed([(*r, None) for r in rows]))


def test_removed_of_nothing(empty, all_null):
    assert substring.removed(empty).count() == 0
    assert {tuple(r) for r in substring.removed(all_null).collect()} == {(None, 0, 0, hashlib.sha256(b"").hexdigest())}


def test_cut_repeats_keeps_columns_and_texts(docs, given):
    out = substring.cut_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(given)
    lost = {(i, n): k for i, n, k, _ in brute_removed(given)}
    for i, t in rows_of(out, "doc_id", "text"):
        before = [x for x in given if x[0] == i]
        if not any(k for (j, _), k in lost.items() if j == i):
            assert t in [x[1] for x in before]


def brute_fingerprint(text):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if total[b] * 2 > len(shingles))


def brute_components(prints):
    prints = list(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates_equal_brute_force(docs, given):
    fp = [(i, brute_fingerprint(t)) for i, t, _ in given]
    root = brute_components({p for _, p in fp})
    least = defaultdict(list)
    for i, p in fp:
        if i is not None:
            least[root[p]].append(i)
    same(rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id"), [(i, f"{p:016x}", min(least[root[p]], default=None)) for i, p in fp])


def test_covering_masks_lose_no_pair():
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_chains_of_fingerprints(spark):
    """A chain of 300 steps is one component, whatever the order; a cluster of a thousand and lone ones besides."""
    import random

    rng = random.Random(5)
    chain = [rng.getrandbits(64)]
    while len(chain) < 300:
        a, b = rng.sample(range(64), 2)
        x = chain[-1] ^ 1 << a ^ 1 << b
        if x not in chain:
            chain.append(x)
    hub = rng.getrandbits(64)
    cluster = {hub} | {hub ^ 1 << a ^ 1 << b for a in range(30) for b in range(30)}
    prints = list({*chain, *cluster, *(rng.getrandbits(64) for _ in range(200))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(simhash.company(df))).collect()}
    want = brute_components(prints)
    groups = lambda pairs: {frozenset(v) for v in pairs.values() if len(v) > 1}
    a, b = defaultdict(list), defaultdict(list)
    for p in prints:
        a[found.get(signed(p), signed(p))].append(p)
        b[want[p]].append(p)
    assert groups(a) == groups(b)


def test_keep_first(docs, given):
    kept = rows_of(simhash.keep_first(docs), "doc_id", "text")
    prints = {brute_fingerprint(t) for _, t, _ in given}
    root = brute_components(prints)
    assert len(kept) == len(set(root.values()))
    assert len({root[brute_fingerprint(t)] for _, t in kept}) == len(kept)


@pytest.mark.parametrize("f", [simhash.near_duplicates, simhash.keep_first])
def test_nothing(f, empty, all_null):
    assert f(empty).count() == 0
    assert f(all_null).count() in (1, 3)


def five_words(text):
    w = words(lowered(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def test_stage_keeps_one_of_near_copies(spark):
    """Copies with some words changed, of similarities on both sides of 0.8; the radius of 2 bits leaves most of them."""
    import random

    import corpus_pipeline

    rng, rows = random.Random(3), []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 150, 400]))]
        for edits in (0, 0, 1, 2, 4, 6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [five_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {find(i) for i in range(len(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(kept) == sorted(want)
    assert simhash.keep_first(df).count() > len(want)


def test_simhashes_equal_plain_counts():
    """Also with even splits, one shingle, and more shingles than a short counter holds."""
    import numpy as np

    rng = np.random.default_rng(6)
    size = [1, 2, 3, 64, 1000, 70_000]
    h, begin = rng.integers(0, 2**64, sum(size), np.uint64), np.append(0, np.cumsum(size))
    for a, b, fp in zip(begin[:3], begin[1:4], simhash.simhashes(h, begin)[:3], strict=True):
        assert int(fp) == sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in h[a:b]) > b - a)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    want = [np.packbits(2 * bits[a:b].sum(0, dtype=int) > b - a, bitorder="little").view(np.uint64)[0] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert simhash.simhashes(h, begin).tolist() == want


def test_covering_keys_meet_within_the_radius():
    import numpy as np

    fp = np.random.default_rng(7).integers(0, 2**64, 1, np.uint64)
    near = np.array([int(fp[0]) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)], np.uint64)
    keys = simhash.covering_keys(near)
    assert keys.shape == (64 * 64, 7) and (keys == simhash.covering_keys(fp)).any(1).all()
    far = simhash.covering_keys(np.random.default_rng(8).integers(0, 2**64, 1000, np.uint64))
    assert len(np.unique(far)) == far.size


def test_near_dedup_goes_through_covering_tables(spark, monkeypatch):
    """Without a band in common, near copies of at most two different fingerprint bits are still found by the covering tables, and
    texts below the similarity are not linked."""
    import random

    import numpy as np

    import corpus_pipeline

    monkeypatch.setattr(simhash, "band_keys", lambda h, begin: np.random.default_rng().integers(0, 2**64, (len(begin) - 1, 32), np.uint64))
    rng, rows = random.Random(9), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(500)]
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(base[: 250 + g])))
    column = simhash.pa.array([t for _, t in rows])
    h, begin = simhash.shingles(*simhash.buffers(column), 5)
    fp, sets = [int(x) for x in simhash.simhashes(h, begin)], [five_words(t) for _, t in rows]
    close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    found = [(i, j) for j in range(len(rows)) for i in range(j) if (fp[i] ^ fp[j]).bit_count() <= 2 and close(i, j)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    assert len(found) > 8 and not kept & {j for _, j in found}
    assert all(any(close(i, j) for i in range(j)) for j in set(range(len(rows))) - kept)


def test_links_lose_no_pair():
    """A bucket where the first set is like neither of two others that are alike."""
    import numpy as np

    s = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 9, 18, 30, 500)]
    assert sorted(map(sorted, simhash.linked(s, 0.8))) == [[0, 1], [1, 2]]
    assert simhash.linked([s[0], s[0]], 0.8) == [(0, 1)]


def test_links_across_labels():
    """Sets of one label are joined already; a link to another label is made once."""
    import numpy as np

    s = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 1, 2, 500)]
    assert simhash.linked(s, 0.8, [7, 7, 7, 7]) == []
    assert sorted(map(sorted, simhash.linked(s, 0.8, [7, 7, -1, 9]))) in ([[0, 2]], [[1, 2]])


@pytest.mark.parametrize("group", [2, 7, 50, 2000])
def test_split_buckets_lose_no_link(spark, group):
    """One family of which most share buckets, in many components, and large ones among them; parts and blocks of a few texts."""
    import random

    from . import brute

    rng, texts = random.Random(11), []
    base = [f"w{i}" for i in range(120)]
    for g in range(12):
        own = list(base)
        for at in rng.sample(range(120), 3 + g // 3):
            own[at] = f"group{g}x{at}"
        for k in range(60 if g < 2 else rng.choice([1, 2, 6])):
            copy = list(own)
            for at in rng.sample(range(120), k % 3):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + ["", "one", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["root"] for r in simhash.similar(df, 5, 0.8, group).collect()}
    a, b = defaultdict(set), defaultdict(set)
    for i, n in enumerate(brute.similar_groups(texts)):
        a[n].add(i)
        b[found[i]].add(i)
    null = lambda groups: sorted(sorted(g) for g in groups.values() if not g & {len(texts) - 1, len(texts) - 3})
    assert len(null(a)) > 3
    assert null(a) == null(b)


def test_similarity_of_odd_rows(docs, given, empty, all_null):
    kept = rows_of(simhash.keep_first(docs, shingle=5, similarity=0.8), "doc_id", "text")
    assert len({five_words(t) for _, t in kept}) == len(kept)
    assert simhash.keep_first(empty, shingle=5, similarity=0.8).count() == 0
    assert simhash.keep_first(all_null, shingle=5, similarity=0.8).count() == 1
