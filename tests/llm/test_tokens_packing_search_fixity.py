import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomsketch.llm import fixity, maxscore, packing, tokens

from .conftest import rows_of, same


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_digests_equal_the_library(docs, given, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(x := ids_of(library, t)), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, t, _ in given]
    same(rows_of(tokens.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_random_texts_equal_the_library(library):
    rng = random.Random(11)
    parts = ["don't", "I'LL", "''s", "<|endoftext|>", "<|startoftext|>", "<", "é", "É", "İ", "ǅ", "½", "12345", "1a2b", "...", "!?", " ", " ", "́", "ﬀ", "日本", "😀", "\0", " ", "\n", "abc", "XyZ", "_", "-", "ß", "ẞ", "Ω", "ſ", "K"]
    it = tokens.encoder(tokens.default_path())
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert it.encode(text) == ids_of(library, text), repr(text)


def test_recent_words_never_give_another_words_ids(library):
    """Words that share their first bytes, differ in zeros or in length, in a table of four places, run after run."""
    rng = random.Random(5)
    words = ["a", "a\0", "ab", "abcdefgh", "abcdefgh\0", "abcdefghi", "abcdefghj", "abcdefghijklmnop", "abcdefghijklmnoq", "abcdefghijklmnopq", "xyzqjxzqjxzq", "1234567890123456", "é", "日本", "<|endoftext|>", "x" * 100]
    it = tokens.ForcedBoundaryEncoder(tokens.default_path())
    it.recent = type("Small", (tokens.RecentWords,), {"BITS": 2})()
    for _ in range(300):
        texts = [" ".join(rng.choices(words, k=rng.randrange(8))) for _ in range(rng.randrange(1, 4))]
        data = [x.encode() for x in texts]
        ids, at = it.encode_texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids_of(library, t) for t in texts]


def test_encode_decode_gives_ids_and_text(docs, given, library):
    out = rows_of(tokens.encode_decode(docs), "doc_id", "ids", "decoded")
    same(out, [(i, x := ids_of(library, t), library.decode(x, skip_special_tokens=False)) for i, t, _ in given])


def test_forced_boundaries_are_outside_every_token():
    it = tokens.encoder(tokens.default_path())
    cut = [(a, b) for a in "qzxj0é" for b in "qzxj0é" if a + b not in it.joined]
    assert cut and not any(a + b in t for a, b in cut for t in it.vocab)


def test_packing_places_every_piece_once(docs, given, library):
    out = packing.pack(docs).collect()
    pieces = defaultdict(list)
    for i, t, _ in given:
        x = [*ids_of(library, t), 1]
        for k, a in enumerate(range(0, len(x), 4096)):
            part = np.array(x[a : a + 4096], "<u4")
            pieces[None].append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out], pieces[None])
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(by) <= -(-total // 4096) * 1.05 + 2


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(capacity - x)
        else:
            rooms[rooms.index(fit)] -= x
    return len(rooms)


def test_plan_is_as_good_as_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [min(100, 1 + int(rng.expovariate(1 / rng.choice([5, 20, 60])))) for _ in range(400)]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.plan(histogram, 100)
        used = defaultdict(int)
        for length, _, n, sequence, offset, each in plan:
            for k in range(n):
                assert offset + (k % each + 1) * length <= 100
                used[sequence + k // each] += length
        assert sum(used.values()) == sum(lengths) and max(used.values()) <= 100
        assert len(used) <= best_fit_decreasing(lengths, 100) * 1.03 + 1


def brute_top(rows, k=5, every=50):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in {i: min(v for j, v in fine if j == i) for i, _ in fine if i % every == 0}.items():
        scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q))[:k]
        for r, (s, i) in enumerate(scores, 1):
            yield q, r, i, -s


def test_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, list(rows[i % 3][1])) for i in range(40)]  # ties
    rows += [(50, list(rows[7][1])), (None, rows[0][1]), (2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.0] * 8), (2201, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    same(rows_of(maxscore.top_k(df), "query_id", "rank", "vec_id", "score"), brute_top(rows))


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    same(rows_of(maxscore.top_k(df), "query_id", "rank", "vec_id", "score"), [(0, 1, 1, 256 * 512)])
    assert maxscore.top_k(df.filter("false")).count() == 0


def test_maxscore_with_blocks_and_skips():
    rng = np.random.default_rng(1)
    m = rng.integers(-300, 300, (500, 12)) * (rng.random((500, 12)) < 0.3)
    for q in rng.integers(-300, 300, (20, 12)):
        best = maxscore.Best(5)
        for a in range(0, 500, 64):
            block = m[a : a + 64]
            maxscore.maxscore(q.astype(float), -1, np.arange(a, a + len(block)), block.T.astype(float), block.max(0).astype(float), block.min(0).astype(float), best)
        want = sorted((-int(s), i) for i, s in enumerate(m @ q))[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score, best.id, strict=True)] == want


def brute_record(url, html):
    head = "WARC/1.1\r\nWARC-Type: resource\r\n" + ("" if url is None else f"WARC-Target-URI: {url}\r\n") + ("" if html is None else f"Content-Length: {len(html.encode())}\r\n")
    return (head + "\r\n" + (html or "") + "\r\n\r\n").encode()


def brute_audit(a, b):
    def by(rows):
        out = defaultdict(list)
        for i, u, h in rows:
            out[i].append(brute_record(u, h))
        return {k: sorted(v) for k, v in out.items()}

    x, y, at = by(a), by(b), 0
    size = lambda v: None if v is None else sum(map(len, v))
    for k in sorted({*x, *y}, key=lambda k: (k is not None, k or 0)):
        if x.get(k) != y.get(k):
            yield k, "changed" if k in x and k in y else "missing" if k in x else "extra", at, size(x.get(k)), size(y.get(k))
        at += size(x.get(k)) or 0


def test_audit_equals_brute_force(spark):
    rng = random.Random(9)
    a = [(rng.randrange(-5000, 5000), f"u{i}", "é" * rng.randrange(50)) for i in range(3000)] + [(None, None, None), (None, "u", ""), (1 << 40, None, "x"), (-(1 << 40), "", None)]
    b = [r for r in a if rng.random() > 0.01]
    b = [(i, u, (h or "") + "!") if rng.random() < 0.01 else (i, u, h) for i, u, h in b] + [(9000 + i, "new", "x") for i in range(5)] + [(1 << 41, "far", "x")]
    rng.shuffle(b)
    schema = "page_id long, url string, html string"
    columns = ["page_id", "status", "offset", "bytes_a", "bytes_b"]
    df = lambda rows: spark.createDataFrame(rows, schema).selectExpr("*", "1 AS n", "2 AS bytes", "'k' AS key")
    same(rows_of(fixity.audit(df(a), df(b)), *columns), brute_audit(a, b))
    assert fixity.audit(df(a), df(a[::-1])).count() == 0
    none = df(a).filter("false")
    assert fixity.audit(none, none).count() == 0
    same(rows_of(fixity.audit(df(a[:50]), none), *columns), brute_audit(a[:50], []))


def test_nothing(empty, all_null):
    assert tokens.digests(empty).count() == 0 and packing.pack(empty).count() == 0
    assert tokens.digests(all_null).filter("n_tokens = 0").count() == 3
    same(rows_of(packing.pack(all_null), "doc_id", "piece", "start", "length"), [(None, 0, 0, 1)] * 3)
