import math
import zlib
from collections import Counter

import numpy as np

from loomsketch.llm import language, maxent, quality

from . import brute
from .conftest import lowered, rows_of, same, words


def brute_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat)


def test_base_rules_equal_brute_force(docs, given):
    out = rows_of(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *(c := brute_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t, _ in given]
    same(out, want)


def test_verdicts(docs, spark, sf):
    out = quality.judge(docs)
    assert not out.filter("base_failed AND kept").count()
    assert not out.filter("kept IS NULL OR quality IS NULL OR quality < 0 OR quality > 1").count()
    told = out.join(spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS label"), "doc_id")
    good = [(r["kept"], r["label"]) for r in told.collect()]
    kept_good = np.mean([k for k, v in good if v == 1])
    kept_bad = np.mean([k for k, v in good if v == 0])
    assert kept_good > 0.85 and kept_good - kept_bad > 0.3, (kept_good, kept_bad)


def test_posterior_follows_from_patterns_alone():
    """Four accurate rules (three at least make the classes identifiable) and a random one: which is which is found out."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.85, 0.85, 0.5)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.1
    assert table[0, 1, 2] > 0.85 and table[1, 1, 2] > 0.8 and abs(table[4, 1, 2] - 0.5) < 0.1


def test_posterior_equals_brute_force(docs, given):
    got = sorted(rows_of(quality.judge(docs), "doc_id", "n_words", "quality", "kept"), key=repr)
    want = sorted([(i, len(words(t)), p, k) for (i, t, _), (p, k) in zip(given, brute.quality([t for _, t, _ in given]), strict=True)], key=repr)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[:2]), r[2])), sorted(want, key=lambda r: (repr(r[:2]), r[2])), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-6) and a[3] == b[3]


def test_keep_good_is_the_verdict(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert not {tuple(r) for r in kept.collect()} - {tuple(r) for r in docs.collect()}
    same(rows_of(kept, "doc_id"), [r[:1] for r in rows_of(quality.judge(docs), "doc_id", "kept") if r[1]])


def test_held_out_accuracy(docs, given):
    lang = {i: v for i, _, v in given if i is not None and i < 1_000_000}
    out = language.identify(docs).collect()
    assert len(out) == len(given)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"] and lang.get(r["doc_id"])]
    assert len(held) > 30 and np.mean(held) > 0.85
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1_000_000, 1_000_001, 1_000_002)} == {"und"}


def test_languages_equal_brute_force(docs, given, spark):
    """Ties between n-grams and between languages, letters beyond Latin, one-letter texts."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    more = [(i, t, g) for i, (t, g) in enumerate([("ab ba", "x"), ("ab ba", "w"), ("日本語の文章です", "ja"), ("한국어 문장", "ko"), ("丠丁七 丠", "zh"), ("𝔘𝔫𝔦", "m"), ("a", None), ("İstanbul ıI", "tr"), ("ab", "x"), ("日", "ja"), ("中文", "zh")] * 3)]
    for df, rows in ((docs, given), (spark.createDataFrame(more, "doc_id long, text string, lang string"), more)):
        got = {(i, round(s, 9), g) for i, g, s in rows_of(language.identify(df), "doc_id", "lang_pred", "score")}
        want = brute.language([(t, g) for i, t, g in rows if not held(i)], [t for _, t, _ in rows])
        assert got == {(i, round(s, 9), g) for (i, _, _), (g, s) in zip(rows, want, strict=True)}


def test_prediction_does_not_use_other_columns(docs):
    blind = docs.withColumn("source", docs["lang"])
    same(rows_of(language.identify(docs), "doc_id", "lang_pred", "score"), rows_of(language.identify(blind), "doc_id", "lang_pred", "score"))


def brute_base(given):
    tokens = {k: [lowered(w) for w in words(t)] + [None] for k, (_, t, _) in enumerate(given)}
    held = {k: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for k, (i, _, _) in enumerate(given)}
    c = Counter(t for k, x in tokens.items() if not held[k] for t in x)
    n, v = sum(c.values()), len(c)
    for k, (i, _, _) in enumerate(given):
        yield i, held[k], len(tokens[k]), sum(c[t] > 0 for t in tokens[k]), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[k])


def test_base_score_equals_brute_force(docs, given):
    key = lambda r: (repr(r[:5]), r[5])
    out = sorted(rows_of(maxent.score(docs), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"), key=key)
    want = sorted(brute_base(given), key=key)
    for a, b in zip(out, want, strict=True):
        assert tuple(a[:5]) == tuple(b[:5]) and math.isclose(a[5], b[5], rel_tol=1e-9)


def toy_model():
    """Counts of 500 words, some of them beyond the head, and a model with weights at random."""
    rng = np.random.default_rng(1)
    h, n = rng.integers(1, 2**63, 500).astype(np.uint64) * np.uint64(2), rng.zipf(1.3, 500).clip(1, 10_000)
    size = np.floor(np.log2(n) * 8).astype(int)
    bins = {int(b): (int((size == b).sum()), int(n[size == b].sum())) for b in np.unique(size)}
    known = maxent.Counts(h[size >= 8], n[size >= 8], bins, 8, 50)
    model = maxent.Model(known)
    model.w[:] = rng.normal(0, 1, model.w.shape)
    model.node[:] = rng.normal(0, 1, model.node.shape)
    return known, model


def test_probabilities_sum_to_one():
    """Over all words that were seen, one that was not, and the end, after any context."""
    known, model = toy_model()
    heads = known.hash[:-1]
    for k in range(5):
        f = np.repeat(maxent.contexts(heads[k : k + 3], np.array([0, 3]))[:, -1:], len(heads) + 2, 1)
        count, klass, code = known.look(np.concatenate([heads, [np.uint64(1), maxent._END]]))
        p = np.exp(model.log_words(f, klass, code))
        share = (np.append(known.count[:-1], [0, known.ends]) + maxent.SMOOTH) / known.leaf[klass, code]
        share[-2] = 1  # the unknown word and all words beyond the head share a class
        assert math.isclose((p * share).sum(), 1, rel_tol=1e-5), k


def test_log_words_equal_plain_sums():
    known, model = toy_model()
    h = np.append(np.random.default_rng(2).choice(known.hash[:-1], 40), maxent._END)
    f = maxent.contexts(h, np.array([0, len(h)]))
    _, klass, code = known.look(h)
    got = model.log_words(f, klass, code)
    rows = model.class_rows(f)
    for i in range(len(h)):
        x = [float(known.share[c]) + sum(float(model.w[c, rows[j, i]]) for j in range(3)) for c in range(maxent.CLASSES)]
        want = x[klass[i]] - math.log(sum(map(math.exp, x)))
        for d in range(maxent.CODE):
            node = int(klass[i]) << maxent.CODE | 1 << d | int(code[i]) >> maxent.CODE - d
            mask = (1 << 64) - 1
            place = [(((int(f[j, i]) ^ (node + 1) * 0x9E3779B97F4A7C15 & mask) * 0xD6E8FEB86659FD93 & mask) >> 64 - 14) for j in range(3)]
            odds = float(known.odds[klass[i], node & (1 << maxent.CODE) - 1]) + sum(float(model.node[p]) for p in place)
            right = int(code[i]) >> maxent.CODE - 1 - d & 1
            want -= math.log1p(math.exp(-odds if right else odds))
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4)


def test_learning_lowers_the_loss():
    """A word that follows another always: its probability there rises, and averaging two models that agree changes nothing."""
    known, model = toy_model()
    model.w[:], model.node[:] = 0, 0
    h = np.tile(known.hash[[3, 7, 11, 5]], 500)
    f, (_, klass, code) = maxent.contexts(h, np.array([0, len(h)])), known.look(h)
    before = model.log_words(f, klass, code).mean()
    for _ in range(20):
        model.update(f, klass, code)
    after = model.log_words(f, klass, code)
    assert after.mean() > before + 1
    parts = {i: (2 * np.frombuffer(x, np.float32).astype(float)).tobytes() for i, x in enumerate(model.parts())}
    other = maxent.Model(known)
    other.load(parts)
    assert np.allclose(other.log_words(f, klass, code), after, atol=1e-3)


def full_model():
    """A model with tables at their bounds, as for billions of tokens, and a batch of tokens."""
    known, _ = toy_model()
    known.rows, known.nodes = 1 << maxent.ROWS[1], 1 << maxent.NODES[1]
    model = maxent.Model(known)
    h = np.random.default_rng(3).choice(known.hash[:-1], 20_000)
    return model, maxent.contexts(h, np.array([0, len(h)])), *known.look(h)[1:]


def test_an_update_equals_plain_sums():
    model, f, klass, code = full_model()
    for _ in range(2):
        node, bend, w, curve = model.node.copy(), model.bend.copy(), model.w.copy(), model.curve.copy()
        rows = model.class_rows(f)
        p = np.exp(model.log_classes(rows))
        share = np.exp(model.known.share)
        for k in range(maxent.CLASSES):
            curve[k] += share[k] * (1 - share[k]) * np.bincount(rows.ravel(), minlength=model.known.rows)
            sums = sum(np.bincount(r, p[k] - (klass == k), model.known.rows) for r in rows)
            w[k] -= maxent.STEP * sums / (maxent.PRIOR + curve[k])
        sums, more = np.zeros(len(node)), np.zeros(len(node))
        for d in range(maxent.CODE):
            right, x, places = model.path(f, klass, code, d)
            p = 1 / (1 + np.exp(-x.astype(float)))
            for at in places:
                sums += np.bincount(at, right - p, len(node))
                more += np.bincount(at, p * (1 - p), len(node))
        bend = bend + more
        node = node + maxent.STEP * sums / (maxent.PRIOR + bend)
        model.update(f, klass, code)
        assert all(np.allclose(a, b, rtol=1e-4, atol=1e-4) for a, b in ((model.node, node), (model.bend, bend), (model.w, w), (model.curve, curve)))


def test_an_update_makes_few_tables(monkeypatch):
    """At most two tables by node an update, not two for each step and feature; their cost made large inputs slow."""
    model, f, klass, code = full_model()
    made = []
    for name in ("zeros", "bincount"):

        def counted(*args, real=getattr(np, name), **more):
            out = real(*args, **more)
            made.append(out.size >= model.known.nodes)
            return out

        monkeypatch.setattr(maxent.np, name, counted)
    model.update(f, klass, code)
    assert sum(made) <= 2


def test_weights_sent_stay_below_the_text():
    """Whatever the number of splits of the input, here of 16 MB, with five bytes a token."""
    model, *_ = full_model()
    known, one = model.known, sum(map(len, model.parts()))
    for total in (10**9, 10**10, 10**12):
        known.total = total
        n = min(maxent.trainers(known), total * 5 // 2**24)
        assert maxent.LEAST_TRAINERS <= n <= maxent.TRAINERS and n * one < total * 5


def test_context_helps_on_held_out_documents(docs):
    rows = [r for r in maxent.score(docs).collect() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1_000_000]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(r["score"] <= 0 for r in rows)


def test_nothing(empty, all_null):
    for f in (quality.judge, quality.keep_good, language.identify, maxent.score):
        assert f(empty).count() == 0
    assert quality.judge(all_null).filter("base_failed").count() == 3 and quality.keep_good(all_null).count() == 0
    assert language.identify(all_null).filter("lang_pred = 'und'").count() == 3
    assert maxent.score(all_null).filter("train_tokens = 0 AND n_tokens = 1").count() == 3
