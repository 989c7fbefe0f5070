"""Every stage of the pipeline against a plain version, on the rows that the stage before it left."""

import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomsketch.llm import substring
from loomsketch.llm.common import stored
from loomsketch.llm.tokens import default_path

from . import brute
from .conftest import rows_of, same


@pytest.fixture(scope="module")
def steps(spark, docs):
    """The input and output of each stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        done = stored(stage(spark, docs, None), name)
        out.append((docs, done))
        docs = done
    return dict(zip([k for k, _ in corpus_pipeline.STAGES], out, strict=True))


def pairs(df):
    return rows_of(df, "doc_id", "text")


def test_columns_stay(steps, docs):
    assert len(steps) == 5
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert after.count() <= before.count()


def test_quality_rules(steps):
    before, after = map(pairs, steps["quality_rules"])
    same(after, [x for x, (_, kept) in zip(before, brute.quality([t for _, t in before]), strict=True) if kept])


def test_near_dedup(steps):
    before, after = map(pairs, steps["near_dedup"])
    groups = {}
    for x, g in zip(before, brute.similar_groups([t for _, t in before]), strict=True):
        groups.setdefault(g, []).append(x)
    assert len(after) == len(groups) < len(before)
    least = lambda g: min((i for i, _ in g if i is not None), default=None)
    same([i for i, _ in after], [least(g) for g in groups.values()])
    assert not Counter(after) - Counter(before)


def test_substring_dedup(steps):
    before, after = map(pairs, steps["substring_dedup"])
    same(after, [(i, " ".join(rest) if lost else t) for (i, t), (lost, rest) in zip(before, brute.removed(before), strict=True)])


def test_sanitise(steps):
    before, after = map(pairs, steps["sanitise"])
    spans = brute.all_spans([t for _, t in before])
    same(after, [(i, brute.replaced(t, s) if s else t) for (i, t), s in zip(before, spans, strict=True)])


def test_best_fit_packing(steps):
    before, after = pairs(steps["best_fit_packing"][0]), steps["best_fit_packing"][1].collect()
    library = Tokenizer.from_file(default_path())
    library.no_truncation(), library.no_padding()
    want = []
    for i, t in before:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(p := ids[a : a + 4096]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p))) for k, a in enumerate(range(0, len(ids), 4096))]
    same([tuple(r)[:5] for r in after], want)
    filled = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096


def test_cut_repeats_on_odd_rows(docs, given):
    """With copies, rows of one doc_id, nulls, and texts that weak hashes take for equal."""
    rows = [(i, t) for i, t, _ in given]
    out = substring.cut_repeats(docs)
    same(pairs(out), [(i, " ".join(rest) if lost else t) for (i, t), (lost, rest) in zip(rows, brute.removed(rows), strict=True)])
    assert not out.filter("text IS NOT NULL AND n_chars <> 1 AND n_chars <> length(text)").count()


def test_passages_add_up(docs):
    gone = Counter()
    for r in substring.passages(docs).collect():
        gone[r["doc_id"]] += r["n_words"]
    want = Counter()
    for i, n in rows_of(substring.removed(docs), "doc_id", "n_removed"):
        want[i] += n
    assert +gone == +want and sum(gone.values())


def test_run_and_empty(spark, sf, empty):
    out = corpus_pipeline.run(spark, sf)
    rows = out.count()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows == out.count() > 100
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
