"""Quality rules by weak supervision (operator 5).

Each rule votes good or bad on a document, or abstains. How documents vote is counted by pattern of votes: there are at
most 3**len(RULES) patterns however many documents there are, and the counts are all that expectation-maximisation needs.
It estimates how often each rule votes either way on good and on bad documents; a document's posterior probability of being
good follows from its pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Words, buffers, chunks, distinct_words, stored, table

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_punct", "n_shout"]

_SYMBOL, _UPPER, _LOWER, _DIGIT, _PUNCT = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", range(65, 91), range(97, 123), range(48, 58), b"!\"'(),-./:;?[\\]^_`{}~@+="))
_HIGH = np.arange(256) >= 128
_TAIL = (np.arange(256) & 0xC0) == 0x80
_KIND = (_SYMBOL + 2 * _UPPER + 4 * (_LOWER | _HIGH) + 8 * _DIGIT + 16 * _PUNCT + 32 * _TAIL).astype(np.uint8)


def _rank(key: np.ndarray) -> np.ndarray:
    """Each number's place among the different numbers."""
    return np.unique(key, return_inverse=True)[1]


def _earlier(key: np.ndarray) -> np.ndarray:
    """For each place, whether an equal number stands before it."""
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """How many \n-split lines with a word there are, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def count_features(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """FEATURES of each text, from whole arrays of bytes. Words and lines are compared by their bytes, windows by their words."""
    w = Words(buf, offsets)
    n, off = len(offsets) - 1, w.off
    inside, kind = w.inside, _KIND[w.buf]

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    out = {"n_words": w.count, "n_symbols": per_text(kind & 1 > 0), "n_upper": per_text(kind & 2 > 0), "n_digits": per_text(kind & 8 > 0), "n_punct": per_text(kind & 16 > 0)}
    out["word_chars"] = per_text(inside & (kind & 32 == 0))
    out["n_letters"] = per_text((kind & 6 > 0) & (kind & 32 == 0))
    count = lambda at, mask: np.bincount(at[mask], minlength=n)[:n].astype(np.int64)
    first, word = distinct_words(w)
    size = max(1, len(first))
    out["n_distinct"] = count(w.text, ~_earlier(w.text * size + word))
    # words in a window of three that is found twice or more in its text
    repeat = np.zeros(len(w), bool)
    at = np.flatnonzero(w.text[2:] == w.text[:-2]) if len(w) > 2 else np.zeros(0, np.int64)
    if len(at):
        three = _rank(_rank(word[at] * size + word[at + 1]) * size + word[at + 2])
        _, like, times = np.unique(w.text[at] * len(at) + three, return_inverse=True, return_counts=True)
        again = at[times[like] > 1]
        for k in range(3):
            repeat[again + k] = True
    out["n_repeat_words"] = count(w.text, repeat)
    out["n_shout"] = count(w.text, w.buf[w.end - 1] == 33)
    data = w.buf.tobytes()
    lines = np.array([duplicate_lines(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64).reshape(n, 2)
    out["n_lines"], out["n_dup_lines"] = lines[:, 0], lines[:, 1]
    return out


@F.arrow_udf(StructType([StructField(k, LongType()) for k in FEATURES]))
def _counted(text: pa.Array) -> pa.Array:
    buf, off = buffers(text)
    found = [count_features(buf, off[a : b + 1]) for a, b in chunks(off)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]), pa.int64()) for k in FEATURES], FEATURES)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and FEATURES of its text under names that begin with __q_. Python gets the texts alone and
    gives back numbers; everything else stays in the JVM."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], _counted(F.col("text").cast("string")).alias("__q"))
    return rows.select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"__q.{k}").alias(f"__q_{k}") for k in FEATURES])


def _q(name: str) -> Column:
    return F.col(f"__q_{name}")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. Limits are shares in percent, compared as integers."""
    w, c = _q("n_words"), _q("word_chars")
    return {
        "length": _vote(w >= 100, w < 50),
        "symbols": _vote(_q("n_symbols") * 1000 <= c, _q("n_symbols") * 100 > 2 * c),
        "lines": _vote(_q("n_dup_lines") * 10 <= _q("n_lines"), _q("n_dup_lines") * 100 > 30 * _q("n_lines")),
        "repeats": _vote(_q("n_repeat_words") * 100 <= 10 * w, _q("n_repeat_words") * 100 > 30 * w),
        "capitals": _vote(_q("n_upper") * 100 <= 15 * c, _q("n_upper") * 100 > 40 * c),
        "shouting": _vote(_q("n_shout") * 100 <= 2 * w, _q("n_shout") * 100 > 20 * w),
        "word_length": _vote((c >= 3 * w) & (c <= 9 * w), (c * 10 < 22 * w) | (c > 14 * w)),
        "letters": _vote(_q("n_letters") * 100 >= 85 * c, _q("n_letters") * 100 < 70 * c),
        "digits": _vote(_q("n_digits") * 100 <= 3 * c, _q("n_digits") * 100 > 20 * c),
        "variety": _vote((_q("n_distinct") * 100 >= 40 * w) | (_q("n_distinct") >= 400), _q("n_distinct") * 100 < 15 * F.least(w, F.lit(2000))),
    }


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray]:
    """The share of good documents, and for each rule P(vote | good or bad): an array (rule, 2: bad and good, 3: vote + 1).

    votes: patterns by rules, each -1, 0 or 1. It starts from the belief that one vote of bad outweighs the votes of good,
    and a prior of a thousandth of the documents keeps the two classes from changing places.
    """
    total = float(counts.sum())
    if not total:
        return 0.5, np.full((votes.shape[1] if votes.ndim == 2 else 0, 2, 3), 1 / 3)
    n_bad, n_good = (votes < 0).sum(1), (votes > 0).sum(1)
    q = 1 / (1 + np.exp(-(1.0 * n_good - 6.0 * n_bad)))
    prior = np.array([[6.0, 2.0, 1.0], [0.5, 2.0, 6.0]])  # bad, good
    prior = prior / prior.sum(1, keepdims=True) * max(2.0, total / 1000)
    hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        by = np.stack([counts * (1 - q), counts * q])
        table_ = np.einsum("cp,pjv->jcv", by, hot) + prior
        table_ /= table_.sum(2, keepdims=True)
        share = (by[1].sum() + 1) / (total + 2)
        now = posterior(votes, share, table_)
        if np.abs(now - q).max() < 1e-10:
            q = now
            break
        q = now
    return share, table_


def posterior(votes: np.ndarray, share: float, table_: np.ndarray) -> np.ndarray:
    """P(good | votes) of each pattern."""
    at = np.arange(votes.shape[1])
    odds = np.log(share / (1 - share)) + (np.log(table_[at, 1, votes + 1]) - np.log(table_[at, 0, votes + 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(found: DataFrame) -> tuple[float, np.ndarray]:
    """The model, from the patterns of votes of a table of features; texts that fail the base rules vote as well."""
    named = rules()
    rows = found.select(*[v.alias(k) for k, v in named.items()]).groupBy(*named).agg(F.count("*").alias("n")).collect()  # at most 3**len(RULES)
    rows = sorted(tuple(r) for r in rows)
    votes = np.array([r[:-1] for r in rows], np.int64).reshape(len(rows), len(named))
    return expectation_maximisation(votes, np.array([r[-1] for r in rows], float))


def verdict(share: float, table_: np.ndarray) -> tuple[Column, Column, Column]:
    """base_failed, the posterior, and kept, over a table of features."""
    odds = F.lit(float(np.log(share / (1 - share))))
    for (_, v), t in zip(rules().items(), table_, strict=True):
        gain = [float(x) for x in np.log(t[1]) - np.log(t[0])]
        odds = odds + F.when(v == 1, gain[2]).when(v == -1, gain[0]).otherwise(gain[1])
    failed = (_q("n_words") < 50) | (_q("n_repeat_words") * 100 > 50 * _q("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return failed, quality, ~failed & (quality >= 0.5)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, kept and the posterior quality of every row.

    Null text counts as empty: no words, so base_failed. A null doc_id is kept; repeated rows each give a row and each
    count for the model; other columns are ignored; an empty table gives no rows.
    """
    found = stored(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "quality")
    failed, quality, kept = verdict(*fit(found))
    return found.select("doc_id", *[_q(k).alias(k) for k in FEATURES[:5]], failed.alias("base_failed"), kept.alias("kept"), quality.alias("quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is kept, with the columns of docs; nulls and repeated rows as by `judge`. Texts are counted
    once and stored with their counts; the verdict is a filter on that table. Nothing is shuffled but patterns of votes."""
    names = docs.columns
    found = stored(features(docs, names), "quality")
    *_, kept = verdict(*fit(found))
    return found.filter(kept).select(*[F.col(f"`{n}`") for n in names])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
