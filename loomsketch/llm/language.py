"""Language identification by rank-order profiles (operator 8).

A profile is a list of n-grams by falling frequency. A document's profile is held against each language's: every n-gram
adds how far its rank is out of place, or the most there is if the language's profile lacks it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, table

#: N-grams in a profile.
SIZE = 300
#: Bits of a code point: an n-gram's code is its up to three code points side by side, with 1 for a word boundary.
_POINT = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of the n-grams of 1 to 3 letters of each text, with word boundaries; sorted by text and n-gram.

    Letters are numbered by the alphabet of these texts, so that text and n-gram fit one number for the sort; where they
    don't, texts are taken in halves.
    """
    whole = "\0" + "\0".join(texts) + "\0"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen & _letters()[: len(seen)])
    bits = (len(alphabet) + 1).bit_length()
    if len(texts) > 1 and len(texts).bit_length() + 3 * bits > 64:
        half = len(texts) // 2
        left, right = ngrams(texts[:half]), ngrams(texts[half:])
        return np.concatenate([left[0], right[0] + half]), np.concatenate([left[1], right[1]]), np.concatenate([left[2], right[2]])
    number = np.ones(len(seen), np.uint64)
    number[alphabet] = np.arange(2, len(alphabet) + 2)
    code = number[points]
    text = np.append(np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]), len(texts) - 1)
    letter = code > 1
    keep = np.ones(len(code), bool)
    keep[:-1] = letter[:-1] | letter[1:]  # of a run of other characters the last is the boundary: it stands in the text whose letter follows
    code, letter, text = code[keep], letter[keep], text[keep].astype(np.uint64) << np.uint64(3 * bits if len(texts) > 1 else 0)
    if len(texts) == 1:
        text[:] = 0
    s1, s2 = np.uint64(bits), np.uint64(2 * bits)
    one = (code | text)[letter]
    # the text of an n-gram that ends or begins at a boundary is that of its letter
    two = ((code[:-1] << s1) | code[1:] | np.where(letter[:-1], text[:-1], text[1:]))[letter[:-1] | letter[1:]]
    three = ((code[:-2] << s2) | (code[1:-1] << s1) | code[2:] | text[1:-1])[letter[1:-1]]
    allg = np.concatenate([one, two, three])
    allg.sort()
    new = np.ones(len(allg), bool)
    new[1:] = allg[1:] != allg[:-1]
    at = np.flatnonzero(new)
    value, name, low = allg[at], np.concatenate([[0, 1], alphabet]).astype(np.uint64), np.uint64((1 << bits) - 1)
    gram = name[value & low] | name[value >> s1 & low] << np.uint64(_POINT) | name[value >> s2 & low] << np.uint64(2 * _POINT)
    return (value >> np.uint64(3 * bits)).astype(np.int64) if len(texts) > 1 else np.zeros(len(value), np.int64), gram, np.diff(np.append(at, len(allg)))


def _lowered(column: pa.Array):
    buf, off = buffers(column)
    data = buf.tobytes() if len(off) > 1 else b""
    for a, b in chunks(off):
        yield a, [data[off[i] : off[i + 1]].decode("utf-8", "replace").replace("\0", " ").lower() for i in range(a, b)]


def learn(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """The profile of each value of `lang`: its `size` most frequent n-grams, ties to the smaller code.

    Counting is distributed and combined before it is shuffled; what comes to the driver is `size` numbers a language.
    """

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, texts in _lowered(batch.column(0)):
                text, gram, n = ngrams(texts)
                names, at = np.unique(langs[a : a + len(texts)].astype(str), return_inverse=True)
                lang = at[text]
                order = np.lexsort((gram, lang))
                lang, gram, n = lang[order], gram[order], n[order]
                first = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
                total = np.add.reduceat(n, first) if len(first) else n
                yield pa.RecordBatch.from_arrays([pa.array(names[lang[first]].astype(object), pa.string()), pa.array(gram[first].astype(np.int64)), pa.array(total, pa.int64())], ["lang", "gram", "n"])

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).select("lang", "gram", "r").collect()
    out: dict[str, list] = {}
    for lang, gram, r in sorted(rows, key=lambda x: (x[0], x[2])):
        out.setdefault(lang, []).append(gram)
    return {k: np.array(v, np.uint64) for k, v in out.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = SIZE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[k] for k in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: no language has it
        for i, k in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, profiles[k]), i] = np.arange(len(profiles[k]))

    def best(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language that is least out of place, ties to the name that sorts first, and 1 - distance / most possible."""
        text, gram, n = ngrams(texts)
        order = np.lexsort((gram, -n, text))
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        place = np.arange(len(text)) - first[text]
        top = place < self.size
        text, gram, place = text[order][top], gram[order][top], place[top]
        count = np.bincount(text, minlength=len(texts))
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        at = np.searchsorted(self.grams, gram)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != gram)] = len(self.grams)
        rank = self.rank[at]
        out = np.where(rank < 0, self.size, np.abs(rank - place[:, None]))
        far = np.stack([np.bincount(text, weights=out[:, i], minlength=len(texts)) for i in range(len(self.langs))], 1)
        pick = far.argmin(1)
        score = 1 - far[np.arange(len(texts)), pick] / (self.size * np.maximum(count, 1))
        return [self.langs[p] if c else "und" for p, c in zip(pick, count, strict=True)], np.where(count > 0, score, 0.0)


def identify(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows with crc32(doc_id) mod 3 = 1 are held out of learning.

    Null text, or text without a letter: `und`, score 0. If no language can be learned, every row is `und`. A null doc_id
    counts as an empty string for the remainder; a null lang teaches nothing; repeated rows count each; other columns are
    ignored. Texts are taken whole, in lower case.
    """
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3) == 1
    profiles = Profiles(learn(docs.filter(~held), size), size)

    def run(batches):
        for batch in batches:
            for a, texts in _lowered(batch.column(2)):
                lang, score = profiles.best(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), batch.column(1).slice(a, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
