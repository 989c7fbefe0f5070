"""Exact substring deduplication by fixed-block anchors (operator 3).

Every document is cut into non-overlapping blocks of 25 words, which are the index, and every rolling window of 25 words is a
probe. Both are filed under their anchor, the smallest hash of the 8-word runs inside them: equal windows have equal anchors,
and neighbouring probes share theirs, so that some ten windows make one row. A block is a hit if another text has a probe
under its anchor. A hit is extended to both sides, word by word, for as long as the probe there is shared with another text as
well. A stretch of 50 words or more always holds a whole block, so every repeat of 50 words lies inside an extended hit.

Extended hits are settled exactly: the 128-bit hash of each 50-word window in them is grouped, and the smallest document that
holds it keeps it. Removed windows that touch make one maximal repeat.

What is shared by many is never sent back to all who hold it. Groups are aggregated before they are shuffled, and each has one
row to return, to its smallest document: an anchor that a single text has ("alone"), and a window that the document keeps.
Everybody else finds by its absence what is shared and what goes. So a passage that a third of all documents hold makes no
hot key in any join, and no pair of documents is ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, chunks, runs, stored, table, texts, word_hashes

WINDOW, RUN = 50, 8
#: What names a row: rows of one doc_id are told apart by a hash of their text.
KEY = ["doc_id", "th"]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(h: np.ndarray, block: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of one document's rolling windows of `block` words, in turn, and how many windows in a row each has. The
    document's blocks are the windows at multiples of `block`. Shorter blocks take shorter runs."""
    run = min(run, block)
    if len(h) < block:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    probe = _least(runs(h, run), block - run + 1).view(np.int64)
    at = np.flatnonzero(np.append(True, probe[1:] != probe[:-1]))
    return probe[at], np.diff(np.append(at, len(probe)))


def extended(h: np.ndarray, alone: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The stretches of `window` words or more, as (first word, end), into which hits extend. A run of window - block + 1
    shared probes holds a multiple of `block`, and so a block that is a hit."""
    block = window // 2
    anchor, n = anchors(h, block)
    shared = np.repeat(~np.isin(anchor, alone), n)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], shared.astype(np.int8), [0]])))
    return [(a, b + block - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + block - 1 - a >= window]


def _each(batch: pa.RecordBatch, at: int):
    """(row, word hashes, words' text) of each text in a column."""
    buf, off = buffers(batch.column(at))
    for x, y in chunks(off):
        w = Words(buf, off[x : y + 1])
        h = word_hashes(w)
        for i in range(y - x):
            yield x + i, h[w.first[i] : w.first[i + 1]]


def _indexed(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, th, n_words, sha (of the words joined by one space) and, of those that can lose words, the distinct anchors."""

    def run(batches):
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts(batch.column(2))]
            n, found, size = [], [], [0]
            for i, h in _each(batch, 2):
                n.append(len(h))
                own = np.unique(anchors(h, window // 2)[0]) if known[i] and len(h) >= window else np.zeros(0, np.int64)
                found.append(own), size.append(size[-1] + len(own))
            lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], [*KEY, "n_words", "sha", "anchors"])

    return rows.mapInArrow(run, "doc_id long, th long, n_words long, sha string, anchors array<long>")


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    off, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[off[i] : off[i + 1]] if v else None for i, v in enumerate(column.is_valid().to_pylist())]


def _windows(joined: DataFrame, doc: str, text: int, alone: int, window: int) -> DataFrame:
    """(a, b, doc_id) of the different windows inside extended hits."""
    names = joined.columns
    at = names.index(doc)

    def run(batches):
        for batch in batches:
            lone = _lists(batch.column(alone))
            rows, a, b = [], [], []
            for i, h in _each(batch, text):
                if lone[i] is None:
                    continue
                for u, v in extended(h, lone[i], window):
                    x, first = np.unique(runs(h[u:v], window, 1), return_index=True)
                    rows.append(np.full(len(x), i)), a.append(x), b.append(runs(h[u:v], window, 2)[first])
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)), batch.column(at).take(take)], ["a", "b", "doc_id"])

    return joined.mapInArrow(run, "a long, b long, doc_id long")


def _removed(h: np.ndarray, alone: np.ndarray, kept: np.ndarray | None, window: int) -> list[tuple[int, int]]:
    """The maximal repeats (first word, end) that go: of windows inside extended hits, those that the document doesn't keep."""
    gone = np.zeros(len(h) + 1, np.int64)
    for u, v in extended(h, alone, window):
        lost = u + np.flatnonzero(~np.isin(runs(h[u:v], window, 1).view(np.int64), [] if kept is None else kept))
        np.add.at(gone, lost, 1)
        np.add.at(gone, lost + window, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(gone[:-1]) > 0).astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


class Repeats:
    """What the documents of a table share. `docs` has doc_id (long), th and text (string) under the names given, and any other
    columns; `rows` is "left" to keep every row of it in `joined`, or "inner" for those alone that may lose words.

    index: a stored row for each row of docs; leaders: (doc_id, sha) of the smallest document of each sequence of words;
    joined: docs with the anchors that its text has alone; kept: the windows that each document keeps.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW, names: tuple[str, str, str] = ("doc_id", "th", "text"), rows: str = "inner"):
        doc, th, text = names
        self.window, self.names = window, docs.columns
        self.index = index = stored(_indexed(docs.select(F.col(doc).alias("doc_id"), F.col(th).alias("th"), F.col(text).alias("text")), window), "anchors")
        long = index.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
        # of documents with the same words the first stands for all: the others have nothing that it lacks
        self.leaders = long.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
        by_anchor = long.select(*KEY, F.explode("anchors").alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("th").alias("th"), F.max("th").alias("other"))
        alone = by_anchor.filter(F.col("th") == F.col("other")).groupBy(*KEY).agg(F.collect_list("k").alias("alone"))
        leading = long.join(self.leaders, ["doc_id", "sha"], "left_semi").select(*KEY, F.size("anchors").alias("n")).distinct()
        none = F.array().cast("array<long>")
        self.candidates = leading.join(alone, KEY, "left").select(*KEY, "n", F.coalesce("alone", none).alias("alone")).filter(F.size("alone") < F.col("n")).select(*KEY, "alone")
        side = self.candidates.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__hash"), F.col("alone").alias("__alone"))
        on = (F.col(doc) == F.col("__doc")) & (F.col(th) == F.col("__hash"))
        self.joined = docs.join(side, on, rows).select(*[F.col(f"`{n}`") for n in docs.columns], "__alone")
        found = _windows(self.joined, doc, docs.columns.index(text), len(docs.columns), window)
        keepers = found.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("a").alias("kept"))
        self.kept = self.candidates.select(*KEY).join(keepers, "doc_id").select(*KEY, "kept")

    def copies(self) -> DataFrame:
        """doc_id and th of the rows that lose all their words to a smaller document with the same words."""
        long = self.index.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= self.window))
        return long.join(self.leaders, ["doc_id", "sha"], "left_anti").select(*KEY)


def without(text: bytes, gone: list[tuple[int, int]]) -> tuple[int, bytes]:
    """How many words stand in the stretches, and the others joined by one space."""
    words = text.split()
    keep = np.ones(len(words), bool)
    for a, b in gone:
        keep[a:b] = False
    return int(len(words) - keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _settled(docs: DataFrame, window: int) -> tuple[Repeats, DataFrame]:
    """The repeats of docs, and (doc_id, th, n_words, n_removed, kept_sha256, starts, ends) of each row that may lose words."""
    found = Repeats(_named(docs), window)
    both = found.joined.alias("j").join(found.kept.alias("k"), KEY, "left").select(*KEY, "text", "__alone", "kept")

    def run(batches):
        for batch in batches:
            lone, kept, whole = _lists(batch.column(3)), _lists(batch.column(4)), texts(batch.column(2))
            total, n, sha, starts, ends = [], [], [], [], []
            for i, h in _each(batch, 2):
                gone = _removed(h, lone[i], kept[i], window)
                lost, rest = without(whole[i], gone)
                total.append(len(h)), n.append(lost), sha.append(hashlib.sha256(rest).hexdigest()), starts.append([a for a, _ in gone]), ends.append([b for _, b in gone])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(total, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], [*KEY, "n_words", "n_removed", "kept_sha256", "starts", "ends"])

    return found, both.mapInArrow(run, "doc_id long, th long, n_words long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>")


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word goes if a window of 50 words covers it that also starts in a document with a smaller doc_id. Null text has no
    words. A row with a null doc_id has no order: it neither loses words nor makes others lose any. Rows with one doc_id do
    not make each other lose words; repeated rows each give a row. Texts of fewer than 50 words are kept. An empty table
    gives no rows; other columns are ignored.
    """
    found, settled = _settled(docs, window)
    rest = found.index.join(found.candidates.select(*KEY), KEY, "left_anti")
    rest = rest.join(found.leaders.withColumn("leads", F.lit(True)), ["doc_id", "sha"], "left")
    copy = F.col("leads").isNull() & F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    rest = rest.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(copy, nothing).otherwise(F.col("sha")).alias("kept_sha256"))
    return settled.select("doc_id", "n_words", "n_removed", "kept_sha256").unionAll(rest)


def passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start and n_words of every maximal repeat that `removed` takes out, in words of the text; nulls as there. A row
    whose words all stand in a smaller document gives one passage, its whole text."""
    found, settled = _settled(docs, window)
    some = settled.select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("z")).select("doc_id", F.col("z.starts").alias("start"), (F.col("z.ends") - F.col("z.starts")).alias("n_words"))
    return some.unionAll(found.index.join(found.copies(), KEY, "left_semi").select("doc_id", F.lit(0).cast("long").alias("start"), "n_words"))


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words that repeat; a text that loses words keeps the others, joined by one space, and its n_chars.

    Rows, nulls and repeats are taken as by `removed`: every row stays, one that loses all its words with an empty text. Both
    uses of the texts share one shuffle.
    """
    kind, names = docs.schema["doc_id"].dataType, docs.columns
    text = F.col("text").cast("string")
    own = [n for n in names if n != "text"]
    keyed = docs.select(*[F.col(f"`{n}`") for n in own], F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
    found = Repeats(keyed, window, ("__id", "__th", "__text"), "left")
    changed = found.kept.select(*KEY, "kept", F.lit(False).alias("copy")).unionAll(found.copies().distinct().select(*KEY, F.lit(None).cast("array<long>").alias("kept"), F.lit(True).alias("copy")))
    changed = changed.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__hash"), F.col("kept").alias("__kept"), F.col("copy").alias("__copy"))
    both = found.joined.join(changed, (F.col("__id") == F.col("__doc")) & (F.col("__th") == F.col("__hash")), "left")
    both = both.select(*[F.col(f"`{n}`") for n in own], "__text", "__alone", "__kept", "__copy")
    at = len(own)

    def run(batches):
        for batch in batches:
            lone, kept, copy, whole = _lists(batch.column(at + 1)), _lists(batch.column(at + 2)), batch.column(at + 3).to_pylist(), batch.column(at).cast(pa.binary()).to_pylist()
            lost = np.zeros(len(whole), bool)
            for i, h in _each(batch, at):
                if copy[i]:
                    whole[i], lost[i] = b"", True
                elif lone[i] is not None:
                    gone = _removed(h, lone[i], kept[i], window)
                    if gone:
                        whole[i], lost[i] = without(whole[i], gone)[1], True
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(whole, pa.binary()).cast(pa.string()), pa.array(lost)], [*own, "__text", "__lost"])

    kinds = ", ".join(f"`{n}` {keyed.schema[n].dataType.simpleString()}" for n in own)
    out = both.mapInArrow(run, f"{kinds}{', ' if kinds else ''}__text string, __lost boolean")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__lost"), F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("text", F.col("__text").cast(docs.schema["text"].dataType)).select(*names)


def op3_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
