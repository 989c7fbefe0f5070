"""Language-model scoring by a hashed maximum-entropy model (operator 7).

The softmax over the vocabulary is factored: P(w | context) = P(class | context) * P(w | class, context). Classes group words
by frequency. Inside a class, each word has a code of CODE bits and the second factor is a path of two-way softmaxes along
the code, times the word's share of those with its code. Both factors have weights for n-gram and skip features of the
context: the word before, the word before that one alone (a skip), and both together (an n-gram). Features are hashed with
what they speak for, a class or a node of the code tree, into two tables of weights. The tables grow with the number of
training tokens up to a documented bound, so that they always fit a worker.

Counting covers all training tokens and is exact: words are counted by a 64-bit hash of their bytes. Weights are trained by
distributed gradient updates: every partition of the training texts passes over all of its tokens, in batches, by gradients
divided by the curvature seen so far, and the partitions' weights are averaged by the curvature behind each. Weights, and so
`score`, therefore depend a little on how rows fall into partitions; counts, base_score and n_known do not. The most frequent
words, at most HEAD, go to every task; the counts of all others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, chunks, mix, stored, table, word_hashes

#: Words that go to every task, classes, and bits of a word's code.
HEAD, CLASSES, CODE = 1 << 17, 8, 5
#: Training tokens for each row of class weights and each node weight, and the least and most of either, as powers of two.
TOKENS_A_ROW, ROWS, TOKENS_A_NODE, NODES = 1 << 11, (10, 17), 1 << 9, (14, 21)
#: Tokens of one gradient update.
BATCH = 1 << 16
#: Step of an update, and the curvature that stands for the belief that a weight is 0.
STEP, PRIOR = 0.5, 2.0
#: Partitions that train at most, and parts in which their weights are sent and added up.
TRAINERS, SLICES = 4096, 128
#: Partitions that may train however few tokens there are, and tokens of each where there are more.
LEAST_TRAINERS, TOKENS_A_TRAINER = 64, 1 << 24
SMOOTH = 0.1
CERTAIN, _JUMP = 60.0, 18
_END, _START = np.uint64(0x0E17D), np.uint64(0x57A27)
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
FEATURES = 3


def sequences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's lower-cased words, then its end; and where each text begins."""
    w = Words(buf, offsets)
    n = len(w.count)
    out = np.full(len(w) + n, _END, np.uint64)
    out[np.arange(len(w)) + w.text] = word_hashes(w, lower=True)
    return out, np.append(w.first[:-1] + np.arange(n), len(out))


def contexts(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of each token's features: the word before, the one before that, and both."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = begin[:-1]
    second = first[begin[1:] - first > 1] + 1
    one[first] = two[first] = two[second] = _START
    a, b = mix(one + np.uint64(1)), mix(two + np.uint64(2))
    return np.stack([a, b, mix(a * _ODD ^ b)])


def _power(n: float, bounds: tuple[int, int]) -> int:
    return 1 << int(np.clip(np.ceil(np.log2(max(n, 1))), *bounds))


class Counts:
    """The totals, the head of the vocabulary, its classes and codes; small enough for every task."""

    def __init__(self, head: np.ndarray, n: np.ndarray, bins: dict[int, tuple[int, int]], low: int, ends: int):
        """head: hashes with their counts n; bins: words and tokens by bin; low: the head's lowest bin."""
        self.total = sum(t for _, t in bins.values()) + ends
        self.distinct = sum(w for w, _ in bins.values()) + (ends > 0)
        of_bin, mass, inner = {}, 0.0, CLASSES - 2
        whole = sum(t for b, (_, t) in bins.items() if b >= low) or 1
        for b in sorted(bins):
            if b < low:
                of_bin[b] = 0
            else:
                of_bin[b] = 1 + min(inner - 1, int(inner * mass / whole))
                mass += bins[b][1]
        self.mass = np.zeros(CLASSES)
        self.mass[0] = SMOOTH  # one unknown word
        for b, (w, t) in bins.items():
            self.mass[of_bin[b]] += t + SMOOTH * w
        self.mass[-1] = ends + SMOOTH if ends else 0
        order = np.argsort(head)
        self.hash, self.count = np.append(head[order], np.uint64(2**64 - 1)), np.append(n[order], 0).astype(float)
        self.klass = np.array([of_bin[int(b)] for b in np.floor(np.log2(np.maximum(self.count[:-1], 1)) * 8)] + [0], np.int64)
        self.ends = ends
        # a class's mass by code; class 0, whose words no task knows, and the end have one code
        self.leaf = np.zeros((CLASSES, 1 << CODE))
        np.add.at(self.leaf, (self.klass[:-1], self.code(self.hash[:-1])), self.count[:-1] + SMOOTH)
        for k in (0, -1):
            self.leaf[k] = 0
            self.leaf[k, 0] = self.mass[k]
        # of node i of a class's code tree, the log odds that a path goes on to the right; CERTAIN where it has no choice
        self.odds = np.zeros((CLASSES, 1 << CODE), np.float32)
        for d in range(CODE):
            left, right = np.moveaxis(self.leaf.reshape(CLASSES, 1 << d, 2, -1).sum(3), 2, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.odds[:, 1 << d : 2 << d] = np.clip(np.nan_to_num(np.log(right / left), nan=0), -CERTAIN, CERTAIN)
        with np.errstate(divide="ignore"):
            self.share = np.log(self.mass / self.mass.sum()).astype(np.float32)
        # the first place in `hash` that a hash with given top bits can have
        self.jump = np.searchsorted(self.hash, np.arange(1 << _JUMP, dtype=np.uint64) << np.uint64(64 - _JUMP))
        self.rows, self.nodes = _power(self.total / TOKENS_A_ROW, ROWS), _power(self.total / TOKENS_A_NODE, NODES)

    @staticmethod
    def code(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - CODE)).astype(np.int64)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count (0: not in the head), class and code of each token."""
        at = self.jump[h >> np.uint64(64 - _JUMP)]
        while (further := self.hash[at] < h).any():  # a few steps: hashes are spread evenly
            at = at + further
        known = self.hash[at] == h
        count, klass = np.where(known, self.count[at], 0.0), np.where(known, self.klass[at], 0)
        end = h == _END
        if self.ends:
            count[end], klass[end] = self.ends, CLASSES - 1
        return count, klass, np.where((klass > 0) & (klass < CLASSES - 1), self.code(h), 0)


class Model:
    """Weights of classes (CLASSES by rows) and of nodes, each with the curvature behind it."""

    def __init__(self, known: Counts):
        self.known = known
        self.w, self.curve = np.zeros((CLASSES, known.rows), np.float32), np.zeros((CLASSES, known.rows), np.float32)
        self.node, self.bend = np.zeros(known.nodes, np.float32), np.zeros(known.nodes, np.float32)

    def class_rows(self, f: np.ndarray) -> np.ndarray:
        return (f >> np.uint64(20) & np.uint64(self.known.rows - 1)).astype(np.int64)

    def log_classes(self, rows: np.ndarray) -> np.ndarray:
        """Natural log of P(class | context); classes without a member have none."""
        x = self.known.share[:, None] + sum(np.take(self.w, r, axis=1) for r in rows)
        x -= x.max(0)
        return x - np.log(np.exp(x).sum(0))

    def path(self, f: np.ndarray, klass: np.ndarray, code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one step of each token's path: the direction, the log odds to the right, and the weights' places."""
        node = klass << CODE | 1 << depth | code >> (CODE - depth)
        places = ((f ^ (node + 1).astype(np.uint64) * _ODD) * _STEP >> np.uint64(65 - int(self.known.nodes).bit_length())).astype(np.int64)
        x = self.known.odds.ravel()[node] + self.node[places[0]] + self.node[places[1]] + self.node[places[2]]
        return code >> (CODE - 1 - depth) & 1, x, places

    def update(self, f: np.ndarray, klass: np.ndarray, code: np.ndarray) -> None:
        """One gradient update from a batch of tokens. The curvature of a class weight is taken at the class's overall share."""
        rows = self.class_rows(f)
        p = np.exp(self.log_classes(rows))
        p[klass, np.arange(len(klass))] -= 1
        share = np.exp(self.known.share)
        self.curve += (share * (1 - share))[:, None] * np.bincount(rows.ravel(), minlength=self.known.rows).astype(np.float32)
        for k, q in enumerate(p):
            sums = np.bincount(rows.ravel(), np.tile(q, FEATURES), self.known.rows)
            self.w[k] -= (STEP * sums / (PRIOR + self.curve[k])).astype(np.float32)
        # what is done for every node is done once an update, not for each step and feature
        sums, bend = np.zeros(self.known.nodes, np.float32), np.zeros(self.known.nodes, np.float32)
        for d in range(CODE):
            right, x, places = self.path(f, klass, code, d)
            p = 1 / (1 + np.exp(-x))
            gap, curve = right.astype(np.float32) - p, p * (1 - p)
            for at in places:
                np.add.at(sums, at, gap)
                np.add.at(bend, at, curve)
        self.bend += bend
        sums /= self.bend + np.float32(PRIOR)
        sums *= np.float32(STEP)
        self.node += sums

    def log_words(self, f: np.ndarray, klass: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Natural log of P(class and code | context) of each token."""
        out = self.log_classes(self.class_rows(f))[klass, np.arange(len(klass))].astype(float)
        for d in range(CODE):
            right, x, _ = self.path(f, klass, code, d)
            out -= np.logaddexp(0, np.where(right == 1, -x, x).astype(float))
        return out

    def parts(self) -> list[bytes]:
        """The curvatures, and the weights times them, cut into SLICES."""
        cut = lambda x: np.split(np.ascontiguousarray(x).ravel(), SLICES)
        return [np.concatenate(x).tobytes() for x in zip(*map(cut, (self.curve, self.curve * self.w, self.bend, self.bend * self.node)), strict=True)]

    def load(self, parts: dict[int, bytes]) -> None:
        """The averages of what `parts` of several models add up to."""
        a, b = self.w.size // SLICES, self.node.size // SLICES
        for i, data in parts.items():
            x = np.frombuffer(data, np.float64)
            curve, w, bend, node = np.split(x, [a, 2 * a, 2 * a + b])
            self.w.ravel()[i * a : (i + 1) * a] = w / np.maximum(curve, 1e-9)
            self.node[i * b : (i + 1) * b] = node / np.maximum(bend, 1e-9)
        self.curve = self.bend = np.zeros(0, np.float32)


def count_words(texts: DataFrame) -> DataFrame:
    """h, n: how often each word occurs, combined in each task before the shuffle."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([y for _, y in held]), minlength=len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in batches:
            buf, off = buffers(batch.column(0))
            for a, b in chunks(off):
                h = word_hashes(Words(buf, off[a : b + 1]), lower=True)
                h, n = np.unique(h, return_counts=True)
                held.append((h, n))
                size += len(h)
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def gather(texts: DataFrame) -> tuple[DataFrame, Counts]:
    """The stored counts of the whole training vocabulary, and what every task needs of them."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    counts = stored(count_words(texts).withColumn("bin", size), "counts")
    bins = {r["bin"]: (r["w"], r["t"]) for r in counts.groupBy("bin").agg(F.count("*").alias("w"), F.sum("n").alias("t")).collect()}  # at most 8 * 63
    low, words = 1 << 30, 0
    for b in sorted(bins, reverse=True):
        words += bins[b][0]
        if words > HEAD:
            break
        low = b
    head = counts.filter(F.col("bin") >= low).select("h", "n").toArrow()  # at most HEAD
    h, n = (head.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    return counts, Counts(h.view(np.uint64), n, bins, low, texts.count())


def trainers(known: Counts) -> int:
    """How many partitions train at most. Each sends all rows and nodes, 25 MB at their bounds, whatever it was given to read; so
    where there are many tokens each gets some 70 MB of text, and what is sent grows with the text and stays below it."""
    return min(TRAINERS, max(LEAST_TRAINERS, known.total // TOKENS_A_TRAINER))


def train(texts: DataFrame, known: Counts) -> Model:
    """The model, its weights averaged over partitions."""

    def run(batches):
        model, seen = Model(known), False
        for batch in batches:
            buf, off = buffers(batch.column(0))
            for a, b in chunks(off):
                h, begin = sequences(buf, off[a : b + 1])
                f = contexts(h, begin)
                _, klass, code = known.look(h)
                for i in range(0, len(h), BATCH):
                    model.update(f[:, i : i + BATCH], klass[i : i + BATCH], code[i : i + BATCH])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(model.parts(), pa.binary())], ["slice", "w"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(w, np.float32).astype(np.float64)
                total[s] = total[s] + x if s in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["slice", "w"])

    schema = "slice int, w binary"
    sums = texts.coalesce(trainers(known)).mapInArrow(run, schema).repartition("slice").mapInArrow(add, schema).collect()  # SLICES rows of bounded size
    model = Model(known)
    model.load({r["slice"]: bytes(r["w"]) for r in sums})
    return model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; see op7's contract.

    Rows with crc32(doc_id) mod 10 = 0 are held out of learning; a null doc_id counts as an empty string and so is held out.
    Null text counts as empty: its only token is the end. Repeated rows each count and each give a row; other columns are
    ignored. With no row to learn from, every token is the one unknown word, of probability 1.
    """
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10) == 0
    texts = docs.filter(~held).select(F.col("text").cast("string").alias("text"))
    counts, known = gather(texts)
    model = train(texts, known)
    ten = np.log(10)

    def run(batches):
        for batch in batches:
            buf, off = buffers(batch.column(2))
            for a, b in chunks(off):
                h, begin = sequences(buf, off[a : b + 1])
                count, klass, code = known.look(h)
                f = contexts(h, begin)
                gain = np.zeros(len(h))
                for i in range(0, len(h), BATCH):
                    gain[i : i + BATCH] = model.log_words(f[:, i : i + BATCH], klass[i : i + BATCH], code[i : i + BATCH])
                inside = count > 0
                with np.errstate(divide="ignore"):
                    lead = np.where(inside, np.log10(count + SMOOTH), 0.0)
                    gain = gain / ten - np.log10(known.leaf)[klass, code] + lead
                add = lambda x, begin=begin: np.add.reduceat(x, begin[:-1])
                rest = np.flatnonzero(~inside)
                at = np.searchsorted(rest, begin)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h[rest].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(begin)), pa.array(add(inside.astype(np.int64))), pa.array(add(lead)), pa.array(add(gain)), lists], ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = stored(rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>").withColumn("rid", F.monotonically_increasing_id()), "scores")
    found = rows.select("rid", F.explode("rest").alias("h")).join(counts.select("h", "n"), "h", "left")
    found = found.groupBy("rid").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(SMOOTH))).alias("tail"))
    out = rows.drop("rest").join(found, "rid", "left")
    tail = F.coalesce("tail", F.lit(0.0))
    base = F.col("base") + tail - F.col("n_tokens") * F.lit(float(np.log10(known.total + SMOOTH * (known.distinct + 1))))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + tail).alias("score"))


def op7_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
