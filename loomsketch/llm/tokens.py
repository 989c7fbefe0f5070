"""BPE by forced boundaries (operator 10).

A pair of neighbouring byte symbols that occurs inside no token of the vocabulary can never be merged across, so a text
may be cut there and the fragments encoded one by one. Two kinds of cut follow from the vocabulary: no token holds white
space, so a text falls apart at ASCII white space; and inside a word, at every pair of symbols that no token holds. The
distinct words of a run of texts are cut so and their fragments merged side by side, in arrays.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cached_property, lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .common import Words, buffers, chunks, distinct_words, first_bytes, mix, table

#: Characters that NFC leaves alone, that are no space, and that are lower-cased one by one into such characters.
_PLAIN = "".join(chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)] if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250)
#: Words of more bytes are merged by the library's model, whose time is nearly linear in their length; the ids are the same.
LONG = 64
#: Byte-level symbols: bytes that are not printable in Latin-1 are moved beyond it.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SYMBOLS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """Remembers make(key) for keys of up to 64 bytes, in two generations of at most `limit` entries each.

    A full generation becomes the old one and its entries move up again when they are asked for: what is frequent stays,
    what is rare goes, and memory is bounded.
    """

    def __init__(self, make, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class RecentWords:
    """The ids of words seen lately, in a table of fixed size that the runs of a worker share. A word has one place in it, which
    the last one that came there holds; it is known by all its bytes, so what is found is never another word's."""

    BITS, BYTES, IDS = 18, 16, 6  # places; the longest word and the most ids that are kept

    def __init__(self):
        n = 1 << self.BITS
        self.head, self.tail, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.count, self.ids = np.zeros(n, np.int64), np.zeros((n, self.IDS), np.uint32)

    def look_up(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, none of them empty, and how many each has; make(buf, start, end) gives those of new ones."""
        size = end - start
        head, tail = first_bytes(buf, start, size), first_bytes(buf, np.minimum(start + 8, len(buf)), np.maximum(size - 8, 0))
        place = (mix(head ^ mix(tail ^ size.astype(np.uint64))) >> np.uint64(64 - self.BITS)).astype(np.int64)
        known = (self.size[place] == size) & (self.head[place] == head) & (self.tail[place] == tail)
        new, old = np.flatnonzero(~known), np.flatnonzero(known)
        made, n = make(buf, start[new], end[new])
        count = self.count[place]
        count[new] = n
        begin = np.cumsum(count) - count
        ids, from_ = np.empty(count.sum(), np.uint32), np.cumsum(n) - n
        ids[np.arange(len(made)) + np.repeat(begin[new] - from_, n)] = made
        at = place[old]
        for k in range(self.IDS):
            more = count[old] > k
            old, at = old[more], at[more]
            ids[begin[old] + k] = self.ids[at, k]
        keep = np.flatnonzero((size[new] <= self.BYTES) & (n <= self.IDS))
        keep = keep[np.unique(place[new[keep]], return_index=True)[1]]  # one word for a place
        kept, at = new[keep], place[new[keep]]
        self.head[at], self.tail[at], self.size[at], self.count[at] = head[kept], tail[kept], size[kept], n[keep]
        for k in range(self.IDS):
            more = n[keep] > k
            self.ids[at[more], k] = made[from_[keep[more]] + k]
        return ids, count


class ForcedBoundaryEncoder:
    """Encodes as the tokenizers library does with the file at `path`, add_special_tokens=False.

    `path`: a tokenizer of the tokenizers library with a BPE model that has an end-of-word suffix, a byte-level
    pre-tokenizer, and added tokens that are matched as they are.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])]
        if odd or not self.suffix or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("not a tokenizer of the kind that ForcedBoundaryEncoder takes")
        self.tokenizer = Tokenizer.from_file(path)
        vocab, merges = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.inner = models.BPE(vocab=vocab, merges=merges)
        self.last = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix)
        bodies = {t.removesuffix(self.suffix) for t in vocab}
        #: Every pair of symbols that stands inside some token. A pair that is not here marks a certain cut.
        self.joined = {t[i : i + 2] for t in bodies for i in range(len(t) - 1)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] if spec["normalizer"]["type"] == "Sequence" else []
        if kinds != ["NFC", "Replace", "Lowercase"] or r"\p{L}" not in pattern:
            raise ValueError("not a tokenizer of the kind that ForcedBoundaryEncoder takes")
        self.vocab, self.merges = vocab, merges
        self.odd = Memo(self.word, 20_000)
        self.recent = RecentWords()
        names = {v: k for k, v in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        #: Each id's decimal digits and token, as bytes.
        self.digits, self.names = [b"%d" % i for i in range(max(names) + 1)], [names.get(i, "").encode() for i in range(max(names) + 1)]

    def cuts(self, piece: str) -> list[str]:
        """The fragments of a pre-token between its forced boundaries."""
        joined = self.joined
        if joined.issuperset(map(add, piece, piece[1:])):
            return [piece]
        out, a = [], 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in joined:
                out.append(piece[a:i])
                a = i
        out.append(piece[a:])
        return out

    def _piece(self, piece: str) -> list[int]:
        *inner, last = self.cuts(piece)
        return [t.id for x in inner for t in self.inner.tokenize(x)] + [t.id for t in self.last.tokenize(last)]

    def word(self, word: bytes) -> list[int]:
        """The ids of a run of bytes without ASCII white space."""
        if b"<" in word and self.added_re:
            out = []
            for i, x in enumerate(self.added_re.split(word.decode("utf-8", "replace"))):
                out += [self.added[x]] if i % 2 else self._plain(x.encode()) if x else []
            return out
        return self._plain(word)

    def _plain(self, word: bytes) -> list[int]:
        text = self.tokenizer.normalizer.normalize_str(word.decode("utf-8", "replace"))
        return [i for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) for i in self._piece(x)]

    @cached_property
    def tables(self) -> Tables:
        return Tables(self)

    def encode_texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin.

        White space cuts texts into words; the distinct words among them are encoded together, then each takes its ids.
        """
        w = Words(buf, offsets)
        first, inverse = distinct_words(w)
        ids, count = self.recent.look_up(w.buf, w.start[first], w.end[first], self._distinct)
        begin = np.concatenate([[0], np.cumsum(count)])
        n = count[inverse]
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(bounds[-1]) + np.repeat(begin[inverse] - bounds[:-1], n)
        return ids[at], bounds[w.first]

    def _distinct(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words and how many each has. Words of plain characters are cut at forced boundaries and merged
        fragment by fragment, all at once; other words, and long ones, go through word()."""
        t, size = self.tables, end - start
        odd = size > LONG
        keep = np.flatnonzero(~odd)
        n, base = size[keep], np.concatenate([[0], np.cumsum(size[keep])])
        b = buf[np.arange(base[-1]) + np.repeat(start[keep] - base[:-1], n)]
        word = np.repeat(np.arange(len(keep)), n)
        head = np.flatnonzero((b & 0xC0) != 0x80)
        point = b[head].astype(np.int64)
        two = (point >= 0xC2) & (point < 0xCA)
        at = head[two]
        point[two] = (point[two] & 0x1F) << 6 | b[at + 1] & 0x3F
        point[(b[head] >= 0xCA)] = 0
        kind, lower = t.kind[point], t.lower[point]
        bad = np.zeros(len(keep), bool)
        bad[word[head[kind == 0]]] = True
        odd[keep[bad]] = True
        b = b.copy()
        b[head] = np.where(lower < 128, lower, 0xC0 | lower >> 6)
        b[at + 1] = 0x80 | lower[two] & 0x3F
        opens = np.ones(len(head), bool)  # a pre-token begins with this character
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (word[head[1:]] != word[head[:-1]])
        piece = np.zeros(len(b) + 1, bool)
        piece[head[opens]] = True
        piece[-1] = True
        cut = piece[:-1].copy()
        cut[1:] |= ~t.joined[b[:-1], b[1:]]
        symbol = np.where(piece[1:], t.last[b], t.inner[b])
        fine = ~bad[word]
        merged = np.full(len(b), -1, np.int64)
        t.merge(symbol[fine], np.cumsum(cut)[fine], np.flatnonzero(fine), merged)
        has = merged >= 0
        count = np.zeros(len(start), np.int64)
        count[keep] = np.bincount(word[has], minlength=len(keep))
        ids = merged[has]
        if odd.any():  # put the ids of odd words in their places
            data, rows = buf.tobytes(), np.flatnonzero(odd)
            found = [self.odd[data[start[i] : end[i]]] for i in rows]
            where = np.concatenate([[0], np.cumsum(count)])[rows]
            count[rows] = [len(x) for x in found]
            ids = np.insert(ids, np.repeat(where, count[rows]), [i for x in found for i in x])
        return ids.astype(np.uint32), count

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_texts(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: tokens joined by one space."""
        return " ".join(t for t in map(self.tokenizer.id_to_token, ids) if t is not None)


class Tables:
    """The vocabulary as arrays: what each byte and character is, which pairs merge, in what order and into what."""

    def __init__(self, it: ForcedBoundaryEncoder):
        shown = {b: chr(_SYMBOLS.get(b, b)) for b in range(256)}
        byte = {c: b for b, c in shown.items()}
        self.inner = np.array([it.vocab[shown[b]] for b in range(256)])
        self.last = np.array([it.vocab[shown[b] + it.suffix] for b in range(256)])
        self.joined = np.zeros((256, 256), bool)
        for x, y in it.joined:
            if x in byte and y in byte:
                self.joined[byte[x], byte[y]] = True
        #: 1 letter, 2 number, 3 other, 0 what word() must look at: apostrophes and < besides all that is not plain.
        self.kind, self.lower = np.zeros(0x280, np.int64), np.zeros(0x280, np.int64)
        for c in _PLAIN:
            if c not in "'<":
                self.kind[ord(c)] = {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3)
                self.lower[ord(c)] = ord(c.lower())
        self.result = np.array([it.vocab[a + b] for a, b in it.merges] + [0])
        self.never = len(it.merges)
        # two hash tables; each pair has its place in one of them
        self.bits, self.factors = 17, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        self.keys = [np.full(1 << self.bits, -1, np.int64) for _ in "ab"]
        self.ranks = [np.full(1 << self.bits, self.never, np.int64) for _ in "ab"]
        slots: list[dict[int, tuple[int, int]]] = [{}, {}]
        for rank, (a, b) in enumerate(it.merges):
            item, side = (it.vocab[a] << 16 | it.vocab[b], rank), 0
            for _ in range(500):
                place = (item[0] * self.factors[side] & (1 << 64) - 1) >> 64 - self.bits
                item, slots[side][place] = slots[side].get(place), item
                if item is None:
                    break
                side ^= 1
            else:
                raise ValueError("the merges don't fit the hash tables")
        for side in (0, 1):
            for place, (key, rank) in slots[side].items():
                self.keys[side][place], self.ranks[side][place] = key, rank

    def rank(self, key: np.ndarray) -> np.ndarray:
        u, shift = key.astype(np.uint64), np.uint64(64 - self.bits)
        x, y = (((u * np.uint64(f)) >> shift).astype(np.int64) for f in self.factors)
        return np.where(self.keys[0][x] == key, self.ranks[0][x], np.where(self.keys[1][y] == key, self.ranks[1][y], self.never))

    def merge(self, symbol: np.ndarray, fragment: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
        """Merges within each fragment, pair of lowest rank first and from the left; writes symbols to out at their places."""
        while len(symbol):
            same = fragment[1:] == fragment[:-1]
            rank = np.full(len(symbol), self.never)
            inside = np.flatnonzero(same)
            rank[inside] = self.rank(symbol[inside] << 16 | symbol[inside + 1])
            begin = np.flatnonzero(np.append(True, ~same))
            low = np.minimum.reduceat(rank, begin)
            low = np.repeat(low, np.diff(np.append(begin, len(symbol))))
            done = low == self.never
            out[place[done]] = symbol[done]
            hit = (rank == low) & ~done
            run = hit[1:] & hit[:-1]
            if run.any():  # of overlapping pairs every second one, from the left
                at = np.arange(len(hit))
                since = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, 0))
                hit &= (at - since) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = self.result[rank[at]]
            keep = ~done
            keep[at + 1] = False
            symbol, fragment, place = symbol[keep], fragment[keep], place[keep]


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def encoded(column: pa.Array, path: str, limit: int = 1 << 20):
    """For each run of texts in a column: its first row, the ids of its texts, and where each text's begin."""
    buf, off = buffers(column)
    for a, b in chunks(off, limit):
        yield a, *encoder(path).encode_texts(buf, off[a : b + 1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of every row. Null text: empty."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for a, ids, at in encoded(batch.column(1), path):
                names = encoder(path).names
                back = [b" ".join([names[i] for i in ids[u:v].tolist()]) for u, v in zip(at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(back)), lists, pa.array(back, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Of every row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty; an empty text has no tokens and the digests of an empty string. A null doc_id is kept as
    it is, repeated rows each give a row, other columns are ignored. Texts are taken whole, whatever their length; memory
    is that of one Arrow batch, of 16 MB of recent words and of the arrays for 1 MB of text, or for one text that is longer.
    """
    path = path or default_path()

    def run(batches):
        sha = hashlib.sha256
        for batch in batches:
            for a, ids, at in encoded(batch.column(1), path):
                digits, names, x, y = encoder(path).digits, encoder(path).names, [], []
                for u, v in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = ids[u:v].tolist()
                    x.append(sha(b" ".join([digits[i] for i in own])).hexdigest())
                    y.append(sha(b" ".join([names[i] for i in own])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(x)), pa.array(np.diff(at)), pa.array(x, pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
