"""What the operators share: tables, intermediate tables in the shared folder, and vectorised words."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: what parts words. Everything else belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes of text that are taken at once, so that a worker's arrays stay small beside its heap.
CHUNK = 1 << 18

#: Stored tables by application, each with the scope it was made in.
_tables: dict[str, list[tuple[str, str]]] = {}
_scopes: list[str] = [""]
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of
    its own; a cluster has no folder that would do, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="loomsketch-")
    return "file://" + _local[sc.applicationId]


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs no more
    than what comes after. The table goes when the application ends, or by `release`."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/loomsketch-{app}"
    if app not in _tables:
        _tables[app] = []
        fs, where = _files(spark, top)
        fs.deleteOnExit(where)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[app].append((path, _scopes[-1]))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str):
    """Tables stored inside belong to `name`, and `release` can remove them together."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def release(spark: SparkSession, name: str, keep: DataFrame) -> None:
    """Removes the tables stored in a scope but those that `keep` reads: what made it is not needed any more."""
    app = spark.sparkContext.applicationId
    mine = [path for path, owner in _tables.get(app, []) if owner == name]
    used = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if mine else set()
    for path in mine:
        if path.rsplit("/", 1)[1] not in used:
            fs, where = _files(spark, path)
            fs.delete(where, True)
            _tables[app].remove((path, name))


def forget(spark: SparkSession) -> None:
    """Removes the folder of a local session without spark.checkpoint.dir."""
    path = _local.pop(spark.sparkContext.applicationId, None)
    if path:
        shutil.rmtree(path, ignore_errors=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Runs (a, b) of rows with at most `limit` bytes each, or one row that is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def texts(column: pa.Array) -> list[bytes]:
    """Each text as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """The words of some texts: `start` and `end` in `buf`, and where each text's words begin in `first`."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = buf = buf[offsets[0] : offsets[-1]]
        self.off = off = offsets - offsets[0]
        inside = ~SPACE[buf]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = off[:-1] < off[1:]
        at, last = off[:-1][full], off[1:][full] - 1
        begins[at], ends[last] = inside[at], inside[last]
        self.inside = inside
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(off) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed and compared one by one; others eight bytes of all words at a time.
LANES = 8
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED, _ODD, _STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))


def first_bytes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on, as one number."""
    return _eights(buf)[start] & _LOW[np.minimum(size, 8)]


def word_hashes(words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (with A-Z as a-z if lower). Eight bytes at a time go through `mix`, so that no
    arrangement of letters cancels out, as it can in sums of powers."""
    buf = lowered(words.buf) if lower else words.buf
    eights, size = _eights(buf), words.end - words.start
    h = mix(size.astype(np.uint64) * _ODD + _SEED)
    h = mix(h ^ (eights[words.start] & _LOW[np.minimum(size, 8)]))
    for k in range(1, LANES):
        at = np.flatnonzero(size > 8 * k)
        if not len(at):
            break
        h[at] = mix(h[at] ^ (eights[words.start[at] + 8 * k] & _LOW[np.minimum(size[at] - 8 * k, 8)]))
    at = np.flatnonzero(size > 8 * LANES)
    if len(at):
        data = memoryview(np.ascontiguousarray(buf))
        h[at] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
    return h


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of the different words: one place each, and for every word the number of its like. Words with equal hashes are compared
    byte by byte; should two differ, words are told apart by their bytes alone."""
    h = word_hashes(words)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    own, like = np.arange(len(h)), first[inverse]
    at = np.flatnonzero(own != like)
    like, size, eights = like[at], words.end - words.start, _eights(words.buf)
    fine = bool((size[at] == size[like]).all())
    for k in range(LANES):
        more = size[at] > 8 * k
        if not fine or not more.any():
            break
        at, like = at[more], like[more]
        low = _LOW[np.minimum(size[at] - 8 * k, 8)]
        fine = bool(((eights[words.start[at] + 8 * k] & low) == (eights[words.start[like] + 8 * k] & low)).all())
    if fine and len(at):
        data, a, b = memoryview(np.ascontiguousarray(words.buf)), words.start.tolist(), words.end.tolist()
        fine = all(data[a[i] : b[i]] == data[a[j] : b[j]] for i, j in zip(at.tolist(), like.tolist(), strict=True) if b[i] - a[i] > 8 * LANES)
    if not fine:
        data, seen, first = words.buf.tobytes(), {}, []
        inverse = np.empty(len(h), np.int64)
        for i, (a, b) in enumerate(zip(words.start.tolist(), words.end.tolist(), strict=True)):
            inverse[i] = seen.setdefault(data[a:b], len(seen))
            if inverse[i] == len(first):
                first.append(i)
        first = np.array(first, np.int64)
    return first, inverse


def runs(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n neighbours, by doubling: each step mixes two shorter runs."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    x, size = mix(h ^ np.uint64(seed)), 1
    while size * 2 <= n:
        x = mix(x[:-size] * _ODD + x[size:])
        size *= 2
    return mix(x[: len(x) - (n - size)] * _STEP + x[n - size :]) if n > size else x
