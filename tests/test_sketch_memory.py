"""What a task holds while it codes sequences, and that pieces and views of Arrow's bytes lose nothing."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomsketch.functions import kmer
from loomsketch.operators import sketch
from loomsketch.params import SketchParams, kept_ranks

P = SketchParams(6, 4, 1, 42)


def coded(batch, **how):
    run = sketch._coder(P, how.get("folded", False), False, "least" in how, how.get("least", 0))
    return sorted((i, c, n) for b in run([batch]) for i, c, n in zip(*[x.to_pylist() for x in b.columns], strict=True))


def test_a_long_sequence_is_coded_in_pieces():
    seq = bytes(random.Random(1).choices(b"ACGTACGTACGTN", k=3_000_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([seq.decode()])], ["sketch_id", "seq"])
    code, n = np.unique(kmer.codes(kmer.dna_bases(np.frombuffer(seq, np.uint8)), P, kept_ranks(P)), return_counts=True)
    assert coded(batch) == [(7, *x) for x in zip(code.tolist(), n.tolist(), strict=True)]
    run = sketch._coder(P, False, False, False, 0)
    tracemalloc.start()
    try:
        list(run([batch]))
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("chunk", [50, 1 << 18])
def test_slices_nulls_and_qualities(monkeypatch, chunk):
    monkeypatch.setattr(sketch, "CHUNK", chunk)
    r = random.Random(2)
    seqs = ["", None, *["".join(r.choices("ACGTacgtN\n", weights=[9] * 8 + [1, 1], k=k)) for k in (3, 12, 49, 50, 51, 62, 4000)], None]
    marks = [None, "x", *["".join(r.choices("!I", weights=[1, 60], k=len(s) - k % 2)) for k, s in enumerate(seqs[2:-1])], ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs), pa.array(marks)], ["sketch_id", "seq", "q"]).slice(1)
    want = []
    for i, (s, q) in enumerate(zip(seqs[1:], marks[1:], strict=True), 1):
        masked = "".join("N" if j < len(q or "") and q[j] < "5" else c for j, c in enumerate(s or "")).encode()
        c, n = np.unique(kmer.codes(kmer.dna_bases(np.frombuffer(masked, np.uint8)), P, kept_ranks(P)), return_counts=True)
        want += [(i, *x) for x in zip(c.tolist(), n.tolist(), strict=True)]
    assert want and coded(batch, least=ord("5")) == want


def test_texts_are_not_copied():
    """A batch of 24 MB in 8000 texts."""
    text = "".join(random.Random(3).choices("abcdefghij ", k=3000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array([text] * 8000)], ["sketch_id", "seq"])
    run = sketch._coder(P, True, False, False, 0)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run([batch])) % 8000 == 0
        assert tracemalloc.get_traced_memory()[1] < 12e6
    finally:
        tracemalloc.stop()
