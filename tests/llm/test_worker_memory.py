"""What a Python worker holds at once over batches of whole texts; a worker keeps what its heap has grown to."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import near_dedup, quality_knn, sp_dropout
from tessera.llm._text import shingle_sets, slices

TEXTS = [" ".join(f"{'abcdefghij'[k % 10]}{(i * 7919 + k * 104729) % 5003}" for k in range(700)) for i in range(500)]
DOCS = pa.RecordBatch.from_pydict({"doc_id": list(range(len(TEXTS))), "text": TEXTS})


def peak_mb(rows) -> float:
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def scores():
    model = quality_knn.Model(np.ones(quality_knn.DIMS, np.float32), np.ones((quality_knn.DIMS, 8), np.float32), np.ones((32, 8), np.float32), np.arange(32) % 2.0, 25, 4)
    for _, _, counts in quality_knn._blocks(DOCS.column("text")):
        yield model.score(counts)


@pytest.mark.parametrize(
    "rows, most",
    [
        (lambda: near_dedup._sketches(5, 200)(iter([DOCS])), 25),
        (lambda: near_dedup._sets(5, 200, np.full(1 << 16, 2**64 - 1, np.uint64))(iter([DOCS.rename_columns(["node", "text"])])), 20),
        (scores, 25),
        (lambda: sp_dropout._round_trip(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 17, sp_dropout.round_trip.__defaults__[2], True)(iter([DOCS])), 50),
    ],
    ids=["sketches", "sets", "scores", "pieces"],
)
def test_worker_peak(rows, most):
    sp_dropout._model(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 17)  # before, as its pairs are no working memory
    found = peak_mb(rows())
    assert found < most, found


def test_registers_made_over_several_slices():
    """The same sets and registers, in order, as slice by slice; empty and null texts, and a text larger than a slice."""
    texts = pa.array(["", None, "one", *TEXTS[:150], " ".join(TEXTS[:90]), "a b c d e f"])
    got = list(near_dedup._set_groups(texts, 5))
    plain = [s for piece in slices(texts) for s in shingle_sets(piece, 5)]
    assert [first for first, _ in got] == np.cumsum([0, *[len(s) for _, s in got]])[:-1].tolist()
    sets = [s for _, some in got for s in some]
    assert len(got) > 1 and len(sets) == len(texts) and all(np.array_equal(a, b) for a, b in zip(sets, plain))
    assert np.array_equal(np.concatenate([near_dedup.setsketch(s, 200) for _, s in got]), near_dedup.setsketch(plain, 200))
