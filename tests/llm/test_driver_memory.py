"""What the pipeline's stages bring to the driver: the learned model alone, and a byte for each counter of shingles."""

import numpy as np
import pytest

from gleaner.llm import overlap, quality


def test_model_is_learned_in_a_task(spark, monkeypatch):
    texts = [f"word{i % 7} and some other words {i}" if i % 2 else f"Buy now!!! {i} $$$ {i % 5}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    counts = np.stack([quality.Terms().counts(texts[i]) for i in sorted(range(60), key=str)])  # keys are ordered as text
    want = quality.Model(counts, np.array([i % 2 for i in sorted(range(60), key=str)]))

    def refuse(*args, **kwargs):
        raise AssertionError("the driver learns the model")

    monkeypatch.setattr(quality.Model, "__init__", refuse)
    got = quality.fit(docs, labels)
    assert got.labels.tolist() == want.labels.tolist() and got.idf.tolist() == want.idf.tolist()
    assert np.allclose(got.score(counts), want.score(counts), atol=1e-5)


def test_no_labels_make_a_model_too(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    got = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert len(got.labels) == 0 and got.score(np.ones((2, quality.TERMS), np.float32)).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("size", [1 << 14, 64])
def test_a_counter_is_a_byte_and_keeps_the_order(spark, monkeypatch, size):
    monkeypatch.setattr(overlap, "PACKED", size)
    times = {7: 1, -5: 2, 900: 3, 901: 40, 1023: 41, 12: 200}
    rows = [(i, [x for x, n in times.items() if i < n]) for i in range(200)]
    got = overlap.counters(spark.createDataFrame(rows, "fp long, shingles array<long>"))
    assert got.dtype == np.uint8 and len(got) == 1024
    levels = [int(got[x & (len(got) - 1)]) for x in times]
    assert levels == [0, 8, 12, 42, 42, 61] and int((got > 0).sum()) == 5
