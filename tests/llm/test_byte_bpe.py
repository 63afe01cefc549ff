import hashlib

import public_tokenizers as P
import pytest

from gleaner.llm import byte_bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ROWS = [
    (1, None), (2, ""), (3, "a" * 3000 + "  \n b"), (4, "  " * 900 + "x's"), (5, "\n" * 1000), (6, "It's  a test, isn't it?  " * 60),
    (7, "Été où ça va 123 4567  \t x" * 30), (7, "Été où ça va 123 4567  \t x" * 30), (8, "日本語のテキスト🙂 " * 80), (None, "don't we'll  " * 40), (9, " " * 97), (10, "b" * 97 + " c"),
]


@pytest.mark.parametrize(("step", "overlap"), [(97, 19), (40, 7), (1 << 16, 1 << 11)])
def test_same_as_the_library_whatever_the_chunks(spark, step, overlap):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.digests(docs, RANKS, P.PATTERN, step=step, overlap=overlap).collect()), key=str)
    encoder = byte_bpe.tokenizer(RANKS, P.PATTERN)
    want = []
    for k, t in ROWS:
        ids = encoder.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0
