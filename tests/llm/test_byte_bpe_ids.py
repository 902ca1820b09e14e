"""The byte BPE gives the token ids themselves, and decodes ids from anywhere."""

from __future__ import annotations

import numpy as np
import pytest

from ebbflow.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [(1, "the quick  brown fox\r\n"), (2, None), (3, ""), (4, "ünïcödé ☃ 漢字 " * 3), (5, "x" * 3000), (6, "it's ab" + "ab" * 3000 + " naïve×1,2 don't\t"), (None, "no id"), (1, "the same id twice")]


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_ids_and_their_bytes(spark, encoding):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = byte_bpe.decode_documents(byte_bpe.token_ids(docs, PATH, public_tokenizers.PATTERN, block_bytes=64, bucket_bytes=16), PATH).collect()
    got = [(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in rows]
    assert sorted(got, key=str) == sorted([(i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS], key=str)


def test_decoding_takes_any_ids(spark, encoding):
    ids = [np.array(encoding.encode_ordinary("red fish")[::-1], "<u4"), np.array([0, 50255, 0], "<u4"), np.zeros(0, "<u4")]
    frame = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(ids)] + [(9, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode_documents(frame, PATH).collect()}
    assert got[9] is None and all(bytes(got[i]) == encoding.decode_bytes(v.tolist()) for i, v in enumerate(ids))
