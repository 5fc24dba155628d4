import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex

from rowforge.llm import op10_bpe as op

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PAT = regex.compile(P.PATTERN)


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (16, 1), (50, 20)])
def test_chunks_agree_with_whole(chunk, overlap):
    enc = op.encoding(PATH, P.PATTERN)
    rng = random.Random(chunk)
    for _ in range(300):
        text = "".join(rng.choice(["a", "it's", " ", "  ", "\n", "\n ", "é", "1", "...", "\x1c", "日本", "'ll", "\t", "word"]) for _ in range(rng.randint(0, 80)))
        assert op.encode_text(text, enc, PAT, chunk, overlap).tolist() == enc.encode_ordinary(text)


def test_long_runs():
    enc = op.encoding(PATH, P.PATTERN)
    for text in ("a" * 5000, " " * 3000 + "x", "\n" * 2000, "ab " * 4000):
        assert op.encode_text(text, enc, PAT, 64, 16).tolist() == enc.encode_ordinary(text)


def test_a_run_that_the_library_refuses():
    enc = op.encoding(PATH, P.PATTERN)
    ids = op.encode_text("x" + " " * 1_000_000, enc, PAT)
    assert op.decode_ids(ids.astype(np.int64), op.token_table(PATH, P.PATTERN)) == b"x" + b" " * 1_000_000
    assert ids.tolist() == [*enc.encode_ordinary("x"), *enc._encode_single_piece(" " * 1_000_000)]


def test_runs_just_under_and_over_the_bound():
    enc = op.encoding(PATH, P.PATTERN)
    for n in (op.LONG_RUN - 1, op.LONG_RUN, op.LONG_RUN + 5000):
        for text in (" " * n + "x", "it's" + "\n" * n, "a" * 50 + "\u3000" * n + "b c"):
            assert op.encode_text(text, enc, PAT).tolist() == enc.encode_ordinary(text)


def test_documents_go_through_chunks():
    """With the query's own parameters, a text of ordinary length is cut several times, and the ids are the library's."""
    enc, rng = op.encoding(PATH, P.PATTERN), random.Random(1)
    text = "".join(rng.choice(["a", "it's", " ", "  ", "\n", "é", "1", "...", "日本", "word"]) for _ in range(20_000))
    assert len(op.chunk_cuts(text, PAT)) > 8
    assert op.encode_text(text, enc, PAT).tolist() == enc.encode_ordinary(text)


def test_rows(spark):
    rows = [(3, "It's été\n", 1), (1, None, 2), (2, "", 3), (3, "It's été\n", 1), (None, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = op.encode_digests(docs, PATH, P.PATTERN).collect()
    assert len(got) == 5
    enc = op.encoding(PATH, P.PATTERN)
    for r in got:
        text = {3: "It's été\n", None: "x"}.get(r.doc_id, "")
        ids = np.array(enc.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert op.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
