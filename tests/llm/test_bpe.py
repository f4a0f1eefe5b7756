import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veedor.llm import bpe

RANKS = bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
TEXTS = ["", None, "Hello  world's   'reve", "a" * 300, " \n\n x \t\r\n" * 40, "naïve ½ ² 東京 word " * 30, "🙂🙂  🙂" * 50, "ab cd " * 100, "no-white-space" * 40]


def test_encode_matches_library_for_any_text():
    @settings(max_examples=400, deadline=None)
    @given(st.text())
    def run(text):
        assert RANKS.encode(text).tolist() == RANKS.encoding.encode_ordinary(text)
        assert RANKS.decode(RANKS.encode(text).tolist()) == text.encode()

    run()


def test_chunks_in_a_task_do_not_change_ids():
    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "'s", "12", "é", "東", "?!", "\u00a0", "x" * 9]), max_size=40).map("".join), st.integers(1, 6), st.integers(0, 9))
    def run(text, overlap, more):
        assert RANKS.encode_chunked(text, 2 * overlap + more, overlap).tolist() == RANKS.encoding.encode_ordinary(text)

    run()
    text = "Some words, and more of them. " * 2_000
    assert RANKS.encode_chunked(text, 8_192, 256).tolist() == RANKS.encoding.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap,spread", [(8_192, 256, 65_536), (64, 16, 0), (20, 5, 100), (7, 3, 0), (64, 16, 300)])
def test_chunks_do_not_change_ids(spark, chunk, overlap, spread):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id " * 20, "x"), (3, "a" * 300, "x"), (3, "other text of one id " * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded), list(r.ids)) for r in bpe.decode(bpe.encode(docs, RANKS, chunk=chunk, overlap=overlap, spread=spread), RANKS).collect())
    want = sorted((i is None, i or 0, (t or "").encode(), RANKS.encoding.encode_ordinary(t or "")) for i, t, _ in rows)
    assert got == want


def test_report(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    ids = RANKS.encoding.encode_ordinary("some text")
    row = bpe.report(docs, RANKS).first()
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert row.decoded_sha256 == hashlib.sha256(b"some text").hexdigest()
    assert bpe.report(docs.limit(0), RANKS).count() == 0
