"""Token ids against the library that reads the same file, and the way back."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from quern.llm.tokens import encoded, vocabulary  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BYTES = {v: k for k, v in RANKS.items()}


def ids_of(texts):
    ids, at = vocabulary(PATH, P.PATTERN).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_like_library_and_back(texts):
    got = ids_of(texts)
    for text, ids in zip(texts, got, strict=True):
        if all(not 0xD800 <= ord(c) < 0xE000 for c in text):
            assert ids == LIBRARY.encode_ordinary(text)
            assert b"".join(BYTES[i] for i in ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "abab" * 900, "漢字かな" * 400, "é" * 1500, "<|endoftext|>", "x\r\n\r\n y", "👩‍👩‍👧 đệ", "ab" * 255 + "c", "ngườilaođộng" * 200])
def test_long_and_odd(text):
    assert ids_of([text]) == [LIBRARY.encode_ordinary(text)]


def test_forgetting_words_changes_nothing(monkeypatch):
    from quern.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    for text in ("một hai ba bốn", "năm sáu bảy", "một hai"):
        assert ids_of([text]) == [LIBRARY.encode_ordinary(text)]


def test_rows(spark):
    df = spark.createDataFrame([(1, "Điều 5."), (2, None), (3, ""), (1, "Điều 5."), (None, "x"), (4, "y " * 400_000)], "doc_id long, text string")
    got = [(r.doc_id, r.ids) for r in encoded(df.withColumn("ids", df.text), PATH, P.PATTERN).collect()]
    assert sorted(got, key=str) == sorted([(d, LIBRARY.encode_ordinary(t or "")) for d, t in ((r.doc_id, r.text) for r in df.collect())], key=str)
    assert encoded(df.limit(0), PATH, P.PATTERN).count() == 0
