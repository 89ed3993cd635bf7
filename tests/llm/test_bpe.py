import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from brightloom.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def test_against_the_library(docs, texts, library):
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=repr) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x4FF), max_size=60) | st.text("aeiou 'sTLR<|>endoftx", max_size=60))
def test_any_text(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ΣΑΣ ΟΔΟΣ", "<|startoftext|>a<|endoftext|>", "漢字 😀👍🏽", "İ ﬁ ½", "a" * 5000, "\0<|endoftext|>"])
def test_odd_texts(own, library, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_columns_stay(docs, texts, own):
    got = bpe.encode_decode(docs, PATH)
    assert got.columns == [*docs.columns, "token_ids", "decoded"]
    for r in got.collect():
        assert r["token_ids"] == own.encode(r["text"] or "") and r["decoded"] == own.decode(r["token_ids"])


def test_empty_table(nothing):
    assert bpe.digests(nothing, PATH).collect() == []
    assert bpe.encode_decode(nothing, PATH).collect() == []
