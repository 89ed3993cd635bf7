import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from brightloom.llm import range_coder, token_files, words  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(texts):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    for doc_id, text in order:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [1 << 20, 700])
def test_files_hold_what_the_library_gives(spark, docs, texts, tmp_path, block_ids):
    token_files.write(docs, str(tmp_path / "ids"), PATH, block_ids=block_ids)
    got = [tuple(r) for r in token_files.read(spark, str(tmp_path / "ids")).drop("file", "ordinal").collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(texts)


def test_characters_beyond_and_special_tokens(spark, tmp_path):
    texts = [(1, "漢字 <|endoftext|> x"), (2, "a  b  \u0085c\n\n d"), (3, "Ωmega 😀 don't we'll"), (4, "x²½ 12 ٣٤"), (5, "<|endoftext|>")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    token_files.write(df, str(tmp_path / "ids"), PATH)
    got = [tuple(r) for r in token_files.read(spark, str(tmp_path / "ids")).drop("file", "ordinal").collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(texts)


def test_empty_table(spark, nothing, tmp_path):
    token_files.write(nothing, str(tmp_path / "ids"), PATH)
    assert token_files.read(spark, str(tmp_path / "ids")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.full(n, 50256), rng.integers(0, 4, n), np.arange(n) % 7):
        assert (range_coder.decode(range_coder.encode(ids, 50257)) == ids).all()


def test_predictable_ids_take_little_room():
    ids = np.tile(np.arange(1000), 200)
    assert len(range_coder.encode(ids, 50257)) < len(ids) // 4


def test_damage_is_noticed():
    block = bytearray(range_coder.encode(np.arange(3000), 50257))
    block[len(block) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        range_coder.decode(bytes(block))


class Counting:
    """The library's tokenizer, and how many bytes it was given."""

    def __init__(self):
        self.own, self.given = Tokenizer.from_file(PATH), 0

    def get_vocab(self):
        return self.own.get_vocab()

    def encode_batch_fast(self, texts, add_special_tokens):
        self.given += sum(len(t.encode()) for t in texts)
        return self.own.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def by_pieces(store, texts):
    pieces, before = words.cuts(pa.array(texts, pa.string()))
    ids, sizes = store.of(pieces)
    ends = np.append(0, np.cumsum(sizes))[before]
    assert ends[-1] == len(ids)
    return [ids[b:e].tolist() for b, e in zip(ends[:-1], ends[1:])]


PARTS = [*"ab Z9 .,;'!?)(<>|-_\n\t\r\x0b\x1c\x1f\x00 \x85\xa0éß×÷ÀΩя漢字\u0300\u1680\u2003\u3000\ufeff😀²½٣   ",
         "<|endoftext|>", "'s", "'LL", " the", " don't", "  ", "\n\n", " x.", "3.5,"]


@pytest.mark.parametrize("most", [20, 500_000])
def test_pieces_give_the_ids_of_whole_texts(most):
    rng, tokenizer = random.Random(most), Tokenizer.from_file(PATH)
    store = words.PieceIds(tokenizer, most=most, together=7)
    for _ in range(60):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(30)]
        assert by_pieces(store, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(store.known[0]) <= most
    assert by_pieces(store, []) == [] and by_pieces(store, ["", ""]) == [[], []]


def test_pieces_are_encoded_once():
    tokenizer = Counting()
    store = words.PieceIds(tokenizer, most=400)
    texts = [" ".join(f"word{i % 300}," for i in range(k, k + 5000)) for k in range(3)]
    first = by_pieces(store, texts)
    once = tokenizer.given
    assert once < 300 * 10 * 3 < sum(map(len, texts)) / 10
    assert by_pieces(store, texts) == first and tokenizer.given == once
    # a table of other words: the store is full, and what it holds is forgotten
    other = [" ".join(f"term{i}" for i in range(1000))]
    by_pieces(store, other)
    by_pieces(store, other)
    assert 0 < len(store.known[0]) <= 400 and "term999" not in store.known[0].to_pylist()


def test_texts_reach_python_as_they_are(spark, docs, tmp_path, monkeypatch):
    """Arrays of words, split by the JVM, took more time than their encoding needs."""
    seen, mapped = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: (seen.append(self.columns), mapped(self, *a, **b))[1])
    token_files.write(docs, str(tmp_path / "ids"), PATH)
    assert seen == [["doc_id", "text"]]


def test_carries_go_through_all_words_of_a_stream():
    top = (1 << 32) - 1
    # two streams; the second sends a word that all before it carry
    sent = np.array([0, 1, 1, 0, 1, 1])
    values = np.array([0, 0, top, 7, top, (1 << 32) + 5])
    last = np.array([9, top + 2])
    first, body = range_coder._in_reading_order(sent, values, 2, last)
    got = {0: [first[0], *body[sent == 0]], 1: [first[1], *body[sent == 1]]}
    for stream, own in got.items():
        want = 0
        for word in [*values[sent == stream].tolist(), int(last[stream]), 0]:
            want = (want << 32) + word
        read = 0
        for word in own:
            read = (read << 32) + int(word)
        assert read == want >> 1


@pytest.mark.parametrize("steps", [1, 7, 256, 1024])
def test_coder_round_trip_of_mixed_ids(steps):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 12_000))
        ids = np.where(rng.random(n) < rng.random() ** 3, rng.integers(0, 50257, n), rng.integers(0, 3, n))
        assert (range_coder.decode(range_coder.encode(ids, 50257, steps)) == ids).all()


def test_a_cut_block_is_refused():
    block = range_coder.encode(np.arange(9000) % 977, 50257)
    for keep in (3, 10, 24, len(block) // 2 // 4 * 4, len(block) - 4):
        with pytest.raises(ValueError):
            range_coder.decode(block[:keep])
