import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for _, t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(texts, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = np.frombuffer(d, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_against_all_windows(docs, texts):
    assert key(tuple(r) for r in repeats.report(docs).collect()) == key(brute(texts, 200))


def test_hot_anchors_and_shuffled_joins(docs, texts, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_TOGETHER", 1)
    monkeypatch.setattr(repeats, "MOST_BROADCAST", 0)
    assert key(tuple(r) for r in repeats.report(docs).collect()) == key(brute(texts, 200))


def test_text_without_its_repeats(docs, texts):
    got = repeats.remove(docs).collect()
    assert set(got[0].asDict()) == set(docs.columns) and len(got) == len(texts)
    sizes = {}
    for (doc_id, n, removed, *_), (_, text) in zip(brute(texts, 200), texts):
        sizes.setdefault((doc_id, n - removed, text is None), 0)
        sizes[doc_id, n - removed, text is None] += 1
    for r in got:
        if r["doc_id"] is not None and r["text"] is not None:
            assert any(k[0] == r["doc_id"] and k[1] - 8 <= len(r["text"].encode()) <= k[1] for k in sizes)


def test_empty_table(nothing):
    assert repeats.report(nothing).collect() == []
    assert repeats.remove(nothing).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 99 + seed, 80).astype(np.uint8).tobytes()
    strings = [base[rng.integers(0, 40) :][: rng.integers(1, 60)] + bytes(rng.integers(0, 256, 3, dtype=np.uint8)) for _ in range(12)]
    strings += [strings[0], b"", b"\0\0\0"]
    found = repeats.RunIndex(strings, 100).matching_statistics()
    at = 0
    for i, s in enumerate(strings):
        for p in range(len(s)):
            best = 0
            for j, t in enumerate(strings):
                for q in range(len(t)):
                    if (i, p) != (j, q):
                        k = 0
                        while p + k < len(s) and q + k < len(t) and s[p + k] == t[q + k]:
                            k += 1
                        best = max(best, k)
            assert found[at + p] == best
        at += len(s) + 1


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    text = "".join(chr(97 + x) for x in np.random.default_rng(1).integers(0, 20, 9000))
    monkeypatch.setattr(repeats, "PIECE", 1000)
    whole = repeats.window_runs(np.frombuffer((text + text[4000:5000]).encode(), np.uint8), 200)
    monkeypatch.setattr(repeats, "PIECE", 1 << 21)
    assert all((a == b).all() for a, b in zip(whole, repeats.window_runs(np.frombuffer((text + text[4000:5000]).encode(), np.uint8), 200)))
    df = spark.createDataFrame([(1, text), (2, "z" + text[4000:5000])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.report(df).collect()}
    assert got == {1: 1000, 2: 1000}
    assert df.where(F.lit(True)).count() == 2
