import hashlib
import re

import pytest

from brightloom.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(texts, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in texts:
        w, hit, ids = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in wins}:
                found = wins.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if found:
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(spark, texts):
    long = words(texts[66][1])
    rows = [(1, " ".join(long[100:130])), (2, " ".join(long[110:125]).upper()), (2, " ".join(long[500:504])), (10, "é " * 3), (3, None), (4, ""),
            (5, "!!! ..."), (6, " ".join(words(texts[52][1])[30:60])), (6, " ".join(words(texts[52][1])[30:60])), (None, " ".join(long[700:712])),
            (7, " ".join(long[7000:7005]) + " never seen"), (8, "one"), (9, "ab ab ab ab ab ab ab ab ab ab ab")]
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, row int").cache(), rows


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("most", [500_000, 0])
def test_against_every_window(docs, texts, items, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    got = [tuple(r) for r in decontaminate.report(docs, items[0]).collect()]
    assert key(got) == key(brute(texts, items[1]))


def test_clean_documents_stay(docs, texts, items):
    got = decontaminate.clean(docs, items[0])
    assert got.columns == docs.columns
    want = [(i, t) for (i, t), r in zip(texts, brute(texts, items[1])) if not r[-1]]
    assert key((r["doc_id"], r["text"]) for r in got.collect()) == key(want)


def test_empty_tables(docs, nothing, items):
    assert decontaminate.report(nothing, items[0]).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.report(docs, items[0].limit(0)).collect())
    assert decontaminate.clean(docs, items[0].limit(0)).count() == docs.count()
