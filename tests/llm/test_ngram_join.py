import random
import re
import uuid
from itertools import combinations

import numpy as np
import pytest

from brightloom.llm import ngram_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(texts, size, percent):
    """(doc_id, set size, least doc_id of the component) of each row, comparing all pairs."""
    sets = [shingles(t, size) for _, t in texts]
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            at[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if root(j) == root(i) and texts[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_against_all_pairs(docs, texts, size, percent):
    got = [tuple(r) for r in ngram_join.join(docs, size, percent).collect()]
    assert key(got) == key(brute(texts, size, percent))


def test_frequent_first_shingles_salts_and_parts(docs, texts, monkeypatch):
    for name, value in (("HOT", 2), ("PART_BYTES", 2000), ("PART", 2), ("QUERY_ROWS", 1), ("LEADERS", 2), ("MOST_BROADCAST", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    got = [tuple(r) for r in ngram_join.join(docs).collect()]
    assert key(got) == key(brute(texts, 4, 85))


def test_one_of_each_component_stays(docs, texts):
    want = brute(texts, 5, 80)
    got = [r for r in ngram_join.keep_one(docs).collect()]
    assert set(got[0].asDict()) == set(docs.columns)
    lone = sum(n == 0 for _, n, _ in want)
    assert len(got) == lone + len({c for _, n, c in want if n and c is not None}) + sum(n > 0 and c is None for _, n, c in want)
    assert {r["doc_id"] for r in got if r["text"] and r["text"].strip()} == {c for _, n, c in want if n}


def test_empty_table(nothing):
    assert ngram_join.join(nothing).collect() == []
    assert ngram_join.keep_one(nothing).collect() == []


def test_bound_on_shared_first_shingles():
    """Of two similar sets, the one whose first shingles end earlier holds the rest of what is common."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, rng.integers(5, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 60, 2).astype(np.uint64)]))
        if len(b) and ngram_join.similar(a, b, 85):
            fa, fb = (ngram_join.first_shingles(x, 85, np.zeros(0, np.uint64)) for x in (a, b))
            sizes = [np.array([len(x)]) for x in (a, a, b, b)]
            least = int(ngram_join.least_met(*sizes, 85)[0])
            assert len(np.intersect1d(fa, fb)) >= max(1, least)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(4, len(words) - 4), edits):
        words[at] = f"own{rng.random()}"
    return " ".join(words)


def test_dissimilar_edits_of_a_hot_text_do_not_all_meet(spark, monkeypatch, tmp_path):
    """What a hot text has left to each of its edited copies gives no row for every two of them, and no link is lost."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [(i, edited(rng, base, 5)) for i in range(120)] + [(i, edited(rng, base, 2)) for i in range(120, 140)]
    texts += [(i, edited(rng, texts[i - 140][1].split(), 1)) for i in range(140, 160)]
    real = ngram_join._meeting

    def counted(percent):
        meet = real(percent)

        def run(batches):
            for batch in meet(batches):
                (tmp_path / uuid.uuid4().hex).write_text(str(batch.num_rows))
                yield batch

        return run

    monkeypatch.setattr(ngram_join, "HOT", 10)
    monkeypatch.setattr(ngram_join, "_meeting", counted)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.join(df).collect()]
    assert key(got) == key(brute(texts, 4, 85))
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 10 * len(texts)


def test_bound_on_the_places_of_first_meetings():
    """Similar sets meet, in the first shingles of both, as often as is asked in places that leave enough."""
    rng = np.random.default_rng(5)
    hot = np.arange(0, 90, 4).astype(np.uint64)
    for _ in range(600):
        a = np.unique(rng.integers(0, 90, rng.integers(4, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 90, 3).astype(np.uint64)]))
        if not len(b) or not ngram_join.similar(a, b, 80):
            continue
        fa, fb = (ngram_join.first_shingles(x, 80, hot).tolist() for x in (a, b))
        places = [(fa.index(x), fb.index(x)) for x in set(fa) & set(fb)]
        met = sum(ngram_join.enough_left(ngram_join.left_over(len(a), i, 80), len(b), 80)
                  and ngram_join.enough_left(ngram_join.left_over(len(b), j, 80), len(a), 80) for i, j in places)
        least = int(ngram_join.least_met(*(np.array([len(x)]) for x in (a, a, b, b)), 80)[0])
        assert met >= max(1, min(ngram_join.MEETINGS, least))
