import random

import numpy as np
import pytest

from brightloom.llm import labelled, quality_zstd, toxicity

WORDS = "the lake was calm and a boat went over it to the far side where people had put up tents for the night".split()
TERMS = ["grobblefink", "snarkwit", "mudhead"]


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, quality, toxic): shouted symbols are bad text; abuse uses terms, some misspelled."""
    rng = random.Random(11)
    out = []
    for i in range(500):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 90))]
        bad, toxic = i % 4 == 0, i % 5 == 2
        if toxic:
            for _ in range(4):
                term = rng.choice(TERMS)
                if rng.random() < 0.2:
                    term = term[:3] + "x" + term[4:]
                words.insert(rng.randrange(len(words)), term)
        out.append((i, " ".join(w.upper() + "!!$$" for w in words) if bad else " ".join(words), int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in corpus] + [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (None, "a b", None, None, 0), (7, "the lake", "en", "s", 8)],
                                 "doc_id long, text string, lang string, source string, score long")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in corpus] + [(3, None, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache()


@pytest.mark.parametrize("module, label, parts, kept_out", [(quality_zstd, 2, 3, 1), (toxicity, 3, 5, 0)])
def test_held_out_rows(tables, corpus, module, label, parts, kept_out):
    import zlib

    docs, labels = tables
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 7}
    held = [row for row in corpus if zlib.crc32(str(row[0]).encode()) % parts == kept_out and row[0] != 7]
    assert all(by[row[0]]["held_out"] for row in held)
    assert np.mean([by[row[0]]["predicted"] == row[label] for row in held]) > 0.95
    assert by[500]["score"] == by[501]["score"] and not by[None]["held_out"]


@pytest.mark.parametrize("module", [quality_zstd, toxicity])
def test_labels_kept_out_teach_nothing(tables, module):
    from pyspark.sql import functions as F

    docs, labels = tables
    parts, kept_out, label = (3, 1, "quality") if module is quality_zstd else (5, 0, "toxic")
    turned = labels.withColumn(label, F.when(labelled.fold(parts) == kept_out, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = (sorted(((r["doc_id"] or -1, r["score"]) for r in module.classify(docs, x).collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [quality_zstd, toxicity])
def test_empty_tables(tables, module):
    docs, labels = tables
    assert module.classify(docs.limit(0), labels).collect() == []
    assert {r["predicted"] for r in module.classify(docs, labels.limit(0)).collect()} == {0}


def test_acceptable_keeps_columns(tables, corpus):
    docs, labels = tables
    got = toxicity.acceptable(docs, labels)
    assert got.columns == docs.columns
    ids = {r["doc_id"] for r in got.collect()}
    toxic = {i for i, _, _, x in corpus if x}
    assert len(ids & toxic) <= 0.05 * len(toxic) and len(set(range(500)) - toxic - ids) <= 5


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abc") for _ in range(n)) for n in (4, 5, 6, 6, 8, 9, 10, 11)] + ["xyz*"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        word = list(rng.choice(terms[:-1]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "d"])
        word = "".join(word)
        near = [d for t in terms[:-1] if (d := levenshtein(word, t)) <= (0 if len(t) < 4 else 1 if len(t) < 9 else 2)]
        assert lexicon.edits(word) == min(near, default=-1)
        assert sorted(levenshtein(word, t) for t in lexicon.terms_near(word)) == sorted(near)
    assert lexicon.edits("xyzabc") == 0 and lexicon.edits("xyyabc") == -1
    rigid = toxicity.Lexicon(["mudhead=", "bog", "scum"])
    assert [rigid.edits(w) for w in ("mudhead", "mudhaad", "bog", "bag", "scum", "skum", "skam")] == [0, -1, 0, -1, 0, 1, -1]


def test_quotation_is_told_from_abuse():
    text = 'he said "mudhead" twice'
    at = text.index("mudhead")
    assert toxicity.quoted(text, at, at + 7)
    plain = "what a mudhead you are, the boat is late again and so are all the others today"
    assert not toxicity.quoted(plain, 7, 14)
    scorer = toxicity.Scorer(["mudhead"], ["mudheat"])
    assert scorer.features(text)[0] > 0 and scorer.features(text)[1] == 0
    assert scorer.features(plain)[2] > 0
    assert scorer.features("mudhexd you")[1] > 0 and scorer.features("mudhexd you")[2] == 0
    assert scorer.features("mudheat you") == (0,) * toxicity.FEATURES


@pytest.mark.parametrize("text, expected", [
    ('"Fine." mudhead "ok"', False), ('so "fine" mudhead "ok"', False), ('a "real mudhead, that" one', True), ("„ein mudhead“", True),
    ("« un mudhead »", False), ("«un mudhead»", True), ("don't be a mudhead, don't", False), ("'mudhead'", True), ('"mudhead', False),
    ('mudhead"', False), ('"' + "x" * 60 + ' mudhead"', False), ("(“mudhead”)", True), ("“so” mudhead”", False),
])
def test_marks_are_matched_in_pairs(text, expected):
    at = text.index("mudhead")
    assert toxicity.quoted(text, at, at + 7) == expected


def bent(rng, term, edits):
    """The term with so many letters replaced, none twice."""
    letters = list(term)
    for at in rng.sample(range(len(term)), edits):
        letters[at] = rng.choice([c for c in "qxzj" if c != letters[at]])
    return "".join(letters)


@pytest.fixture(scope="module")
def abuse(spark):
    """A model of labels with a three-letter, a four-letter and longer terms, an innocent word near one, and copies of one text."""
    rng = random.Random(3)
    terms = ["bog", "scum", "snark", "mudhead", "grobblefink"]
    copied = " ".join(prose_word(rng) for _ in range(60))
    rows = []
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(terms))
        elif i % 3 == 0:
            words.insert(rng.randrange(len(words)), "shark")
        rows.append((i, f"{copied} {' '.join(words)}" if i % 60 == 0 else " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return toxicity.fit(docs, labels), terms, copied


def prose_word(rng):
    return "".join(rng.choice("abcdefghik") for _ in range(rng.randint(4, 8)))


def test_only_terms_are_learned(abuse):
    (terms, ordinary, weights), planted, copied = abuse
    assert {t.rstrip("=") for t in terms} == set(planted)
    assert "shark" in ordinary or "snark=" in terms
    assert not set(copied.split()) & set(terms) and (weights[1:] >= 0).all()


def test_misspellings_score_above_clean_texts(abuse):
    (terms, ordinary, weights), planted, _ = abuse
    scorer, rng = toxicity.Scorer(terms, ordinary), random.Random(4)

    def score(text):
        return labelled.probability(weights, np.array([scorer.features(text)]))[0]

    for _ in range(40):
        clean = [rng.choice(WORDS) for _ in range(40)]
        clean_score = score(" ".join(clean))
        assert clean_score < 0.5 and score(" ".join(["shark", *clean])) == clean_score
        for term in planted:
            exact = score(" ".join([term, *clean]))
            assert exact > clean_score
            if term + "=" in terms:
                continue
            for edits in range(1, toxicity.Lexicon.most_edits(len(term)) + 1):
                assert clean_score < score(" ".join([bent(rng, term, edits), *clean])) <= exact
    assert score("scuz off") > 0.5 and score("you mudhaad") > 0.5


def test_rising_weights():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.standard_normal(400) > 0).astype(int)
    w = labelled.rising(x, y)
    assert w[1] > 0 and w[2] == 0 and (w[1:] >= 0).all()
    assert (labelled.rising(-x[:, :1], y)[1:] == 0).all()


def test_the_bound_is_one_on_rows(spark):
    docs = spark.createDataFrame([(1 if i < 500 else i, f"text {i % 400}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (510, 0), (511, 1)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", labels["doc_id"] > 0, 100).collect()
    assert len(rows) == 100
    rows = labelled.training_rows(docs, labels, "toxic", labels["doc_id"] > 0, 1000).collect()
    assert len(rows) == 402 and len({(r["doc_id"], r["text"]) for r in rows}) == 402


def test_logistic_without_both_classes():
    w = labelled.logistic(np.zeros((4, 1)), np.ones(4))
    assert 0.5 < labelled.probability(w, np.zeros((1, 1)))[0] < 1
    assert labelled.logistic(np.zeros((0, 2)), np.zeros(0)).shape == (3,)


def test_dictionaries_see_the_ends_of_long_texts(spark, monkeypatch):
    rows = [(i, "the lake was calm " * (quality_zstd.PIECE // 18 * n) + "the end", i % 2) for i, n in enumerate([1, 5, 6, 7, 11, 12] * 8)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_zstd, "_dictionary", lambda samples: seen.append(samples) or b"".join(samples)[: quality_zstd.DICTIONARY])
    learned = [r[1] for r in quality_zstd.training_rows(docs, labels, "quality", labels["doc_id"] >= 0, 100).where("half = 0").select("doc_id", "text").collect()]
    for bound in (None, 4):
        seen.clear()
        quality_zstd.fit(docs, labels, **({} if bound is None else {"pieces_each": bound}))
        assert sum(p.endswith(b"the end") for p in sum(seen, [])) == len(learned)
    assert quality_zstd.spread(list(range(11)), 4) == [0, 3, 7, 10] and quality_zstd.spread([1, 2, 3], 1) == [3]
