import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, tkey string, spans int, score double, n int, cid int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéö") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): long, short, empty, NULL, repeated, nearly repeated; a NULL id; passages that several share."""
    rng = random.Random(5)
    passage, line = prose(rng, 60), prose(rng, 9)
    out = []
    for i in range(40):
        out.append((i, prose(rng, rng.randint(1, 260))))
    base = prose(rng, 150)
    for i in range(40, 52):
        words = base.split()
        for _ in range(i - 40):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append((i, " ".join(words)))
    for i in range(52, 58):
        out.append((i, f"{prose(rng, 30)} {passage} {line}\n{prose(rng, 30)}"))
    out += [(58, ""), (59, None), (60, " \t\n"), (61, "One."), (62, "one. "), (63, "ONE.\tÉ"), (64, base), (64, base), (64, None)]
    out += [(None, base.upper()), (None, prose(rng, 40)), (65, "x" * 30_000), (66, prose(rng, 8000)), (67, "ab " * 400), (68, f"{line} {line} {line} {line}")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with further columns, whose names operators may use for themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "t", 2, 0.5, 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
