import hashlib
import random
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from brightloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, window int, stretch string"
RANKS = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
PATTERN = public_tokenizers.PATTERN
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "\\", "\n", "a", "é", "[", "<", '"']


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool", "a\nb", "[/TURN]\\"]),
                          st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5))
def test_template_is_reversible(turns):
    window = "".join(a + cf.escape(x) + b for r, x in turns for a, b in [cf.marks(r)])
    assert [(r, x) for r, x, _ in cf.parse(window)] == turns
    for _, x, at in cf.parse(window):
        assert window[at:].startswith(cf.escape(x)) and cf.unescape(cf.escape(x)) == x


def rows_of():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9) if c else 57):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool", "system" if c % 3 and t else None, None])
            text = rng.choice([None, "", " ".join(rng.choice(PIECES + ["word"]) for _ in range(rng.randint(0, 90)))])
            rows.append((c, t or None, role, text, 1, "s"))
    rows += [(61, 1, "assistant", "tie b", 1, "s"), (61, 1, "assistant", "tie a", 1, "s"), (61, 1, "assistant", "tie a", 1, "s")]
    rows += [(None, 1, "user", "lost", 1, "s"), (62, 0, "assistant", "long " * 20_000, 1, "s")]
    rng.shuffle(rows)
    return rows


def conversations(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}


def expected(turns):
    loss = "".join(x for r, x in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("stretch", [1024, 7])
def test_digests_and_windows(spark, stretch):
    rows = rows_of()
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = conversations(rows)
    got = cf.digests(table, RANKS, PATTERN, 120, 2, stretch).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: expected(t) for c, t in want.items()}
    assert len(got) == len(want)

    count = cf.token_counter(RANKS, PATTERN)
    cost = lambda t: sum(map(count, cf.marks(t[0]))) + count(cf.escape(t[1]))
    found = defaultdict(list)
    for r in cf.windows(table, RANKS, PATTERN, 120, 2, stretch).collect():
        found[r["conv_id"]].append(r)
    for c, turns in want.items():
        at, windows = 0, sorted(found[c], key=lambda r: (r["stretch"], r["window"]))
        for w, r in enumerate(windows):
            parsed = [(role, x) for role, x, _ in cf.parse(r["text"])]
            assert r["n_tokens"] == sum(map(cost, parsed)) and r["over_budget"] == (r["n_tokens"] > 120)
            new, context = parsed[r["n_context"]:], parsed[: r["n_context"]]
            assert new == turns[at : at + len(new)] and len(new) == r["n_new"] >= 1
            system = turns[0][0] == "system" and at > 0
            if system:
                assert context[0] == turns[0]
            tail = context[system:]
            assert len(tail) <= 2 and tail == turns[at - len(tail) : at] and sum(map(cost, tail)) <= 30
            assert r["n_tokens"] <= 120 or len(parsed) == 1 + system
            assert [r["text"][s["start"]:s["end"]] for s in r["loss"]] == [cf.escape(x) for role, x in new if role == "assistant"]
            at += len(new)
            if at < len(turns) and at % stretch:
                assert r["n_tokens"] + cost(turns[at]) > 120
        assert at == len(turns)
    assert any(r["n_context"] == 3 for w in found.values() for r in w)


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert cf.digests(table, RANKS, PATTERN).collect() == [] and cf.windows(table, RANKS, PATTERN).collect() == []


def test_query_on_given_tables(spark, data_folder):
    from brightloom.llm.catalog import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{data_folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = conversations(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = QUERIES["op12_budgeted_windows"](spark, data_folder).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: expected(t) for c, t in want.items()}
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)
