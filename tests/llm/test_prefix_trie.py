import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brightloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, shard int, pos int, p string"


def rows_of(seed=3):
    """Shared openings, copies, long ones beyond a strip, NULLs, ties, repeated rows, a negative id."""
    rng = random.Random(seed)
    rows, opening = [], [("system", "Be kind."), ("user", "Hi — ä"), ("assistant", "")]
    for c in list(range(40)) + [-6, -5, -1]:
        turns = opening[: rng.randint(0, 3)] + [(rng.choice(["user", None]), rng.choice(["a", "b", None])) for _ in range(rng.randint(0, 6))]
        if c % 7 == 0:
            turns = opening + [("user", "again")] * 30 + [("user", str(c % 2))]
        rows += [(c, t if t else None, r, x, 1, 2, "p") for t, (r, x) in enumerate(turns)]
    rows += [(3, 5, "user", "tie b", 1, 2, "p"), (3, 5, "user", "tie a", 1, 2, "p"), (3, 5, "user", "tie a", 1, 2, "p")]
    rows += [(None, 1, "user", "lost", 1, 2, "p"), (90, 1, "user", "x" * 100_000, 1, 2, "p")]
    rng.shuffle(rows)
    return rows


def sequences(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}


def swapped(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(own):
    members = defaultdict(list)
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    return {
        (m[0], len(node)): (members[node[:-1]][0] if node else None, len(m), kids[node], leaves[node], saved[node],
                            hashlib.sha256(",".join(str(c) for c in m if len(own[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    }


def found(nodes):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
            for r in nodes.collect()}


@pytest.mark.parametrize("strip,shard", [(64, 2048), (4, 8)])
def test_rebuilt_conversations(spark, strip, shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = rows_of()
    turns, convs = prefix_trie.swapped_openings(prefix_trie.keyed_turns(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    nodes = prefix_trie.with_end_digests(*prefix_trie.trie(turns, convs, strip))
    want = brute(swapped(sequences(rows)))
    assert nodes.count() == len(want)
    assert found(nodes) == want


def test_as_they_are_with_texts(spark):
    rows = rows_of(8)
    table = spark.createDataFrame(rows, SCHEMA)
    nodes, ends = prefix_trie.build(table)
    own = sequences(rows)
    assert found(prefix_trie.with_end_digests(nodes, ends)) == brute(own)
    texts = prefix_trie.with_texts(nodes, table).collect()
    assert {(r["conv_id"], r["depth"], r["role"], r["text"]) for r in texts} == {
        (c, d, *(own[c][d - 1] if d else (None, None))) for c, d in brute(own)}


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    nodes, ends = prefix_trie.build(table)
    assert nodes.collect() == [] and ends.collect() == []


def test_positions_of_one_hot_conversation(spark):
    from brightloom.llm.turns import plain_turns, positions

    table = spark.range(3000).selectExpr("7L as conv_id", "cast(null as long) as turn", "'user' as role", "if(id % 3 = 0, 'same', cast(id as string)) as text")
    got = positions(plain_turns(table.repartition(6)), "text").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 3001))
    assert [r["text"] for r in got] == sorted(r["text"] for r in got)
    assert {r["n_turns"] for r in got} == {3000}


def test_before_sums_and_xors(spark):
    from brightloom.llm.turns import before

    totals = spark.range(50).selectExpr("id % 2 as k", "id as i", "id * id as v")
    got = before(totals, "k", "i", ["v"], F.sum, lambda a, b: a + b, wide=2)
    assert {(r["k"], r["i"]): r["v"] for r in got.collect()} == {(i % 2, i): sum(j * j for j in range(i % 2, i, 2)) for i in range(50)}
