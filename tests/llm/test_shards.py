import zlib
from collections import Counter

from brightloom.llm import shards


def test_counts_slots_and_digests(docs, texts):
    got = shards.assign(docs).collect()
    counts = Counter(r["shard"] for r in got)
    assert sum(counts.values()) == len(texts) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_one_hot_key(spark):
    df = spark.range(999).selectExpr("if(id < 400, 7, id) as doc_id", "'same' as text")
    counts = Counter(r["shard"] for r in shards.assign(df, 10).collect())
    assert sorted(counts.values()) == [99] + [100] * 9


def test_little_moves_with_another_shard(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text").cache()
    a, b = ({r["doc_id"]: r["shard"] for r in shards.assign(df, n, vnodes=200).collect()} for n in (10, 11))
    assert sum(a[i] != b[i] for i in a) < 2000  # dealing anew would move ten of eleven


def test_empty_table(nothing):
    assert shards.assign(nothing).collect() == []


def test_overflow_goes_on_clockwise():
    placed = shards.spread([3, 0, 5, 0], [(0, 0), (2, 1), (3, 2)], [2, 3, 3])
    assert placed == [(0, 0, 2, 0, 0), (0, 2, 3, 1, 0), (2, 0, 2, 1, 1), (2, 2, 5, 2, 0)]
    turned = shards.spread([0, 0, 0, 4], [(1, 0), (2, 1)], [2, 2])
    assert turned == [(3, 0, 2, 0, 0), (3, 2, 4, 1, 0)]
