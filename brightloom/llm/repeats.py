"""Suffix-array dedup by a run-length index: removes bytes that lie in repeated strings of ``length`` bytes.

A window is a string of ``length`` bytes of one text. Its anchor is its ``GRAM``-byte part of least hash, so equal windows
have equal anchors at equal places. Neighbouring windows with one anchor share a context, the bytes that they cover; no
window lies in two contexts. What repeats is found anchor by anchor:

* an anchor that occurs once has no repeated window;
* of a context that occurs twice, every window is repeated;
* the distinct contexts of an anchor are indexed together. The index is the run-compressed Burrows-Wheeler transform of
  the contexts with the text places of the run ends. Only there is a longest match with the next or previous suffix
  measured; at any other place it is one less than at the place before, so that streaming over the text gives the
  matching statistics of every window, and a match of ``length`` marks it.

Hot anchors: contexts are counted by partial sums before they are compared, and an anchor with more than ``MOST_TOGETHER``
distinct contexts has its windows counted by a 128-bit hash instead, which no task gathers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.llm.lean import give_back, lean
from brightloom.llm.names import free, own

ship_by_value(__name__)

LENGTH, GRAM = 200, 32
MOST_TOGETHER, INDEX_BYTES, PIECE = 4096, 1 << 20, 1 << 21
MOST_BROADCAST, MOST_TEXTS = 1_200_000, 300_000
RUNS = "tkey binary, anchor bigint, c1 bigint, c2 bigint, s0 int, nw int"
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    x = data.astype(np.uint64)
    for shift, n in ((8, 1), (16, 2), (32, 4)):
        x = x[:-n] | (x[n:] << np.uint64(shift))
    for n in (8, 16):
        x = (x[:-n] * A) ^ ((x[n:] + B) * B)
        x ^= x >> np.uint64(31)
    x *= A
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, from the prefixes and suffixes of blocks."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def window_runs(data: np.ndarray, length: int):
    """(anchor hash, first window, windows) of each run of windows of one text that share their anchor."""
    n = len(data) - length + 1
    hashes = gram_hashes(data)
    w, parts = length - GRAM + 1, []
    for low in range(0, n, PIECE):  # places count from the piece's start, so that they fit beside the hash
        high = min(n, low + PIECE)
        own = hashes[low : high + w - 1]
        key = (own & ~np.uint64((1 << 24) - 1)) | np.arange(len(own), dtype=np.uint64)
        parts.append((sliding_min(key, w) & np.uint64((1 << 24) - 1)).astype(np.int64) + low)
    place = np.concatenate(parts)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return hashes[place[first]].view(np.int64), first, np.diff(np.append(first, n))


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _runs(length):
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for key, text in zip(batch["tkey"].to_pylist(), batch["text"].to_pylist()):
                data = _bytes(text)
                if len(data) < length:
                    continue
                anchor, first, windows = window_runs(np.frombuffer(data, np.uint8), length)
                ends = (first + windows + length - 1).tolist()
                digest = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(first.tolist(), ends)])
                c = np.frombuffer(digest, np.int64).reshape(-1, 2)
                for column, values in zip(out[1:], (anchor, c[:, 0], c[:, 1], first, windows)):
                    column.append(values)
                out[0] += [key] * len(first)
            if out[0]:
                arrays = [pa.array(out[0], pa.binary())]
                arrays += [pa.array(np.concatenate(c), t) for c, t in zip(out[1:], (pa.int64(),) * 3 + (pa.int32(),) * 2)]
                yield pa.RecordBatch.from_arrays(arrays, ["tkey", "anchor", "c1", "c2", "s0", "nw"])

    return lean(run)


class RunIndex:
    """The run-compressed transform of byte strings, each ended by a separator, with the places of run ends."""

    def __init__(self, strings: list[bytes], deepest: int):
        joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        joined[ends] = 0
        self.symbols, self.ends = joined, ends
        n = len(joined)
        packed = np.zeros(n, np.uint64)
        padded = np.append(joined, np.zeros(8, np.int16)).astype(np.uint64)
        for i in range(7):
            packed = (packed << np.uint64(9)) | padded[i : i + n]
        self.ranks: list[tuple[int, np.ndarray]] = []
        order, rank = self._rank(packed)
        step = 7
        self.ranks.append((step, rank))
        while step < deepest:
            after = np.zeros(n, np.uint64)
            after[: n - step] = rank[step:].astype(np.uint64) + np.uint64(1)
            order, rank = self._rank((rank.astype(np.uint64) << np.uint64(32)) | after)
            step *= 2
            self.ranks.append((step, rank))
        # suffixes that agree to the end of their string keep any order
        before = joined[order - 1]
        change = (before[1:] != before[:-1]) | (before[1:] == 0)  # what comes before a string is no match
        self.heads = np.append(0, np.flatnonzero(change) + 1)
        self.tails = np.append(np.flatnonzero(change), n - 1)
        self.letters = before[self.heads]
        self.head_place, self.tail_place = order[self.heads], order[self.tails]
        # the neighbours across run borders: the tail before each head, and the head after each tail
        self.before_head, self.after_tail = self.tail_place[:-1], self.head_place[1:]

    @staticmethod
    def _rank(key):
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        return order, rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the suffixes from ``a`` and ``b`` on agree, at most to the end of a string."""
        n, a, b = len(self.symbols), a.copy(), b.copy()
        start = a.copy()
        for step, rank in reversed(self.ranks):
            inside = (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            a += step * same
            b += step * same
        for _ in range(6):
            inside = (a < n) & (b < n)
            same = inside & (self.symbols[np.minimum(a, n - 1)] == self.symbols[np.minimum(b, n - 1)])
            a += same
            b += same
        end = self.ends[np.searchsorted(self.ends, start)]
        return np.minimum(a - start, end - start)

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest match of the text from there on with the text from another place on."""
        n = len(self.symbols)
        reach = np.zeros(n, np.int64)
        if len(self.heads) > 1:
            found = self.common(self.head_place[1:], self.before_head)
            for place in (self.head_place[1:], self.before_head):
                np.maximum.at(reach, place, place + found)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def _search(length):
    """Over rows sorted by anchor: the repeated windows of each context, from indexes over whole anchors."""
    def run(batches):
        held, size = [], 0

        def index(rows):
            index = RunIndex([r[4] for r in rows], 2 * length - GRAM + 2)
            marked = index.matching_statistics() >= length
            out, at = [], 0
            for anchor, c1, c2, nw, context in rows:
                spans = _spans(marked[at : at + nw])
                at += len(context) + 1
                if spans:
                    out.append({"anchor": anchor, "c1": c1, "c2": c2, "spans": [{"a": a, "b": b} for a, b in spans]})
            return pa.RecordBatch.from_pylist(out, schema=SPANS_ARROW) if out else None

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "c1", "c2", "nw", "context"))):
                if size >= INDEX_BYTES and held[-1][0] != row[0]:
                    found = index(held)
                    if found:
                        yield found
                    held, size = [], 0
                if held and held[-1][:3] == row[:3]:
                    continue  # the same context from a copy of its text
                held.append(row)
                size += len(row[4])
        if held:
            found = index(held)
            if found:
                yield found

    return lean(run)


SPANS = "anchor bigint, c1 bigint, c2 bigint, spans array<struct<a:int,b:int>>"
SPANS_ARROW = pa.schema([
    ("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()),
    ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
])


def _contexts(length):
    def run(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist()):
                data = _bytes(text)
                out += [(w["anchor"], w["c1"], w["c2"], w["nw"], data[w["s0"] : w["s0"] + w["nw"] + length - 1]) for w in wanted]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.int32(), pa.binary()))],
                    ["anchor", "c1", "c2", "nw", "context"])

    return lean(run)


def _windows(length):
    def run(batches):
        for batch in batches:
            for anchor, c1, c2, nw, context in zip(*(batch[c].to_pylist() for c in ("anchor", "c1", "c2", "nw", "context"))):
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[i : i + length]) for i in range(nw)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(np.full(nw, x), pa.int64()) for x in (anchor, c1, c2)), pa.array(np.arange(nw), pa.int32()),
                    pa.array(h[:, 0]), pa.array(h[:, 1])], ["anchor", "c1", "c2", "at", "w1", "w2"])

    return lean(run)


def _broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """tkey and spans: the bytes [a, b) of each text (by its md5) that lie in repeated windows, merged and in order."""
    runs = materialise(docs.select(_key().alias("tkey"), "text").mapInArrow(_runs(length), RUNS), "runs")
    often = materialise(runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    runs = materialise(runs.join(_broadcast(often), "anchor", "left_semi"), "repeated-runs")
    key = ["anchor", "c1", "c2"]
    contexts = materialise(runs.groupBy(*key).agg(
        F.count("*").alias("c"), F.min(F.struct("tkey", "s0", "nw")).alias("rep")), "contexts")
    several = contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    open_ = contexts.join(several, "anchor").select(*key, "c", "contexts", "rep.*")

    def texts_of(some):
        wanted = materialise(some.groupBy("tkey").agg(F.collect_list(F.struct(*key, "s0", "nw")).alias("wanted")), "wanted")
        if some.count() <= MOST_BROADCAST:  # so many contexts, not texts
            wanted = F.broadcast(wanted)
        found = docs.select(_key().alias("tkey"), "text").join(wanted, "tkey").select("text", "wanted")
        return found.mapInArrow(_contexts(length), "anchor bigint, c1 bigint, c2 bigint, nw int, context binary")

    marked = texts_of(open_.where(F.col("contexts") <= MOST_TOGETHER)).repartition("anchor").sortWithinPartitions(*key).mapInArrow(
        _search(length), SPANS)
    hot = materialise(open_.where(F.col("contexts") > MOST_TOGETHER), "hot")
    if not hot.isEmpty():
        windows = materialise(texts_of(hot).dropDuplicates(key).mapInArrow(
            _windows(length), "anchor bigint, c1 bigint, c2 bigint, at int, w1 bigint, w2 bigint"), "windows")
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        marked = marked.union(windows.join(twice, ["w1", "w2"], "left_semi").groupBy(*key).agg(
            F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans")))
    marked = materialise(marked, "marked")

    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("nw").alias("b")))
    twice = contexts.where("c > 1").select(*key, F.lit(True).alias("twice"))
    known = twice.join(marked, key, "full_outer")
    spans = runs.join(known, key).select(
        "tkey", "s0", F.explode(F.when(F.col("twice"), whole).otherwise(F.col("spans"))).alias("s"))
    spans = spans.select("tkey", (F.col("s0") + F.col("s.a")).alias("a"), (F.col("s0") + F.col("s.b") + length - 1).alias("b")).distinct()
    spans = spans.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return spans.mapInArrow(_merge, "tkey binary, spans array<struct<a:int,b:int>>")


def merged(spans) -> list[tuple[int, int]]:
    out = []
    for s in spans or []:
        if out and s["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["b"]))
        else:
            out.append((s["a"], s["b"]))
    return out


def _merge(batches):
    for batch in batches:
        spans = [[{"a": a, "b": b} for a, b in merged(s)] for s in batch["spans"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["tkey"], pa.array(spans, SPANS_ARROW.field("spans").type)], ["tkey", "spans"])


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return data
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte goes when it lies in a string of ``length`` bytes that also starts elsewhere, in the same text or another; a
    repeated row is another text. NULL is an empty text; texts shorter than ``length`` lose nothing. Other columns are
    ignored.
    """
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans"))):
                data, spans = _bytes(text), merged(spans)
                out.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(data, spans)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = materialise(repeated(docs, length), "spans")
    keyed = docs.select("doc_id", "text", _key().alias("tkey"))
    return keyed.join(_broadcast(spans, MOST_TEXTS), "tkey", "left").drop("tkey").mapInArrow(
        lean(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of ``docs`` with repeated bytes gone from ``text``; parts of characters that remain go, too."""
    def cleared(text, spans):
        return kept(_bytes(text), list(zip(spans["a"], spans["b"]))).decode("utf-8", "ignore")

    @F.arrow_udf("string")
    def rest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for low in range(0, len(texts), 500):
                some, cuts = texts.slice(low, 500), spans.slice(low, 500)
                hit = np.flatnonzero(pc.and_(some.is_valid(), cuts.is_valid()).to_numpy(zero_copy_only=False))
                new = [cleared(some[i].as_py(), cuts[i].as_py()) for i in hit.tolist()]
                mask = np.zeros(len(some), bool)
                mask[hit] = True
                out.append(pc.replace_with_mask(some, pa.array(mask), pa.array(new, some.type)))
            yield pa.concat_arrays(out) if out else texts
            del texts, spans, out
        give_back()

    key, cut = free(docs, "tkey"), free(docs, "spans")
    spans = materialise(repeated(docs, length), "spans").select(
        F.col("tkey").alias(key), F.struct(F.col("spans.a").alias("a"), F.col("spans.b").alias("b")).alias(cut))
    found = docs.withColumn(key, _key()).join(_broadcast(spans, MOST_TEXTS), key, "left")
    return found.withColumn("text", rest("text", cut)).select(*own(docs))
