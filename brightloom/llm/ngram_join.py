"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct shingles, as 64-bit hashes. Documents with one set form a class. For a threshold
t a class of n shingles lacks at most e = n - ceil(t n) of a partner's, so the e + 1 first shingles of each, in one
global order, must meet: frequent ones last (at most ``MOST_HOT`` of them), else by hash. Any order gives the same links; this one
keeps copies of a hot text apart by their own edits.

1. Classes with the same first shingle are clustered around leaders (``LEADERS`` at a time) that they are similar to.
   A cluster, in parts of at most ``PART``, is a group; every other class is a group of its own.
2. The matrix has a row for each (shingle, group) of the groups' first shingles, with how much may still follow it. Groups
   that meet in a row, can agree in size and have enough left there are candidates, unless they are linked already or meet in
   too few rows. Of what two similar classes share, the ``MEETINGS`` first have at most that many less one left out before
   them; so texts with many edits of their own don't meet in what a hot text has left to each of them.
3. A candidate's classes are queries against the other group: a query opens the group only if the union of the
   group's shingles holds ceil(t n) of its own; then members of fitting size are compared until one is similar.
4. Links join whole groups, which are linked inside through their leader, so a group needs no second link to a query.

Hot groups: exact copies are one class; a first shingle of many classes is split by salt; queries of a hot group are split
and the group repeated for each part. The sets of a group part are all that a task holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.llm.components import components
from brightloom.llm.lean import lean
from brightloom.llm.names import free, own

ship_by_value(__name__)

MOST_HOT, HOT = 1_000_000, 64
MEETINGS = 2
LEADERS, PART, PART_BYTES, QUERY_ROWS = 16, 256, 1 << 23, 2048
MOST_BROADCAST = 500_000
ROWS = "doc_id bigint, tkey binary, sid binary, n bigint, first array<bigint>"
SETS = "sid binary, tokens binary"


class WordHashes(dict):
    def __missing__(self, word):
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


class Shingles:
    """Sorted hashes of the distinct shingles of a text."""

    def __init__(self, size: int, most: int = 200_000):
        self.size, self.most, self.known = size, most, WordHashes()

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z alone; parts at 0x20 and 0x09 to 0x0D
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, min(len(h), self.size), np.uint64)
        for i in range(min(self.size, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def first_shingles(tokens: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The shingles of which a partner must hold one, in the global order."""
    n = len(tokens)
    if n and len(hot):
        late = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
        tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[: n - needed(n, percent) + 1]  # all of them for a negative ``percent``


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) < needed(max(len(a), len(b)), percent):
        return False
    common = held(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def held(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sorted ``a`` are in the sorted ``b``."""
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def least_met(low_g, high_g, low_h, high_h, percent: int):
    """How many first shingles two groups (by the sizes of their classes) must share, at least, to hold similar classes.

    Of two classes, the first shingles of the one whose end earlier can only meet first shingles of the other; so what
    they have in common is at most what these share and the rest of that class. One less, as sizes between are rounded.
    """
    def one(high, low):  # the larger class on the side of ``high``
        m = np.minimum(high, low * 100 // percent)
        return -(-(m + low) * percent // (100 + percent)) - (-(-m * percent // 100) - 1) - 1

    return np.minimum(one(high_g, low_h), one(high_h, low_g))


def left_over(n, place, percent: int):
    """By how much a class of ``n`` shingles, with one at ``place`` of its order, may exceed a partner: see ``enough_left``."""
    return 100 * n - (100 + percent) * place


def enough_left(left, low, percent: int):
    """Whether a shingle with this ``left_over`` can be among the ``MEETINGS`` first that its class shares with one of ``low`` shingles.

    Similar classes of n and m share at least percent * (n + m) / (100 + percent), and what they share from the k-th common
    shingle on is all but k - 1 of that; it lies at that place or later.
    """
    return left >= percent * low - (100 + percent) * (MEETINGS - 1)


def _sid(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _rows(size, percent):
    def run(batches):
        shingles, none = Shingles(size), np.zeros(0, np.uint64)
        for batch in batches:
            sets = [shingles.of(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], batch["tkey"], pa.array([_sid(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([first_shingles(s, percent, none).view(np.int64) if len(s) else s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], ["doc_id", "tkey", "sid", "n", "first"])

    return lean(run)


def _later(size, percent, hot):
    def run(batches):
        shingles = Shingles(size)
        for batch in batches:
            out = [first_shingles(shingles.of(t or ""), percent, hot).view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["cid"], batch["tkey"], batch["n"], pa.array(out, pa.list_(pa.int64()))], ["cid", "tkey", "n", "first"])

    return lean(run)


def _sets(size, columns):
    def run(batches):
        shingles, seen = Shingles(size), set()
        for batch in batches:
            new = []
            for cid in batch["cid"].to_pylist():  # copies of a text: once a task
                new.append(cid not in seen)
                seen.add(cid)
            batch = batch.filter(pa.array(new))
            out = [shingles.of(t or "").tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(out, pa.binary())], [*columns, "tokens"])

    return lean(run)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tkey"))


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast while it has at most ``MOST_BROADCAST`` rows, which are short."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (tkey, doc_id and others) with the text of the rows that hold them; repeated rows come repeatedly."""
    if keys.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    rows = _keyed(docs)
    same = (rows["tkey"] == keys["tkey"]) & rows["doc_id"].eqNullSafe(keys["doc_id"])
    return rows.join(keys, same).select(rows["text"], *[keys[c] for c in keys.columns if c != "doc_id"])


def _leaders(percent):
    """Over rows sorted by (bucket, salt): cid, leader and part of each class of a bucket.

    Classes whose shingles are the most common in their part come first: among copies with edits of their own, the text
    that they were made from is the best leader.
    """
    def cluster(part):
        sets = [s for _, s in part]
        every, counts = np.unique(np.concatenate(sets), return_counts=True)
        common = [counts[np.searchsorted(every, s)].mean() for s in sets]
        leaders, sizes, out = [], [], []
        for k in sorted(range(len(part)), key=lambda k: (-common[k], part[k][0])):
            cid, own = part[k]
            for i, (leader, its) in enumerate(leaders):
                if similar(own, its, percent):
                    sizes[i] += 1
                    out.append((cid, leader, sizes[i] // PART))
                    break
            else:
                if len(leaders) < LEADERS:
                    leaders.append((cid, own))
                    sizes.append(0)
                out.append((cid, cid, 0))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["cid", "leader", "part"])

    def run(batches):
        at, part = None, []
        for batch in batches:
            for bucket, salt, cid, tokens in zip(*(batch[c].to_pylist() for c in ("bucket", "salt", "cid", "tokens"))):
                if (bucket, salt) != at:
                    if part:
                        yield cluster(part)
                    at, part = (bucket, salt), []
                if not part or part[-1][0] != cid:
                    part.append((cid, np.frombuffer(tokens, np.uint64)))
        if part:
            yield cluster(part)

    return lean(run)


def _salts():
    """How many parts a bucket is split into, so that the sets of a part fit a task."""
    return F.ceil(F.sum("n") * 8 / PART_BYTES)


def _cluster(docs, classes, size, percent, split=True) -> DataFrame:
    """cid, leader, part of the classes (cid, doc_id, tkey, n, bucket) that share their bucket."""
    counts = classes.groupBy("bucket").agg(F.count("*").alias("c"), _salts().alias("salts")).where("c > 1")
    salt = F.pmod(F.xxhash64("cid"), F.col("salts")) if split else F.lit(0).cast("long")
    shared = classes.join(counts, "bucket").select("cid", "doc_id", "tkey", "bucket", salt.alias("salt"))
    schema = "cid bigint, bucket bigint, salt bigint, tokens binary"
    sets = _texts(docs, materialise(shared, "shared")).select("cid", "bucket", "salt", "text").mapInArrow(
        _sets(size, ["cid", "bucket", "salt"]), schema)
    return sets.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "cid").mapInArrow(
        _leaders(percent), "cid bigint, leader bigint, part bigint")


def _frequent(tokens: DataFrame) -> DataFrame:
    """The most frequent of the tokens that more than ``HOT`` rows have, at most ``MOST_HOT`` of them."""
    return materialise(tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > HOT).orderBy(
        F.desc("c"), "token").limit(MOST_HOT).select("token"), "frequent")


def _rare_first(docs, first, size, percent) -> DataFrame:
    """``first`` with frequent shingles put last, in the same order for all classes.

    Frequent is what many classes have among their first shingles; then what many have among those that came in instead;
    and of the classes that hold such ones, which are copies of hot texts, whatever many of them hold at all.
    """
    def numbers(frequent):
        return frequent.toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64)  # bounded by MOST_HOT

    def holders(frequent):
        return materialise(first.select("cid", F.explode("first").alias("token")).join(
            F.broadcast(frequent), "token", "left_semi").select("cid").distinct(), "holders")

    def renewed(frequent, hot):
        touched = holders(frequent)
        wanted = materialise(first.drop("first").join(_checked(touched), "cid", "left_semi"), "touched")
        again = _texts(docs, wanted).mapInArrow(_later(size, percent, hot), "cid bigint, tkey binary, n bigint, first array<bigint>")
        again = again.dropDuplicates(["cid"]).join(_checked(wanted.select("cid", "doc_id")), "cid")
        again = materialise(again.select(first.columns), "first")
        rest = first.join(_checked(touched), "cid", "left_anti")
        return materialise(rest.unionByName(again), "renewed"), again

    frequent = _frequent(first.select(F.explode("first").alias("token")))
    hot = np.sort(numbers(frequent))
    if not len(hot):
        return first
    first, again = renewed(frequent, hot)
    second = _frequent(again.select(F.explode("first").alias("token")).join(F.broadcast(frequent), "token", "left_anti"))
    if second.isEmpty():
        return first
    copies = materialise(first.drop("first").join(_checked(holders(second)), "cid", "left_semi"), "copies")
    tokens = _texts(docs, copies).mapInArrow(_later(size, -1, np.zeros(0, np.uint64)), "cid bigint, tkey binary, n bigint, first array<bigint>")
    third = _frequent(tokens.dropDuplicates(["cid"]).select(F.explode("first").alias("token")).join(F.broadcast(frequent), "token", "left_anti"))
    new = materialise(second.union(third).distinct(), "frequent")
    return renewed(new, np.unique(np.concatenate([hot, numbers(new)])))[0]


def _meeting(percent):
    """Over rows sorted by token: pairs of groups of different leaders that can agree in size, with the tokens they meet in."""
    def pairs_of(*columns):
        token, group, leader, low, high, rows, left = (x.astype(np.int64) for x in columns)
        strong = enough_left(left, low, percent)  # of a pair at least the one of smaller ``low`` is
        order = np.lexsort((-left, group, ~strong, token))
        token, group, leader, low, high, rows, left, strong = (x[order] for x in (token, group, leader, low, high, rows, left, strong))
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lengths = np.diff(np.append(starts, len(token)))
        firsts = np.minimum(np.add.reduceat(strong.astype(np.int64), starts), lengths - 1)
        shapes = np.column_stack([lengths, firsts])
        found = []
        for k, m in np.unique(shapes[firsts > 0], axis=0):
            runs = starts[(lengths == k) & (firsts == m)]
            if k <= 1000:
                i, j = np.triu_indices(k, 1)
                i, j = i[i < m], j[i < m]
                step = max(1, 250_000 // len(i))
                parts = (((runs[s : s + step, None] + i).ravel(), (runs[s : s + step, None] + j).ravel())
                         for s in range(0, len(runs), step))
            else:  # a few, too long for a table of pairs
                parts = ((np.full(k - 1 - i, r + i), np.arange(r + i + 1, r + k)) for r in runs for i in range(m))
            for a, b in parts:
                fit = ((leader[a] != leader[b]) & (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
                       & enough_left(left[a], low[b], percent) & enough_left(left[b], low[a], percent))
                a, b = a[fit], b[fit]
                larger = (rows[a] > rows[b]) | ((rows[a] == rows[b]) & (group[a] < group[b]))
                a, b = np.where(larger, a, b), np.where(larger, b, a)  # the members of the smaller group will be the queries
                least = np.minimum(least_met(low[a], high[a], low[b], high[b], percent), MEETINGS)
                found.append(np.column_stack([group[a], group[b], least]))
                if sum(map(len, found)) > 500_000:
                    yield found
                    found = []
        yield found

    def run(batches):
        kept, size, names = [], 0, ("token", "group", "leader", "low", "high", "rows", "left")

        def emit(parts):
            for found in parts:
                pair = np.concatenate([np.zeros((0, 3), np.int64), *found])
                pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                at = np.flatnonzero(np.append(True, (pair[1:, :2] != pair[:-1, :2]).any(1))) if len(pair) else np.zeros(0, np.int64)
                counts = np.diff(np.append(at, len(pair)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[at, 0]), pa.array(pair[at, 1]), pa.array(counts), pa.array(pair[at, 2])], ["g", "h", "c", "least"])

        for batch in batches:
            kept.append([batch[c].to_numpy(zero_copy_only=False) for c in names])
            size += batch.num_rows
            if size >= 300_000 and kept[0][0][0] != kept[-1][0][-1]:
                columns = [np.concatenate(c) for c in zip(*kept)]
                cut = np.searchsorted(columns[0], columns[0][-1])  # the last token may go on
                yield from emit(pairs_of(*(c[:cut] for c in columns)))
                kept = [[c[cut:] for c in columns]]
                size = len(kept[0][0])
        if size:
            yield from emit(pairs_of(*(np.concatenate(c) for c in zip(*kept))))

    return lean(run)


def _open(percent):
    """Over rows sorted by (g, salt, query): a link for each query that is similar to a member of g."""
    def run(batches):
        at, members, union, last = None, [], None, None
        for batch in batches:
            out = []
            for g, salt, query, cid, tokens in zip(*(batch[c].to_pylist() for c in ("g", "salt", "query", "cid", "tokens"))):
                if (g, salt) != at:
                    at, members, union, last = (g, salt), [], None, None
                if (query, cid) == last:
                    continue
                last = (query, cid)
                own = np.frombuffer(tokens, np.uint64)
                if not query:
                    members.append((cid, own))
                    continue
                if union is None and members:
                    union = np.unique(np.concatenate([m for _, m in members])) if len(members) > 1 else members[0][1]
                if not members or held(own, union) < needed(len(own), percent):
                    continue
                for other, its in members:
                    if similar(own, its, percent):
                        out.append((cid, other))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return lean(run)


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, tkey and n of each row, and the component of its class (NULL without shingles)."""
    rows = materialise(_keyed(docs).mapInArrow(_rows(size, percent), ROWS), "rows")
    classes = materialise(rows.where("n > 0").groupBy("sid").agg(
        F.min(F.struct("doc_id", "tkey")).alias("rep"), F.first("n").alias("n"), F.first("first").alias("first"),
    ).select(F.monotonically_increasing_id().alias("cid"), "sid", "rep.doc_id", "rep.tkey", "n", "first"), "classes")

    first = _rare_first(docs, classes.select("cid", "doc_id", "tkey", "n", "first"), size, percent)
    # near copies mostly share their shingle of least hash, whatever is rare in them
    buckets = classes.select("cid", "doc_id", "tkey", "n", F.get("first", F.lit(0)).alias("bucket"))
    clusters = materialise(_cluster(docs, buckets, size, percent), "clusters")
    leading = clusters.groupBy(F.col("leader").alias("cid")).agg(F.count("*").alias("size")).where("size > 1")
    again = leading.join(buckets, "cid").select("cid", "doc_id", "tkey", "n", "bucket").join(
        buckets.groupBy("bucket").agg(_salts().alias("c")).where(F.col("c") > 1), "bucket", "left_semi")
    links = clusters.select(F.col("cid").alias("a"), F.col("leader").alias("b"))
    top = clusters.select("cid", "leader", "part", F.col("leader").alias("top"))
    if not again.isEmpty():  # leaders of one bucket that salt has kept apart
        above = materialise(_cluster(docs, again, size, percent, split=False), "leaders").select("cid", "leader")
        links = links.union(above)
        above = above.select(F.col("cid").alias("leader"), F.col("leader").alias("above"))
        top = clusters.join(above, "leader", "left").select("cid", "leader", "part", F.coalesce("above", "leader").alias("top"))

    # a group is named by one of its classes; classes without a cluster are groups of their own
    names = top.join(classes.select("cid", "n"), "cid").groupBy("leader", "part").agg(
        F.min("cid").alias("group"), F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    named = top.join(names, ["leader", "part"]).select("cid", "group", "top", "rows", "low", "high")
    groups = materialise(classes.select("cid", "doc_id", "tkey", "n").join(named, "cid", "left").select(
        "cid", "doc_id", "tkey", F.coalesce("group", "cid").alias("group"), F.coalesce("top", "cid").alias("leader"),
        *(F.coalesce(c, "n").cast("int").alias(c) for c in ("low", "high")), F.coalesce("rows", F.lit(1)).cast("int").alias("rows")), "groups")

    entry = ["token", "group", "leader", "low", "high", "rows"]
    entries = first.select("cid", "n", "first").join(_checked(groups.select("cid", *entry[1:])), "cid").select(
        F.posexplode("first").alias("place", "token"), "n", *entry[1:]).select(*entry, left_over(F.col("n"), F.col("place"), percent).alias("left"))
    matrix = entries.where("rows = 1").union(entries.where("rows > 1").groupBy(*entry).agg(F.max("left").alias("left")))
    met = matrix.repartition("token").sortWithinPartitions("token").mapInArrow(
        _meeting(percent), "g bigint, h bigint, c bigint, least bigint")
    pairs = materialise(met.groupBy("g", "h").agg(F.sum("c").alias("c"), F.max("least").alias("least")).where("c >= least").select("g", "h"), "pairs")

    load = pairs.groupBy("g").agg(F.count("*").alias("c"))
    salts = F.ceil(F.col("c") / QUERY_ROWS)
    asked = pairs.join(load, "g").select("g", "h", F.pmod(F.xxhash64("h"), salts).alias("salt"))
    queries = asked.join(groups.select(F.col("group").alias("h"), "cid"), "h").select("g", "salt", F.lit(1).alias("query"), "cid")
    members = load.select("g", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")).join(
        groups.select(F.col("group").alias("g"), "cid"), "g").select("g", "salt", F.lit(0).alias("query"), "cid")
    units = materialise(queries.union(members), "units")
    wanted = units.select("cid").distinct().join(groups.select("cid", "doc_id", "tkey"), "cid")
    sets = _texts(docs, materialise(wanted, "wanted")).select("cid", "text").mapInArrow(_sets(size, ["cid"]), "cid bigint, tokens binary")
    opened = sets.join(_checked(units), "cid").repartition("g", "salt").sortWithinPartitions("g", "salt", "query", "cid")
    found = opened.select("g", "salt", "query", "cid", "tokens").mapInArrow(_open(percent), "a bigint, b bigint")
    linked = components(materialise(links.union(found), "found"))

    named = classes.select("cid", "sid").join(linked.withColumnRenamed("id", "cid"), "cid", "left").select(
        "sid", F.coalesce("component", "cid").alias("component"))
    return rows.select("doc_id", "tkey", "n", "sid").join(named, "sid", "left").select("doc_id", "tkey", "n", "component")


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * common >= ``percent`` * union of their shingles of ``size`` words. A text of fewer words
    has its whole sequence as one shingle; NULL and empty texts have none and are linked with nothing. NULL doc_ids take
    part but name a component only if it has no other; repeated rows are each kept. Other columns are ignored.
    """
    rows = materialise(_linked(docs, size, percent), "linked")
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the least doc_id (NULL last), then of the least text digest.

    Of rows that repeat doc_id and text one stays. Rows without words are linked with nothing and all stay.
    """
    rows = materialise(_linked(docs, size, percent), "linked").where("n > 0")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("k"))
    same = rows.groupBy("doc_id", "tkey").agg((F.count("*") > 1).alias("again"))
    first = first.select("k.doc_id", "k.tkey").alias("f").join(
        same.alias("s"), F.expr("f.doc_id <=> s.doc_id and f.tkey = s.tkey")).select("f.doc_id", "f.tkey", "s.again")
    id_, key, more = (free(docs, c) for c in ("kept_id", "kept_key", "kept_again"))
    first = materialise(first, "kept").toDF(id_, key, more)
    empty = docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z"))
    if first.count() <= MOST_BROADCAST:
        first = F.broadcast(first)
    found = docs.join(first, docs["doc_id"].eqNullSafe(first[id_]) & (F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))) == first[key]))
    once = found.where(~F.col(more)).select(*own(docs))
    again = found.where(F.col(more)).dropDuplicates([id_, key]).select(*own(docs))
    return once.unionByName(again).unionByName(empty)
