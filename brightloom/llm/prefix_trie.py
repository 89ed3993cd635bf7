"""The prefix trie of conversations by vertical bitmaps.

Conversations are numbered by conv_id and cut into shards of ``SHARD``; their turns into strips of ``STRIP`` positions, so
that neither many conversations nor a long one meet in one task. In each (shard, strip) an index maps (position, turn) to
the bitset of the conversations that have this turn there. From the bitset of a node at depth d its children are found
depth first: the lowest conversation left names its turn at d + 1, the parent's bitset is intersected with that posting,
and the members found are taken out. A node's popcount counts its members, its intersection with the conversations of d
turns is its end list.

Nodes of several shards meet by a 128-bit digest of their prefix, the XOR of a hash of (position, role, text) over its turns,
which also lets a strip begin where the one before it ended. Sums over subtrees need no walk over levels: each node
belongs to its smallest member, the nodes of one owner form a chain down to the owner's end, and the chains below a node
are those of its members; so a subtree's sum is the members' chain totals, weighted popcounts again, less what the
owner's chain holds above the node.

Defined cases: rows without conv_id take no part; NULL role or text is empty; equal turns are ordered by role and
text; a repeated row is a further turn; very long texts enter by hash and length; an empty table has no node, not even
the root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.functions.values import with_row_index
from brightloom.llm.turns import before, plain_turns, positions

SHARD, STRIP = 2048, 64
NODE = ["depth", "p", "q"]
FOUND = "shard int, strip long, depth long, p long, q long, up long, uq long, bytes long, n long, least long, members binary, ends binary"

ship_by_value(__name__)


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns, and of each turn a 128-bit hash (h, g) of (role, text) and its text's UTF-8 bytes."""
    return positions(plain_turns(conversations), F.xxhash64(F.lit(11), "role", "text").alias("h"),
                     F.xxhash64("text", F.lit(23), "role").alias("g"), F.octet_length("text").cast("long").alias("bytes"))


def swapped_openings(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv_id, n_turns) of conversations rebuilt with the opening of the first one of their group.

    With h = crc32(decimal conv_id) % most, c gets the first h turns of c - c % group and its own after its first h.
    """
    size = F.crc32(F.col("conv_id").cast("string")) % most
    convs = turns.groupBy("conv_id").agg(F.max("n_turns").alias("n")).withColumn("h", size)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(bases, "base", "left").select(
        "conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("tail"))
    convs = materialise(convs, "openings")
    values = ["h", "g", "bytes"]
    c, span = F.col("conv_id"), F.lit(group - 1)
    targets = F.sequence(F.when(c > 0, c).otherwise(c - span), F.when(c < 0, c).otherwise(c + span))
    heads = turns.where((c % group == 0) & (F.col("pos") < most)).select(F.explode(targets).alias("to"), "pos", *values)
    known = convs.select(F.col("conv_id").alias("to"), F.col("h").alias("most"))
    heads = heads.join(known, "to").where("pos <= most").select(F.col("to").alias("conv_id"), "pos", *values)
    known = convs.select("conv_id", F.col("h").alias("own"), "head")
    tails = turns.where(F.col("pos") > size).join(known, "conv_id").select("conv_id", (F.col("pos") - F.col("own") + F.col("head")).alias("pos"), *values)
    return heads.unionByName(tails), convs.select("conv_id", (F.col("head") + F.col("tail")).alias("n_turns"))


def _bitsets(rows: np.ndarray, bits: np.ndarray, n: int) -> list[int]:
    """For each of ``n`` row numbers, the bitset of its bits."""
    out = [0] * n
    for r, b in zip(rows.tolist(), bits.tolist()):
        out[r] |= 1 << b
    return out


def _packed(bitset: int, count: int) -> bytes:
    """A bitset in full, or as 16-bit numbers where that is shorter."""
    if 2 * count >= SHARD // 8:
        return bitset.to_bytes(SHARD // 8, "little")
    out = []
    while bitset:
        low = bitset & -bitset
        out.append(low.bit_length() - 1)
        bitset ^= low
    return np.array(out, "<u2").tobytes()


def _bits(packed: bytes) -> np.ndarray:
    if len(packed) == SHARD // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little"))
    return np.frombuffer(packed, "<u2")


def _walk(schema, strip_size):
    def walk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, strip = key[0].as_py(), key[1].as_py()
        col = {c: table[c].to_numpy() for c in ("bit", "pos", "h", "g", "p", "q", "bytes", "base")}
        base = col["base"].astype(bool)
        start, stop = strip * strip_size, (strip + 1) * strip_size
        ids, ended, starts = {}, {}, {}
        for bit, conv, n, p, q in zip(*(col[c][base].tolist() for c in ("bit", "h", "g", "p", "q"))):
            ids[bit] = conv
            ended[n] = ended.get(n, 0) | 1 << bit
            starts[p, q] = starts.get((p, q), 0) | 1 << bit
        pos, bit, h, g, p, q, size = (col[c][~base] for c in ("pos", "bit", "h", "g", "p", "q", "bytes"))
        order = np.lexsort((g, h, pos))
        pos, bit, h, g, p, q, size = (x[order] for x in (pos, bit, h, g, p, q, size))
        new = np.ones(len(pos), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        posting = np.cumsum(new) - 1
        sets = _bitsets(posting, bit, int(new.sum()))
        p, q, size = p[new].tolist(), q[new].tolist(), size[new].tolist()
        named, alive = {}, {}
        for at, b, k in zip(pos.tolist(), bit.tolist(), posting.tolist()):
            named.setdefault(at, {})[b] = k
        for at, k in zip(pos[new].tolist(), range(len(sets))):
            alive[at] = alive.get(at, 0) | sets[k]

        out = {f: [] for f in schema.names[2:]}

        def emit(depth, members, p, q, up, uq, bytes_):
            n, ends = members.bit_count(), members & ended.get(depth, 0)
            list_ = [ids[b] for b in _bits(_packed(ends, ends.bit_count())).tolist()] if ends else None
            row = (depth, p, q, up, uq, bytes_, n, ids[(members & -members).bit_length() - 1], _packed(members, n),
                   np.array(list_, "<i8").tobytes() if list_ else None)
            for values, value in zip(out.values(), row):
                values.append(value)

        stack = [(start, members, p0, q0) for (p0, q0), members in starts.items()]
        if strip == 0:
            for _, members, p0, q0 in stack:
                emit(0, members, p0, q0, None, None, 0)
        while stack:
            depth, members, p0, q0 = stack.pop()
            rest = members & alive.get(depth + 1, 0)
            while rest:
                k = named[depth + 1][(rest & -rest).bit_length() - 1]
                child = rest & sets[k]
                rest ^= child
                p1, q1 = p0 ^ p[k], q0 ^ q[k]
                emit(depth + 1, child, p1, q1, p0, q0, size[k])
                if depth + 1 < stop:
                    stack.append((depth + 1, child, p1, q1))
        n = len(out["depth"])
        return pa.table([pa.array([shard] * n), pa.array([strip] * n), *out.values()], schema=schema)

    return walk


def _weigh(schema):
    def weigh(batches):
        weights = np.zeros((SHARD, 2), np.int64)
        for batch in batches:
            rows = {c: batch[c].to_pylist() for c in ("depth", "p", "q", "members", "weights")}
            out = {f: [] for f in schema.names}
            for depth, p, q, members, given in zip(*rows.values()):
                if members is None:
                    weights = np.zeros((SHARD, 2), np.int64)
                    for w in given:
                        weights[w["bit"]] = w["total"], w["leaf"]
                    continue
                total, leaves = weights[_bits(members)].sum(0).tolist()
                for values, value in zip(out.values(), (depth, p, q, total, leaves)):
                    values.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return weigh


def _hash_ends(schema):
    def hash_ends(batches):
        at, digest, some = None, None, False
        for batch in batches:
            out = []
            for *node, ends in zip(*(batch[c].to_pylist() for c in ("depth", "p", "q", "ends"))):
                if node != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest, some = node, hashlib.sha256(), False
                digest.update((("," if some else "") + ",".join(map(str, np.frombuffer(ends, "<i8").tolist()))).encode())
                some = True
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, digest.hexdigest())))], schema=schema)

    return hash_ends


def _schema(spark, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def shard_nodes(turns: DataFrame, convs: DataFrame, strip: int = STRIP) -> tuple[DataFrame, DataFrame]:
    """The nodes that each (shard, strip) finds, with members and end lists; and the conversations with shard and bit.

    ``turns``: conv_id, pos, h, g, bytes; ``convs``: each conv_id once, with its n_turns.
    """
    spark = turns.sparkSession
    convs = with_row_index(convs.select("conv_id", "n_turns"), [F.col("conv_id")], "_i")
    convs = materialise(convs.select("conv_id", "n_turns", (F.col("_i") / SHARD).cast("int").alias("shard"), (F.col("_i") % SHARD).cast("int").alias("bit")), "shards")
    place = F.floor((F.col("pos") - 1) / strip).alias("strip")
    turns = turns.select("conv_id", "pos", "h", "g", "bytes").join(convs, "conv_id").select(
        "conv_id", "n_turns", "shard", place, "bit", "pos", "h", "g", F.xxhash64("pos", "h", "g").alias("p"), F.xxhash64("g", "pos", "h").alias("q"), "bytes")
    turns = materialise(turns, "turns")
    long_ones = turns.where(F.col("n_turns") > strip)
    totals = long_ones.groupBy("conv_id", "strip").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    starts = before(totals, "conv_id", "strip", ["p", "q"], F.bit_xor, lambda a, b: a.bitwiseXOR(b)).where("strip > 0")
    starts = convs.select("conv_id", F.lit(0).cast("long").alias("strip"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")).unionByName(starts)
    starts = starts.join(convs, "conv_id").select(
        "shard", "strip", "bit", (F.col("strip") * strip).alias("pos"), F.col("conv_id").alias("h"), F.col("n_turns").alias("g"), "p", "q",
        F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("base"))
    cells = turns.drop("conv_id", "n_turns").withColumn("base", F.lit(False)).unionByName(starts)
    found = cells.groupBy("shard", "strip").applyInArrow(_walk(_schema(spark, FOUND), strip), FOUND)
    return materialise(found, "shard-nodes"), convs


def trie(turns: DataFrame, convs: DataFrame, strip: int = STRIP) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and the shards' end lists (depth, p, q, shard, ends: conv_ids ascending as 64-bit integers).

    A node: depth, p and q (digest of its prefix), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens.
    """
    spark = turns.sparkSession
    found, convs = shard_nodes(turns, convs, strip)
    nodes = found.groupBy(*NODE).agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), *[F.max(c).alias(c) for c in ("bytes", "up", "uq")])
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("p"), F.col("uq").alias("q")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(kids, NODE, "left").fillna(0, ["n_children"]), "nodes")

    saved = (F.col("n_convs") - 1) * F.col("bytes")
    chains = nodes.groupBy("conv_id").agg(F.sum(saved).alias("total"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    weights = convs.join(chains, "conv_id").groupBy("shard").agg(F.collect_list(F.struct("bit", "total", "leaf")).alias("weights"))
    strips = found.select("shard", "strip").distinct()
    none = [F.lit(None).cast("long").alias(c) for c in NODE]
    weights = strips.join(weights, "shard").select("shard", "strip", *none, F.lit(None).cast("binary").alias("members"), "weights")
    sums = "depth long, p long, q long, total long, leaves long"
    weighed = weights.unionByName(found.select("shard", "strip", *NODE, "members"), allowMissingColumns=True).repartition("shard", "strip") \
        .sortWithinPartitions("shard", "strip", F.col("members").isNotNull()).mapInArrow(_weigh(_schema(spark, sums)), sums)
    weighed = weighed.groupBy(*NODE).agg(F.sum("total").alias("total"), F.sum("leaves").alias("n_leaves"))

    # What an owner's chain saves above a node; only nodes of several members save anything.
    shared = nodes.where("n_convs > 1").select("conv_id", "depth", F.shiftright("depth", 6).alias("part"), saved.alias("above"))
    parts = shared.groupBy("conv_id", "part").agg(F.sum("above").alias("above"))
    parts = before(parts, "conv_id", "part", ["above"], F.sum, lambda a, b: a + b).withColumnRenamed("above", "_above")
    own = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = shared.withColumn("above", F.coalesce(F.sum("above").over(own), F.lit(0))).join(parts, ["conv_id", "part"])
    above = above.select("conv_id", "depth", (F.col("above") + F.col("_above")).alias("above"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"), F.col("q").alias("uq"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.join(weighed, NODE).join(above, ["conv_id", "depth"], "left").withColumn(
        "saved_tokens", F.when(F.col("n_convs") > 1, F.col("total") - F.col("above")).otherwise(0))
    done = done.join(parents, ["depth", "up", "uq"], "left").select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return done, found.where("ends is not null").select(*NODE, "shard", "ends")


def with_end_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ends_sha256 of their end lists: decimal conv_ids, ascending, comma-joined.

    A node's lists are streamed in the order of the shards, one row for each shard that has some.
    """
    ddl = "depth long, p long, q long, ends_sha256 string"
    digests = ends.repartition(*NODE).sortWithinPartitions(*NODE, "shard").mapInArrow(_hash_ends(_schema(nodes.sparkSession, ddl)), ddl)
    return nodes.join(digests, NODE, "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"])


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of a trie of ``conversations`` with role and text of their last turn (NULL for the root)."""
    rows = positions(plain_turns(conversations), "role", "text").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(rows, ["conv_id", "depth"], "left")


def build(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``trie`` of the conversations as they are."""
    turns = keyed_turns(conversations)
    return trie(turns, turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns")))
