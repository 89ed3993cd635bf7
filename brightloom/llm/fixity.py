"""WARC: a Merkle fixity audit of replicas, in DataFrame functions.

Records lie one after the other in files, as ``stored`` writes them; ``catalogue`` reads a replica's bytes and hashes each
record in a pass of its own. A leaf of a file's tree covers ``leaf_bytes`` of offsets and hashes, in
order of offset, the records that begin there; ``fanout`` neighbours form a node of the next level, up to one root a
file. The files' roots are leaves of a tree over ``buckets`` of file names and one root of the replica. Offsets, not
positions, decide where a record belongs, so a lost record disturbs its own leaf alone.

The audit compares the roots of two replicas and then reads, level by level, only the children of nodes that differ.
Every group that is gathered into one hash is bounded by ``fanout`` or by the records of one leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise

LEAF_BYTES, FANOUT, RUN = 1 << 16, 16, 1000
MOST, COPIES = 1 << 16, 256  # records of a run that make one file; copies of a record that one task lays out


def warc_record(url, page_id, html):
    """A WARC response record as text; NULL parts count as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def stored(pages: DataFrame, run: int = RUN, most: int = MOST) -> DataFrame:
    """The records of ``pages`` as a replica holds them, written once: file, offset, record (bytes), page_id.

    A file holds ``run`` neighbouring page ids (NULL ids: ``none``), in order of id and digest. A run of over ``most``
    records, as one id or no id on many pages makes it, is dealt by digest to several files. Repeated records are counted
    before they meet and lie one after the other, so that no task gathers them. No pages give no records.
    """
    records = pages.select(
        "page_id", F.encode(warc_record(F.col("url"), F.col("page_id"), F.col("html")), "UTF-8").alias("record"),
        F.coalesce(F.floor(F.col("page_id") / run).cast("string"), F.lit("none")).alias("run"),
    ).withColumn("digest", F.sha2("record", 256))
    sizes = pages.groupBy(F.coalesce(F.floor(F.col("page_id") / run).cast("string"), F.lit("none")).alias("run")).agg(F.count("*").alias("c"))
    parts = sizes.where(F.col("c") > most).select("run", F.ceil(F.col("c") / most).alias("parts"))  # at most rows / most rows
    named = records.join(F.broadcast(parts), "run", "left").withColumn("file", F.when(F.col("parts").isNull(), F.col("run")).otherwise(
        F.concat_ws("-", "run", F.pmod(F.xxhash64("digest"), F.col("parts")))))
    different = named.groupBy("file", "page_id", "digest").agg(F.count("*").alias("n"), F.min("record").alias("record"))
    size = F.octet_length("record").cast("long")
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    laid = different.select(
        "file", "page_id", "record", "n", F.coalesce(F.sum(F.col("n") * size).over(before), F.lit(0)).cast("long").alias("start"))
    many = laid.where(F.col("n") > COPIES).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("file", "start", "first").withColumn("last", F.least(F.col("first") + COPIES, "n") - 1)
    few = laid.where(F.col("n") <= COPIES).withColumn("first", F.lit(0).cast("long")).withColumn("last", F.col("n") - 1)
    copies = few.unionByName(many).withColumn("i", F.explode(F.sequence("first", "last")))
    return materialise(copies.select("file", (F.col("start") + F.col("i") * size).alias("offset"), "record", "page_id"), "replica")


def catalogue(records: DataFrame) -> DataFrame:
    """file, offset, length, digest, page_id of a replica's records (file, offset, record, page_id), each read and hashed once.

    What the audit reads is the table written here. NULL records have no length and no digest.
    """
    return materialise(records.select(
        "file", "offset", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), "page_id"), "catalogue")


def lay_out(pages: DataFrame, run: int = RUN, most: int = MOST) -> DataFrame:
    """The catalogue of the stored records of ``pages``."""
    return catalogue(stored(pages, run, most))


def _gather(df: DataFrame, keys: list[str], order: str, digest) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), digest.alias("h"))))
    return df.groupBy(*keys).agg(
        F.sha2(F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x[order].cast("string"), x["h"])), ","), 256)
        .alias("hash")
    )


def levels_for(records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> int:
    last = records.agg(F.max("offset")).first()[0] or 0
    levels, covered = 1, leaf_bytes
    while covered <= last:
        levels, covered = levels + 1, covered * fanout
    return levels


def trees(records: DataFrame, levels: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, buckets: int = 4096) -> list[DataFrame]:
    """From leaves to the replica's root, tables of (parent, node, hash); the root's node and parent are ``root``.

    The leaves are written once; each higher level reads a ``fanout`` part of the one below.
    """
    leaf = F.floor(F.col("offset") / leaf_bytes)
    at = materialise(
        _gather(records.withColumn("n", leaf), ["file", "n"], "offset", F.concat_ws("/", "length", "digest")), "leaves"
    )
    files = [at]
    for _ in range(levels - 1):
        at = _gather(at.withColumn("up", F.floor(F.col("n") / fanout)), ["file", "up"], "n", F.col("hash")).withColumnRenamed("up", "n")
        files.append(at)
    out = []
    for k, level in enumerate(files):
        node = F.concat_ws("/", F.lit(k), "file", "n")
        parent = F.concat_ws("/", F.lit(k + 1), "file", F.floor(F.col("n") / fanout)) if k < levels - 1 else F.concat(
            F.lit("b/"), F.pmod(F.xxhash64("file"), F.lit(buckets)))
        out.append(level.select(parent.alias("parent"), node.alias("node"), "hash"))
    above = _gather(out[-1], ["parent"], "node", F.col("hash")).select(F.lit("root").alias("parent"), F.col("parent").alias("node"), "hash")
    root = _gather(above, ["parent"], "node", F.col("hash")).select(F.lit("root").alias("parent"), F.col("parent").alias("node"), "hash")
    return [*out, above, root]


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that only one side has."""
    a, b = left.select("node", F.col("hash").alias("a")), right.select("node", F.col("hash").alias("b"))
    return a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas: file, offset, status, and each side's digest and length.

    Both inputs hold file, offset, length and digest, at most one record an offset (of several, each is compared).
    ``status`` is ``corrupt``, ``missing`` (only left) or ``extra`` (only right). Equal or empty replicas give no row;
    NULL files are not records and are skipped. Other columns are ignored.
    """
    sides = [s.where("file is not null and offset is not null").select("file", "offset", "length", "digest") for s in (left, right)]
    levels = max(levels_for(s, leaf_bytes, fanout) for s in sides)
    mine, theirs = (trees(s, levels, leaf_bytes, fanout) for s in sides)
    suspects = differing(mine[-1], theirs[-1])
    for a, b in list(zip(mine, theirs))[-2::-1]:
        below = [side.join(suspects.withColumnRenamed("node", "parent"), "parent", "left_semi") for side in (a, b)]
        suspects = materialise(differing(*below), "suspects")
    leaf = F.concat_ws("/", F.lit(0), "file", F.floor(F.col("offset") / leaf_bytes))
    a, b = (s.withColumn("node", leaf).join(suspects, "node", "left_semi").drop("node") for s in sides)
    a = a.select("file", "offset", F.col("length").alias("left_length"), F.col("digest").alias("left_digest"))
    b = b.select("file", "offset", F.col("length").alias("right_length"), F.col("digest").alias("right_digest"))
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("corrupt")
    return a.join(b, ["file", "offset"], "full_outer").where(
        ~(F.col("left_digest").eqNullSafe(F.col("right_digest")) & F.col("left_length").eqNullSafe(F.col("right_length")))
    ).select("file", "offset", status.alias("status"), "left_length", "right_length", "left_digest", "right_digest")
