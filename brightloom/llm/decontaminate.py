"""Benchmark decontamination: which words of documents lie in windows of benchmark items; DataFrame functions only.

A window is ``window`` consecutive words of an item, or all words of a shorter one. It is a sequence of shingles of
``SHINGLE`` words (fewer in shorter windows). A document can only hold a window if it holds the window's rarest shingle, so
that shingle is the necessary prefix: windows are joined to documents on it alone. Bounds on place and length follow, and
then every shingle of the window must stand at its own place, which is exact containment.

Rarity is the number of occurrences in all documents, counted on the join of documents with the benchmark's shingles. A
window of which some shingle occurs nowhere is left out. The benchmark's shingles are broadcast only while there are at
most ``MOST_BROADCAST`` of them; more are joined by a shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise

WINDOW, SHINGLE, MOST_BROADCAST = 10, 3, 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """The words of a text, A-Z in lower case; none for NULL."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lower, F.lit(WORD), 0)


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """The distinct windows of the items: wid, size, words; and the items of each: wid, item."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    w = w.select("item", "size", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("words"))
    return w.select(F.sha2(F.array_join("words", " "), 256).alias("wid"), "item", "size", "words").distinct()


def _broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW):
    """(texts, matches, windows): row, doc_id, tkey (the text's md5), n_words, words; row, start, size, wid (None without windows); wid, item."""
    texts = materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.md5("text").alias("tkey"), words(F.col("text")).alias("words")
    ).withColumn("n_words", F.size("words").cast("long")), "words")
    own = materialise(windows_of(items, window), "windows")
    distinct = own.select("wid", "size", "words").distinct()
    k = F.least(F.col("size"), F.lit(SHINGLE))
    needed = materialise(distinct.select("wid", "size", k.alias("k"), F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))).alias("offset", "shingle")),
        "shingles")
    n_needed = needed.count()
    vocabulary = needed.select("k", "shingle").distinct()

    found = None
    for k in sorted(r["k"] for r in vocabulary.select("k").distinct().collect()):  # at most SHINGLE values
        rest = [F.get("words", F.col("pos") + i) for i in range(1, k)]
        keys = vocabulary.where(F.col("k") == k).select("k", "shingle", F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(i)) for i in range(k)]).alias("key"))
        at = texts.select("row", "n_words", "words", F.posexplode("words").alias("pos", "word")).where(F.col("pos") + k <= F.col("n_words"))
        at = at.select("row", "n_words", "pos", F.xxhash64("word", *rest).alias("key"), F.struct("word", *[r.alias(f"w{i}") for i, r in enumerate(rest)]).alias("own"))
        hit = at.join(_broadcast(keys, n_needed), "key").where(
            F.col("shingle") == F.concat_ws(" ", *[F.col(f"own.{c}") for c in ["word", *(f"w{i}" for i in range(k - 1))]]))
        hit = hit.select("row", "n_words", "pos", "k", "shingle")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return texts, None, own
    hits = materialise(found, "hits")

    rarity = hits.groupBy("k", "shingle").agg(F.count("*").alias("n"))
    ranked = needed.join(_broadcast(rarity, n_needed), ["k", "shingle"], "left")
    prefix = ranked.groupBy("wid", "size").agg(
        F.count("*").alias("shingles"), F.count("n").alias("there"), F.min(F.struct("n", "shingle", "offset", "k")).alias("least"),
    ).where("shingles = there").select("wid", "size", "shingles", "least.k", "least.shingle", "least.offset")
    candidates = hits.join(_broadcast(prefix, n_needed), ["k", "shingle"]).withColumn("start", F.col("pos") - F.col("offset")).where(
        (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    candidates = candidates.select("row", "start", "wid", "size", "shingles")
    places = candidates.join(_broadcast(needed.select("wid", "k", "shingle", "offset"), n_needed), "wid").withColumn("pos", F.col("start") + F.col("offset"))
    there = places.join(hits.select("row", "pos", "k", "shingle"), ["row", "pos", "k", "shingle"])
    matches = there.groupBy("row", "start", "wid", "size", "shingles").agg(F.count("*").alias("n")).where("n = shingles")
    return texts, materialise(matches.select("row", "start", "size", "wid"), "matches"), own


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    NULL and empty texts have no words and are clean; items without words are no windows; a NULL item_id counts as the
    empty string; repeated items count once, repeated documents each. Other columns are ignored. An empty benchmark
    leaves every document clean.
    """
    texts, matches, own = find(docs, items, window)
    rows = texts.select("row", "doc_id", "n_words")
    nothing = F.sha2(F.lit(""), 256)
    if matches is None:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                           nothing.alias("items_sha256"), F.lit(False).alias("contaminated"))
    end = F.col("start") + F.col("size")
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.select("row", "start", end.alias("end"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hit = spans.withColumn("new", new).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    named = matches.select("row", "wid").join(own.select("wid", "item"), "wid").groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    return rows.join(hit, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark; NULL and empty texts stay."""
    texts, matches, _ = find(docs, items, window)
    if matches is None:
        return docs
    leaked = texts.select("row", "tkey").join(matches.select("row").distinct(), "row").select(F.col("tkey").alias("leaked")).distinct()
    leaked = materialise(leaked, "leaked")
    return docs.join(_broadcast(leaked, leaked.count()), F.md5(docs["text"]) == leaked["leaked"], "left_anti")
