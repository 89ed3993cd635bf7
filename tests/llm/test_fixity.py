import pytest
from pyspark.sql import functions as F

from brightloom.llm import fixity


@pytest.fixture(scope="module")
def laid(spark):
    pages = spark.range(3000).selectExpr("if(id % 500 = 3, null, id) as page_id", "concat('http://h/', id) as url",
                                         "if(id % 7 = 0, null, repeat('x', id % 300)) as html", "id as offset", "'f' as file")
    pages = pages.unionByName(pages.where("page_id = 10")).unionByName(pages.where("page_id = 10").withColumn("html", F.lit("other")))
    return fixity.lay_out(pages, 400).cache()


def test_offsets_follow_each_other(laid):
    rows = sorted((r["file"], r["offset"], r["length"]) for r in laid.collect())
    for a, b in zip(rows, rows[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_repeated_pages_are_laid_out(spark):
    """One page on a third of the rows, NULL ids on another third, an id with many records; no byte is lost or lies twice."""
    pages = spark.range(3000).selectExpr(
        "case id % 3 when 0 then 7L when 1 then null else if(id < 1500, 450L, id) end as page_id", "'u' as url",
        "if(id % 3 = 0, 'same', repeat('y', cast(id % 211 as int))) as html", "id as run", "'d' as digest")
    laid = fixity.stored(pages, 400, most=300).collect()
    want = sorted(bytes(r[0]) for r in pages.select(F.encode(fixity.warc_record(F.col("url"), F.col("page_id"), F.col("html")), "UTF-8")).collect())
    assert sorted(bytes(r["record"]) for r in laid) == want
    files = {}
    for r in sorted(laid, key=lambda r: (r["file"], r["offset"])):
        assert r["offset"] == files.get(r["file"], 0)
        files[r["file"]] = r["offset"] + len(r["record"])
    assert sum(f.startswith("none-") for f in files) > 1 and sum(f.startswith("1-") for f in files) > 1


def test_damaged_bytes_are_found(spark):
    from brightloom.llm.catalog import damaged

    pages = spark.range(900).selectExpr("if(id = 20, null, id) as page_id", "'u' as url", "if(id = 30, null, repeat('zé', cast(id % 50 as int))) as html")
    replica = fixity.stored(pages.unionByName(pages.where("page_id = 7")), 100)
    left = fixity.catalogue(replica)
    got = fixity.audit(left, fixity.catalogue(damaged(replica)), leaf_bytes=2048, fanout=3).collect()
    place = {(r["file"], r["offset"]): r["page_id"] for r in left.collect()}
    found = sorted((r["status"], place.get((r["file"], r["offset"])), (r["right_length"] or 0) - (r["left_length"] or 0))
                   for r in got if r["status"] == "corrupt")
    assert found == sorted([("corrupt", i, 0) for i in range(900) if i % 101 == 7 for _ in range(1 + (i == 7))]
                           + [("corrupt", i, -4) for i in range(900) if i % 103 == 11])
    assert {place[r["file"], r["offset"]] for r in got if r["status"] == "missing"} == {i for i in range(900) if i % 211 == 3}
    assert sorted(place[r["file"], r["offset"] - 1] for r in got if r["status"] == "extra") == [i for i in range(900) if i % 307 == 5]


def test_no_pages(spark):
    assert fixity.lay_out(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_audit_finds_what_differs(laid):
    other = laid.where("not coalesce(page_id % 401 = 5, false)").withColumn(
        "digest", F.when(F.col("page_id") % 333 == 1, F.lit("0")).otherwise(F.col("digest")))
    extra = laid.limit(1).select(F.lit("new").alias("file"), F.lit(0).cast("long").alias("offset"), "length", "digest", "page_id")
    got = {(r["file"], r["offset"]): r["status"] for r in fixity.audit(laid, other.unionByName(extra), leaf_bytes=4096, fanout=4).collect()}
    want = {}
    for r in laid.collect():
        if r["page_id"] is not None and r["page_id"] % 401 == 5:
            want[r["file"], r["offset"]] = "missing"
        elif r["page_id"] is not None and r["page_id"] % 333 == 1:
            want[r["file"], r["offset"]] = "corrupt"
    want["new", 0] = "extra"
    assert got == want


def test_equal_and_empty_replicas(laid):
    assert fixity.audit(laid, laid).collect() == []
    assert fixity.audit(laid.limit(0), laid.limit(0)).collect() == []
    few = laid.limit(3)
    assert {r["status"] for r in fixity.audit(few, few.limit(0)).collect()} == {"missing"}
