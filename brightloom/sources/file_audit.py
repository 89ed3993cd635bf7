"""One verdict row per file of a folder: extension, size and content signature."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value

# Accepted extensions, leading bytes of the formats.
EXTENSIONS = ("csv", "xlsx", "json", "parquet")
PARQUET_MARK = "50415231"   # PAR1
ZIP_MARK = "504B0304"       # PK\x03\x04


HEAD_BYTES = 8
WHOLE_BYTES = (1 << 31) - 1024   # what a Spark value can hold

ship_by_value(__name__)


def audit_files(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """path, length, extension, verdict ('ok' or the reason for rejection).

    Names and sizes are read from the listing alone. Of a file that passes both checks a task reads the first eight bytes,
    whatever its size. A store that only Spark's readers can open gives its files to those, up to the 2 GiB that they can
    hold; a larger file there is not opened and says so. Without ``max_bytes`` no size is too large. Empty files are not listed.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    )
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = listing.select("path", "length", extension.alias("extension"))
    known, small = F.col("extension").isin(*EXTENSIONS), _within(max_bytes)
    rejected = files.where(~known | ~small).withColumn(
        "verdict", F.when(~known, "unsupported file type").otherwise("file too large"))
    opened = files.where(known & small).mapInArrow(_heads, "path string, length long, extension string, head string")
    opened = materialise(opened, "heads")
    verdict = content_verdict("extension", "head")
    checked = opened.where("head is not null").select("path", "length", "extension", verdict)
    closed = opened.where("head is null")
    if not closed.isEmpty():
        contents = listing.where(F.col("length") < WHOLE_BYTES).select("path", F.hex(F.substring("content", 1, HEAD_BYTES)).alias("head"))
        read = closed.drop("head").join(contents, "path", "left")
        checked = checked.unionByName(read.select(
            "path", "length", "extension", F.when(F.col("head").isNull(), "too large to be opened in this store").otherwise(verdict).alias("verdict")))
    return rejected.unionByName(checked)


def _heads(batches):
    """The first bytes of each file in hex; NULL where the store can't be opened from here."""
    from pyarrow import fs

    for batch in batches:
        heads = []
        for path in batch["path"].to_pylist():
            try:
                if path.startswith("file:"):
                    store, place = fs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/")
                else:
                    store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    heads.append(file.read(HEAD_BYTES).hex().upper())
            except (OSError, ValueError, NotImplementedError):
                heads.append(None)
        yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], batch["extension"], pa.array(heads, pa.string())], ["path", "length", "extension", "head"])


def _within(max_bytes: int | None):
    return F.lit(True) if max_bytes is None else F.col("length") <= max_bytes


def content_verdict(extension: str, head: str):
    """Verdict of the first eight bytes (as hex) against the file extension."""
    kind, mark = F.col(extension), F.col(head)
    text_start = F.regexp_replace(mark, "^(09|0A|0B|0C|0D|20)+", "")
    null_byte = mark.rlike("^(..)*00")
    return (
        F.when((kind == "parquet") & ~mark.startswith(PARQUET_MARK), "not a Parquet file")
        .when((kind == "xlsx") & ~mark.startswith(ZIP_MARK), "not an Excel file")
        .when((kind == "json") & ~(text_start.startswith("7B") | text_start.startswith("5B")),
              "not a JSON file")
        .when((kind == "csv") & null_byte, "binary content in a CSV file")
        .when((kind == "csv") & (mark.startswith(ZIP_MARK) | mark.startswith(PARQUET_MARK)),
              "zip or Parquet content in a CSV file")
        .otherwise("ok")
        .alias("verdict")
    )
