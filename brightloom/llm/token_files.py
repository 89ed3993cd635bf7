"""Token-ID output: texts as token ids in files of range-coded blocks, and reading them back.

``write`` sorts the documents by doc_id (ties by the text's crc32), encodes each whole text with the tokenizers
library, appends the end id and cuts the ids of each partition (one file number) into blocks of ``block_ids`` ids, coded by
``range_coder``. The files are Parquet tables with a row for each block, so that they split, survive lost executors and
can be read by any task:

    file, block   number of the partition and of the block in it, both ascending with doc_id
    first, n_ids  ids of the file before the block, and in it
    payload       the coded block, with its own checksum
    docs          for each document with ids here: ordinal in the file, doc_id, part (0 where it begins), its first
                  id's place in the block, its ids in this block, and its ids in all

``read`` decodes the blocks, checks them and gives the documents back.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.functions.runtime import ship_by_value
from brightloom.llm import range_coder, words

BLOCK_IDS = 1 << 20
#: Bytes of text that are cut and encoded at a time; longer texts are taken alone.
SLICE_BYTES = 16 << 20

BLOCKS = (
    "file int, block int, first bigint, n_ids int, payload binary, "
    "docs array<struct<ordinal:bigint,doc_id:bigint,part:int,at:int,n:int,n_tokens:bigint>>"
)
PIECES = "file int, ordinal bigint, doc_id bigint, part int, start bigint, n_tokens bigint, crc bigint, ids binary"

for _module in (range_coder, words):
    ship_by_value(_module.__name__)
ship_by_value(__name__)


def _tokenizer(path):
    # a task has one core, and the pool of threads would be the library's own
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where slices of about SLICE_BYTES begin and end."""
    _, ends = words.bytes_of(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, side="right")) - 1)
        yield begin, end
        begin = end


def _encoded(batches, tokenizer_path) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of all documents of a slice, ids of each) without end ids."""
    store = words.of_worker(("token_files", tokenizer_path), lambda: words.PieceIds(_tokenizer(tokenizer_path)))
    for batch in batches:
        for begin, end in _slices(batch["text"]):
            pieces, before = words.cuts(batch["text"].slice(begin, end - begin))
            ids, sizes = store.of(pieces)
            ends = np.append(0, np.cumsum(sizes))
            yield batch["doc_id"].slice(begin, end - begin), ids, np.diff(ends[before])


def _parts(begin, end, block_ids):
    """Cut runs of ids (at least one each) where blocks begin: of each part its run, number in the run, begin and end."""
    count = (end - 1) // block_ids - begin // block_ids + 1
    run = np.repeat(np.arange(len(begin)), count)
    part = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    block = begin[run] // block_ids + part
    return run, part, np.maximum(begin[run], block * block_ids), np.minimum(end[run], (block + 1) * block_ids)


def _packer(tokenizer_path, vocabulary, end_id, block_ids, schema):
    layout = schema.field("docs").type.value_type

    def pack(batches):
        file = TaskContext.get().partitionId()
        held: list[np.ndarray] = []     # what the open block has so far
        docs: list[pa.Array] = []
        block, ordinal, done = 0, 0, 0  # done: ids of the file so far

        def flush():
            nonlocal block, held, docs
            ids, own = np.concatenate(held), pa.concat_arrays(docs)
            row = [[file], [block], [block * block_ids], [len(ids)], [range_coder.encode(ids, vocabulary)]]
            arrays = [pa.array(v, f.type) for v, f in zip(row, schema)]
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own).cast(schema.field("docs").type))
            block, held, docs = block + 1, [], []
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for doc_ids, ids, sizes in _encoded(batches, tokenizer_path):
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            ends = done + np.cumsum(sizes)
            run, part, begin, end = _parts(ends - sizes, ends, block_ids)
            columns = [pa.array(ordinal + run), doc_ids.take(pa.array(run)), pa.array(part), pa.array(begin % block_ids),
                       pa.array(end - begin), pa.array(sizes[run])]
            rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, layout)], fields=list(layout))
            stops = np.append(np.flatnonzero(np.diff(begin // block_ids)) + 1, len(run))
            at = 0
            for stop in stops.tolist():
                held.append(ids[begin[at] - done : end[stop - 1] - done])
                docs.append(rows.slice(at, stop - at))
                if end[stop - 1] == (block + 1) * block_ids:
                    yield flush()
                at = stop
            done, ordinal = int(ends[-1]), ordinal + len(sizes)
        if held:
            yield flush()

    return pack


def _unpack(schema):
    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch["docs"].slice(i, 1).flatten()
                ordinal, doc_id, part, at, n, n_tokens = docs.flatten()
                begin, size, whole = (c.to_numpy().astype(np.int64) for c in (at, n, n_tokens))
                ids = memoryview(range_coder.decode(batch["payload"][i].as_py()).tobytes())
                alone = (size == whole).tolist()
                runs = [ids[b:e] for b, e in zip((4 * begin).tolist(), (4 * (begin + size)).tolist())]
                columns = [
                    pa.array(np.full(len(docs), batch["file"][i].as_py())), ordinal, doc_id, part,
                    pa.array(batch["first"][i].as_py() + begin), n_tokens,
                    pa.array([zlib.crc32(r) if a else None for r, a in zip(runs, alone)], pa.int64()),
                    pa.array([None if a else bytes(r) for r, a in zip(runs, alone)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return unpack


def _arrow(spark, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def write(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int = 50257, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Write the token ids of ``docs`` to ``path``.

    A NULL or empty text gives the end id alone; NULL doc_ids come first; rows with one doc_id stay apart, in order of the
    text's crc32; very long texts span blocks. Other columns are ignored. An empty table gives an empty folder of files.
    """
    spark = docs.sparkSession
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "tie", F.struct(F.crc32("text"), F.monotonically_increasing_id())
    ).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = ordered.drop("tie")
    ordered.mapInArrow(_packer(tokenizer_path, vocabulary, end_id, block_ids, _arrow(spark, BLOCKS)), BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, ordinal."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    pieces = blocks.mapInArrow(_unpack(_arrow(spark, PIECES)), PIECES)
    part = F.struct("part", "ids")
    joined = F.aggregate(F.sort_array(F.collect_list(F.when(F.col("ids").isNotNull(), part))), F.lit(b""),
                         lambda a, x: F.concat(a, x["ids"]))
    whole = pieces.groupBy("file", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.first("n_tokens").alias("n_tokens"),
        F.coalesce(F.max("crc"), F.crc32(joined)).alias("ids_crc32"),
    )
    # a row for each file, of which there are as many as write tasks
    files = blocks.groupBy("file").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
    files = files.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("base"))
    return whole.join(F.broadcast(files), "file").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "file", "ordinal"
    )
