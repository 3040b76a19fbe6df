"""Token counts from flat, unindexed token files by a separator scan.

A token file is a stream of fixed-width ids in which an end id closes each document; nothing says where documents
begin.  It is held in blocks of a fixed number of ids, cut without regard to documents.  Each block is searched for the
end id in one vectorised comparison, which gives the documents that end in it and the ids left over behind the last
end.  A prefix scan over the blocks of a file stitches the boundaries: a document that ends in a block as its first one
began behind the last end id before that block.

Defined cases: an empty file or block has no documents; ids behind the last end id are a document that is not closed
(``closed`` false); two end ids in a row are an empty document of the end id alone; a block's bytes beyond a whole
number of ids are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, text_of
from .tokens import encoder, public


def scan_blocks(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(file, doc, start, n_tokens, closed) from (file string, block long, data binary); the end id counts as a token.

    ``doc`` numbers the documents of a file from 0 and ``start`` is the document's first id in the file.
    """

    def search(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file, block, data in zip(*(batch.column(k) for k in range(3))):
                ids = np.frombuffer(data.as_py(), dtype)
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()]), pa.array([block.as_py()], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    found = blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(search, "file string, block long, n long, ends array<long>")
    found = Scratch(blocks.sparkSession).put(found, "ends")
    # one short row a block goes through the scan, not the ids of its ends
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    facts = found.select("file", "block", "n", F.size("ends").alias("m"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("tail"))
    base = facts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs", F.coalesce(F.sum("m").over(before), F.lit(0)))
    base = base.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("tail") + 1).over(before), F.lit(0)))
    placed = found.join(base.select("file", "block", "base", "docs", "open"), ["file", "block"])
    each = placed.where(F.size("ends") > 0).select("file", "base", "docs", "open", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1)
    closed = each.select("file", (F.col("docs") + F.col("k")).alias("doc"), start.alias("start"), (F.col("base") + F.col("end") + 1).alias("stop"), F.lit(True).alias("closed"))
    whole = base.groupBy("file").agg(F.sum("m").alias("doc"), F.coalesce(F.max(F.col("base") + F.col("tail") + 1), F.lit(0)).alias("start"), F.sum("n").alias("stop"), F.lit(False).alias("closed"))
    rows = closed.unionByName(whole.where("stop > start"))
    return rows.select("file", "doc", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """(file, block, data) of raw token files, read by Spark's own reader; ``block_bytes`` a multiple of the id width.

    Spark hands each file over whole, so files should be shards of at most some 100 MB, as token shards are.
    """

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                raw = memoryview(data.as_buffer())
                for k, at in enumerate(range(0, len(raw), block_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([k], pa.int64()), pa.array([bytes(raw[at : at + block_bytes])])], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block long, data binary")


def token_stream(df: DataFrame, end_id: int, block_ids: int = 1 << 16, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """The documents as token files in blocks: (file, block, data, ids), a file for each partition of ``df``.

    ``ids`` lists the documents that end in the block, in their order in the file; only the check of a scan uses it.
    An id that ``dtype`` cannot hold is an error.
    """
    path = ranks_path or public("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]):
        encode, file = encoder(path, False), f"{TaskContext.get().partitionId():06d}"
        held, size, block, names = [], 0, 0, []

        def row(ids, listed):
            if int(ids.max()) > np.iinfo(dtype).max:
                raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([ids.astype(dtype).tobytes()]), pa.array([listed], pa.list_(pa.int64()))], ["file", "block", "data", "ids"])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held += (encode(text.as_py()), np.array([end_id], np.uint32))
                size += len(held[-2]) + 1
                names.append((size, ident))
                while size >= block_ids:
                    flat = np.concatenate(held)
                    whole = [i for at, i in names if at <= block_ids]
                    yield row(flat[:block_ids], whole)
                    names = [(at - block_ids, i) for at, i in names if at > block_ids]
                    held, size, block = [flat[block_ids:]], size - block_ids, block + 1
        if size:
            yield row(np.concatenate(held), [i for _, i in names])

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, "file string, block long, data binary, ids array<long>")


def document_token_counts(df: DataFrame, end_id: int = 50256, dtype: str = "<u2", **params) -> DataFrame:
    """doc_id, file, doc, start, n_tokens for each document: its tokens are written as token files and found again.

    The end-of-text string inside a text is encoded as ordinary text, so the end id marks ends of documents only.
    """
    stream = Scratch(df.sparkSession).put(token_stream(df, end_id, dtype=dtype, **params), "stream")
    counts = scan_blocks(stream, end_id, dtype)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stream.select("file", "block", F.size("ids").cast("long").alias("m"))
    base = sizes.select("file", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    named = stream.join(base, ["file", "block"]).select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("doc"), "doc_id")
    return counts.join(named, ["file", "doc"], "left").select("doc_id", "file", "doc", "start", "n_tokens")
