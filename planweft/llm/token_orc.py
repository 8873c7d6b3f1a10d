"""Operator 10: token ids in ORC files, written in ascending id order and read back by stripe.

Documents are range-partitioned and sorted by id, encoded in their sorted
partition and written with Spark's ORC writer: the ids are an integer column, so
the stripes hold run-length encoded integers, with a row index every
``index_stride`` rows and a Bloom filter on ``doc_id`` for metadata pruning. A
large file is read by many tasks, stripe by stripe.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweft.llm import units
from planweft.llm.shared import new_dir, only, parallelism, text_or_empty, tidy

FILE_SCHEMA = "doc_id long, part int, before long, n int, ids array<int>"


def encode_documents(sorted_docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, part, ids before it in the partition, number of ids, ids) of partitions that are already sorted."""

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        library = units.of_file(tokenizer, spaced=True)
        for batch in batches:
            done = 0
            for ids, ends in library.documents(batch.column(1), end_id):
                bounds = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ends)), pa.array(np.full(len(ends), part), pa.int32()), pa.array(before + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int32()), lists], names=["doc_id", "part", "before", "n", "ids"])
                done, before = done + len(ends), before + int(ends[-1])

    return sorted_docs.mapInArrow(tidy(run), FILE_SCHEMA)


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, stripe_bytes: int = 64 << 20, index_stride: int = 1000) -> None:
    """Write the ids of every text (null: empty), each followed by ``end_id``, as ORC files under ``path``.

    File names ascend with doc_id and rows ascend within a file; null ids come
    first, rows of one id are in the order of the input, in as many files as they need. Texts of
    any length are encoded whole. An empty table gives
    files without rows. Other columns are ignored.
    """
    spark = df.sparkSession
    docs = only(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), F.monotonically_increasing_id().alias("place"))
    # the place in the input splits an id that many rows share
    ranged = docs.repartitionByRange(partitions or parallelism(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    out = encode_documents(ranged, tokenizer, end_id).write.option("compression", "zstd")
    out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_stride).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, before, n, ids`` of the files; filters on doc_id are pushed to stripe statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def summarise(tokens: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` from what :func:`read_tokens` gives."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            raw = memoryview(np.ascontiguousarray(flat, "<i4")).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    docs = tokens.select("doc_id", "part", "before", "ids").mapInArrow(tidy(run), "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    # the ids themselves aren't read for the totals
    totals = tokens.groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("tokens"))
    starts = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return docs.join(starts, F.col("part") == F.col("of_part")).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, **options) -> DataFrame:
    """Write, read back and summarise; see :func:`write_tokens` for how odd rows count."""
    path = path or new_dir(df.sparkSession, "tokens")
    write_tokens(df, path, tokenizer, end_id, **options)
    return summarise(read_tokens(df.sparkSession, path))
