"""Operator 5: contiguous shards of equal bytes, by global prefix sums. DataFrame operations only.

The rows are range-partitioned by id; each range's byte total is summed, the
totals are prefix-summed (one small row per range), and a row's place in the
whole is its range's start plus its place in the range. Cuts lie at equal
multiples of total / shards, and a row belongs to the shard in which its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweft.llm.shared import cut, only, parallelism, text_or_empty


def balanced_shards(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Every row's shard and its slot there.

    Returns ``doc_id long, size long, text_crc32 long, shard int, slot long``.
    ``size`` is the text's UTF-8 bytes plus ``overhead``; a null text has no
    bytes. Shards are contiguous in (id, size, checksum) order, null ids first;
    repeated rows each get a slot. Shard sizes differ from the equal target by
    less than one row at each end; with fewer rows than shards some shards stay
    empty. An empty table gives no rows; other columns are ignored.
    """
    text = text_or_empty("text")
    sized = only(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32"]
    # written once: the ranges come from a sample, and both readings below must see the same ones
    ranged = cut(sized.repartitionByRange(4 * parallelism(df.sparkSession), *order).withColumn("part", F.spark_partition_id()))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts = totals.select(
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("ends", F.sum("size").over(here)).withColumn("nth", F.row_number().over(here))
    placed = local.join(starts, F.col("part") == F.col("of_part")).select(
        "doc_id", "size", "text_crc32",
        # twice the middle byte, so that whole numbers do
        F.least(F.lit(shards - 1), F.expr(f"((2 * (bytes_before + ends) - size) * {shards}) div (2 * all_bytes)")).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first")).select(F.col("shard").alias("of_shard"), "first")
    # one row per shard, a number that the caller sets
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("of_shard")).select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
