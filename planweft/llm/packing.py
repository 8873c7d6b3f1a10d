"""Operator 4: best-fit decreasing packing with a segment tree over remaining capacities.

Pieces have whole lengths of at most the capacity, and bins of equal remaining
capacity are interchangeable. So best-fit decreasing over any number of pieces
follows from the count of pieces of each length: the driver takes lengths in
falling order, asks a segment tree for the tightest open bins in logarithmic
time, and places whole runs of equal pieces in whole runs of equal bins. The plan
has a size that the capacity bounds, not the data; every piece then finds its
bin by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweft.llm import units
from planweft.llm.shared import cut, only, text_or_empty, tidy

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
PLAN = "of_length int, first_rank long, last_rank long, each long, sequence long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds how many open bins have that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.full[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open bin has."""
        at = need + self.size
        if self.full[at]:
            return need
        while at > 1:
            if not at & 1 and self.full[at + 1]:  # a right sibling with bins: its leftmost leaf with bins
                at += 1
                while at < self.size:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (pieces by length).

    Returns runs (length, first rank, last rank + 1, pieces per bin, first bin,
    offset): rank r of the run goes to bin ``first bin + (r - first) // each`` at
    ``offset + (r - first) % each * length``.
    """
    tree, runs, plan, opened = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, bins: int) -> None:
        if bins and room:
            runs.setdefault(room, []).append((first, bins))
            tree.add(room, bins)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # no open bin fits: as many new ones as the rest fills
                room, first = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            else:
                first, bins = runs[room].pop()
                tree.add(room, -bins)
            # a bin that takes a piece is the tightest for the next one, until it has no room for it
            each = room // length
            whole = min(bins, left // each)
            if whole:
                plan.append((length, rank, rank + whole * each, each, first, capacity - room))
                put(room - each * length, first, whole)
                left, rank = left - whole * each, rank + whole * each
            if left and whole < bins:  # the last pieces, fewer than this bin could take
                plan.append((length, rank, rank + left, left, first + whole, capacity - room))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, bins - whole)
    return plan


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Encode every text and cut it; ``nth`` counts the pieces of one length within the task ``part``."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        library = units.of_file(tokenizer, spaced=False)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            docs, done = batch.column(0).to_pylist(), 0
            for ids, ends in library.documents(batch.column(1), end_id):
                data, first, out = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0, []
                for doc, end in zip(docs[done : done + len(ends)], ends.tolist(), strict=True):
                    for piece, at in enumerate(range(first, end, capacity)):
                        length = min(capacity, end - at)
                        out.append((doc, piece, at - first, length, zlib.crc32(data[4 * at : 4 * (at + length)]), part, int(seen[length])))
                        seen[length] += 1
                    first = end
                done += len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return only(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(tidy(run), PIECES)


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A
    document's ids are its text's (null: empty) and ``end_id``, so every row has
    at least one, and texts of any length are encoded whole. Only documents longer than a sequence are cut. Repeated ids and
    rows are packed each; a null id is kept. An empty table gives no rows; other
    columns are ignored.
    """
    spark: SparkSession = df.sparkSession
    pieces = cut(cut_pieces(df, tokenizer, end_id, capacity, id_col, text_col))
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(plan_bins(counts, capacity), PLAN)

    # ranks across the parts, without a task that sees all pieces of a common length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(F.col("part").alias("in_part"), F.col("length").alias("in_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(starts, (F.col("part") == F.col("in_part")) & (F.col("length") == F.col("in_length"))).withColumn("rank", F.col("earlier") + F.col("nth"))
    # the plan's size is bounded by the capacity
    found = ranked.join(F.broadcast(plan), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("last_rank")))
    place = F.col("rank") - F.col("first_rank")
    return found.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (place % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
