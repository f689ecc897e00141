"""Best-fit-decreasing packing of token sequences, exact at any number of documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm import encoders
from tripweave.llm.chunks import release, slices
from tripweave.sources.shared import written

CAPACITY = 2048


class Capacities:
    """Segment tree over the remaining capacities 0 to most: the tightest one in use that is large enough, in logarithmic time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = np.zeros(2 * self.leaves, bool)

    def mark(self, capacity: int, used: bool) -> None:
        k = self.leaves + capacity
        self.tree[k] = used
        while k > 1:
            k //= 2
            self.tree[k] = self.tree[2 * k] or self.tree[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        k = self.leaves + least
        if self.tree[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.tree[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over how many pieces there are of each length.

    Pieces of one length are alike, and so are bins with the same capacity left, so a
    whole run of steps is taken at once: a piece goes to the tightest open bin,
    which stays the tightest until no piece of this length fits it any more. The result is that of
    placing the pieces one by one. Its size depends on the lengths there are, not on the number of pieces.

    Returns runs (length, rank, bin, each, used): from rank on (up to the next run's rank of that
    length) the pieces fill bins from number `bin` on, `each` to a bin, the first of them at offset `used`.
    """
    open_bins: dict[int, deque] = {}
    tree = Capacities(capacity)
    runs, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if not open_bins.setdefault(left, deque()):
                tree.mark(left, True)
            open_bins[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                each = capacity // length
                left, first, n = capacity, bins, -(-todo // each)
                bins += n
            else:
                first, n = open_bins[left].popleft()
                if not open_bins[left]:
                    tree.mark(left, False)
                each = left // length
            runs.append((length, rank, first, each, capacity - left))
            full = min(n, todo // each)
            put(left - each * length, first, full)
            rank, todo = rank + full * each, todo - full * each
            if todo and full < n:  # the last pieces of this length don't fill their bin
                put(left - todo * length, first + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            if full < n:
                if not open_bins.setdefault(left, deque()):
                    tree.mark(left, True)
                open_bins[left].appendleft((first + full, n - full))
    return runs


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): token ids of whole texts, each followed by `end`, cut at the capacity.

    A null text counts as empty and gives the end id alone. ids is empty without with_ids.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders.encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = enc.encode(part.column(1), end)
                each = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = np.repeat(np.cumsum(counts) - counts, each) + start
                found = [ids[a : a + n] for a, n in zip(at, length, strict=True)]
                kept = pa.array([x.astype(np.int32) if with_ids else [] for x in found], pa.list_(pa.int32()))
                crc = pa.array([encoders.crc32(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), crc, kept], names=["id", "piece", "start", "length", "ids_crc32", "ids"])
        release()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>")


def pack(rows: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows with sequence_id and offset (long): each is in one sequence of at most `capacity`, gapless from 0.

    Lengths are from 1 to capacity. The rows are written once with a number of their own. The
    plan needs only how many rows there are of each length (at most `capacity` numbers reach the
    driver); a row's rank among those of its length comes from counts by length and written
    part, so no task holds more than one part of a length, however common that is. Repeated rows are rows of their own.
    """
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")  # the number is fixed from here on
    part = F.shiftright("_row", 33).alias("_part")
    sums = rows.groupBy(F.col(length_col).alias("_length"), part).count()
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))), "counts")
    counts = {r[0]: r[1] for r in sums.groupBy("_length").agg(F.sum("count")).collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast(runs)

    inside = F.row_number().over(Window.partitionBy("_length", "_part").orderBy("_row")) - 1
    keys = rows.select("_row", F.col(length_col).alias("_length"), part).withColumn("_inside", inside)
    ranks = keys.join(sums, ["_length", "_part"]).select("_row", "_length", (F.col("_before") + F.col("_inside")).alias("_rank"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        span = np.int64(1) << 50
        starts = table[:, 0] * span + table[:, 1]
        for batch in batches:
            row, length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            run = table[np.searchsorted(starts, length * span + rank, side="right") - 1] if len(row) else table[:0]
            k = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(run[:, 2] + k // run[:, 3]), pa.array(run[:, 4] + k % run[:, 3] * length)], names=["_at", "sequence_id", "offset"])

    placed = ranks.mapInArrow(kernel, "_at long, sequence_id long, offset long")
    return rows.join(placed, F.col("_row") == F.col("_at")).drop("_row", "_at")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places in packed sequences, one row per piece.

    Columns: id_col, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, ids. Null
    and empty texts are pieces of one id; rows that repeat are packed each; other columns aren't read.
    """
    found = pack(pieces(docs, vocabulary, id_col, text_col, capacity, end, with_ids), "length", capacity)
    found = found.withColumnRenamed("id", id_col).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    return found if with_ids else found.drop("ids")
