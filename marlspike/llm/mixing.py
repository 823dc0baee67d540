"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded random order, are dealt into blocks. Block j (from 1) of a source
of weight w is released at slot floor((j - 1) / w) and due by slot ceil(j / w); of the released blocks,
that of the earliest deadline goes next. Windows come from the exact weights over the whole schedule,
nothing is rounded, so at each slot a source has had its weight's share of the slots so far to within less
than one block, as long as it has blocks; a source that runs out asks for no more slots, and the others
keep their windows.

What a slot's choice depends on is only how many blocks each source has had. The driver runs through the
schedule once and keeps these counts every RANGE slots, a few numbers for each source and nothing for
each block; tasks then deal the slots of each range from its counts, and the rows meet their slots by
source and block.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pack, row_of, table, unpack, written

#: Documents of a block, slots of a period, documents for each bucket of the order within a source, slots that a task deals (and eight for each source, at least).
BLOCK, PERIOD, BUCKET, RANGE = 16, 5040, 4096, 500_000


def periods(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Slots of each source in one period, by largest remainders; one at least for each source of weight above 0."""
    if len(weights) > slots:
        slots = len(weights) * 4
    total = sum(weights.values())
    exact = {k: v / total * slots for k, v in weights.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    rest = sorted(exact, key=lambda k: (out[k] - exact[k], k))
    while sum(out.values()) < slots:
        for k in rest[: slots - sum(out.values())]:
            out[k] += 1
    while sum(out.values()) > slots:
        k = max((k for k in out if out[k] > 1), key=lambda k: (out[k] - exact[k], k))
        out[k] -= 1
    return out


class Dealer:
    """Earliest deadline first among released blocks, from a slot on at which each source has had counts[i] of its blocks[i] blocks.

    each: the exact number of slots for a block, by source, as (numerator, denominator). Slots without a released block stay empty.
    """

    def __init__(self, each: list[tuple[int, int]], blocks: list[int], counts: list[int], slot: int = 0):
        self.each, self.blocks, self.counts, self.slot = each, blocks, list(counts), slot
        self.waiting = [(self.counts[i] * each[i][0] // each[i][1], i) for i in range(len(blocks)) if self.counts[i] < blocks[i]]
        heapq.heapify(self.waiting)
        self.ready: list[tuple[int, int]] = []

    def run(self, until: int) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot) of the slots before until."""
        each, blocks, counts, waiting, ready, t = self.each, self.blocks, self.counts, self.waiting, self.ready, self.slot
        while waiting or ready:
            if not ready and waiting[0][0] > t:
                t = waiting[0][0]
            if t >= until:
                break
            while waiting and waiting[0][0] <= t:
                i = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(counts[i] + 1) * each[i][0] // each[i][1]), i))
            i = heapq.heappop(ready)[1]
            yield i, counts[i], t
            counts[i] += 1
            if counts[i] < blocks[i]:
                heapq.heappush(waiting, (counts[i] * each[i][0] // each[i][1], i))
            t += 1
        self.slot = t

    @property
    def over(self) -> bool:
        return not self.waiting and not self.ready


def slots_for_a_block(weights: dict[str, float]) -> list[tuple[int, int]]:
    """Of the sources in order of their names, exactly."""
    total = sum((Fraction(v) for v in weights.values()), Fraction(0))
    return [((x := total / Fraction(weights[k])).numerator, x.denominator) for k in sorted(weights)]


def slots_of(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, array]:
    """Slot (from 0) of each of a source's blocks."""
    names = sorted(weights)
    out = {k: array("q") for k in names}
    dealer = Dealer(slots_for_a_block(weights), [blocks[k] for k in names], [0] * len(names))
    for i, _, t in dealer.run(1 << 62):
        out[names[i]].append(t)
    return out


def schedule(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slot (from 0) of each of a source's blocks in one period of sum(shares) slots."""
    return {k: list(v) for k, v in slots_of(shares, shares).items()}


def dealing(names: list[str], each: list[tuple[int, int]], blocks: list[int]):
    """From rows (slot, until, counts): _source, _block and _at of the blocks that are dealt in between."""

    def part(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([names[x[0]] for x in rows], pa.string()), *(pa.array([x[k] for x in rows], pa.int64()) for k in (1, 2))], names=["_source", "_block", "_at"])

    def f(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held = []
                for x in Dealer(each, blocks, unpack(row["counts"], np.int64).tolist(), row["slot"]).run(row["until"]):
                    held.append(x)
                    if len(held) == 50_000:
                        yield part(held)
                        held = []
                if held:
                    yield part(held)

    return f


def dealt(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """(_source, _block, _at) of all blocks, dealt in ranges of slots."""
    names = sorted(weights)
    each, of = slots_for_a_block(weights), [blocks[k] for k in names]
    dealer, rows, length = Dealer(each, of, [0] * len(names)), [], max(RANGE, 8 * len(names))
    while not dealer.over:
        slot, counts = dealer.slot, pack(np.array(dealer.counts, np.int64))
        until = slot + length
        for _ in dealer.run(until):
            pass
        rows.append((slot, until, counts))
    ranges = spark.createDataFrame(rows, "slot long, until long, counts binary").repartition(max(1, len(rows)))
    return ranges.mapInArrow(dealing(names, each, of), "_source string, _block long, _at long")


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, seed: int = 1, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs as a struct _row, with _source, _block, _slot and _place (within the block): reading by (_slot, _place) mixes the sources.
    No row goes or comes twice.

    A null source is the source "". Without weights, a source weighs the square root of its rows; sources
    that are not among the weights follow all others. Rows that repeat an id, or have none, have no fixed order
    among themselves. The sources, one row each, are counted on the driver. Weights are exact: period rounds nothing any more.
    """
    spark = docs.sparkSession
    identity = F.col(f"`{doc_id}`")
    # rows without an id are told apart by their place, or all of a source would fall in one bucket
    key = F.when(identity.isNull(), F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).otherwise(F.xxhash64(F.lit(seed), identity))
    rows = docs.select(row_of(docs), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_source"), F.shiftrightunsigned(key, 1).alias("_key"), identity.alias("_id"))
    counts = {r[0]: r[1] for r in rows.groupBy("_source").count().collect()}
    weights = {k: float(v) ** 0.5 for k, v in counts.items()} if weights is None else {k: v for k, v in weights.items() if v > 0 and k in counts}
    # rank within a source: its rows in buckets of hash ranges, sizes of the buckets before, rank within a bucket
    n_buckets = max(1, -(-sum(counts.values()) // BUCKET))
    rows = rows.withColumn("_bucket", F.floor((F.col("_key") / F.lit(float(1 << 63))) * n_buckets).cast("long"))
    sizes = written(rows.groupBy("_source", "_bucket").agg(F.count("*").alias("n")), "mix-sizes")
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    # in doubles, equal keys would fall in one bucket anyway: ranks stay whole
    nth = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_key", "_id"))
    rows = rows.withColumn("_nth", nth).join(sizes, ["_source", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    plan = dealt(spark, weights, {k: -(-counts[k] // block) for k in weights})
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block)).join(plan, ["_source", "_block"], "left")
    slot = F.coalesce("_at", F.lit(1 << 61) + F.col("_block"))
    return rows.select("_row", "_source", "_block", slot.cast("long").alias("_slot"), (F.col("_rank") % block).alias("_place"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scheduled(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("_row.doc_id", "_row.source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))


def identity() -> Column:
    """What tells a document from others: its id, or its source and text where it has none."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("source", "text"))


def positions(docs: DataFrame) -> DataFrame:
    """(_id, slot, place) of each identity() among documents; rows that share one share the place of one of them."""
    at = scheduled(docs.select(identity().alias("doc_id"), "source"))
    return at.groupBy(F.col("_row.doc_id").alias("_id")).agg(F.min(F.struct("_slot", "_place")).alias("at")).select("_id", F.col("at._slot").alias("slot"), F.col("at._place").alias("place"))


def mixed(docs: DataFrame, *without: str) -> DataFrame:
    """All documents as a struct _row (but for some columns), with slot and place, in the order of the mix over the parts of the table."""
    both = docs.select(row_of(docs, *without), identity().alias("_id")).join(positions(docs), "_id", "left")
    return both.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix over the parts of the table; positions() gives that order again."""
    return mixed(docs).select("_row.*")


def placed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As stage(), and each document's slot and place, which outlive the order of the parts: what follows reads the mix from them."""
    return mixed(docs, "slot", "place").select("_row.*", "slot", "place")
