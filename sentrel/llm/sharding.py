"""Minimax contiguous sharding.

Rows with equal texts (equal 64-bit hashes of them) are an atomic group. Groups are ordered by the bytes of their cell, one of 65,536 by the hash's
first bits (large ones first, so that a group larger than a share stands alone and the small ones even out the rest), then by the cell, then by
the hash. Over the ordered group sizes the smallest feasible shard capacity is found by binary search with a greedy check; then the
sequence is cut there, each cut as near to an equal share of what is left as that capacity allows. The law is ``bytes``.

The driver never holds all groups: it starts with the cells' sizes, and of the items (cells, ranges of hashes, single groups) that the greedy
check of one byte less cuts through it asks for 256 smaller ranges each, until all of them are single groups. Then no smaller capacity is
feasible for the groups themselves, and the one found is. Slots are numbered by item, and an item with many rows is split by a
hash of its rows, so no task numbers a hot group alone. Defined cases: a null text is empty text in its size and checksum and
grouped with it; repeated rows get a slot each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.llm.common import Scratch

#: Cells of the histogram (a power of two), bytes that a row adds to its text, rows of an item that are numbered together, ranges that an item is split into.
CELL_BITS, OVERHEAD, PART_ROWS, FINER = 16, 16, 512, 256


def feasible(sums: list[int], shards: int, capacity: int) -> bool:
    """Whether groups with these prefix sums (from 0) fit into so many contiguous shards: fill each as far as it goes."""
    at, last = 0, len(sums) - 1
    for _ in range(shards):
        if at == last:
            break
        at = bisect_right(sums, sums[at] + capacity, lo=at) - 1
    return at == last


def smallest_capacity(sizes: list[int], shards: int) -> int:
    sums = [0, *accumulate(sizes)]
    low, high = max([*sizes, -(-sums[-1] // shards)], default=0), sums[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(sums, shards, middle) else (middle + 1, high)
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """``shards`` + 1 positions; shard k holds the groups from cuts[k] up to cuts[k + 1]. No shard exceeds the smallest capacity."""
    sums, n = [0, *accumulate(sizes)], len(sizes)
    capacity = smallest_capacity(sizes, shards)
    earliest = [n]  # earliest[m]: from here on all fits into m shards
    for _ in range(shards):
        earliest.append(bisect_left(sums, sums[earliest[-1]] - capacity))
    out = [0]
    for left in range(shards - 1, -1, -1):
        at = out[-1]
        goal = sums[at] + (sums[-1] - sums[at]) / (left + 1)
        cut = bisect_left(sums, goal, lo=at)
        if cut > at + 1 and goal - sums[cut - 1] <= sums[min(cut, n)] - goal:
            cut -= 1
        most = min(bisect_right(sums, sums[at] + capacity, lo=at) - 1, max(at, n - left))
        out.append(max(min(max(cut, earliest[left]), most), at) if left else n)
    return out


def crossed(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Items that don't fit where the greedy check with this capacity ends a shard."""
    sums, out, at = [0, *accumulate(sizes)], [], 0
    for _ in range(shards):
        if at == len(sizes):
            break
        at = bisect_right(sums, sums[at] + capacity, lo=at) - 1
        if at < len(sizes):
            out.append(at)
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Item:
    """Groups that follow each other: the first and last hash, bytes and rows."""

    low: int
    high: int
    size: int
    rows: int


def _cell(h: str) -> Column:
    return F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int")


def _items(groups: DataFrame, *by: str) -> list[tuple]:
    found = groups.groupBy(*by).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    return [(*(r[c] for c in by), Item(r["low"], r["high"], r["size"], r["n"])) for r in found]


def _split(groups: DataFrame, items: list[Item]) -> dict[Item, list[Item]]:
    """Each item's smaller ranges, in order."""
    asked = groups.sparkSession.createDataFrame([(i.low, i.high, -(-(i.high - i.low + 1) // FINER)) for i in items], "low long, high long, width long")
    there = groups.join(F.broadcast(asked), (_cell("h") == _cell("low")) & F.col("h").between(F.col("low"), F.col("high")))
    found = sorted(_items(there.select("low", F.expr("(h - low) div width").alias("k"), "h", "size", "n").withColumnRenamed("low", "of"), "of", "k"), key=lambda x: x[:2])
    return {i: [x for of, _, x in found if of == i.low] for i in items}


def partition(groups: DataFrame, shards: int) -> tuple[list[Item], list[int]]:
    """Items in order and the cuts between them, from (h, size, n) of each group. At most 65,536 cells, and 256 ranges of each item that is crossed."""
    cells = sorted(_items(groups.withColumn("cell", _cell("h")), "cell"), key=lambda x: (-x[1].size, x[0]))
    items = [x for _, x in cells]
    while True:
        sizes = [i.size for i in items]
        open_ = [items[k] for k in crossed(sizes, shards, smallest_capacity(sizes, shards) - 1) if items[k].low < items[k].high] if items else []
        if not open_:
            return items, cuts(sizes, shards)
        finer = _split(groups, open_)
        items = [x for i in items for x in finer.get(i, [i])]


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless within the shard), grown_shard (null for this law)."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("h"),
    )
    groups = Scratch(spark, "shards").save(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    items, at = partition(groups, shards)
    plan = []
    for k in range(shards):
        slot = 0
        for i in items[at[k] : at[k + 1]]:
            plan.append((i.low, i.high, k, slot, -(-i.rows // PART_ROWS)))
            slot += i.rows
    plan = F.broadcast(spark.createDataFrame(plan, "low long, high long, shard int, base long, parts int"))  # as many as items
    placed = rows.join(plan, (_cell("h") == _cell("low")) & F.col("h").between(F.col("low"), F.col("high")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")).cast("int"))
    split = placed.where("parts > 1").groupBy("low", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("low").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    split = split.select("low", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("low", "part").orderBy("doc_id", "text_crc32")
    slot = F.col("base") + F.coalesce("ahead", F.lit(0)) + F.row_number().over(own) - 1
    return placed.join(split, ["low", "part"], "left").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
