"""Sharding by minimax contiguous partition, with DataFrame functions only.

Atomic groups (equal texts) are ordered by the MD5 of their text. The smallest feasible shard capacity is found
by binary search; a capacity is feasible if filling shards greedily in that order needs no more shards than there
are. The groups are then cut where the greedy filling at that capacity cuts.

The ordered sizes are never gathered whole. The driver sees sums over cells (ranges of the hash) and splits only
cells in which some capacity of the remaining search interval could place a cut, until those cells hold a
single group. Groups as large as an even share of what is left are found the same way; each gets a shard of its own
(it alone decides the capacity there), and the rest is solved over the remaining shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Hex digits of the first cells (65,536 sums on the driver), by which a cell is split further, and of a whole key.
DIGITS, DEEPER_DIGITS, KEY_DIGITS = 4, 3, 32
#: Each shard's rows are numbered in this many independent parts.
SLOT_PARTS = 1024


@dataclass(frozen=True)
class Cell:
    """A range of the order: all groups whose key starts with ``prefix``."""

    prefix: str
    size: int
    single: bool


def _cells(groups: DataFrame, digits: int, parents: list[str] | None = None) -> list[Cell]:
    if parents:
        groups = groups.where(F.substring("group_key", 1, len(parents[0])).isin(parents))
    sums = groups.groupBy(F.substring("group_key", 1, digits).alias("prefix")).agg(
        F.sum("size").alias("size"), F.min("group_key").alias("low"), F.max("group_key").alias("high")
    )
    return [
        Cell(r["low"], int(r["size"]), True) if r["low"] == r["high"] else Cell(r["prefix"], int(r["size"]), False)
        for r in sums.collect()
    ]


def _split(cells: list[Cell], groups: DataFrame, which: set[str]) -> list[Cell]:
    """The cells named in ``which`` are replaced by the sums one level deeper."""
    by_length: dict[int, list[str]] = {}
    for prefix in sorted(which):
        by_length.setdefault(len(prefix), []).append(prefix)
    kept = [c for c in cells if c.prefix not in which]
    for length, prefixes in by_length.items():
        kept += _cells(groups, min(KEY_DIGITS, length + DEEPER_DIGITS), prefixes)
    return sorted(kept, key=lambda c: c.prefix)


def _fill(cells: list[Cell], capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (index of the first cell of each later shard), or None if the shards don't suffice."""
    cuts, load = [], 0
    for i, c in enumerate(cells):
        if load and load + c.size > capacity:
            cuts.append(i)
            load = 0
            if len(cuts) >= shards:
                return None
        if c.size > capacity:
            return None
        load += c.size
    return cuts


def _fill_loose(cells: list[Cell], capacity: int, most: int) -> list[int]:
    """Cells in which the cuts fall if cells could be divided anywhere: no real cut comes later."""
    found, start, before = [], 0, 0
    for i, c in enumerate(cells):
        while before + c.size > start + capacity and len(found) < most:
            found.append(i)
            start += capacity
        before += c.size
    return found


def _tight(cells: list[Cell], capacity: int, most: int) -> list[int]:
    """Cells in which the cuts fall if a shard ends before any cell that doesn't fit whole: no real cut comes earlier."""
    found, load = [], 0
    for i, c in enumerate(cells):
        load += c.size
        if load > capacity and len(found) < most:
            found.append(i)
            load = c.size
    return found


def _smallest(cells: list[Cell], shards: int) -> int:
    low = max(-(-sum(c.size for c in cells) // shards), max((c.size for c in cells), default=0))
    high = low + max((c.size for c in cells), default=0)
    while _fill(cells, high, shards) is None:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _fill(cells, middle, shards) is not None else (middle + 1, high)
    return low


def plan_cuts(groups: DataFrame, shards: int) -> tuple[dict[str, int], list[str], int]:
    """``(key of a large group -> its shard, first keys of the further shards, capacity of the others)``."""
    cells = sorted(_cells(groups, DIGITS), key=lambda c: c.prefix)
    alone: dict[str, int] = {}
    while cells and len(alone) < shards - 1:
        share = -(-sum(c.size for c in cells) // (shards - len(alone)))
        large = [c for c in cells if c.size >= share]
        if mixed := {c.prefix for c in large if not c.single}:
            cells = _split(cells, groups, mixed)
        elif large:
            top = max(large, key=lambda c: (c.size, c.prefix))
            alone[top.prefix] = len(alone)
            cells.remove(top)
        else:
            break
    left = shards - len(alone)
    while cells:
        capacity = _smallest(cells, left)
        cuts = _fill(cells, capacity, left)
        # The smallest capacity over groups is at least this and at most that over whole cells; so are its cuts.
        least = max(-(-sum(c.size for c in cells) // left), max((c.size for c in cells if c.single), default=0))
        early, late = _tight(cells, least, left - 1), _fill_loose(cells, capacity, left - 1)
        wide = set()
        for j, first in enumerate(early):
            last = late[j] if j < len(late) else len(cells) - 1
            wide.update(c.prefix for c in cells[first : last + 1] if not c.single)
        if not wide:
            return alone, [cells[i].prefix for i in cuts], capacity
        cells = _split(cells, groups, wide)
    return alone, [], 0


def _shard_of(key: Column, alone: dict[str, int], cuts: list[str]) -> Column:
    place = F.lit(len(alone))
    for first in cuts:
        place = place + F.when(key >= F.lit(first), 1).otherwise(0)
    for group, shard in alone.items():
        place = F.when(key == F.lit(group), shard).otherwise(place)
    return place.cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Deal ``docs`` into shards of near-equal bytes; equal texts share a shard.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. A null text counts as an empty one
    (8 bytes, CRC 0), a null id is kept as null, repeated rows are rows of their own, an empty table gives no rows and
    other columns are ignored. Slots number a shard's rows from 0 without gaps; the order is by part of the id's hash,
    then id, then key, so equal rows may trade slots.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(row_id).alias("doc_id"),
            (F.octet_length(whole).cast("long") + 8).alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.md5(whole.cast("binary")).alias("group_key"),
        )
    )
    alone, cuts, _ = plan_cuts(rows.select("group_key", "size"), shards)
    dealt = rows.withColumn("shard", _shard_of(F.col("group_key"), alone, cuts)).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SLOT_PARTS)).cast("int")
    )
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * SLOT_PARTS rows, whatever the input.
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "group_key")
    return dealt.join(F.broadcast(bases), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
