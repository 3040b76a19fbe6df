"""Shards of nearly equal bytes by minimax contiguous partition; DataFrame functions only.

Equal texts are one atomic group, whose size is the sum of its rows' sizes.  A group larger than an even share of what
is left gets a shard of its own (fewer than the number of shards can be).  The other groups stand in the order of their
digests and are cut into contiguous shards: a binary search finds the smallest capacity for which a greedy walk, which
fills each shard as far as the capacity goes, needs no more shards than there are.

The walk needs the running sums of the groups, which are not gathered.  It runs on units of the order: at first the
digests with the same four leading digits, whose sizes are at most 65,536 numbers.  A walk that may stop at the ends of
units only needs a capacity that is large enough, one that may also stop anywhere inside a unit a capacity that is no
larger than needed.  Only units where one of the two could stop are split, by two more digits at a time, until every one
of them is a single group; then both walks are the walk over all groups, and their capacity is the smallest feasible.

A row's place in its shard follows the digest of its id, so a shard is in random order and its rows are numbered in
groups by the digest's first digits: no task holds a shard, and a group of copies is spread over all of them.

Defined cases: a null text counts as empty; rows that repeat an id are rows of their own; with fewer groups than shards
each has its own and the rest are empty; an empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, text_of

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Leading hexadecimal digits of a unit's digests at first, and how many more when it is split.
DIGITS, MORE = 4, 2


class Walk:
    """The greedy walk over units (prefix of the digests, bytes, groups) in order."""

    def __init__(self, units: list[tuple[str, int, int]]):
        self.units = sorted(units)
        self.ends = list(accumulate(size for _, size, _ in self.units))
        self.total = self.ends[-1] if self.ends else 0

    def stop(self, y: int, inside: bool) -> int:
        """The last place up to ``y`` where a shard may end; inside: anywhere in a unit of several groups."""
        k = bisect_right(self.ends, y)
        if inside and k < len(self.units) and self.units[k][2] > 1:
            return y
        return self.ends[k - 1] if k else 0

    def stops(self, capacity: int, shards: int, inside: bool) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(self.stop(out[-1] + capacity, inside))
        return out

    def capacity(self, shards: int, inside: bool) -> int:
        """The smallest capacity with which the walk reaches the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.stops(middle, shards, inside)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_units(self, shards: int) -> list[str]:
        """The units of several groups where a walk with a capacity that is still possible may stop."""
        least, most = self.capacity(shards, True), self.capacity(shards, False)
        out = set()
        for a, b in zip(self.stops(least, shards, False), self.stops(most, shards, True)):
            first, last = bisect_right(self.ends, a + least), bisect_left(self.ends, b + most)
            out.update(prefix for prefix, _, groups in self.units[first : last + 1] if groups > 1)
        return sorted(out)

    def cuts(self, shards: int) -> list[str]:
        """The prefixes with which the second and later shards begin."""
        stops = self.stops(self.capacity(shards, False), shards, False)[1:-1]
        return [self.units[bisect_right(self.ends, x)][0] for x in stops if x < self.total]


def _units(groups: DataFrame, alone: list[str], digits: int, within: list[str] | None = None) -> list[tuple[str, int, int]]:
    """The units of the groups that are not ``alone``; within: of those units with fewer digits only."""
    rest = groups.where(~F.col("digest").isin(alone)) if alone else groups
    if within is not None:
        rest = rest.where(F.substring("digest", 1, len(within[0])).isin(within))
    found = rest.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"))
    return [tuple(r) for r in found.collect()]


def plan_shards(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """(digests with a shard of their own, first prefixes of the other shards but one) for groups (digest, bytes)."""
    largest = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = []
    for digest, size in largest:
        if size * (shards - len(alone)) <= left:
            break
        alone.append(digest)
        left -= size
    shards -= len(alone)
    walk = Walk(_units(groups, alone, DIGITS))
    while opened := walk.open_units(shards):
        by_digits: dict[int, list[str]] = {}
        for prefix in opened:
            by_digits.setdefault(len(prefix), []).append(prefix)
        kept = [u for u in walk.units if u[0] not in set(opened)]
        for digits, within in by_digits.items():
            kept += _units(groups, alone, digits + MORE, within)
        walk = Walk(kept)
    return alone, walk.cuts(shards)


def _shard(digest: Column, alone: list[str], cuts: list[str]) -> Column:
    """The shard of a digest: its own, or as many as begin before it."""
    among = sum(((digest >= cut).cast("int") for cut in cuts), F.lit(len(alone)))
    return F.when(digest.isin(alone), F.array_position(F.array(*map(F.lit, alone)), digest).cast("int") - 1).otherwise(among) if alone else among


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, text_sha256, shard, slot) of every row of ``df``: its shard and its place there, from 0."""
    scratch, text = Scratch(df.sparkSession), text_of(text_col)
    rows = scratch.put(df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                                 F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("text_sha256")), "rows")
    groups = scratch.put(rows.groupBy(F.col("text_sha256").alias("digest")).agg(F.sum("size").alias("bytes")), "groups")
    alone, cuts = plan_shards(groups, shards)
    order = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    dealt = rows.withColumn("shard", _shard(F.col("text_sha256"), alone, cuts)).withColumn("_order", order).withColumn("_part", F.substring("_order", 1, 3))
    counts = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_part").orderBy("_order", "doc_id", "text_sha256")
    placed = dealt.withColumn("_rank", F.row_number().over(within)).join(firsts, ["shard", "_part"])
    return placed.select("doc_id", "size", "text_crc32", "text_sha256", "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot"))
