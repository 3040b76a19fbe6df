"""Removal of repeated passages: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes when a ``length``-byte string that covers it starts anywhere else too, in the same text or another.

1.  Every window of ``length`` bytes has an anchor: its least-hashed ``gram``-byte string, leftmost on ties.  Equal
    windows have equal anchors at equal distance, so only windows whose anchor occurs at two places can repeat.  What
    crosses the network first is one short row for each text and anchor; texts of a digest seen before are left out.
2.  For each such anchor the bytes that its windows cover (its extent) are laid out with the anchor in one column.
    Extents that are equal byte for byte are counted, not compared: their windows repeat.  A text that has the same
    extent many times has one row for it, with the places.
3.  The extents of an anchor are split in shards.  A shard's transform lists, column by column from the right, the
    bytes before its sorted suffixes.  Two transforms are merged by refining the interleave: a pass over the bits that
    say which shard comes next puts each of them into the bucket of the byte before it, which sorts the suffixes by one
    more byte, and no suffix is sorted again.  As the rows are aligned, one sweep over the columns settles every depth.
    Common prefixes of neighbours are carried along; neighbours that share ``length`` bytes are the repeated intervals.
4.  An anchor with more than ``most`` different extents is not merged in one task: the digests of its windows are
    counted by an aggregation instead, which is exact as well.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; of a text that occurs twice every byte
goes (if it has ``length`` bytes).  Rows are told apart by their place, not by id, so null and repeated ids are fine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, free_names, numbered, set_aside, text_of
from .shingles import BASE, inverse, mix, powers, prefix_hashes

PAD = 255  # no byte of UTF-8
OTHER = 0xC2B2AE3D27D4EB4F  # a second odd base
OUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def anchors(raw: bytes, length: int, gram: int, block: int = 1 << 22) -> tuple[np.ndarray, ...]:
    """(hash, place, first start, last start) of each anchor; its windows start at first..last.

    ``block`` windows are looked at together (fewer than 2^27, as a place within a block has 28 bits).
    """
    whole, windows, width = np.frombuffer(raw, np.uint8), len(raw) - length + 1, length - gram + 1
    keys, places, begins, last = [], [], [], -1
    for at in range(0, windows, block):
        m = min(block, windows - at)
        codes = whole[at : at + m + length - 1]
        n = len(codes) - gram + 1
        sums = prefix_hashes(codes)
        grams = mix((sums[gram:] - sums[:-gram]) * powers(inverse(), len(codes) + 1)[:n])
        rank = (grams >> np.uint64(28) << np.uint64(28)) | np.arange(n, dtype=np.uint64)
        full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        full[:n] = rank
        grid = full.reshape(-1, width)
        left = np.minimum.accumulate(grid, 1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(right[:m], left[width - 1 : width - 1 + m])
        place = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
        first = np.concatenate(([True], place[1:] != place[:-1]))
        first[0] = at + int(place[0]) != last  # else the block before ended with the same anchor
        last = at + int(place[-1])
        begin = np.flatnonzero(first)
        for out, part in zip((keys, places, begins), (grams[place[begin]].view(np.int64), at + place[begin], at + begin)):
            out.append(part)
    begin = np.concatenate(begins)
    return np.concatenate(keys), np.concatenate(places), begin, np.append(begin[1:], windows) - 1


def _marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, keys) for each text of at least ``length`` bytes: its anchors, and once more those at several places in it."""

    def run(batches):
        for batch in batches:
            found = [np.unique(anchors(text.as_py().encode("utf-8", "replace"), length, gram)[0], return_counts=True) for text in batch.column(1)]
            if found:
                keys = [np.repeat(k, np.minimum(n, 2)) for k, n in found]
                ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], ["row", "keys"])

    return docs.mapInArrow(run, "row long, keys array<long>")


def _extents(found: DataFrame, length: int, gram: int) -> DataFrame:
    """For each listed anchor the bytes that its windows cover, with the places in the text where they begin."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary())

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "key", "at", "digest", "los", "extent"])

    def run(batches):
        for batch in batches:
            out, held = [[] for _ in kinds], 0
            for row, text, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_py().encode("utf-8", "replace")
                keys, place, lo, hi = anchors(raw, length, gram)
                own: dict = {}
                for k in np.flatnonzero(np.isin(keys, listed.values.to_numpy())).tolist():
                    extent = raw[lo[k] : hi[k] + length]
                    spot = own.setdefault((int(keys[k]), xxhash.xxh3_128_digest(extent)), (int(place[k] - lo[k]), [], extent))
                    spot[1].append(int(lo[k]))
                for (key, digest), (at, los, extent) in own.items():
                    for column, value in zip(out, (row, key, at, digest, los, extent)):
                        column.append(value)
                    held += len(extent)
                    if held > 1 << 22:
                        yield pack(out)
                        out, held = [[] for _ in kinds], 0
            yield pack(out)

    return found.mapInArrow(run, "row long, key long, at int, digest binary, los array<long>, extent binary")


class Columns:
    """Aligned extents of many groups: a matrix of bytes, PAD outside each extent; ``group`` does not decrease."""

    def __init__(self, extents: list[bytes], at: np.ndarray, group: np.ndarray, length: int, gram: int):
        self.before = length - gram
        self.width = self.before + length
        self.group = group
        sizes = np.array([len(e) for e in extents], np.int64)
        self.lo = self.before - at
        rows = np.full((len(extents), self.width), PAD, np.uint8)
        for row, extent, lo in zip(rows, extents, self.lo.tolist()):
            row[lo : lo + len(extent)] = np.frombuffer(extent, np.uint8)
        self.grid = np.ascontiguousarray(rows.T)  # by column: a pass reads one row of this
        self.hi = self.lo + sizes - length  # the last start


def shard_transform(grid: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The shard's transform: for each column, right to left, the bytes before the sorted suffixes, group by group."""
    width, n = grid.shape
    order, out = np.arange(n), np.empty((width, n), np.uint8)
    wide = group.astype(np.int32) << 8
    for c in range(width - 1, -1, -1):
        out[c] = grid[c][order]
        key = wide | out[c]  # the groups keep their places in any order
        if np.any(key[1:] < key[:-1]):
            order = order[np.argsort(key, kind="stable")]
    return out


def _neighbours(common: np.ndarray, spot: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Common prefixes of new neighbours, from those of the old order: the least on the way between their old spots."""
    n = len(spot)
    out = np.zeros(n, np.int32)
    pair = np.flatnonzero(same)
    lo, hi = spot[pair - 1], spot[pair]
    near = hi - lo == 1
    out[pair[near]] = common[hi[near]] + 1
    if len(far := np.flatnonzero(~near)):
        cuts = np.empty(2 * len(far), np.int64)
        cuts[::2], cuts[1::2] = lo[far] + 1, hi[far] + 1
        out[pair[far]] = np.minimum.reduceat(np.append(common, 0), cuts)[::2] + 1
    return out


def merge_repeats(table: Columns, shard: np.ndarray, length: int) -> np.ndarray:
    """starts[column, row]: the window that starts there occurs in another row of the group.

    The two shards' transforms are merged by interleave refinement; see the module's text.
    """
    group, width = table.group, table.width
    n = len(group)
    members = [np.flatnonzero(~shard), np.flatnonzero(shard)]
    streams = [shard_transform(table.grid[:, m], group[m]) for m in members]
    # the interleave at depth 0: within each group the first shard, then the second
    order = np.lexsort((shard, group))
    bits = shard[order]
    wide = group[order].astype(np.int32) << 8
    first = np.concatenate(([True], wide[1:] != wide[:-1]))
    # rows in merged order, kept only to name the rows of the repeated intervals
    rows = order
    common = np.zeros(n, np.int32)
    starts = np.zeros((table.before + 1, n), bool)
    read = np.empty(n, np.uint8)
    for c in range(width - 1, -1, -1):
        read[~bits], read[bits] = streams[0][c], streams[1][c]
        key = wide | read
        if np.any(key[1:] < key[:-1]):
            spot = np.argsort(key, kind="stable")
            bits, rows, key = bits[spot], rows[spot], key[spot]
        else:
            spot = np.arange(n)
        same = np.concatenate(([False], key[1:] == key[:-1])) & ~first
        common = _neighbours(common, spot, same)
        if c <= table.before:
            long = common >= length
            long[:-1] |= common[1:] >= length
            starts[c, rows] = long
    return starts


def _intervals(starts: np.ndarray, lo: int, hi: int) -> list[dict]:
    column = np.zeros(hi - lo + 3, np.int8)
    column[1:-1] = starts[lo : hi + 1]
    edges = np.flatnonzero(column[1:] != column[:-1])
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def _merged(groups: DataFrame, length: int, gram: int, rows_at_once: int) -> DataFrame:
    """Repeated starts of each extent, counted from its own begin; ``groups`` has key, at, digest, extent."""
    sorted_groups = groups.repartition("key").sortWithinPartitions("key")

    def solve(table: pa.Table):
        key = table["key"].to_numpy()
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        columns = Columns(table["extent"].to_pylist(), table["at"].to_numpy().astype(np.int64), group, length, gram)
        starts = merge_repeats(columns, np.arange(len(key)) % 2 == 1, length)
        found = [_intervals(starts[:, r], int(columns.lo[r]), int(columns.hi[r])) for r in range(len(key))]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(key), table["digest"].combine_chunks(), pa.array(found, kind)], ["key", "digest", "runs"])

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows > rows_at_once:
                key = held["key"].to_numpy()
                ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                if not len(ends):
                    break
                at = int(ends[max(0, np.searchsorted(ends, rows_at_once, "right") - 1)])
                yield solve(held.slice(0, at).combine_chunks())
                held = held.slice(at)
        if held is not None and held.num_rows:
            while held.num_rows:
                key = held["key"].to_numpy()
                ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
                at = int(ends[max(0, np.searchsorted(ends, rows_at_once, "right") - 1)])
                yield solve(held.slice(0, at).combine_chunks())
                held = held.slice(at)

    return sorted_groups.mapInArrow(run, "key long, digest binary, runs array<struct<a: int, b: int>>")


def _counted(groups: DataFrame, length: int) -> DataFrame:
    """The same result for anchors with very many extents, from counts of 128-bit hashes of their windows."""

    def windows(batches):
        names = ["key", "digest", "start", "off", "one", "two"]
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, prints, starts = [], [[], []], []
            for extent in batch.column(3):
                codes = np.frombuffer(extent.as_py(), np.uint8)
                n = len(codes) - length + 1
                for base, out in zip((BASE, OTHER), prints):
                    sums = prefix_hashes(codes, base)
                    out.append(mix((sums[length:] - sums[:-length]) * powers(inverse(base), n)).view(np.int64))
                sizes.append(n)
                starts.append(np.arange(n, dtype=np.int32))
            each, start = pa.array(np.repeat(np.arange(len(sizes)), sizes)), np.concatenate(starts)
            off = np.repeat(batch.column(1).to_numpy(), sizes) - start
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(2).take(each), *map(pa.array, (start, off.astype(np.int32), *map(np.concatenate, prints)))], names)

    each = groups.select("key", "at", "digest", "extent").mapInArrow(windows, "key long, digest binary, start int, off int, one long, two long")
    same = ["key", "off", "one", "two"]
    twice = each.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hit = each.join(twice, same, "left_semi")
    return hit.groupBy("key", "digest").agg(F.collect_set(F.struct(F.col("start").alias("a"), F.col("start").alias("b"))).alias("runs"))


def _trim(raw: bytes, runs: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, removed spans) for intervals of repeated starts."""
    kept, removed, spans, at = [], 0, 0, 0
    stop = -1
    for a, b in sorted(runs):
        begin, end = a, b + length
        if begin <= stop:  # touches or overlaps the span before
            if end > stop:
                removed += end - stop
                stop = at = end
            continue
        kept.append(raw[at:begin])
        removed += end - begin
        spans += 1
        stop = at = end
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def repeated_passages(df: DataFrame, text_col: str = "text", length: int = 400, gram: int = 32, most: int = 32768,
                      rows_at_once: int = 6000) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, kept_sha256 and kept_text for each row.

    kept_text drops characters that a removed span cuts in two; kept_sha256 is of the bytes themselves.  ``df`` should
    be a written table: its rows are numbered by their place in it, and it is read more than once.  Its columns that have
    the name of a new one, in any case of letters, are renamed to ``<name>_in``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    df, names = set_aside(df, *OUT)
    number, size, sha = free_names(df, "_row", "_bytes", "_sha", besides=OUT)
    rows = numbered(df, number)
    text = text_of(names[text_col])
    slim = rows.select(F.col(number).alias("row"), text.alias("text"), F.octet_length(text).alias("n_bytes"))
    known = scratch.put(slim.select("row", "n_bytes", F.sha2("text", 256).alias("digest")), "known")
    groups = known.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"))
    groups = scratch.put(groups.where(F.col("n_bytes") >= length), "texts")

    # of equal texts the first goes on
    long = slim.where(F.col("n_bytes") >= length).select("row", "text")
    later = known.join(groups.where("copies > 1").select("digest", F.col("row").alias("kept")), "digest").where("row != kept").select("row")
    listed = scratch.put(_marked(long, length, gram).join(later, "row", "left_anti").select("row", F.explode("keys").alias("key")), "anchors")
    twice = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    repeated = listed.join(twice, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("keys"))
    touched = scratch.put(long.join(repeated, "row"), "touched")
    scratch.drop("anchors")
    extents = scratch.put(_extents(touched, length, gram), "extents")
    distinct = extents.groupBy("key", "digest").agg(F.sum(F.size("los")).alias("n"), F.first("at").alias("at"), F.first("extent").alias("extent"))
    distinct = scratch.put(distinct, "distinct")
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    full = distinct.where("n > 1").select("key", "digest", F.expr(f"array(named_struct('a', 0, 'b', cast(octet_length(extent) as int) - {length}))").alias("runs"))
    several = distinct.join(per_key.where(F.col("kinds").between(2, most)).select("key"), "key", "left_semi")
    merged = _merged(several.select("key", "at", "digest", "extent"), length, gram, rows_at_once)
    crowded = distinct.join(per_key.where(F.col("kinds") > most).select("key"), "key", "left_semi")
    if not per_key.where(F.col("kinds") > most).isEmpty():
        merged = merged.unionByName(_counted(crowded, length))
    runs = scratch.put(full.unionByName(merged.where(F.size("runs") > 0)), "runs")
    places = extents.select("row", "key", "digest", "los").join(runs, ["key", "digest"])
    by_row = places.groupBy("row").agg(F.collect_list(F.struct("los", "runs")).alias("spans"))

    def trim(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            res = [[] for _ in kinds]
            for row, raw, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                spans = {(lo + r["a"], lo + r["b"]) for s in listed.as_py() for lo in s["los"] for r in s["runs"]}
                kept, removed, n = _trim(raw.as_py().encode("utf-8", "replace"), list(spans), length)
                for column, value in zip(res, (row, removed, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(res, kinds)], ["row", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    cut_texts = scratch.put(touched.select("row", "text").join(by_row, "row").mapInArrow(trim, "row long, n_removed long, n_spans long, kept_sha256 string, kept_text string"), "cut")
    for name in ("touched", "extents", "distinct", "runs"):
        scratch.drop(name)
    copies = known.join(groups.where("copies > 1").select("digest"), "digest").select("row", F.col("n_bytes").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept_text"))
    changed = cut_texts.join(copies.select("row"), "row", "left_anti").unionByName(copies)
    before = rows.withColumn(size, F.octet_length(text).cast("long")).withColumn(sha, F.sha2(text, 256))
    whole = before.join(changed.withColumnRenamed("row", number), number, "left")
    return whole.select(*[F.col(f"`{c}`") for c in df.columns], F.col(size).alias("n_bytes"),
                        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
                        F.coalesce("kept_sha256", sha).alias("kept_sha256"), F.coalesce("kept_text", text).alias("kept_text"))


def drop_repeated_passages(df: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """``df`` with the repeated passages cut out of the text; every row stays, with its other columns."""
    names = set_aside(df, *OUT)[1]
    done = repeated_passages(df, text_col, **params)
    return done.select(*[F.col("kept_text" if c == text_col else f"`{names[c]}`").alias(c) for c in df.columns])
