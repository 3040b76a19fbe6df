"""Best-fit packing of documents into sequences of at most ``capacity`` tokens by exact-complement hashing.

Only piece lengths matter to the packing, so the plan is made on the histogram of lengths (``capacity`` counts, however
large the corpus).  For the longest open piece the gap is looked up in an index of single, pair and triple sums of the
lengths still available; a combination that fills the gap exactly is consumed as often as the counts allow.  What finds
no exact complement is packed best-fit, again trying to close each remaining gap exactly.  The pieces then take their
places by rank within their length: ranks are counted in salted groups and joined with the groups' offsets, so a length
that holds a third of all pieces is never in one task.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are packed each for itself, a null id
like any other; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, text_of
from .tokens import encoder, public

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; a document longer than ``capacity`` is cut, and only its first piece may be shorter."""
    path = ranks_path or public("byte_bpe_50k.tiktoken")

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            out = [[], [], [], [], [], []]
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4", copy=False)
                first = len(ids) % capacity or capacity
                ends = range(min(first, len(ids)), len(ids) + 1, capacity)
                begin = 0
                for k, stop in enumerate(ends):
                    raw = ids[begin:stop].tobytes()
                    for column, value in zip(out, (ident, k, begin, stop - begin, zlib.crc32(raw), raw if with_ids else None)):
                        column.append(value)
                    begin = stop
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


class _Index:
    """Which available lengths sum to a gap: one, two or three of them, ``most`` at most.

    often: of several pairs take the one that the counts allow most often, else the one with the longest piece.
    """

    def __init__(self, left: np.ndarray, most: int = 3, often: bool = True):
        self.left, self.most, self.often = left, most, often

    def exact(self, gap: int, held: Counter) -> tuple[int, ...] | None:
        left = self.left[: gap + 1].copy()
        for length, n in held.items():
            if length <= gap:
                left[length] -= n
        if gap < 1:
            return ()
        if left[gap] > 0:
            return (gap,)
        if self.most > 1 and (pair := self._pair(left, gap, 1)):
            return pair
        best = None
        if self.most < 3:
            return best
        there = np.flatnonzero(left[1 : gap // 3 + 1] > 0) + 1
        for small in there[::-1]:
            left[small] -= 1
            pair = self._pair(left, gap - int(small), int(small))
            left[small] += 1
            if pair:
                best = (int(small), *pair)
                break
        return best

    def _pair(self, left: np.ndarray, total: int, least: int) -> tuple[int, int] | None:
        a = np.arange(least, total // 2 + 1)
        if not len(a):
            return None
        often = np.minimum(left[a], left[total - a])
        if total % 2 == 0:
            often[-1] = left[total // 2] // 2
        k = int(np.argmax(often if self.often else often > 0))
        return (int(a[k]), int(total - a[k])) if often[k] > 0 else None


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) for ``counts[length]`` pieces of each length.

    The histogram is small, so the plan is made with single, pair and triple complements and with fewer of them first,
    and the one with fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, most, often) for most in (3, 2, 1) for often in (True, False)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: np.ndarray, capacity: int, most: int, often: bool) -> list[tuple[tuple[int, ...], int]]:
    left = np.asarray(counts, np.int64).copy()
    index, out = _Index(left, most, often), []

    def consume(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = int(min(left[k] // n for k, n in need.items()))
        for k, n in need.items():
            left[k] -= n * times
        out.append((pattern, times))

    for length in range(capacity, 0, -1):
        while left[length]:
            found = index.exact(capacity - length, Counter([length]))
            if found is None:
                break
            consume((length, *found))
    index.most = 3
    for length in range(capacity, 0, -1):
        while left[length]:
            pattern, gap = [length], capacity - length
            while gap:
                held = Counter(pattern)
                if found := index.exact(gap, held):
                    pattern += found
                    break
                room = left[: gap + 1].copy()
                for k, n in held.items():
                    if k <= gap:
                        room[k] -= n
                fits = np.flatnonzero(room > 0)
                if not len(fits):
                    break
                pattern.append(int(fits[-1]))
                gap -= int(fits[-1])
            consume(tuple(pattern))
    return out


def _places(patterns, capacity: int):
    """Sorted keys length * 2^40 + first rank, and for each the first sequence and the offset in a sequence."""
    used, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            rows.append((length << 40 | int(used[length]), base, at))
            used[length] += times
            at += length
        base += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 3)


def pack(pieces: DataFrame, capacity: int = 1024, salts: int | None = None) -> DataFrame:
    """``pieces`` (with lengths 1 to ``capacity``, read more than once: pass a written table) with their places."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    places = _places(plan_patterns(counts, capacity), capacity)
    # pieces of one length are ranked in groups of some hundred thousand, however many there are
    salts = salts or max(256, int(counts.max()) // 200_000)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            k = np.searchsorted(places[:, 0], (length << 40) | rank, "right") - 1
            first = places[k, 0] & ((1 << 40) - 1)
            kept = batch.select([c for c in batch.schema.names if c != "_rank"])
            yield kept.append_column("sequence_id", pa.array(places[k, 1] + rank - first)).append_column("offset", pa.array(places[k, 2]))

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rn", F.row_number().over(within).cast("long")).join(offsets, ["length", "_salt"])
    slim = ranked.select(*pieces.columns, (F.col("_before") + F.col("_rn") - 1).alias("_rank"))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return slim.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, capacity: int = 1024, **params) -> DataFrame:
    """Tokenise, cut and pack the documents of ``df``."""
    scratch = Scratch(df.sparkSession)
    return pack(scratch.put(token_pieces(df, capacity, **params), "pieces"), capacity)
