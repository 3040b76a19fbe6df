"""SentencePiece encoding and decoding over a relational lattice.

Text is cut between two neighbouring characters that no piece holds side by side, where no merge and no path can join
two sides.  This gives units much like words without their punctuation.  Each different unit of the whole table is encoded once: units are grouped, all their
substrings up to the longest piece are joined by equality to the piece table (a vocabulary, so its size is bounded; it
is in every task, by length), and the edges found are the unit's lattice.  A fold with Spark's higher-order
``aggregate`` then picks the path.  For a unigram model that is Viterbi over the edges' scores (:func:`fold_viterbi`).
The ids of a BPE model are not its lattice's best path: it merges the best-scored neighbours first, so for BPE models
the same lattice is folded in merge order (:func:`fold_merges`), which gives the library's ids.  Characters without a
piece become byte pieces.

Documents are held meanwhile as codes into their chunk's list of units.  The texts are read twice, once for the units and
once for the codes, so neither is stored.  A chunk asks for its units in one packed row for each bucket of their hashes,
a bucket's task encodes each of its different units, and the ids come back in one packed row for each chunk and bucket.
A chunk is put together in one task, whose size is bounded by ``chunk_bytes``.

Defined cases: null and empty texts have no ids; units over ``longest`` characters (a text without blanks) are encoded
by the library in the task that found them; rows that repeat an id are separate documents; a null id passes through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, _is_table, pinned, text_of
from .tokens import public

BLANK = "▁"


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[tuple[str, int, float], ...]:
    """(piece, id, score) of the pieces that text can match."""
    sp = processor(path)
    return tuple((sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))


@lru_cache(maxsize=2)
def side_by_side(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, whether a piece holds the first class's character before the second's)."""
    table = [p for p, _, _ in pieces(path)]
    held = sorted({ord(c) for p in table for c in p})
    of = np.zeros(0x110000, np.int32)  # 0: in no piece
    of[held] = np.arange(1, len(held) + 1)
    pairs = np.array([(ord(x), ord(y)) for x, y in {z for p in table for z in zip(p, p[1:])}], np.int64).reshape(-1, 2)
    joined = np.zeros((len(held) + 1, len(held) + 1), bool)
    joined[of[pairs[:, 0]], of[pairs[:, 1]]] = True
    return of, joined


def cut_units(texts: list[str], path: str) -> tuple[pa.Array, np.ndarray]:
    """(the units of all texts one after the other, how many each text has); a text with any character begins with a blank."""
    marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
    whole = "".join(marked)
    codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    of, joined = side_by_side(path)
    kind = of[codes]
    head = np.ones(len(codes), bool)
    head[1:] = ~joined[kind[:-1], kind[1:]]
    first = np.cumsum([0] + [len(t) for t in marked])
    head[first[:-1][np.diff(first) > 0]] = True
    raw = np.frombuffer(whole.encode(), np.uint8)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)[head]
    made = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw)).astype(np.int64)), pa.py_buffer(raw))
    return made, np.diff(np.append(0, np.cumsum(head))[first])


def units(text: str, path: str) -> list[str]:
    return cut_units([text], path)[0].to_pylist()


def _encode_alone(unit: str, path: str) -> list[int]:
    """A unit by the library, which puts a blank before what it encodes."""
    sp = processor(path)
    return sp.encode(unit[1:]) if unit[0] == BLANK else sp.encode("\n" + unit)[2:]


@lru_cache(maxsize=2)
def piece_table(path: str) -> tuple[dict[int, tuple[pa.Array, np.ndarray]], pa.Array, np.ndarray, np.ndarray]:
    """(pieces and their rows by length, all pieces, their ids, their scores)."""
    table = pieces(path)
    size = np.array([len(p) for p, _, _ in table])
    names = pa.array([p for p, _, _ in table])
    by_length = {int(k): (names.take(pa.array(rows)), rows) for k in np.unique(size) for rows in [np.flatnonzero(size == k)]}
    return by_length, names, np.array([i for _, i, _ in table], np.int64), np.array([x for _, _, x in table])


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each character begins and the end, each character's unit, its place in that)."""
    raw = np.frombuffer("".join(column.to_pylist()).encode(), np.uint8)
    n = pc.utf8_length(column).to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return raw, np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int32), of, np.arange(len(of)) - (np.cumsum(n) - n)[of]


def _spans(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(raw))


EDGE = pa.struct([("b", pa.int32()), ("e", pa.int32()), ("id", pa.int32()), ("score", pa.float64())])


def edges_of(column: pa.Array, path: str) -> pa.Array:
    """For each unit its substrings that are pieces, b and e counted from 0, best score first, then from the left.

    All substrings of one length that begin that length apart are one column, which is joined to the pieces of that length.
    """
    raw, begins, of, place = _letters(column)
    left = np.bincount(of, minlength=len(column))[of] - place  # characters from here to the unit's end
    by_length, _, ids, scores = piece_table(path)
    starts, rows, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (names, at) in by_length.items():
        for phase in range(k if len(of) >= k else 0):
            spots = np.arange(phase, len(of) + 1, k)
            hit = pc.index_in(_spans(raw, begins[spots]), value_set=names)
            good = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
            good = good[left[spots[good]] >= k]
            starts.append(spots[good])
            rows.append(at[hit.take(pa.array(good)).to_numpy()])
            sizes.append(np.full(len(good), k))
    start, row, size = map(np.concatenate, (starts, rows, sizes))
    order = np.lexsort((place[start], -scores[row], of[start]))
    start, row, size = start[order], row[order], size[order]
    b = place[start]
    made = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((b.astype(np.int32), (b + size).astype(np.int32), ids[row].astype(np.int32), scores[row]), EDGE)], fields=list(EDGE))
    ends = np.cumsum(np.append(0, np.bincount(of[start], minlength=len(column))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), made)


def ids_of(column: pa.Array, bounds: np.ndarray, path: str, first_byte: int) -> pa.Array:
    """Packed ids of each unit along its boundaries, the bits of a number; a character without a piece becomes its bytes."""
    raw, begins, of, place = _letters(column)
    head = np.flatnonzero((bounds[of] >> place) & 1)
    ends = np.append(begins[head], begins[-1])
    _, names, ids, _ = piece_table(path)
    hit = pc.index_in(_spans(raw, ends), value_set=names)
    lone = hit.is_null().to_numpy(zero_copy_only=False)
    size = np.where(lone, np.diff(ends), 1)
    upto = np.cumsum(size)
    flat = np.empty(upto[-1] if len(upto) else 0, "<u4")
    spelled = np.repeat(lone, size)
    flat[~spelled] = ids[hit.drop_null().to_numpy()]
    flat[spelled] = first_byte + raw[np.repeat(lone, np.diff(ends))].astype(np.int64)
    stops = 4 * np.cumsum(np.append(0, np.bincount(of[head], size, minlength=len(column)))).astype(np.int64)
    return pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(flat)])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: as a lambda's variable it is not copied into every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def fold_merges(n: Column, edges: Column) -> Column:
    """Boundaries of the path of a BPE model: the best-scored edge over two neighbours joins them, leftmost on ties.

    The boundaries are the bits of a number (so units have at most 61 characters): an edge joins two neighbours if its
    ends are boundaries and exactly one boundary is inside.  ``edges`` has the best first; as boundaries do not come
    back, edges that have lost an end are dropped on the way, and when no edge fits the rest of the fold does nothing.
    """
    joins = F.transform(F.filter(edges, lambda x: x["e"] - x["b"] > 1), lambda x: F.struct(
        (bit(x["e"]) - bit(x["b"] + 1)).alias("inner"), (bit(x["b"]) + bit(x["e"])).alias("ends")))
    state = lambda mask, live: F.struct(mask.alias("mask"), live.alias("live"))

    def step(now: Column, _: Column) -> Column:
        def join(live: Column) -> Column:
            fits = F.filter(live, lambda x: F.bit_count(now["mask"].bitwiseAND(x["inner"])) == 1)
            return bound(F.get(fits, F.lit(0)), lambda m: F.when(m.isNull(), state(now["mask"], F.slice(live, F.lit(1), F.lit(0)))).otherwise(state(now["mask"] - now["mask"].bitwiseAND(m["inner"]), live)))

        live = F.filter(now["live"], lambda x: now["mask"].bitwiseAND(x["ends"]) == x["ends"])
        return F.when(F.size(now["live"]) == 0, now).otherwise(bound(live, join))

    return F.aggregate(F.sequence(F.lit(1), n), state(bit(n + 1) - 1, joins), step, lambda now: now["mask"])


def fold_viterbi(n: Column, edges: Column, unknown: float) -> Column:
    """Boundaries of the best-scoring path of a unigram model; a character without an edge costs ``unknown``."""
    lone = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("b"), (k + 1).alias("e"), F.lit(float(unknown)).alias("score")))
    every = F.concat(F.transform(edges, lambda x: F.struct(x["b"].alias("b"), x["e"].alias("e"), x["score"].alias("score"))), lone)
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, end: Column) -> Column:
        into = F.filter(every, lambda x: x["e"] == end)
        come = F.transform(into, lambda x: F.struct((F.element_at(best, x["b"] + 1)["score"] + x["score"]).alias("score"), F.concat(F.element_at(best, x["b"] + 1)["path"], F.array(end)).alias("path")))
        return F.array_append(best, F.array_max(come))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: F.element_at(best, -1)["path"])


def encode_units(words: DataFrame, path: str, bpe: bool = True, kinds: str | None = None, before: Callable = iter, after: Callable = iter, result: str | None = None) -> DataFrame:
    """``words``, which has a column unit, with ids: packed unsigned 32-bit numbers.

    ``before`` makes such rows, with the columns ``kinds``, of those of ``words``, and ``after`` makes the ``result`` of the
    rows with ids, in the tasks that build the lattice and look up the ids.
    """
    kinds = kinds or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    first_byte = processor(path).piece_to_id("<0x00>")
    unknown = min(s for _, _, s in pieces(path)) - 10.0

    def grid(batches: Iterator[pa.RecordBatch]):
        for batch in before(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, edges_of(batch.column("unit"), path)], [*batch.schema.names, "edges"])

    def ids(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = ids_of(batch.column("unit"), batch.column("bounds").to_numpy(), path, first_byte)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "ids"])

    latticed = words.mapInArrow(grid, f"{kinds}, edges array<struct<b: int, e: int, id: int, score: double>>")
    n, edges = F.length("unit"), F.col("edges")
    bounds = fold_merges(n, edges) if bpe else F.aggregate(fold_viterbi(n, edges, unknown), F.lit(0).cast("long"), lambda mask, k: mask.bitwiseOR(bit(k)))
    folded = latticed.select(*latticed.columns[:-1], bounds.alias("bounds"))
    return folded.mapInArrow(lambda batches: after(ids(batches)), result or f"{kinds}, ids binary")


MARK = b"\xff"  # no byte of UTF-8


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _chunks(batches: Iterator[pa.RecordBatch], path: str, chunk_bytes: int):
    """(chunk, ids, texts, n_units, codes, units) for stretches of a task's rows with about ``chunk_bytes`` of text each."""
    part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def close():
        cut = [cut_units(texts[a : a + 128], path) for a in range(0, len(texts), 128)]
        coded = pa.chunked_array([u for u, _ in cut]).dictionary_encode().unify_dictionaries()
        return part << 32 | n, ids, texts, np.concatenate([k for _, k in cut]), np.concatenate([x.indices.to_numpy() for x in coded.chunks]), coded.chunk(0).dictionary.to_pylist()

    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(ident)
            texts.append(text.as_py())
            size += 64 + len(texts[-1])
            if size >= chunk_bytes:
                yield close()
                n, ids, texts, size = n + 1, [], [], 0
    if ids:
        yield close()


def _asked(path: str, longest: int, chunk_bytes: int, buckets: int):
    """Rows (doc_id, text) to a row for each chunk and bucket with the chunk's units there and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]):
        for chunk, _, _, _, _, known in _chunks(batches, path, chunk_bytes):
            by_bucket: dict[int, list] = {}
            for k, u in enumerate(known):
                if len(u) <= longest:
                    raw = u.encode()
                    by_bucket.setdefault(zlib.crc32(raw) % buckets, []).append((raw, k))
            rows = [[], [], [], [], []]
            for bucket, held in by_bucket.items():
                held.sort()  # sorted, units compress to less
                joined = MARK.join([raw for raw, _ in held])
                for column, value in zip(rows, (chunk, bucket, len(joined), pa.compress(joined, codec="zstd", asbytes=True), pack(np.array([k for _, k in held])))):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["chunk", "bucket", "size", "units", "places"])

    return run


def _coded(path: str, longest: int, chunk_bytes: int):
    """Rows (doc_id, text) to a row for each chunk, with its documents as codes and the ids of its long units."""
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]):
        for chunk, ids, texts, n_units, codes, known in _chunks(batches, path, chunk_bytes):
            long = [k for k, u in enumerate(known) if len(u) > longest]
            alone = [np.array(_encode_alone(known[k], path), "<u4").tobytes() for k in long]
            row = [chunk, ids, [zlib.crc32(t.encode("utf-8", "replace")) for t in texts], n_units, pack(codes), long, alone]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["chunk", "doc_id", "crc", "n_units", "codes", "long_idx", "long_ids"])

    return run


def _different(batches: Iterator[pa.RecordBatch]):
    """The packed rows of a task to its different units, with the chunks that ask for each and its number there."""
    known: dict[bytes, int] = {}
    unit, chunk, pos = [], [], []
    for batch in batches:
        for of, size, raw, places in zip(*[batch.column(c).to_pylist() for c in ("chunk", "size", "units", "places")]):
            held = pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True).split(MARK)
            unit.append(np.array([known.setdefault(u, len(known)) for u in held], np.int64))
            chunk.append(np.full(len(held), of, np.int64))
            pos.append(unpack(places, len(held)))
    if not unit:
        return
    unit, chunk, pos, names = *map(np.concatenate, (unit, chunk, pos)), list(known)
    order = np.argsort(unit, kind="stable")
    ends = np.cumsum(np.append(0, np.bincount(unit)))
    chunk, pos = chunk[order], pos[order]
    for a in range(0, len(names), 8192):
        stops = ends[a : a + 8193]
        lists = [pa.ListArray.from_arrays(pa.array((stops - stops[0]).astype(np.int32)), pa.array(x[stops[0] : stops[-1]])) for x in (chunk, pos)]
        yield pa.RecordBatch.from_arrays([pa.array([u.decode() for u in names[a : a + 8192]], pa.string()), *lists], ["unit", "chunks", "pos"])


def _answers(buckets: int):
    """A task's units with their ids to one packed row for each chunk and bucket: the units' numbers, how many ids each has, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]):
        parts, flat, n = [], [], 0
        for batch in batches:
            ids = batch.column("ids")
            each = pc.list_value_length(batch.column("pos")).to_numpy()
            word = np.repeat(np.arange(n, n + batch.num_rows), each)
            bucket = np.repeat([zlib.crc32(u.encode()) % buckets for u in batch.column("unit").to_pylist()], each)
            parts.append((word, bucket, batch.column("chunks").flatten().to_numpy(), batch.column("pos").flatten().to_numpy()))
            flat.append((pc.binary_length(ids).to_numpy().astype(np.int64) // 4, b"".join(ids.to_pylist())))
            n += batch.num_rows
        if not parts:
            return
        word, bucket, chunk, pos = map(np.concatenate, zip(*parts))
        size, flat = np.concatenate([x for x, _ in flat]), np.frombuffer(b"".join([x for _, x in flat]), "<i4")
        begin = np.cumsum(size) - size
        order = np.lexsort((pos, bucket, chunk))
        word, bucket, chunk, pos = word[order], bucket[order], chunk[order], pos[order]
        heads = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (bucket[1:] != bucket[:-1])))
        rows = [[] for _ in range(5)]
        steps = np.diff(pos, prepend=0)
        steps[heads] = pos[heads]
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(word)]):
            m, first = size[word[a:b]], begin[word[a:b]]
            ids = flat[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())]
            for column, value in zip(rows, (int(chunk[a]), b - a, pack(steps[a:b]), pa.compress(m.astype(np.uint8).tobytes(), codec="zstd", asbytes=True), pack(ids))):
                column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["of", "n", "steps", "sizes", "ids"])

    return run


def _put(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's documents with the ids of their units."""
    places, held, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<i4")]
    for x in answers.to_pylist():
        places.append(np.cumsum(unpack(x["steps"], x["n"]), dtype=np.int64))
        held.append(np.frombuffer(pa.decompress(x["sizes"], decompressed_size=x["n"], codec="zstd", asbytes=True), np.uint8).astype(np.int64))
        flat.append(unpack(x["ids"], int(held[-1].sum())))
    made = []
    for row in docs.to_pylist():  # one row
        idx = np.concatenate([*places, np.array(row["long_idx"], np.int64)])
        sizes = np.concatenate([*held, np.array([len(x) // 4 for x in row["long_ids"]], np.int64)])
        every = np.concatenate([*flat, np.frombuffer(b"".join(row["long_ids"]), "<i4")])
        begin, size = np.zeros(len(idx), np.int64), np.zeros(len(idx), np.int64)
        size[idx], begin[idx] = sizes, np.cumsum(sizes) - sizes
        codes = unpack(row["codes"], sum(row["n_units"]))
        upto, packed = np.cumsum([0] + row["n_units"]).tolist(), []
        for a, b in zip(upto, upto[1:]):
            c = codes[a:b]
            m = size[c]
            packed.append(every[np.repeat(begin[c] - np.cumsum(m) + m, m) + np.arange(m.sum())].tobytes())
        made.append(pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(packed, pa.binary()), pa.array(row["crc"], pa.int64())], names=["doc_id", "ids", "text_crc32"]))
    return pa.concat_tables(made)


def encode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", longest: int = 61, chunk_bytes: int = 8 << 20,
                     buckets: int = 256, after: Callable | None = None, result: str = "doc_id long, ids binary, text_crc32 long") -> DataFrame:
    """(doc_id, ids, text_crc32) for each document, ids as packed unsigned 32-bit numbers.

    A frame that is no written table is written first, so that both readings give the same chunks.
    ``after`` makes other rows, the ``result``, of an Arrow table of these, where a chunk is put together.
    """
    path = path or public("piece_bpe_32k.model")
    longest = min(longest, 61)
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    slim = pinned(slim if _is_table(slim) else Scratch(df.sparkSession).put(slim, "rows"))
    chunks = slim.mapInArrow(_coded(path, longest, chunk_bytes), "chunk long, doc_id array<long>, crc array<long>, n_units array<long>, codes binary, long_idx array<int>, long_ids array<binary>")
    asked = slim.mapInArrow(_asked(path, longest, chunk_bytes, buckets), "chunk long, bucket int, size long, units binary, places binary").repartition(buckets, "bucket")
    answers = encode_units(asked, path, True, "unit string, chunks array<long>, pos array<int>", _different, _answers(buckets), "of long, n int, steps binary, sizes binary, ids binary")
    put = (lambda docs, words: after(_put(docs, words))) if after else _put
    return chunks.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(put, result)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for (doc_id, ids packed): by table of the pieces' bytes; broken byte sequences become U+FFFD."""
    path = path or public("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]):
        known = piece_bytes(path)
        for batch in batches:
            texts = [b"".join(map(known.__getitem__, np.frombuffer(x.as_py(), "<u4").tolist()))[1:].decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    sp = processor(path)
    return [bytes((int(p[3:5], 16),)) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]


def document_pieces(df: DataFrame, path: str | None = None, **params) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and round_trip (decoding gives the text again, blank marks read as blanks)."""
    path = path or public("piece_bpe_32k.model")

    def count(made: pa.Table) -> pa.Table:
        known = piece_bytes(path)
        rows = [[], [], []]
        for raw, crc in zip(made.column(1), made.column(2).to_pylist()):
            raw = raw.as_py()
            text = b"".join(map(known.__getitem__, np.frombuffer(raw, "<u4").tolist()))[1:]
            for column, value in zip(rows, (len(raw) // 4, zlib.crc32(raw), zlib.crc32(text) == crc)):
                column.append(value)
        return pa.table([made.column(0), *(pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return encode_documents(df, path, after=count, result="doc_id long, n_ids long, ids_crc32 long, round_trip boolean", **params)
