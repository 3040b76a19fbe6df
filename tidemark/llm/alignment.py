"""Alignment of two tokenizers' tokens over the same bytes, merged in lockstep.

Every document has tokens of A (byte-level BPE, of space+text) and of B (SentencePiece, which adds the space itself).
Byte offsets where tokens of both end are cuts; the tokens between two cuts are a group, and every A token of a group is
linked with every B token of it.

*   A task takes documents in chunks of ``chunk_bytes``.  Texts are cut before a blank between two characters that are
    no white space: no token of either vocabulary spans such a place, so each different unit of a chunk is tokenised
    once, and the units' tokens are gathered for all documents.
*   :func:`lockstep` merges the two sequences of ends of all documents of a chunk at once.  One NumPy state vector holds
    a pointer into A and one into B for each lane; a lane is a document, or a section of a long one between two units.
    Each step advances the pointers, emits the cuts and links of the lanes that are at a cut, and compacts away the
    lanes that are done.
*   How many documents hold a pair of ids linked is summed over chunks (a chunk's own documents are counted before
    anything is shuffled).  Each chunk then gets the counts of its own pairs back, so what is shuffled is a row for each
    chunk and pair, not for each link, and the number of documents of a frequent pair never meets in one task.

Defined cases: null and empty texts, and texts that either vocabulary does not give back byte for byte, have no tokens;
rows that repeat an id are documents of their own; a null id passes through; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from .pieces import BLANK, processor
from .tokens import encoder, public

#: The characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def units_of(text: str) -> list[str]:
    """The units of a text, without the blank that each of them begins with."""
    out = []
    for part in text.split(" "):
        if out and out[-1] and out[-1][-1] not in WHITE and part and part[0] not in WHITE:
            out.append(part)
        elif out:
            out[-1] += f" {part}"
        else:
            out.append(part)
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Vocabularies:
    """Ids and byte lengths of units in both vocabularies; what has been tokenised is kept, ``most`` units at most."""

    def __init__(self, ranks_path: str, model_path: str, most: int = 100_000, line: int = 200):
        self.a, self.sp, self.most, self.line = encoder(ranks_path, False), processor(model_path), most, line
        sp = self.sp
        self.size_b = sp.get_piece_size()
        self.bytes_b = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace(BLANK, " ").encode() for k in range(self.size_b)]
        self.bytes_a = token_bytes(ranks_path)
        self.length_a, self.length_b = (np.array([len(x) for x in held], np.int64) for held in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = [np.zeros(0, np.int64)] * 2
        self.flat = [np.zeros(0, np.int64)] * 2
        self.good = np.zeros(0, bool)

    def _tokenise(self, units: list[str]) -> tuple | None:
        """(A's ids, B's ids, A tokens of each unit, B tokens of each) of units that stand one after the other; None if bytes differ."""
        raw = "".join([f" {u}" for u in units])
        ids = (self.a(raw).astype(np.int64), np.array(self.sp.encode(raw[1:], num_threads=1), np.int64))
        for held, table in zip(ids, (self.bytes_a, self.bytes_b)):
            if b"".join(map(table.__getitem__, held.tolist())) != raw.encode():
                return None
        stop = np.cumsum([len(u.encode()) + 1 for u in units])
        ends = [np.searchsorted(np.cumsum(length[held]), stop, "right") for held, length in zip(ids, (self.length_a, self.length_b))]
        return *ids, *[np.diff(x, prepend=0) for x in ends]

    def _add(self, units: list[str]) -> None:
        """Tokenise new units: those without outer white space in lines of ``line`` units, as they would stand in a text."""
        flat, sizes = ([], []), ([], [])
        close = [u for u in units if u and u[0] not in WHITE and u[-1] not in WHITE]
        lines = [close[k : k + self.line] for k in range(0, len(close), self.line)] + [[u] for u in units if not u or u[0] in WHITE or u[-1] in WHITE]
        order, good = [], []
        while lines:
            line = lines.pop()
            got = self._tokenise(line)
            if got is None and len(line) > 1:
                lines += [[u] for u in line]
                continue
            order += line
            good += [got is not None] * len(line)
            ids_a, ids_b, size_a, size_b = got or (np.zeros(0, np.int64),) * 2 + (np.zeros(1, np.int64),) * 2
            for held, ids in zip((*flat, *sizes), (ids_a, ids_b, size_a, size_b)):
                held.append(ids)
        for side in (0, 1):
            self.flat[side] = np.concatenate([self.flat[side], *flat[side]])
            self.size[side] = np.concatenate([self.size[side], *sizes[side]])
        self.good = np.append(self.good, np.array(good, bool))
        for u in order:
            self.known[u] = len(self.known)

    def look_up(self, units: list[str]) -> np.ndarray:
        """Places of the units in the store; units may repeat, but each is stored once."""
        if len(self.known) > self.most:
            self.forget()
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            self._add(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def ids(self, side: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each place has, all of them)."""
        starts = np.cumsum(self.size[side]) - self.size[side]
        sizes = self.size[side][places]
        return sizes, self.flat[side][spans(starts[places], sizes)]


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> list[bytes]:
    import base64

    with open(ranks_path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks[k] for k in range(len(ranks))]


@lru_cache(maxsize=2)
def vocabularies(ranks_path: str, model_path: str) -> Vocabularies:
    return Vocabularies(ranks_path, model_path)


@lru_cache(maxsize=8)
def _written(size: int, ends: str) -> pa.Array:
    """Every id in decimal with each of ``ends`` after it: id k with the e-th end is at e * size + k."""
    return pa.array([f"{k}{e}" for e in ends for k in range(size)])


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, from_b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Merge the token ends of all lanes at once; at each step the groups that end there: (lane, a0, a1, b0, b1).

    Lane k has the A tokens from_a[k] to to_a[k] and the B tokens from from_b[k] on, which end at the same byte.
    """
    lane = np.flatnonzero(to_a > from_a)
    i, j, last = from_a[lane].copy(), from_b[lane].copy(), to_a[lane]
    begin_a, begin_b = i.copy(), j.copy()
    while len(lane):
        end_a, end_b = ends_a[i], ends_b[j]
        cut = end_a == end_b
        i += end_a <= end_b
        j += end_b <= end_a
        at = np.flatnonzero(cut)
        if len(at):
            yield lane[at], begin_a[at], i[at], begin_b[at], j[at]
            begin_a[at], begin_b[at] = i[at], j[at]
            live = i < last
            if not live.all():
                lane, i, j, last, begin_a, begin_b = (x[live] for x in (lane, i, j, last, begin_a, begin_b))


def rectangles(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, A token, B token) of all pairs of the groups [a0, a1) x [b0, b1)."""
    wide = b1 - b0
    size = (a1 - a0) * wide
    group = np.repeat(np.arange(len(size)), size)
    local = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    down, right = np.divmod(local, wide[group])
    return group, a0[group] + down, b0[group] + right


def _sections(sizes_a: np.ndarray, doc_of_unit: np.ndarray, tokens: int) -> np.ndarray:
    """First unit of each lane: at the first unit of a document, and where ``tokens`` more A tokens have passed."""
    before = np.cumsum(sizes_a) - sizes_a
    head = np.ones(len(doc_of_unit), bool)
    head[1:] = doc_of_unit[1:] != doc_of_unit[:-1]
    block = (before - np.maximum.accumulate(np.where(head, before, 0))) // tokens
    head[1:] |= block[1:] != block[:-1]
    return np.flatnonzero(head)


def align_chunk(texts: list[str | None], vocabularies: Vocabularies, lane_tokens: int = 256, as_text: bool = False) -> dict[str, np.ndarray | list]:
    """The alignment of a chunk's documents: counts and groups of each, and (document, pair, times) of its links, sorted."""
    voc, n = vocabularies, len(texts)
    there = np.array([bool(t) and BLANK not in t for t in texts], bool)
    kept = np.flatnonzero(there)
    parts = pc.split_pattern(pa.array([texts[k] for k in kept], pa.large_string()), " ")
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(kept, np.diff(parts.offsets.to_numpy()))
    loose = np.array([not w or w[0] in WHITE or w[-1] in WHITE for w in words], bool)
    mixed = np.unique(doc[loose[codes]])  # documents with other white space at a blank: their units are put together one by one
    if len(mixed):
        lists = [units_of(texts[k]) for k in mixed]
        more = pa.array([u for x in lists for u in x], pa.large_string()).dictionary_encode()
        plain = ~np.isin(doc, mixed)
        doc = np.concatenate([doc[plain], np.repeat(mixed, [len(x) for x in lists])])
        codes = np.concatenate([codes[plain], more.indices.to_numpy().astype(np.int64) + len(words)])
        words += more.dictionary.to_pylist()
        order = np.argsort(doc, kind="stable")
        doc, codes = doc[order], codes[order]
    used = np.unique(codes)
    places = np.zeros(len(words), np.int64)
    places[used] = voc.look_up([words[k] for k in used])
    places = places[codes]
    failed = np.zeros(n, bool)
    failed[doc[~voc.good[places]]] = True
    fine = ~failed[doc]
    doc, places = doc[fine], places[fine]

    (size_a, ids_a), (size_b, ids_b) = voc.ids(0, places), voc.ids(1, places)
    ends_a, ends_b = np.cumsum(voc.length_a[ids_a]), np.cumsum(voc.length_b[ids_b])
    first = _sections(size_a, doc, lane_tokens)
    upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
    from_a, from_b, to_a = (upto_a - size_a)[first], (upto_b - size_b)[first], np.append(upto_a[first[1:] - 1], upto_a[-1:])[: len(first)]
    lane_doc = doc[first]
    cut_a, cut_b, links = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool), [np.zeros(0, np.int64)]
    top = np.int64(len(voc.bytes_a) * voc.size_b)
    for lane, a0, a1, b0, b1 in lockstep(ends_a, ends_b, from_a, to_a, from_b):
        cut_a[a1 - 1] = cut_b[b1 - 1] = True
        group, a, b = rectangles(a0, a1, b0, b1)
        links.append(lane_doc[lane[group]] * top + ids_a[a] * voc.size_b + ids_b[b])
    links = np.concatenate(links)
    links.sort()
    new = np.ones(len(links), bool)
    new[1:] = links[1:] != links[:-1]
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(links)))
    link_doc, pair = np.divmod(links[starts], top)

    doc_a, doc_b = np.repeat(doc, size_a), np.repeat(doc, size_b)
    out = {"n_a": np.bincount(doc_a, minlength=n), "n_b": np.bincount(doc_b, minlength=n), "n_groups": np.bincount(doc_a[cut_a], minlength=n),
           "n_links": np.bincount(link_doc, times, minlength=n).astype(np.int64), "link_doc": link_doc, "pair": pair, "times": times}
    return out | {"groups": _groups(ids_a, ids_b, cut_a, cut_b, doc_a, doc_b, voc, n, as_text)}


def _groups(ids_a, ids_b, cut_a, cut_b, doc_a, doc_b, voc: Vocabularies, n: int, as_text: bool) -> list[str]:
    """The groups of each document, written ``a1,a2|b1;a3|b2``, or the digest of that."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    before_b = np.searchsorted(group_b, group_a)  # B tokens of earlier groups
    before_a = np.searchsorted(group_a, group_b, "right")  # A tokens of this group and earlier ones
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    size_a, size_b = len(voc.bytes_a), voc.size_b
    last = np.ones(len(ids_b), bool)
    last[:-1] = doc_b[1:] != doc_b[:-1]
    written = pa.concat_arrays([_written(size_a, ",|"), _written(size_b, ",;"), _written(size_b, ("",))])
    codes[np.arange(len(ids_a)) + before_b] = ids_a + size_a * cut_a
    codes[np.arange(len(ids_b)) + before_a] = 2 * size_a + ids_b + size_b * (cut_b.astype(np.int64) + last)
    line = written.take(pa.array(codes))
    offsets, raw = np.frombuffer(line.buffers()[1], np.int32, len(line) + 1), memoryview(line.buffers()[2] or b"")
    stop = np.cumsum(np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n))
    ends = offsets[stop].tolist() if len(line) else [0] * n
    out, begin = [], 0
    for end in ends:
        text = raw[begin:end]
        out.append("" if begin == end else bytes(text).decode() if as_text else hashlib.sha256(text).hexdigest())
        begin = end
    return out


CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
         "pair array<long>, n_docs array<long>, links binary, n_pairs array<long>")


def _chunks(ranks_path: str, model_path: str, chunk_bytes: int, lane_tokens: int, as_text: bool):
    """Rows (doc_id, text) to one row a chunk."""

    def close(ids: list, texts: list) -> pa.RecordBatch:
        got = align_chunk(texts, vocabularies(ranks_path, model_path), lane_tokens, as_text)
        pair, place, n_docs = np.unique(got["pair"], return_inverse=True, return_counts=True)
        step = np.diff(place.astype(np.int64), prepend=0)  # small numbers, as a document's pairs are sorted
        packed = pa.compress(np.stack([step, got["times"]]).astype("<i4").tobytes(), codec="zstd", asbytes=True)
        row = [uuid.uuid4().int >> 66, ids, *[got[c] for c in COUNTS], got["groups"], pair, n_docs, packed, np.bincount(got["link_doc"], minlength=len(ids))]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.binary(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(ident)
                texts.append(text.as_py())
                held += 64 + (len(texts[-1]) if texts[-1] else 0)
                if held >= chunk_bytes:
                    yield close(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield close(ids, texts)

    return run


def _give_back(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of its pairs: n_best and count_sum."""
    total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
    at = right.column("pos").to_numpy()
    total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    out = []
    for row in left.to_pylist():
        n_links = sum(row["n_pairs"])
        raw = pa.decompress(row["links"], decompressed_size=8 * n_links, codec="zstd", asbytes=True)
        step, times = np.frombuffer(raw, "<i4").reshape(2, -1).astype(np.int64)
        place, doc = np.cumsum(step), np.repeat(np.arange(len(row["n_pairs"])), row["n_pairs"])
        sums = np.zeros((2, len(row["n_pairs"])), np.int64)
        np.add.at(sums[0], doc, times * best[place])
        np.add.at(sums[1], doc, times * total[place])
        out.append(pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), **{c: pa.array(row[c], pa.int64()) for c in COUNTS}, "n_best": sums[0], "count_sum": sums[1],
                             "groups": pa.array(row["groups"], pa.string())}))
    return pa.concat_tables(out)


class Alignment:
    """The alignment of a table's documents, stored by chunk: :meth:`documents` and :meth:`pairs` read it."""

    def __init__(self, df: DataFrame, ranks_path: str | None = None, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 chunk_bytes: int = 2 << 20, lane_tokens: int = 256, as_text: bool = False):
        ranks_path, model_path = ranks_path or public("byte_bpe_50k.tiktoken"), model_path or public("piece_bpe_32k.model")
        slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.size_b = processor(model_path).get_piece_size()
        self.scratch = Scratch(df.sparkSession)
        self.chunks = self.scratch.put(slim.mapInArrow(_chunks(ranks_path, model_path, chunk_bytes, lane_tokens, as_text), CHUNK), "chunks")
        self.asked = self.chunks.select("chunk", F.posexplode(F.arrays_zip("pair", "n_docs"))).select("chunk", "pos", "col.pair", "col.n_docs")
        totals = self.asked.groupBy("pair").agg(F.sum("n_docs").alias("total")).withColumn("a_id", F.expr(f"pair div {self.size_b}"))
        self.totals = self.scratch.put(totals, "totals")

    def _marked(self) -> DataFrame:
        highest = self.totals.groupBy("a_id").agg(F.max("total").alias("most"))
        return self.totals.join(highest, "a_id").select("pair", "a_id", "total", (F.col("total") == F.col("most")).alias("best"))

    def pairs(self) -> DataFrame:
        """(a_id, b_id, n_docs, best): linked ids, how many documents hold them linked, and whether that is A's highest."""
        return self._marked().select("a_id", F.expr(f"pair % {self.size_b}").alias("b_id"), F.col("total").alias("n_docs"), "best")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (their digest, or their text)."""
        answers = self.asked.join(self._marked(), "pair").select(F.col("chunk").alias("of"), "pos", "total", "best")
        both = self.chunks.select("chunk", "doc_id", *COUNTS, "groups", "links", "n_pairs").groupBy("chunk").cogroup(answers.groupBy("of"))
        return both.applyInArrow(_give_back, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def align_documents(df: DataFrame, **params) -> DataFrame:
    """Every row of ``df`` with the counts of its alignment and its groups."""
    return Alignment(df, **params).documents()
