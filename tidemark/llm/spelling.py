"""Spelling variants: words at one edit, found by Gram matrices of letter counts over blocks of words.

Two words that differ by one inserted or deleted letter have letter counts at a squared distance of one, by one replaced
letter of two at most.  Words are blocked by their length, and within a length by how many of their letters fall into each
of ``letter_groups`` classes (the code modulo that number); the class counts sum to the length, and one edit moves one
letter into, out of or between classes, so near words are in the same or in adjacent blocks, and no others are compared.
A block with many words is dealt into parts by a hash.  For each pair of parts one NumPy product of the count matrices
gives all squared distances; pairs at two at most are kept and their edits verified.  No pair of words further apart
leaves the product.

Counting: each task counts the runs of its documents chunk by chunk, the counts are summed by word.  A run is altered by
a rule on the CRC-32 of ``<id>:<run>``; as the CRC is linear, that of a document's prefix is carried over a run's length
and combined with the run's own, so it takes one array operation for all runs of a chunk.

A word's form is its most frequent near word (ties: the first in code-point order) if that has at least ``ratio`` times
its count; following forms is done by pointer doubling on written tables.  Forms at least double the count, so chains
are short.

Defined cases: null and empty texts have no words; a null id is written as nothing; rows that repeat an id count each;
words may be of any length; an empty table gives no words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: What is no letter, once A-Z are lower case; A-Z stay in neither class.
OTHER = "[^a-zÀ-ÿ]+"
LETTERS = [*map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))]
#: One run in so many is altered.
EVERY = 97


def run_hashes(words: list[str], codes: np.ndarray, doc: np.ndarray, ids: list[str]) -> np.ndarray:
    """CRC-32 of ``<id>:<word>`` for each occurrence: word ``codes[k]`` in document ``doc[k]``."""
    raw = [w.encode() for w in words]
    own = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    before = [zlib.crc32(f"{i}:".encode()) for i in ids]
    keys, place = np.unique(doc * (1 << 32) + size[codes], return_inverse=True)
    zeros = {n: (bytes(n), zlib.crc32(bytes(n))) for n in np.unique(size[codes]).tolist()}
    carried = [zlib.crc32(zeros[k & 0xFFFFFFFF][0], before[k >> 32]) ^ zeros[k & 0xFFFFFFFF][1] for k in keys.tolist()]
    return np.array(carried, np.int64)[place] ^ own[codes]


def count_words(ids: list, texts: list[str | None], shortest: int) -> tuple[list[str], np.ndarray]:
    """(words, counts) of a chunk's documents, after the altering rule."""
    plain = pc.replace_substring_regex(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())), OTHER, " ")
    parts = pc.split_pattern(plain, " ")
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    letters = np.array([len(w) for w in words], np.int64)
    long = letters[codes] >= shortest  # shorter runs give no word, altered or not
    codes, doc = codes[long], doc[long]
    hashed = run_hashes(words, codes, doc, ["" if i is None else str(i) for i in ids])
    hit = hashed % EVERY == 0
    counts = dict(zip(words, np.bincount(codes[~hit], minlength=len(words)).tolist()))
    for code, h in zip(codes[hit].tolist(), hashed[hit].tolist()):
        word = words[code]
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
        counts[word] = counts.get(word, 0) + 1
    kept = [(w, n) for w, n in counts.items() if n and len(w) >= shortest]
    return [w for w, _ in kept], np.array([n for _, n in kept], np.int64)


def word_counts(df: DataFrame, shortest: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """(word, n) of the words with ``shortest`` letters and ``least`` occurrences and more."""

    def run(batches):
        ids, texts, held = [], [], 0

        def close() -> pa.RecordBatch:
            words, counts = count_words(ids, texts, shortest)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(ident)
                texts.append(text.as_py())
                held += 64 + len(texts[-1] or "")
                if held >= chunk_bytes:
                    yield close()
                    ids, texts, held = [], [], 0
        if ids:
            yield close()

    slim = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def adjacent(groups: int) -> list[tuple[int, ...]]:
    """How the class counts of two near words differ, each difference or its opposite once."""
    unit = [tuple(int(k == g) for k in range(groups)) for g in range(groups)]
    return [(0,) * groups, *unit, *[tuple(x - y for x, y in zip(unit[a], unit[b])) for a in range(groups) for b in range(a)]]


def letter_blocks(words: DataFrame, groups: int, part_words: int, part_letters: int) -> DataFrame:
    """(c0, c1, .., part, words, counts): blocks by class counts, in parts of about ``part_words`` words or fewer."""
    keys = [f"c{k}" for k in range(groups)]
    classes = ["".join(c for c in LETTERS if ord(c) % groups == k) for k in range(groups)]
    kept = words.select("word", "n", *[(F.length("word") - F.length(F.translate("word", held, ""))).alias(k) for k, held in zip(keys, classes)])
    sizes = kept.groupBy(*keys).agg(F.ceil(F.greatest(F.count(F.lit(1)) / part_words, F.sum(F.length("word")) / part_letters)).alias("parts"))
    dealt = kept.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    return dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct("word", "n")).alias("w")).select(*keys, "part", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))


def _letters(words: list[str]) -> np.ndarray:
    """The letters of words of one length, a row each: all are below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _counts(letters: np.ndarray) -> np.ndarray:
    flat = np.arange(len(letters))[:, None] * 256 + letters
    return np.bincount(flat.ravel(), minlength=len(letters) * 256).reshape(-1, 256).astype(np.float32)


def close_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` whose letter counts are at a squared distance of two at most, by one Gram product."""
    x, y = _counts(left), _counts(right)
    used = np.flatnonzero(x.any(0) | y.any(0))
    x, y = x[:, used], y[:, used]
    half_x, half_y = (-(m * m).sum(1, keepdims=True) / 2 for m in (x, y))
    one_x, one_y = np.ones_like(half_x), np.ones_like(half_y)
    return np.nonzero(np.hstack([x, half_x, one_x]) @ np.hstack([y, one_y, half_y]).T >= -1)  # the product is minus half the distance


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced letter (same width), or one inserted or deleted (widths one apart)."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(1) == 1
    short, long = (left, right) if left.shape[1] < right.shape[1] else (right, left)
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= short.shape[1]


def _near(batches):
    """Rows (same, words, counts, words_2, counts_2) to (word, near, near_n), both ways."""
    for batch in batches:
        for row in batch.to_pylist():
            words, others = row["words"], row["words_2"]
            left, right = _letters(words), _letters(others)
            i, j = close_pairs(left, right)
            if row["same"]:
                i, j = i[i < j], j[i < j]
            step = max(1, (1 << 24) // left.shape[1])
            near = [one_edit(left[i[k : k + step]], right[j[k : k + step]]) for k in range(0, len(i), step)]
            found = np.flatnonzero(np.concatenate(near)) if near else np.zeros(0, np.int64)
            if not len(found):
                continue
            i, j = i[found], j[found]
            a, b = pa.array(words).take(pa.array(i)), pa.array(others).take(pa.array(j))
            n_a, n_b = np.array(row["counts"], np.int64)[i], np.array(row["counts_2"], np.int64)[j]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.array(np.concatenate([n_b, n_a]))], ["word", "near", "near_n"])


def near_words(words: DataFrame, letter_groups: int = 5, part_words: int = 1024, part_letters: int = 1 << 20) -> DataFrame:
    """(word, near, near_n): all pairs of the words (word, n) at exactly one edit, both ways."""
    keys = [f"c{k}" for k in range(letter_groups)]
    blocks = Scratch(words.sparkSession).put(letter_blocks(words, letter_groups, part_words, part_letters), "blocks")
    moves = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, move)], F.lit(not any(move)).alias("stays")) for move in adjacent(letter_groups)])
    left = blocks.withColumn("move", F.explode(moves))
    left = left.select(*[(F.col(k) + F.col("move")[k]).alias(k) for k in keys], F.col("part").alias("part_1"), "move.stays", "words", "counts")
    right = blocks.select(*keys, "part", F.col("words").alias("words_2"), F.col("counts").alias("counts_2"))
    both = left.join(right, keys).where("NOT stays OR part_1 <= part")
    return both.select((F.col("stays") & (F.col("part_1") == F.col("part"))).alias("same"), "words", "counts", "words_2", "counts_2").mapInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far each round."""
    scratch, k = Scratch(forms.sparkSession), 0
    hops = scratch.put(forms.select("word", F.col("form").alias("root")), "hops0")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        k += 1
        moved = scratch.put(hops.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"hops{k}")
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hops


def spelling_forms(df: DataFrame, ratio: int = 2, shortest: int = 5, least: int = 3, letter_groups: int = 5, **columns) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``df``."""
    scratch = Scratch(df.sparkSession)
    words = scratch.put(word_counts(df, shortest, least, **columns), "words")
    best = near_words(words, letter_groups).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best"))
    taken = -F.col("best.neg") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.neg")).alias("form_n"))
    found = scratch.put(found, "found")
    last = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
