"""Near-duplicate detection: fast similarity sketches, banding, exact verification, connected components.

A sketch has ``bands * rows`` bins.  In round i every shingle is hashed to a bin with a value in [i, i + 1) and each bin
keeps its least value; from round ``bins`` on, all shingles go to one bin a round, so every bin fills, for small sets
too, and the share of equal bins estimates the Jaccard similarity with concentration bounds.

1.  Documents with equal shingle sets form a class (an aggregation that combines map-side); only classes go on.
2.  Bands of ``rows`` bins put the classes into buckets.  Each class is verified against the least member with which it
    shares most buckets, on the full shingle sets.  This gives most links with one pair a class.
3.  Buckets that still hold several components are searched to the end: members outside a bucket's largest component
    are compared with all members of other components, in blocks of bounded size, and every pair whose sketches and
    bitmaps allow the similarity is verified on full sets.  A set's bitmap has the parity of the shingles that hash to
    each bit, so two bitmaps differ in no more bits than the sets differ in shingles: it excludes no link, and groups
    whose members are all nearly similar enough give few pairs.  So no link is lost that shares a bucket, and no bucket
    is expanded into all pairs.

With 32 bands of 5 rows a pair at similarity 0.85 shares no bucket with probability 8e-9.

Defined cases: null or empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle
is one shingle; a row without id is linked with nothing, has no component and stays; rows that repeat an id are one
document.  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, cut, text_of
from .shingles import mix, shingle_set

BLOCK, BITS = 2048, 2048


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch: for each bin the least (round, hash) that fell into it."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    at, none = 0, np.iinfo(np.uint64).max
    while at < 2 * bins and (at == 0 or out.max() == none):
        many = max(1, min(2 * bins - at, -(-2 * bins // max(1, len(shingles)))))
        rounds = np.arange(at, at + many, dtype=np.uint64)[:, None]
        h = mix(shingles[None, :] ^ mix(rounds + np.uint64(0x5851F42D4C957F2D)))
        low = h & np.uint64(0xFFFFFFFF)
        where = np.where(rounds < bins, ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32), rounds - np.minimum(rounds, np.uint64(bins)))
        np.minimum.at(out, where.ravel().astype(np.intp), ((rounds << np.uint64(32)) | low).ravel())
        at += many
    return out


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = values.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + grid[:, k])
    return out


def _sketched(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text in batch.column(1):
                s = shingle_set(text.as_py().encode("utf-8", "replace"), words)
                values = sketch(s, bands * rows) if len(s) else None
                out[0].append(len(s))
                out[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out[2].append(mix(values).astype(np.uint8).tobytes() if len(s) else None)
                out[3].append(np.packbits(np.bincount((s & np.uint64(BITS - 1)).astype(np.intp), minlength=BITS).astype(np.uint8) & 1).tobytes() if len(s) else None)
                out[4].append(band_hashes(values, bands, rows).view(np.int64).tolist() if len(s) else None)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_shingles", "print", "sketch", "bitmap", "bands"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, print binary, sketch binary, bitmap binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets."""

    def run(batches):
        @lru_cache(maxsize=64)
        def of(text: str) -> np.ndarray:
            return shingle_set(text.encode("utf-8", "replace"), words)

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = of(a.as_py()), of(b.as_py())
                least, most = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * least >= percent * most else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches, by alternating star contraction."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
        before = now


def _residual_pairs(members: DataFrame, bins: int, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a bucket and whose sketches and bitmaps allow the similarity.

    members: (bucket, doc, component, n_shingles, sketch, bitmap) of buckets with more than one component.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    ranked = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    info = ranked.select("bucket", F.col("top.component").alias("major"), F.ceil(F.col("all") / BLOCK).cast("int").alias("cm"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("cx"))
    placed = members.join(info, "bucket").withColumn("_s", F.xxhash64("doc"))
    facts = ("doc", "component", "n_shingles", "sketch", "bitmap")
    member = placed.select("bucket", F.pmod("_s", "cm").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cx") - 1)).alias("j"), F.lit(False).alias("minor"), *facts)
    minor = placed.where("component <> major").select("bucket", F.explode(F.sequence(F.lit(0), F.col("cm") - 1)).alias("i"), F.pmod("_s", "cx").cast("int").alias("j"), F.lit(True).alias("minor"), *facts)
    blocks = member.unionByName(minor).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    share = percent / 100
    enough = int(bins * share - 6.5 * (bins * share * (1 - share)) ** 0.5)

    def pairs(table: pa.Table) -> pa.RecordBatch:
        flag = table["minor"].to_numpy()
        docs, comps = table["doc"].to_numpy(), table["component"].to_numpy()
        grid = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, bins)
        bits = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        size = table["n_shingles"].to_numpy()
        rest, found_a, found_b = np.flatnonzero(~flag), [], []
        for x in np.flatnonzero(flag):
            near = rest[comps[rest] != comps[x]]
            differ = np.bitwise_count(bits[near] ^ bits[x]).sum(1, dtype=np.int64)
            near = near[(100 + percent) * differ <= (100 - percent) * (size[near] + size[x])]
            near = near[(grid[near] == grid[x]).sum(1) >= enough]
            found_a.append(np.maximum(docs[near], docs[x]))
            found_b.append(np.minimum(docs[near], docs[x]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    def run(batches):
        held: list[pa.Table] = []

        def groups(table, last):
            keys = [table[c].to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
            bounds = [0, *cuts.tolist(), table.num_rows]
            whole = bounds if last else bounds[:-1]
            return [table.slice(p, q - p) for p, q in zip(whole, whole[1:])], table.slice(whole[-1])

        def made(parts):
            return [pairs(g) for g in parts if g["minor"].to_numpy().any()]

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if batch.num_rows:
                whole, rest = groups(pa.concat_tables(held), False)
                held = [rest]
                yield from made(whole)
        if held and (table := pa.concat_tables(held)).num_rows:
            yield from made(groups(table, True)[0])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 85,
                    bands: int = 32, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    bins = bands * rows
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    known = scratch.put(_sketched(docs, words, bands, rows), "sketches")
    linkable = known.where("doc_id IS NOT NULL AND print IS NOT NULL")
    classes = linkable.groupBy("print").agg(F.min("doc_id").alias("class"))
    equal = linkable.select("doc_id", "print").join(classes, "print").select(F.col("doc_id").alias("a"), F.col("class").alias("b")).where("a <> b")
    first = linkable.join(classes.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi")

    spread = first.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("doc"))
    shared = spread.groupBy("bucket").agg(F.min("doc").alias("rep"), F.max("doc").alias("top")).where("rep < top").select("bucket", "rep")
    buckets = scratch.put(spread.join(shared, "bucket"), "buckets")
    ids = buckets.select(F.col("doc").alias("doc_id")).distinct()
    texts = scratch.put(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    best = buckets.where("doc <> rep").groupBy("doc", "rep").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.max(F.struct("n", (-F.col("rep")).alias("r"))).alias("m"))
    tried = scratch.put(best.select(F.col("doc").alias("a"), (-F.col("m.r")).alias("b")), "tried")
    links = scratch.put(verified(tried, texts, words, percent).unionByName(equal), "links")
    found = components(links)

    labelled = buckets.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    sketches = first.select(F.col("doc_id").alias("doc"), "n_shingles", "sketch", "bitmap").dropDuplicates(["doc"])
    members = scratch.put(labelled.join(mixed, "bucket", "left_semi").distinct().join(sketches, "doc"), "members")
    more = scratch.put(_residual_pairs(members, bins, percent).join(tried, ["a", "b"], "left_anti"), "more")
    late = scratch.put(verified(more, texts, words, percent), "late")
    if late.isEmpty():
        final = found
    else:
        of = found.select(F.col("node"), "component")
        lifted = late.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        upper = components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        base = found.unionByName(upper.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
        final = base.join(upper.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    final = cut(final)
    for name in ("buckets", "texts", "tried", "links", "members", "more", "late"):
        scratch.drop(name)
    slim = known.select("doc_id", "n_shingles")
    return slim.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``df`` with one document of each component, in the columns of ``df``.

    A component's least id stays; of rows that repeat it, all stay (they are the same document).
    """
    gone = near_duplicates(df, id_col, text_col, **params).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(df.columns)
