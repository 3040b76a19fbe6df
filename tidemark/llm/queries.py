"""The corpus operators as queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, labels


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import mark_exact_copies

    return mark_exact_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import text_media

    return text_media(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    scored = score_quality(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score", "accepted")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import document_token_counts

    return document_token_counts(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import document_pieces

    return document_pieces(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_documents

    return align_documents(documents(spark, sf_dir)).withColumnRenamed("groups", "groups_sha256")


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_forms

    return spelling_forms(documents(spark, sf_dir))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    sharded = shard_documents(documents(spark, sf_dir))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_toxicity, op3_quality_classifier, op4_suffix_array_dedup, op5_token_counts, op6_sentencepiece,
        op7_minhash_near_dedup, op8_tiff_media, op9_language_id, op10_best_fit_packing,
        op11_tokenizer_alignment, op12_spelling_forms, op13_sharding)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
g AS (SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

#: A table of the 256 remainders, and the CRC-32 of a string with it.
CRC_SQL = """
crc_steps(n, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS crc FROM crc_steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])))"


#: Near words share a string with one letter left out, or one is the other with one left out.
OP12_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY id, run),
h AS (SELECT run, n, {_crc32("id || ':' || run")} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
y AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM x),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM y a JOIN y b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT y.word, v.word, v.n FROM y JOIN v ON v.word = y.cut
  UNION SELECT v.word, y.word, y.n FROM y JOIN v ON v.word = y.cut),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
follow(word, root) AS (SELECT word, word FROM f UNION ALL SELECT follow.word, f.form FROM follow JOIN f ON f.word = follow.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, follow.root, f.n, f.n_near, f.form_n FROM f JOIN follow USING (word) JOIN f AS last ON last.word = follow.root WHERE last.form IS NULL
"""

#: step: one shard of a greedy walk with the capacity mid; at its end mid is feasible or not.  laid: the walk with the least capacity.
OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, sum(size)::BIGINT AS b FROM d GROUP BY h),
o AS (SELECT h, b, row_number() OVER (ORDER BY b DESC, h) AS r, sum(b) OVER (ORDER BY b DESC, h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g),
a AS (SELECT h, b, r, bool_and(b * (41 - r) > rest) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS alone FROM o),
n AS (SELECT count(*) FILTER (alone) AS own, 40 - count(*) FILTER (alone) AS k, coalesce(sum(b) FILTER (NOT alone), 0)::BIGINT AS total FROM a),
p AS (SELECT h, b, (sum(b) OVER (ORDER BY h))::BIGINT AS e FROM a WHERE NOT alone),
step AS (
  SELECT (total + k - 1) // k AS lo, total AS hi, ((total + k - 1) // k + total) // 2 AS mid, 0::BIGINT AS x, 0 AS j FROM n
  UNION ALL
  SELECT lo, hi, (lo + hi) // 2, x, j FROM (
    SELECT CASE WHEN x < total AND j = k THEN mid + 1 ELSE lo END AS lo, CASE WHEN x = total THEN mid ELSE hi END AS hi,
      CASE WHEN x = total OR j = k THEN 0 ELSE coalesce(e, 0) END AS x, CASE WHEN x = total OR j = k THEN 0 ELSE j + 1 END AS j
    FROM (SELECT s.*, p.e FROM step s ASOF LEFT JOIN p ON s.x + s.mid >= p.e) CROSS JOIN n WHERE lo < hi)),
least AS (SELECT min(hi) AS c FROM step),
laid AS (
  SELECT 0 AS j, 0::BIGINT AS x UNION ALL
  SELECT j + 1, e FROM (SELECT l.j, l.x, p.e FROM (SELECT j, x, x + c AS y FROM laid, least) l ASOF JOIN p ON l.y >= p.e), n WHERE x < total),
s AS (
  SELECT h, (r - 1)::INT AS shard FROM a WHERE alone UNION ALL
  SELECT h, (own + (SELECT count(*) FROM laid WHERE j > 0 AND x <= p.e - p.b))::INT FROM p, n)
SELECT doc_id, size, {_crc32("t")} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY sha256(doc_id::VARCHAR), doc_id, h) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN s USING (h), crc
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op12_spelling_forms": OP12_SQL, "op13_sharding": OP13_SQL}
