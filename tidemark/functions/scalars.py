"""Scalar, array, map, string and encoding functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_null(x: Column, floating: bool = False) -> Column:
    """Null or, for floats, NaN."""
    return x.isNull() | F.isnan(x) if floating else x.isNull()


def divide(x: Column, y: Column, zero_y=None, zero_x: float = 0.0, both: float = 1.0) -> Column:
    """x / y with given results for x / 0 (null, if None), 0 / y and 0 / 0."""
    return F.when((x == 0) & (y == 0), both).when(y == 0, F.lit(zero_y).cast("double")).when(x == 0, zero_x).otherwise(F.try_divide(x, y))


def power(a: Column, b: Column) -> Column:
    """a ** b; the real part where a negative base has a broken exponent."""
    real = F.pow(F.abs(a), b)
    return F.when((a < 0) & (b != F.floor(b)), real * F.cos(F.pi() * b)).otherwise(F.pow(a, b))


def log(x: Column, base: float | None = None) -> Column:
    safe = F.when(x > 0, x)
    return F.ln(safe) if base is None else F.log(float(base), safe)


def pct(v0: Column, v1: Column, both_zero: float = 1.0, from_zero: float = -1.0) -> Column:
    """Change from v0 to v1 over v0's magnitude, whose sign is v1 - v0's; fixed results where v0 is 0."""
    return F.when((v0 == 0) & (v1 == 0), 0.0).when(v0 == 0, F.when(v1 > 0, both_zero).otherwise(from_zero)).otherwise(F.try_divide(v1 - v0, F.abs(v0)))


def ratio(a: Column, b: Column, zero=None) -> Column:
    return F.when(b == 0, F.lit(zero).cast("double")).otherwise(F.try_divide(a, b))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 46 of them are enough for 32-bit, 92 for 64-bit numbers, and a pair that is done stays as it is."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def gcd_array(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: gcd(acc, x))


def lcm_array(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(1).cast("long"), lambda acc, x: F.coalesce(F.try_divide(F.abs(acc * x), gcd(acc, x)).cast("long"), F.lit(0).cast("long")))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_items(a: Column, b: Column, ordered: bool = True) -> Column:
    return a == b if ordered else F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def chunks(a: Column, n: int) -> Column:
    """The array in pieces of ``n``."""
    return F.when(F.size(a) == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / n).cast("int") - 1), lambda k: F.slice(a, k * n + 1, n)))


def range_chunks(n: Column, gap: int) -> Column:
    """[start, end) pairs that cut 0..n in steps of ``gap``."""
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(gap))
    return F.transform(starts, lambda s: F.array(s, F.least(s + gap, n)))


def insert(a: Column, value, at, before: bool = True) -> Column:
    """``value`` before (behind) the first ``at``; at the end, if ``at`` is not there."""
    spot = F.array_position(a, F.lit(at)).cast("int")
    return F.when(spot == 0, F.array_append(a, F.lit(value))).otherwise(F.concat(F.slice(a, F.lit(1), spot - (1 if before else 0)), F.array(F.lit(value)), F.slice(a, F.greatest(spot, F.lit(1)) + (0 if before else 1), F.size(a))))


def counts(a: Column) -> Column:
    """Map from each item to how often it comes."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.struct(x.alias("key"), F.size(F.filter(a, lambda y: y == x)).cast("long").alias("value"))))


def sorted_map(m: Column, by: str = "key", reverse: bool = False) -> Column:
    """The map's entries in order of key or value."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(e[by].alias("by"), e["key"].alias("key"), e["value"].alias("value")))
    ordered = F.sort_array(entries, not reverse)
    return F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def decimals(x: Column) -> Column:
    """Decimal places of a number, trailing zeros not counted."""
    plain = F.format_number(F.abs(x), 12)
    return F.length(F.regexp_extract(plain, r"\.(\d*?)0*$", 1))


def collapse_blanks(s: Column, to: str = " ") -> Column:
    return F.regexp_replace(s, " +", to)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), also where e^x is too large."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax_array(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def within(x: Column, y: Column, below: float = 0.0, above: float = 0.0) -> Column:
    return x.between(y - below, y + above)


def vote(labels: Column) -> Column:
    """Most frequent label of an array, the smallest on ties."""
    kinds = F.array_sort(F.array_distinct(labels))
    scored = F.transform(kinds, lambda k: F.struct(F.size(F.filter(labels, lambda x: x == k)).alias("n"), (-k).alias("neg"), k.alias("k")))
    return F.array_max(scored)["k"]


def vote_multi(probs: Column) -> Column:
    """Class (from 0) with the highest sum of probabilities over an array of arrays; the first on ties."""
    total = F.aggregate(probs, F.transform(F.get(probs, 0), lambda x: x * 0.0), lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b))
    return F.array_position(total, F.array_max(total)).cast("int") - 1


def vote_binary(probs: Column, cut: float = 0.5) -> Column:
    return (F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) >= cut * F.size(probs)).cast("int")


def base64_text(s: Column) -> Column:
    return F.base64(s.cast("binary"))


def from_base64(s: Column) -> Column:
    return F.decode(F.unbase64(s), "UTF-8")


def encrypt(s: Column, key: str, mode: str = "ECB") -> Column:
    """AES of the text with PKCS padding, as base64; the key is cut or padded with zero bytes to 16."""
    k = key.encode()[:16].ljust(16, b"\0")
    return F.base64(F.aes_encrypt(s, F.lit(k), F.lit(mode), F.lit("PKCS")))


def decrypt(s: Column, key: str, mode: str = "ECB") -> Column:
    k = key.encode()[:16].ljust(16, b"\0")
    return F.decode(F.aes_decrypt(F.unbase64(s), F.lit(k), F.lit(mode), F.lit("PKCS")), "UTF-8")


def hmac_sha256(s: Column, key: str) -> Column:
    """Keyed digest by its definition, on two plain digests."""
    k = key.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), s.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def sorted_array(a: Column, ascending: bool = True) -> Column:
    return F.sort_array(a, ascending)


def insertion_index(a: Column, x: Column) -> Column:
    """Where ``x`` goes in a sorted array, counted from 0, behind equal items."""
    return F.size(F.filter(a, lambda y: y <= x))


def insert_sorted(a: Column, x: Column) -> Column:
    """The sorted array with ``x`` in its place."""
    return F.concat(F.filter(a, lambda y: y <= x), F.array(x), F.filter(a, lambda y: y > x))


def rank_of_insert(a: Column, x: Column, method: str = "dense") -> Column:
    """The rank from 1 that ``x`` would have among the items: dense, min, max, average or first (last of its equals)."""
    less = F.filter(a, lambda y: y < x)
    same = F.size(F.filter(a, lambda y: y == x))
    return {"dense": F.size(F.array_distinct(less)) + 1, "min": F.size(less) + 1, "max": F.size(less) + same + 1, "first": F.size(less) + same + 1,
            "average": F.size(less) + 1 + same / 2}[method]


def at_least(x: Column, y: Column, tol: float = 0.0) -> Column:
    return x >= y - tol


def at_most(x: Column, y: Column, tol: float = 0.0) -> Column:
    return x <= y + tol


def below(x: Column, y: Column, tol: float = 0.0) -> Column:
    """Smaller by more than ``tol``."""
    return x < y - tol


def padded(s: Column, size: int = 16) -> Column:
    """The text's bytes, with zero bytes up to a multiple of ``size``."""
    raw = s.cast("binary")
    return F.rpad(raw, (F.ceil(F.octet_length(raw) / size) * size).cast("int"), F.lit(b"\0"))


def _key(key: str | bytes) -> bytes:
    raw = key.encode() if isinstance(key, str) else key
    return raw + b"\0" * (-len(raw) % 16)


def encrypt_ecb(s: Column, key: str | bytes) -> Column:
    """AES in ECB mode of the text padded with zero bytes, as hex: Spark's own padding is one block more, which is cut off."""
    raw = padded(s)
    return F.lower(F.hex(F.substring(F.aes_encrypt(raw, F.lit(_key(key)), F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.octet_length(raw))))


def decrypt_ecb(s: Column, key: str | bytes) -> Column:
    whole = F.concat(F.unhex(s), F.aes_encrypt(F.lit(b""), F.lit(_key(key)), F.lit("ECB"), F.lit("PKCS")))
    return F.rtrim(F.decode(F.aes_decrypt(whole, F.lit(_key(key)), F.lit("ECB"), F.lit("PKCS")), "UTF-8"), F.lit("\0"))


def encrypt_cbc(s: Column, key: str | bytes, iv: str | bytes) -> Column:
    """AES in CBC mode of the text padded with zero bytes, as hex."""
    raw = padded(s)
    made = F.aes_encrypt(raw, F.lit(_key(key)), F.lit("CBC"), F.lit("PKCS"), F.lit(_key(iv)))
    return F.lower(F.hex(F.substring(made, F.lit(17), F.octet_length(raw))))


def decrypt_cbc(s: Column, key: str | bytes, iv: str | bytes) -> Column:
    """The block of padding that Spark wants is made from the last block, which is what it is chained to."""
    code = F.unhex(s)
    last = F.when(F.octet_length(code) > 0, F.substring(code, F.octet_length(code) - 15, F.lit(16))).otherwise(F.lit(_key(iv)))
    tail = F.substring(F.aes_encrypt(F.lit(b""), F.lit(_key(key)), F.lit("CBC"), F.lit("PKCS"), last), F.lit(17), F.lit(16))
    whole = F.concat(F.lit(_key(iv)), code, tail)
    return F.rtrim(F.decode(F.aes_decrypt(whole, F.lit(_key(key)), F.lit("CBC"), F.lit("PKCS")), "UTF-8"), F.lit("\0"))


def base64_url(s: Column) -> Column:
    return F.translate(F.base64(s.cast("binary")), "+/", "-_")


def from_base64_url(s: Column) -> Column:
    return F.decode(F.unbase64(F.translate(s, "-_", "+/")), "UTF-8")


# ---- pages


def html_text(html: Column) -> Column:
    """What a reader sees: without scripts, styles and tags, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def html_head(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1)


def head_items(html: Column) -> Column:
    """Number of tags that open in the head."""
    return F.size(F.regexp_extract_all(html_head(html), F.lit("<([A-Za-z])"), F.lit(1)))


def add_to_head(html: Column, tag: str) -> Column:
    """``tag`` at the end of the head."""
    return F.replace(html, F.lit("</head>"), F.lit(tag + "</head>"))


def drop_head_script(html: Column) -> Column:
    """Without a script that is last in the head."""
    return F.regexp_replace(html, r"<script[^>]*></script></head>", "</head>")
