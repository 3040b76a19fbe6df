"""Operators on tables: joins, upserts, densifying, pivots, membership intervals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import Order, names


def na_to_value(df: DataFrame, value=None) -> DataFrame:
    """NaN and null become ``value`` (null, if None) in every column that can hold it."""
    kinds = dict(df.dtypes)
    out = {c: F.nanvl(F.col(c), F.lit(None).cast(k)) for c, k in kinds.items() if k in ("double", "float")}
    clean = df.withColumns(out) if out else df
    return clean if value is None else clean.na.fill(value)


def same_structure(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.limit(0)


def merge(left: DataFrame, right: DataFrame, on, how: str = "inner", same_keep: str = "left") -> DataFrame:
    """Join; of columns that both sides have beyond the keys, only those of ``same_keep`` stay."""
    on = names(on)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    if same_keep == "left":
        right = right.drop(*shared)
    else:
        left = left.drop(*shared)
    return left.join(right, on, how)


def upsert(old: DataFrame, new: DataFrame, keys, keep: str = "new", null_overwrites: bool = True) -> DataFrame:
    """Rows of both by key; where both have a key, the ``keep`` side's shared columns win, nulls included.

    null_overwrites=False: a null of the winning side does not replace a value.  Columns of one side only are kept,
    null where that side lacks the key.
    """
    keys = names(keys)
    a, b = old.withColumn("__old", F.lit(True)), new.withColumn("__new", F.lit(True))
    joined = a.alias("o").join(b.alias("n"), keys, "full_outer")
    win, lose, flag = ("n", "o", "__new") if keep == "new" else ("o", "n", "__old")
    cols = []
    for c in [*old.columns, *(c for c in new.columns if c not in old.columns)]:
        if c in keys:
            cols.append(F.col(c))
        elif c in old.columns and c in new.columns:
            first, second = F.col(f"{win}.{c}"), F.col(f"{lose}.{c}")
            cols.append((F.when(F.col(flag).isNotNull(), first).otherwise(second) if null_overwrites else F.coalesce(first, second)).alias(c))
        else:
            cols.append(F.col(f"{'o' if c in old.columns else 'n'}.{c}").alias(c))
    return joined.select(*cols)


def upsert_rows(old: DataFrame, new: DataFrame, cols=None, keep: str = "new") -> DataFrame:
    """Union without keys; of rows equal in ``cols`` (all, if None) one stays, of the ``keep`` side first."""
    both = old.withColumn("__side", F.lit(0 if keep == "old" else 1)).unionByName(new.withColumn("__side", F.lit(1 if keep == "old" else 0)), allowMissingColumns=True)
    by = names(cols) or [c for c in both.columns if c != "__side"]
    rest = [c for c in both.columns if c not in by and c != "__side"]
    pick = F.min_by(F.struct(*rest), "__side").alias("__r") if rest else F.min("__side").alias("__r")
    return both.groupBy(*by).agg(pick).select(*by, *([F.col(f"__r.`{c}`").alias(c) for c in rest] if rest else [])).select(*[c for c in both.columns if c != "__side"])


def side_by_side(frames: list[DataFrame], keys) -> DataFrame:
    """Full outer join of all frames on the keys."""
    return reduce(lambda a, b: a.join(b, names(keys), "full_outer"), frames)


def stack(func: Callable[..., DataFrame], calls: list[tuple[tuple, dict]]) -> DataFrame:
    """Union of what ``func`` returns for each (args, kwargs)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [func(*a, **k) for a, k in calls])


def per_group(df: DataFrame, key, func: Callable, schema: str) -> DataFrame:
    """A Python function on each group's rows; for what no expression can say."""
    return df.groupBy(*names(key)).applyInPandas(func, schema)


def exists_flag(df: DataFrame, other: DataFrame, cols, out: str = "exists") -> DataFrame:
    """Whether ``other`` has a row with this row's values of ``cols``."""
    cols = names(cols)
    there = other.select(*cols).distinct().withColumn("__there", F.lit(True))
    return df.join(there, cols, "left").withColumn(out, F.col("__there").isNotNull()).drop("__there")


def rows_to_cols(df: DataFrame, index, col: str, value: str, values: list | None = None, fill=None) -> DataFrame:
    """Long to wide; a key with two rows for one column is an error, raised when the rows are computed.

    Give ``values`` to save the pass that finds them.
    """
    index = names(index)
    cell = F.when(F.count(value) > 1, F.raise_error(F.lit("a key has several rows for one column"))).otherwise(F.first(value, ignorenulls=True))
    wide = df.groupBy(*index).pivot(col, values).agg(cell)
    return wide if fill is None else wide.na.fill(fill)


def cols_to_rows(df: DataFrame, cols, name: str = "name", value: str = "value", dropna: bool = True) -> DataFrame:
    """Wide to long over ``cols``; dropna: without null values."""
    cols = names(cols)
    long = df.unpivot([c for c in df.columns if c not in cols], cols, name, value)
    return long.where(F.col(value).isNotNull()) if dropna else long


def pivot_table(df: DataFrame, index, col: str, value: str, agg: Callable[[str], Column] = F.avg, values: list | None = None, margins: bool = False, margin_name: str = "All", fill=None) -> DataFrame:
    """Aggregate by index and column, with margins from one cube over the rows if asked."""
    index = names(index)
    if not margins:
        wide = df.groupBy(*index).pivot(col, values).agg(agg(value))
        return wide if fill is None else wide.na.fill(fill)
    text = df.withColumns({c: F.col(c).cast("string") for c in [*index, col]})
    cube = text.cube(*index, col).agg(agg(value).alias("__v"), F.grouping_id().alias("__g"))
    rows = cube.where(F.col("__g").isin(0, 1, (1 << len(index) + 1) - 2, (1 << len(index) + 1) - 1))
    total = F.col("__g") >= (1 << len(index) + 1) - 2
    rows = rows.select(*[F.when(total, margin_name).otherwise(F.col(c)).alias(c) for c in index], F.when(F.col("__g") % 2 == 1, margin_name).otherwise(F.col(col)).alias(col), "__v")
    wide = rows.groupBy(*index).pivot(col, None if values is None else [*map(str, values), margin_name]).agg(F.first("__v"))
    return wide if fill is None else wide.na.fill(fill)


def crosstab(df: DataFrame, a: str, b: str, values: list | None = None, margins: bool = False, normalize: str | None = None) -> DataFrame:
    """Contingency table of two columns; normalize: 'all', 'index' or 'columns'."""
    counts = pivot_table(df.withColumn("__one", F.lit(1)), a, b, "__one", F.count, values, margins, fill=0)
    if normalize is None:
        return counts
    cols = [c for c in counts.columns if c != a]
    if normalize == "index":
        total = reduce(lambda x, y: x + y, [F.col(c) for c in cols])
        return counts.select(a, *[F.try_divide(F.col(c), total).alias(c) for c in cols])
    sums = counts.agg(*[F.sum(c).alias(c) for c in cols]).withColumnsRenamed({c: f"__{c}" for c in cols})
    whole = reduce(lambda x, y: x + y, [F.col(f"__{c}") for c in cols])
    # the sums are one row
    return counts.join(F.broadcast(sums)).select(a, *[F.try_divide(F.col(c), whole if normalize == "all" else F.col(f"__{c}")).alias(c) for c in cols])


def _every(tuples: DataFrame, domain: DataFrame, col: str, most: int = 100_000) -> DataFrame:
    """Each of ``tuples`` with each value of ``domain``.

    Up to ``most`` values are broadcast; more are dealt into buckets, each of which every tuple meets once.
    """
    n = domain.count()
    if n <= most:
        return tuples.crossJoin(F.broadcast(domain))
    buckets = -(-n // 1000)
    dealt = domain.withColumn("__b", F.pmod(F.xxhash64(col), F.lit(buckets)))
    return tuples.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))).join(dealt, "__b").drop("__b")


def densify(df: DataFrame, full_col: str, domain: DataFrame, ids, cols, fill: str | None = None, value=None, method: str = "product", only_domain: bool = True, final_dropna: bool = False) -> DataFrame:
    """Every value of ``domain`` for every id, with gaps filled forth, back, both ways or not at all.

    product: every combination of the ids' values, and rows outside the domain are left out before filling; pivot: the
    id tuples that occur, and rows outside the domain still fill, then ``only_domain`` leaves them out.  ``domain`` is a
    small dimension (one row a period) and is joined to the ids, not to the rows.
    """
    ids, cols = names(ids), names(cols)
    domain = domain.select(full_col).distinct()
    if method == "product":
        tuples = reduce(lambda a, b: a.crossJoin(b), [df.select(c).distinct() for c in ids])
    else:
        tuples = df.select(*ids).distinct()
    grid = _every(tuples, domain, full_col)
    keys = [*ids, full_col]
    full = grid.withColumn("__in", F.lit(True)).join(df.select(*keys, *cols), keys, "left" if method == "product" else "full_outer")
    order = Order(ids, full_col)
    if value is not None:
        full = full.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})
    if fill:
        forth = {c: F.last(c, ignorenulls=True).over(order.to_here()) for c in cols}
        back = {c: F.first(c, ignorenulls=True).over(order.window().rowsBetween(0, Window.unboundedFollowing)) for c in cols}
        full = full.withColumns({c: {"ffill": forth[c], "bfill": back[c], "both": F.coalesce(forth[c], back[c])}[fill] for c in cols})
    if only_domain:
        full = full.where(F.col("__in"))
    return (full.dropna(subset=cols, how="all") if final_dropna else full).select(*keys, *cols)


def members_at(members: DataFrame, parent: str, child: str, begin: str, end: str, dates: DataFrame, date: str, end_default=None, out: str = "time", bucket_days: int = 64) -> DataFrame:
    """Which members each date has: one row for each date with begin <= date <= end; an open end is ``end_default``.

    Intervals and dates meet in buckets of ``bucket_days`` days, so this is an equi-join with a filter, not a join of
    everything with everything.
    """
    open_end = F.lit(end_default).cast("date") if end_default is not None else F.lit("9999-12-31").cast("date")
    bound = dates.agg(F.max(F.col(date).cast("date"))).first()[0]
    m = members.withColumns({"__b": F.col(begin).cast("date"), "__e": F.least(F.coalesce(F.col(end).cast("date"), open_end), F.lit(bound).cast("date"))}).where("__b <= __e")
    slot = lambda c: F.floor(F.unix_date(c) / bucket_days)
    m = m.withColumn("__k", F.explode(F.sequence(slot(F.col("__b")), slot(F.col("__e")))))
    d = dates.select(F.col(date).cast("date").alias(out)).distinct().withColumn("__k", slot(F.col(out)))
    return d.join(m, "__k").where(F.col(out).between(F.col("__b"), F.col("__e"))).select(out, parent, child, begin, end)


def top_names(df: DataFrame, cols, n: int = 1, largest: bool = True, out: str = "top") -> DataFrame:
    """For each row the names of its ``n`` largest (smallest) columns, ties in the columns' order; nulls are left out."""
    cols = names(cols)
    sign = -1 if largest else 1
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.struct((F.col(c).cast("double") * sign).alias("v"), F.lit(k).alias("k"), F.lit(c).alias("c"))) for k, c in enumerate(cols)])
    return df.withColumn(out, F.transform(F.slice(F.array_sort(F.array_compact(cells)), 1, n), lambda x: x["c"]))


def top_rows(df: DataFrame, label: str, cols, n: int = 1, largest: bool = True) -> DataFrame:
    """(name, label, value, place): for each column the labels of the ``n`` rows with largest (smallest) values."""
    long = cols_to_rows(df.select(label, *names(cols)), cols)
    by = F.col("value").desc() if largest else F.col("value").asc()
    return long.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(by, label)).cast("long")).where(F.col("place") <= n)


def bootstrap(df: DataFrame, rounds: int, seed: int = 0, out: str = "round") -> DataFrame:
    """``rounds`` samples with replacement, numbered from 0, each with as many rows as ``df``.

    The rows are numbered through by the sizes of the tasks' shares; draws are numbers, and meet the rows in an equi-join.
    """
    rows = cut(df.withColumn("__id", F.monotonically_increasing_id())).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each task that read rows
    begin = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    numbered = rows.join(begin, "__part").withColumn("__k", F.col("__b") + F.col("__at")).drop("__part", "__at", "__id", "__b")
    draws = df.sparkSession.range(total * rounds).select(F.floor(F.col("id") / max(total, 1)).cast("int").alias(out), F.floor(F.rand(seed) * total).cast("long").alias("__k"))
    return numbered.join(draws, "__k").select(*[F.col(f"`{c}`") for c in df.columns], out)
