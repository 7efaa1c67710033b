"""Filters, joins, shares, ranks and samples.

Totals over a whole table are one-row aggregates that are broadcast back, never
windows without a partition: those would bring all rows into one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiq.functions.numeric import all_finite, bin_right_closed, col, tertile
from stratiq.sources.scratch import dropped, saved

#: Rows of a few numbers each up to which a table may be broadcast.
FEW_ROWS = 1_000_000
#: Tasks of one stage.
MOST_TASKS = 10_000
#: Tasks up to which Spark passes rows on as they come, without holding them (spark.shuffle.sort.bypassMergeThreshold).
PASSED_ON = 200


def small(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most so many rows; as it is otherwise, for Spark to join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, each: int, *by: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt to tasks of about ``each`` rows (evenly, or by the columns ``by``).

    For work whose cost lies in the rows, not in their bytes: a given number of
    tasks is kept, while by size alone a small file would be one task's work.
    ``rows``: their number, counted if it is not known.
    """
    n = min(MOST_TASKS, max(1, -(-(df.count() if rows is None else rows) // each)))
    # A join or sum deals fewer than the session's number anew, and then by size.
    n = max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if by and n > 1 else n
    return df.repartition(n, *by)


def dealt(df: DataFrame, each: int, *by: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt to tasks of about ``each`` rows by columns that are together nearly unique.

    :func:`spread` without columns sorts what each task reads, so that the one task
    of a file holds the whole file.  Here rows go on as they come: to at most
    ``PASSED_ON`` tasks first, and from these, each a part of the rows, to as many
    as it takes.
    """
    n = min(MOST_TASKS, max(1, -(-(df.count() if rows is None else rows) // each)))
    first = df.repartition(min(n, PASSED_ON), *by)
    # A column of its own between the two, or Spark would merge them into one.
    return first if n <= PASSED_ON else first.withColumn("_deal", F.xxhash64(*by)).repartition(n, "_deal").drop("_deal")


def looked_up(rows: DataFrame, key: str, table: DataFrame, share: int = 500, most: int = 100_000) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` at most once.

    Keys of more than ``most`` rows and more than 1/``share`` of them, at most
    ``share`` in number, meet their row by broadcast, the others by shuffle: no
    key has to fit one task.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counts = with_totals(counts, _all=F.sum("_n")).filter((F.col("_n") > most) & (F.col("_n") * share > F.col("_all")))
    hot = [r[0] for r in counts.select(key).collect()]  # at most ``share`` keys
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key).unionByName(rows.filter(~is_hot).join(table, key))


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Every row with table-wide aggregates: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.na.drop(subset=list(columns))


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(all_finite(columns))


def filter_text(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a SQL condition holds; an empty one passes all; anything but a boolean raises ValueError."""
    if not condition or not condition.strip():
        return df
    if df.select(F.expr(condition)).schema[0].dataType.simpleString() != "boolean":
        raise ValueError(f"not a condition: {condition}")
    return df.filter(F.expr(condition))


def attach(df: DataFrame, other: DataFrame, key: str, how: str = "left", strict: bool = False) -> DataFrame:
    """Join on a key; the other side's clashing names get __dup, or raise ValueError if strict."""
    clash = (set(df.columns) & set(other.columns)) - {key}
    if clash and strict:
        raise ValueError(f"both sides have {sorted(clash)}")
    return df.join(other.withColumnsRenamed({c: f"{c}__dup" for c in clash}), key, how)


def attach_all(df: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins of several tables onto a backbone."""
    return reduce(lambda a, b: attach(a, b, key), others, df)


def contracted(df: DataFrame, columns: Sequence[str], key: Sequence[str] = (), some: bool = True) -> DataFrame:
    """``df`` itself, if it has the columns, a row (with ``some``) and no key twice; ValueError otherwise."""
    all_of(df, columns)
    if some and df.isEmpty():
        raise ValueError("no rows")
    if key and not df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        raise ValueError(f"{list(key)} is not unique")
    return df


def unique_leaves(df: DataFrame, parent: str, leaf: str, out: str = "name") -> DataFrame:
    """Folders' last names, with as many parents' names in front as it takes until no two folders share a name.

    ``parent`` is the path above the leaf; folders of equal paths stay equal.
    """
    at = Window.partitionBy(out)
    df = df.withColumns({"_up": F.split(parent, "/"), out: F.col(leaf), "_open": F.lit(True)})
    depth = df.agg(F.max(F.size("_up"))).first()[0] or 0
    for _ in range(depth):
        # A shared name takes one more name of its path; names that stand alone stay.
        shared = (F.count(F.lit(1)).over(at) > 1) & (F.size("_up") > 0)
        longer = F.concat_ws("_", F.element_at("_up", -1), F.col(out))
        df = df.withColumn("_open", shared).withColumn(out, F.when(F.col("_open"), longer).otherwise(F.col(out)))
        df = df.withColumn("_up", F.when(F.col("_open"), F.slice("_up", F.lit(1), F.size("_up") - 1)).otherwise(F.col("_up")))
    return df.drop("_up", "_open")


def top_n(df: DataFrame, n: int, by: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The first n rows of each group, without ties: the order must be total."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def first_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return top_n(df, 1, [key], order)


def shares(df: DataFrame, by: Sequence[str], weight: Column | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Counts (or summed weights) n and their share of the whole, or of the group ``within``."""
    counts = df.groupBy(*by).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    if within:
        return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    return with_totals(counts, _all=F.sum("n")).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_z", ddof: int = 1) -> DataFrame:
    """Columns less their mean, by their standard deviation; null if that is 0."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    totals = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": sd(c) for c in columns}
    out = with_totals(df, **totals)
    return out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}).drop(*totals)


def zscore_text(columns: Sequence[str]) -> str:
    """Band mathematics for z-scores as text, an expression for each band: (b - b_mean) / sqrt(b_var)."""
    return "; ".join(f"(`{c}` - `{c}_mean`) / nullif(sqrt(`{c}_var`), 0.0D)" for c in columns)


def band_math(df: DataFrame, columns: Sequence[str], text: str, suffix: str = "_z") -> DataFrame:
    """A column for each of the expressions of ``text``, which may use the bands and each one's _mean and _var (of the population)."""
    totals = {f"{c}_mean": F.avg(c) for c in columns} | {f"{c}_var": F.var_pop(c) for c in columns}
    parts = [e.strip() for e in text.split(";") if e.strip()]
    return with_totals(df, **totals).withColumns({f"{c}{suffix}": F.expr(e) for c, e in zip(columns, parts, strict=True)}).drop(*totals)


def unit_range(df: DataFrame, columns: Sequence[str], suffix: str = "_n") -> DataFrame:
    """Columns mapped to 0..1; null for the whole column if it is constant."""
    totals = {f"_lo_{c}": F.min(c) for c in columns} | {f"_hi_{c}": F.max(c) for c in columns}
    out = with_totals(df, **totals)
    return out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)) for c in columns}).drop(*totals)


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, in the order given; null without values.

    Distinct values are counted, range-partitioned and sorted; from the number
    of rows in each partition follows which partitions hold the wanted ranks, and
    a running sum within these finds their values.  No task sees more than one
    range of values, and the driver one number for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # Written out, so that both passes see the same ranges.
    counts = saved(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "quantiles")
    sizes = sorted((r["part"], r["n"]) for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        dropped(counts)
        return [None] * len(probs)
    places = [p * (total - 1) for p in probs]
    wanted = {}
    for rank in {int(x) for x in places} | {min(total - 1, int(x) + 1) for x in places}:
        before = 0
        for part, n in sizes:
            if rank < before + n:
                wanted[rank] = (part, rank - before)
                break
            before += n
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    held = counts.filter(F.col("part").isin(*{part for part, _ in wanted.values()})).withColumn("upto", upto)
    row = held.agg(*[F.min(F.when((F.col("part") == part) & (F.col("upto") > at), F.col("v"))).alias(str(rank)) for rank, (part, at) in wanted.items()]).first()
    dropped(counts)
    low, high = ([row[str(min(total - 1, int(x) + k))] for x in places] for k in (0, 1))
    return [a + (b - a) * (x - int(x)) for a, b, x in zip(low, high, places, strict=True)]


def quantile_bins(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins between distinct exact quantiles, closed on the right, the lowest value included."""
    cuts = sorted({x for x in quantiles(df, column, [round(i / bins, 15) for i in range(bins + 1)]) if x is not None})
    return df.withColumn("_cuts", F.array(*map(F.lit, cuts)).cast("array<double>")).withColumn(out, bin_right_closed(column, "_cuts")).drop("_cuts")


def tertile_tokens(df: DataFrame, columns: dict[str, str], prefix: str, out: str = "label") -> DataFrame:
    """A token 1 to 3 for each column and a label such as ``prefix_elev-1_slope-3``; columns: name to short name."""
    bins = {}
    for c, short in columns.items():
        low, high = quantiles(df, c, [1 / 3, 2 / 3])
        bins[f"{short}_bin"] = tertile(c, F.lit(low).cast("double"), F.lit(high).cast("double"))
    rows = df.withColumns(bins)
    tokens = [F.concat(F.lit(f"{s}-"), F.col(f"{s}_bin").cast("string")) for s in columns.values()]
    return rows.withColumn(out, F.concat_ws("_", F.lit(prefix), *tokens))


def row_ids(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Dense 1-based ids in key order without bringing all rows into one task.

    Rows are range-partitioned by key; a row's id is its rank in the partition
    plus the sizes of the partitions before, one number each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, F.col(key)).withColumn("_part", F.spark_partition_id())
    # The partition number is fixed before any further exchange; rank within it by key.
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parts.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(out, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


def stratified(df: DataFrame, by: str, n: int, draw: Column, key: str) -> DataFrame:
    """n rows of each group by a deterministic draw, ties by key."""
    return top_n(df, n, [by], [draw, F.col(key)])


def stratified_spaced(df: DataFrame, by: str, n: int, draw: Column, key: str, d: float, x: str = "x", y: str = "y") -> DataFrame:
    """n rows of each group by a deterministic draw, of the rows that stay when, in the draw's order, those within d of an earlier one go.  Rows without a place or group don't count."""
    from .geometry import thin

    rows = df.na.drop(subset=[by, x, y]).withColumn("_draw", draw)
    return stratified(thin(rows, key, ["_draw"], d, x, y), by, n, F.col("_draw"), key).drop("_draw")


def stratified_share(df: DataFrame, by: str, share: float, draw: Column, key: str) -> DataFrame:
    """About a share of each group (at least one row), by a deterministic draw."""
    w = Window.partitionBy(by)
    rank, size = F.row_number().over(w.orderBy(draw, F.col(key))), F.count(F.lit(1)).over(w)
    return df.withColumn("_r", rank).withColumn("_c", F.ceil(size * share)).filter("_r <= _c").drop("_r", "_c")


def union_fill(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def lookup(df: DataFrame, table: DataFrame, on: str, value: str) -> DataFrame:
    """A value from a dimension table, the first for each key, null if there is none.  Spark broadcasts the table if it proves small."""
    return df.join(table.groupBy(on).agg(F.min(value).alias(value)), on, "left")


def panels(df: DataFrame, by: str, label: str, **aggregates: Column) -> DataFrame:
    """Aggregates for each group and, under ``label``, for all rows together, from one pass."""
    rolled = df.rollup(by).agg(F.grouping(by).alias("_all"), *[c.alias(n) for n, c in aggregates.items()])
    return rolled.withColumn(by, F.when(F.col("_all") == 1, label).otherwise(col(by).cast("string"))).drop("_all")


def product_without(tables: Sequence[DataFrame], baseline: Column) -> DataFrame:
    """All combinations of small parameter tables, less the baseline."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables).filter(~baseline)


def sample_rows(df: DataFrame, n: int, draw: Column, key: str) -> DataFrame:
    """n rows by a deterministic draw, ties by key."""
    return df.orderBy(draw, F.col(key)).limit(n)


def pad_last(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Nulls filled with the last value before them in their group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, True).over(w))


def rename_by(df: DataFrame, table: dict[str, str], strip: str | None = None) -> DataFrame:
    """Columns renamed by a table, and a pattern stripped from all names."""
    out = df.withColumnsRenamed(table)
    return out.toDF(*[re.sub(strip, "", c) for c in out.columns]) if strip else out


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def any_of(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Of the names those that the table has, in the order given; to select or drop."""
    return [c for c in dict.fromkeys(columns) if c in df.columns]


def all_of(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The names, if the table has all of them; ValueError otherwise."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return list(columns)
