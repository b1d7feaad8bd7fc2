"""Distributed ranks, running totals and exact quantiles.

Rows are first reduced to distinct values with counts. The distinct values are then
cut into range buckets whose bounds come from one sketch pass, so no task ever sorts
more than about ``distinct / buckets`` values of one group, and bucket offsets join the
parts. Bounds are plain numbers fixed before the job starts: a retried task cannot
disagree with its neighbours about where a bucket ends.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.columns import column, join_groups, melt, numeric_columns, quoted
from cohort.session import cut_lineage


def bucket_count(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(partitions, 1024))


def _number(value: float) -> str:
    return f"{float(value)!r}D".upper()


def text_literal(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bucket_sql(value_sql: str, bounds: Sequence, literal: Callable[..., str] = _number) -> str:
    """SQL text for the number of ``bounds`` that are <= value, as a balanced CASE tree."""
    ordered = sorted(set(bounds))

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN {value_sql} < {literal(ordered[mid])} THEN {tree(low, mid)} ELSE {tree(mid + 1, high)} END"

    return tree(0, len(ordered))


def range_bounds(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Cut points per column from one quantile-sketch pass (a few hundred numbers each)."""
    buckets = buckets or bucket_count(df)
    probabilities = [i / buckets for i in range(1, buckets)]
    source = df.select(*[column(c).cast("double").alias(c) for c in columns])
    found = source.approxQuantile([quoted(c) for c in columns], probabilities, 1.0 / (4 * buckets))
    return {c: sorted(set(b for b in bounds if b == b)) for c, bounds in zip(columns, found)}


def running_totals(
    cells: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``cum_<s>``, the sum of ``s`` over cells of the group with value <= this one, and
    ``tot_<s>``, its sum over the whole group.

    ``cells`` holds one row per (by, value). Without ``bucket`` the distinct values of a
    group must be few by construction (rounded scores, bins, levels).
    """
    group = Window.partitionBy(*[column(c) for c in by])
    if bucket is None:
        upto = group.orderBy(column(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return cells.select(
            "*", *[F.sum(column(s)).over(upto).alias(f"cum_{s}") for s in sums],
            *[F.sum(column(s)).over(group).alias(f"tot_{s}") for s in sums],
        )
    keys = [*by, "_bucket"]
    cut = cells.withColumn("_bucket", bucket)
    totals = cut.groupBy(*[column(c) for c in keys]).agg(*[F.sum(column(s)).alias(f"_t_{s}") for s in sums])
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[column(c) for c in keys],
        *[F.coalesce(F.sum(column(f"_t_{s}")).over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(column(f"_t_{s}")).over(group).alias(f"tot_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*[column(c) for c in keys]).orderBy(column(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = join_groups(cut, offsets, keys)
    return joined.select(
        *[column(c) for c in cells.columns],
        *[(F.sum(column(s)).over(inside) + column(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[column(f"tot_{s}") for s in sums],
    )


def numbered(df: DataFrame, order: Sequence[Column], out: str = "_rank", part: str = "_part") -> DataFrame:
    """Add the row number (from 1) in the given order over all rows, and the range of the sort a row fell into.

    A sort across the cluster, written to the checkpoint folder so that the numbers hold; the counts of
    the ranges, one row each, join the parts. Ties are in any order: break them in ``order``.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition number and place in it
    held = cut_lineage(ranged.withColumn("_at", at).withColumn(part, F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    counts = held.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(part).alias("_of"), (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(part)) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), F.col(part) == F.col("_of")).withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_of", "_before", "_at")


def column_bucket(bounds: Mapping[str, Sequence], name: str, value: str, literal: Callable[..., str] = _number) -> Column:
    """Bucket of a long-form value by the bounds of its own column."""
    parts = " ".join(f"WHEN {text_literal(c)} THEN {bucket_sql(quoted(value), b, literal)}" for c, b in bounds.items())
    return F.expr(f"CASE {quoted(name)} {parts} ELSE 0 END")


def value_cells(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), parts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts per (by, column, value) over numeric columns; the partial sums run map-side.

    ``parts`` adds counts of the rows that meet a condition, such as one group or sample.
    """
    parts = parts or {}
    source = df.select(*[column(c) for c in [*by, *columns]], *[c.alias(f"_is_{k}") for k, c in parts.items()])
    long = melt(source, columns, [*by, *[f"_is_{k}" for k in parts]], cast="double")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*[column(c) for c in by], "column", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(f"_is_{k}"), 1)).alias(k) for k in parts]
    )


def ranked_cells(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), parts: Mapping[str, Column] | None = None
) -> DataFrame:
    """``value_cells`` with ``cum_n``; ranks of a cell are ``cum_n - n + 1 .. cum_n``."""
    bounds = range_bounds(df, columns)
    cells = value_cells(df, columns, by, parts)
    sums = ["n", *(parts or {})]
    return running_totals(cells, "value", sums, [*by, "column"], column_bucket(bounds, "column", "value"))


def mid_rank(n: str = "n", cum: str = "cum_n") -> Column:
    """Average rank of a tie block."""
    return column(cum).cast("double") - (column(n).cast("double") - F.lit(1.0)) / F.lit(2.0)


def rank_average(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Every distinct value of a column with its count and average-tie rank."""
    cells = ranked_cells(df, [value])
    return cells.select(F.col("value").alias(value), "n", mid_rank().alias(out))


def quantile_name(p: float) -> str:
    return f"q{p * 100:g}".replace(".", "_")


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles by linear interpolation: ``(by, column, n, q25, q50, ...)``.

    Only bucket counts are shuffled for the whole table; values are counted one by one just
    in the buckets that hold a wanted rank.
    """
    keys = [*by, "column"]
    bounds = range_bounds(df, columns)
    long = melt(df, columns, by, cast="double").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    long = long.withColumn("_bucket", column_bucket(bounds, "column", "value"))
    group = Window.partitionBy(*[column(c) for c in keys])
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = long.groupBy(*[column(c) for c in keys], "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    placed = counts.select(
        *[column(c) for c in keys], "_bucket", (F.sum("_size").over(upto) - F.col("_size")).alias("_before"),
        F.sum("_size").over(upto).alias("_upto"), F.sum("_size").over(group).alias("tot_n"),
    )
    wanted = F.lit(False)
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("tot_n") - 1).cast("double")
        for fn in (F.floor, F.ceil):
            wanted = wanted | ((F.col("_before") <= fn(at)) & (fn(at) < F.col("_upto")))
    chosen = placed.filter(wanted).drop("_upto")
    inside_bucket = join_groups(long, chosen, [*keys, "_bucket"])
    cells = inside_bucket.groupBy(*[column(c) for c in keys], "_bucket", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("_before").alias("_before"), F.max("tot_n").alias("tot_n"))
    along = (
        Window.partitionBy(*[column(c) for c in keys], "_bucket").orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = cells.withColumn("cum_n", F.sum("n").over(along) + F.col("_before"))
    picks = []
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("tot_n") - 1).cast("double")
        for side, fn in (("lo", F.floor), ("hi", F.ceil)):
            rank = fn(at)
            inside = (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"_{side}_{quantile_name(p)}"))
    found = ranked.groupBy(*[column(c) for c in keys]).agg(F.max("tot_n").alias("n"), *picks)
    out = []
    for p in probabilities:
        name = quantile_name(p)
        at = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at).cast("double"))).alias(name))
    return found.select(*[column(c) for c in keys], "n", *out)


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, columns, [0.5], by).withColumnRenamed("q50", "median")


def top_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per column, lowest value on ties: ``(by, column, value, number, n)``.

    ``number`` is the value of a numeric column, which is then compared as a number. Counts
    come first, so a value holding a third of the rows costs one row per task.
    """
    numbers = set(numeric_columns(df))
    pairs = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column"), column(c).cast("string").alias("value"),
            (column(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("number"),
        ) for c in columns
    ]))
    keys = [column(c) for c in by]
    long = df.select(*keys, pairs.alias("_p")).select(*keys, "_p.column", "_p.value", "_p.number").filter(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "column", "value", "number").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("number"), F.col("value"))).alias("_b")
    return counts.groupBy(*keys, "column").agg(best).select(*keys, "column", "_b.value", "_b.number", (-F.col("_b.neg")).alias("n"))
