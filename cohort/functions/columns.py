"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> str:
    """``name`` as a SQL identifier; table columns may hold spaces, ``/`` and ``?``."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str | Column) -> Column:
    return F.col(quoted(name)) if isinstance(name, str) else name


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """``num / den``; ``empty`` where the denominator is zero (ANSI mode would raise)."""
    guarded = F.when(den != 0, num / den)
    return guarded if empty is None else guarded.otherwise(F.lit(float(empty)))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def clip(value: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def labelled(value: Column, rules: Sequence[tuple[float, str]], last: str) -> Column:
    """First label whose upper bound (exclusive) lies above ``value``, else ``last``."""
    out = None
    for bound, label in rules:
        hit = value < F.lit(float(bound))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def string_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def require(df: DataFrame, names: Sequence[str], what: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def melt(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    cast: str = "string",
    name: str = "column",
    value: str = "value",
) -> DataFrame:
    """Long form ``(keys, name, value)``: one pass over the rows whatever the column count."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias(name), column(c).cast(cast).alias(value)) for c in columns])
    )
    return df.select(*[column(k) for k in keys], pairs.alias("_p")).select(
        *[column(k) for k in keys], f"_p.{name}", f"_p.{value}"
    )


def by_families(df: DataFrame, families: Mapping[str, str | Column], keep: Sequence[str]) -> DataFrame:
    """Rows repeated once per attribute as ``(family, label, keep...)``; null labels drop out."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("family"), column(c).cast("string").alias("label"))
                for f, c in families.items()
            ]
        )
    )
    return (
        df.select(*[column(k) for k in keep], pairs.alias("_f"))
        .select("_f.family", "_f.label", *[column(k) for k in keep])
        .filter(F.col("label").isNotNull())
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(column(n), digits).alias(n) if t in ("double", "float") else column(n)
            for n, t in df.dtypes
        ]
    )


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on group keys in which a null group matches itself."""
    renamed = right.select(
        *[(column(c).alias(f"_key_{keys.index(c)}") if c in keys else column(c)) for c in right.columns]
    )
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & left[quoted(k)].eqNullSafe(F.col(f"_key_{i}"))
    return left.join(renamed, match, how).drop(*[f"_key_{i}" for i in range(len(keys))])
