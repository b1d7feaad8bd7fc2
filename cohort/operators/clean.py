"""Column transforms, imputation, encoding and filters.

Fitted state (fills, means, bounds) is one small record per column. Level tables stay
DataFrames: the encoders join them, and Spark broadcasts them when they are small enough.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohort import roles as R
from cohort.functions.columns import clip, column, melt, numeric_columns, quoted, require, string_columns
from cohort.operators.rank import bucket_count, column_bucket, medians, ranked_cells, running_totals, text_literal, top_values

AGE_BANDS = R.AGE_BANDS


# ---------------------------------------------------------------- names and values

def normalize_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case, and turn blanks and hyphens into underscores."""
    names = [c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after normalisation: {clashes}")
    return df.toDF(*names)


def rename_columns(df: DataFrame, names: Mapping[str, str] = R.RENAMES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def unmapped_columns(df: DataFrame, names: Mapping[str, str] = R.RENAMES) -> list[str]:
    return [c for c in df.columns if c not in names]


def recode_values(df: DataFrame, recodes: Mapping[str, Mapping[str, str]] = R.RECODES) -> DataFrame:
    """Replace listed values per column, keep every other value."""
    changed = {}
    for name, mapping in recodes.items():
        if name in df.columns:
            pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
            changed[name] = F.coalesce(F.element_at(pairs, column(name)), column(name))
    return df.withColumns(changed) if changed else df


def select_profile(df: DataFrame, roles: R.ColumnRoles = R.ColumnRoles(), profile: str = "safe") -> DataFrame:
    """Row key, the profile's model columns that exist, and the target."""
    names = [roles.row_id, *roles.features(profile), roles.target]
    return df.select(*[column(c) for c in names if c in df.columns])


def drop_excluded(df: DataFrame, names: Sequence[str] = R.EXCLUDED) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def band(name: str, bands: Sequence[tuple[str, int, int]] = R.AGE_BANDS) -> Column:
    """Label of the closed band a value falls in; null outside every band."""
    out = None
    for label, low, high in bands:
        hit = column(name).between(low, high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def severity(score: str, bounds=R.SEVERITY, last: str = R.SEVERITY_LAST) -> Column:
    """Label of the first bound the score does not exceed; the last label otherwise, also for null."""
    out = None
    for bound, label in bounds:
        hit = column(score) <= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def binary_target(df: DataFrame, name: str, threshold: float = R.AT_RISK_SCORE) -> Column:
    """A numeric score becomes 1 from ``threshold`` on; a 0/1 text column is cast."""
    if name in numeric_columns(df):
        return (column(name) >= threshold).cast("int")
    return column(name).try_cast("int")


def coerce_types(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Numbers where a column must be numeric (null if unreadable), text elsewhere."""
    return df.select(
        *[
            (column(c).try_cast("double") if c in numeric else column(c).cast("string")).alias(c)
            for c in df.columns
        ]
    )


# ---------------------------------------------------------------- imputation and scaling

@dataclass
class Fills:
    """Values put in place of nulls, learnt on one table and applied to others."""

    numeric: dict[str, float] = field(default_factory=dict)
    text: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        changed = {}
        for name, value in self.numeric.items():
            if name in df.columns:
                changed[name] = F.coalesce(column(name).cast("double"), F.lit(float(value)))
        for name, value in self.text.items():
            if name in df.columns:
                changed[name] = F.coalesce(column(name).cast("string"), F.lit(value))
        out = df.withColumns(changed) if changed else df
        return out.drop(*[c for c in self.dropped if c in df.columns])

    def to_dict(self) -> dict:
        return asdict(self)


def learn_fills(
    df: DataFrame, numeric: Sequence[str] = (), text: Sequence[str] = (), mode_numeric: Sequence[str] = (),
    missing: str = "Missing",
) -> Fills:
    """Median per numeric column, mode per ``text`` and ``mode_numeric`` column.

    Modes take the lowest value on a tie. A numeric column without any value is dropped;
    a text column without any value is filled with ``missing``.
    """
    found, modes = {}, {}
    if numeric:
        found = {r["column"]: r["median"] for r in medians(df, numeric).collect()}  # one row per column
    if text or mode_numeric:
        numbers = {c: column(c).cast("double") for c in mode_numeric}
        words = {c: column(c).cast("string") for c in text}
        top = top_values(df.select(*[v.alias(c) for c, v in {**numbers, **words}.items()]), [*numbers, *words]).collect()
        found |= {r["column"]: r["number"] for r in top if r["column"] in numbers}
        modes = {r["column"]: r["value"] for r in top}
    wanted = [*numeric, *mode_numeric]
    return Fills(
        numeric={c: float(found[c]) for c in wanted if c in found},
        text={c: modes.get(c, missing) for c in text},
        dropped=[c for c in wanted if c not in found],
    )


def columns_with_nulls(df: DataFrame, names: Sequence[str]) -> list[str]:
    row = df.agg(*[F.max(column(c).isNull()).alias(f"c{i}") for i, c in enumerate(names)]).first() if names else ()
    return [c for c, has in zip(names, row) if has]


def fill_medians(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Medians for the nulls of numeric columns; a column without nulls keeps its type."""
    names = columns_with_nulls(df, numeric_columns(df) if names is None else names)
    return learn_fills(df, numeric=names).transform(df) if names else df


def fill_modes(df: DataFrame, names: Sequence[str] | None = None, missing: str | None = "Missing") -> DataFrame:
    """Mode imputation of text columns; with ``missing=None`` an all-null column is dropped."""
    names = string_columns(df) if names is None else names
    fills = learn_fills(df, text=names, missing="\0")
    empty = [c for c, v in fills.text.items() if v == "\0"]
    for c in empty:
        if missing is None:
            fills.dropped.append(c)
            del fills.text[c]
        else:
            fills.text[c] = missing
    return fills.transform(df)


@dataclass
class Scaling:
    """Mean and population SD per column; an SD of zero scales by one."""

    mean: dict[str, float]
    std: dict[str, float]

    def column(self, name: str) -> Column:
        return (column(name).cast("double") - F.lit(self.mean[name])) / F.lit(self.std[name])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.mean})


def learn_scaling(df: DataFrame, names: Sequence[str]) -> Scaling:
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.avg(column(c)).alias(f"m{i}"), F.stddev_pop(column(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    mean = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(names)}
    std = {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(names)}
    return Scaling(mean, {c: s if s > 1e-12 * max(1.0, abs(mean[c])) else 1.0 for c, s in std.items()})


def zscore(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return learn_scaling(df, names).transform(df)


# ---------------------------------------------------------------- levels and encodings

def _text_levels(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sorted position of every distinct text value: ``(column, value, index)``.

    Cut points are every so-many-th of a hash-ordered sample of the levels, so even a
    column with very many levels is ordered in pieces.
    """
    cells = melt(df, names).filter(F.col("value").isNotNull()).distinct().withColumn("one", F.lit(1).cast("long"))
    buckets = bucket_count(df)
    picked = cells.orderBy(F.xxhash64("column", "value"), "column", "value").limit(20 * buckets)
    sample = picked.select("column", "value").collect()
    bounds = {c: sorted(r["value"] for r in sample if r["column"] == c)[20::20] for c in names}
    slot = column_bucket(bounds, "column", "value", text_literal)
    ranked = running_totals(cells, "value", ["one"], ["column"], slot)
    return ranked.select("column", "value", (F.col("cum_one") - 1).cast("int").alias("index"))


def level_index(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, value, index)``: levels of each column numbered from zero in sorted order."""
    numbers = [c for c in names if c in numeric_columns(df)]
    texts = [c for c in names if c not in numbers]
    parts = []
    if texts:
        parts.append(_text_levels(df, texts))
    for name in numbers:
        cells = ranked_cells(df.select(column(name)).distinct(), [name])
        parts.append(
            cells.select("column", F.col("value").cast(dict(df.dtypes)[name]).cast("string").alias("value"),
                         (F.col("cum_n") - 1).cast("int").alias("index"))
        )
    return reduce(DataFrame.unionByName, parts)


def encode_levels(df: DataFrame, names: Sequence[str], suffix: str = "_index", levels: DataFrame | None = None) -> DataFrame:
    """Add the sorted level number of each column; nulls and unseen values stay null."""
    levels = level_index(df, names) if levels is None else levels
    out = df
    for i, name in enumerate(names):
        one = levels.filter(F.col("column") == name).select(
            F.col("value").alias(f"_v{i}"), F.col("index").alias(name + suffix)
        )
        out = out.join(one, column(name).cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    return out


def lookup(df: DataFrame, name: str, mapping: DataFrame, key: str, value: str, default, out: str) -> DataFrame:
    """Dictionary lookup with a default for keys the mapping lacks."""
    small = mapping.select(column(key).alias("_key"), column(value).alias("_value"))
    joined = df.join(small, column(name) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_value"), F.lit(default))).drop("_key", "_value")


def column_levels(df: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels per column, for encodings that turn each level into a column."""
    out: dict[str, list[str]] = {c: [] for c in names}
    for r in melt(df, names).filter(F.col("value").isNotNull()).distinct().toLocalIterator():  # each becomes a column
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, names: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """0/1 column ``col_level`` per level; a level unseen in ``levels`` gets zeros everywhere."""
    levels = column_levels(df, names) if levels is None else levels
    hot = [
        F.coalesce((column(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in names for v in levels[c]
    ]
    return df.select(*[column(c) for c in df.columns if c not in names], *hot)


def one_hot_sparse(df: DataFrame, key: str, names: Sequence[str], levels: DataFrame | None = None) -> DataFrame:
    """The ones of a one-hot table in long form, ``(key, column, level, position)``, for any number of levels.

    ``position`` counts the levels of all columns in the order of ``names``; a level that ``levels``
    lacks has no row. Levels meet the rows by a join, so none of them passes through the driver.
    """
    levels = level_index(df, names) if levels is None else levels
    sizes = {r["column"]: r["n"] for r in levels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    before, start = {}, 0
    for c in names:
        before[c], start = start, start + sizes.get(c, 0)
    offset = F.create_map(*[F.lit(x) for c in names for x in (c, before[c])])
    placed = levels.select(F.col("column").alias("_c"), F.col("value").alias("_v"), (F.col("index") + offset[F.col("column")]).cast("long").alias("position"))
    long = melt(df, names, [key]).filter(F.col("value").isNotNull())
    return long.join(placed, (F.col("column") == F.col("_c")) & (F.col("value") == F.col("_v"))).select(column(key), "column", F.col("value").alias("level"), "position")


def binary_codes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Two-valued columns as 0/1 in sorted order; a column with another level count is omitted."""
    found = (
        melt(df, names).filter(F.col("value").isNotNull()).groupBy("column")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"), F.approx_count_distinct("value").alias("_k"))
    )
    # exactly two levels: every value equals the smallest or the largest, and those differ
    spread = {r["column"]: (r["low"], r["high"]) for r in found.collect()}
    checks = [
        F.count_if(column(c).isNotNull() & ~column(c).cast("string").isin(list(spread[c]))).alias(c)
        for c in names if c in spread and spread[c][0] != spread[c][1]
    ]
    others = df.agg(*checks).first().asDict() if checks else {}
    two = [c for c in names if others.get(c) == 0]
    codes = {c: (column(c).cast("string") == spread[c][1]).cast("int") for c in two}
    out = df.drop(*[c for c in names if c not in two])
    return out.withColumns(codes) if codes else out


# ---------------------------------------------------------------- filters

def at_risk(df: DataFrame, threshold: float = R.AT_RISK_SCORE, score: str = "depression_score") -> DataFrame:
    require(df, [score])
    return df.filter(column(score) >= threshold)


def by_demographics(
    df: DataFrame, gender: str | None = None, age_min: int | None = None, age_max: int | None = None,
    education: str | None = None, names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Case-insensitive equality and inclusive age bounds; a filter not given is not applied."""
    names = {"gender": "gender", "age": "age", "education": "education_level", **(names or {})}
    out = df
    for key, wanted in (("gender", gender), ("education", education)):
        if wanted is not None:
            out = out.filter(F.lower(column(names[key])) == wanted.lower())
    if age_min is not None:
        out = out.filter(column(names["age"]) >= age_min)
    if age_max is not None:
        out = out.filter(column(names["age"]) <= age_max)
    return out


def drop_missing(df: DataFrame, critical: Sequence[str] = R.CRITICAL) -> DataFrame:
    present = [quoted(c) for c in critical if c in df.columns]
    return df.dropna(subset=present) if present else df


def min_group_size(counts: DataFrame, size: int = 30, count: str = "n") -> DataFrame:
    return counts.filter(column(count) >= size)


def pipeline(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chain of table-to-table steps in one lazy plan."""
    return reduce(lambda table, step: table.transform(step), steps, df)


def clean(df: DataFrame, critical: Sequence[str] = R.CRITICAL) -> DataFrame:
    """Normalised names, medians for missing numbers, then rows without critical values dropped."""
    return pipeline(df, normalize_names, fill_medians, lambda t: drop_missing(t, critical))


# ---------------------------------------------------------------- roles

def classify_columns(df: DataFrame, roles: R.ColumnRoles = R.STANDARD_ROLES) -> dict[str, str]:
    """Role of every column; unlisted numbers count as numeric, the rest as nominal."""
    out, numbers = {}, numeric_columns(df)
    for c in df.columns:
        if c == roles.row_id:
            out[c] = "id"
        elif c == roles.target:
            out[c] = "target"
        elif c in roles.ordinal:
            out[c] = "ordinal"
        elif c in roles.nominal:
            out[c] = "nominal"
        elif c in roles.numeric or c in numbers:
            out[c] = "numeric"
        else:
            out[c] = "nominal"
    return out


def column_roles(df: DataFrame, roles: R.ColumnRoles = R.STANDARD_ROLES) -> DataFrame:
    """``(column, role, levels, n_features)``: encoded width, one-hot dropping one level.

    Null counts as a level of a nominal column.
    """
    kinds = classify_columns(df, roles)
    nominal = [c for c, k in kinds.items() if k == "nominal"]
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    all_columns = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    base = all_columns.withColumn("role", F.element_at(names, F.col("column")))
    if nominal:
        counts = melt(df, nominal).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("levels"))
        base = base.join(counts, "column", "left")
    else:
        base = base.withColumn("levels", F.lit(None).cast("long"))
    width = (
        F.when(F.col("role").isin("numeric", "ordinal"), F.lit(1).cast("long"))
        .when(F.col("role") == "nominal", F.greatest(F.coalesce("levels", F.lit(1)) - 1, F.lit(0)))
        .otherwise(F.lit(0))
    )
    return base.select("column", "role", "levels", width.cast("long").alias("n_features"))


def standardize(
    df: DataFrame, names: Mapping[str, str] = R.RENAMES, recodes: Mapping[str, Mapping[str, str]] = R.RECODES,
    roles: R.ColumnRoles = R.STANDARD_ROLES,
) -> tuple[DataFrame, DataFrame]:
    """Renamed and recoded table together with its column-role report."""
    out = recode_values(rename_columns(df, names), recodes)
    return out, column_roles(out, roles)


def clipped(name: str, low: float | None, high: float | None) -> Column:
    return clip(column(name), low, high)
