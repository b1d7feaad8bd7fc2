"""Statistical tests.

Spark reduces rows to sufficient statistics (group moments, contingency cells, rank sums,
cross-products). P-values are columns computed from those few rows; matrices whose size is
the number of columns are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions import distributions as D
from cohort.functions.columns import column, count_if, join_groups, labelled, melt, numeric_columns, ratio
from cohort.functions.linalg import in_task
from cohort.operators.rank import bucket_sql, medians, mid_rank, numbered, range_bounds, ranked_cells, running_totals
from cohort.session import cut_lineage


def stars(p: Column) -> Column:
    return labelled(p, [(0.001, "***"), (0.01, "**"), (0.05, "*")], "ns")


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(label, n, mean, var)`` over rows where both columns are present."""
    return df.filter(column(value).isNotNull() & column(group).isNotNull()).groupBy(
        column(group).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(column(value)).alias("mean"), F.var_samp(column(value)).alias("var"))


def _pairs(moments: DataFrame) -> DataFrame:
    """Every pair of groups, lower label first; one row per group goes in."""
    a = moments.select(*[F.col(c).alias(f"{c}_a") for c in ("label", "n", "mean", "var")], F.lit(1).alias("_k"))
    b = moments.select(*[F.col(c).alias(f"{c}_b") for c in ("label", "n", "mean", "var")], F.lit(1).alias("_k"))
    return a.join(b, "_k").filter(F.col("label_a") < F.col("label_b")).drop("_k")


def _t_columns(pairs: DataFrame, correction: bool | None) -> DataFrame:
    """t, df, SE and Cohen's d; Welch where sizes differ unless ``correction`` decides."""
    na, nb, va, vb = (F.col(c).cast("double") for c in ("n_a", "n_b", "var_a", "var_b"))
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    welch = (na != nb) if correction is None else F.lit(correction)
    ra, rb = va / na, vb / nb
    se = F.sqrt(F.when(welch, ra + rb).otherwise(pooled * (1.0 / na + 1.0 / nb)))
    dof = F.when(welch, F.pow(ra + rb, F.lit(2.0)) / (ra * ra / (na - 1) + rb * rb / (nb - 1))).otherwise(na + nb - 2)
    diff = F.col("mean_a") - F.col("mean_b")
    return pairs.select("*", diff.alias("difference"), se.alias("se"), dof.alias("dof"), ratio(diff, se).alias("t"),
                        ratio(diff, F.sqrt(pooled)).alias("cohen_d"))


def t_test(
    df: DataFrame, value: str, group: str, paired: bool = False, pair_key: str | None = None, correction: bool | None = None,
    labels: Sequence | None = None,
) -> DataFrame:
    """Two-sample t-test with CI95 and Cohen's d; groups in ascending order.

    ``labels`` names the two groups; the rows of others are not read. The paired test matches the
    two groups' rows on ``pair_key``.
    """
    if labels is not None:
        if len(set(labels)) != 2:
            raise ValueError("labels must name two groups")
        df = df.filter(column(group).isin(list(labels)))
    if paired:
        if pair_key is None:
            raise ValueError("a paired test needs pair_key")
        first, last = df.agg(F.min(column(group)), F.max(column(group))).first()
        rows = df.select(column(pair_key).alias("_key"), column(group).alias("_g"), column(value).cast("double").alias("_v"))
        both = rows.filter(F.col("_g").isin([first, last])).groupBy("_key").agg(
            F.avg(F.when(F.col("_g") == F.lit(first), F.col("_v"))).alias("x"),
            F.avg(F.when(F.col("_g") == F.lit(last), F.col("_v"))).alias("y"),
        ).dropna()
        s = both.agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("difference"),
            F.stddev_samp(F.col("x") - F.col("y")).alias("sd"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
        )
        se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
        spread = F.sqrt((F.col("vx") + F.col("vy")) / 2.0)
        out = s.select("n", "difference", se.alias("se"), (F.col("n") - 1).cast("double").alias("dof"),
                       ratio(F.col("difference"), se).alias("t"), ratio(F.col("difference"), spread).alias("cohen_d"))
    else:
        out = _t_columns(_pairs(group_moments(df, value, group)), correction)
    half = D.t_critical_95(F.col("dof")) * F.col("se")
    return out.select("*", D.t_two_sided_p(F.col("t"), F.col("dof")).alias("p"),
                      (F.col("difference") - half).alias("ci95_low"), (F.col("difference") + half).alias("ci95_high"))


def _one_way(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ANOVA table from group counts, means and variances (a one-row group has no spread)."""
    n = F.col("n").cast("double")
    grand = moments.groupBy(*by).agg((F.sum(n * F.col("mean")) / F.sum("n")).alias("_grand"))
    # without ``by`` the grand mean is one row, so sending it to every task is bounded
    centred = join_groups(moments, grand, list(by)) if by else moments.join(F.broadcast(grand))
    away = F.col("mean") - F.col("_grand")
    t = centred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(n * away * away).alias("ss_between"),
        F.sum((n - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"),
    )
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    f = ratio(ratio(F.col("ss_between"), d1), ratio(F.col("ss_within"), d2))
    return t.select(
        *by, "k", "n", "ss_between", "ss_within", d1.alias("df_between"), d2.alias("df_within"),
        ratio(F.col("ss_between"), d1).alias("ms_between"), ratio(F.col("ss_within"), d2).alias("ms_within"), f.alias("f"),
        ratio(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("eta_squared"),
    )


def anova_one_way(df: DataFrame, value: str, group: str) -> DataFrame:
    table = _one_way(group_moments(df, value, group))
    return table.withColumn("p", D.f_p(F.col("f"), F.col("df_between"), F.col("df_within")))


#: Additive fits end when the residual of the normal equations has fallen to this share.
FIT_TOLERANCE = 1e-11


def _level_effects(cells: DataFrame) -> DataFrame:
    """``(b, effect)`` of the additive fit ``y ~ a + b`` over cells ``(a, b, n, y)``, by conjugate gradients.

    Factor a is eliminated: a step takes level means of a of the direction and sums them over b, so the
    data are two grouped sums and joins of the cells per step. The directions are as many rows as b
    has levels, and only two numbers a step reach the driver.
    """
    base_a = cells.groupBy("a").agg(F.sum("n").alias("n_a"), F.sum(F.col("n") * F.col("y")).alias("s_a"))
    base_b = cells.groupBy("b").agg(F.sum("n").alias("n_b"))
    with_a = cells.join(base_a, "a")
    state = with_a.groupBy("b").agg(F.sum(F.col("n") * (F.col("y") - F.col("s_a") / F.col("n_a"))).alias("r"))
    state = cut_lineage(state.join(base_b, "b").select("b", "n_b", F.lit(0.0).alias("effect"), "r", F.col("r").alias("p")))
    start = rest = state.agg(F.sum(F.col("r") ** 2)).first()[0] or 0.0
    levels = state.count()
    for _ in range(2 * levels + 50):  # exact arithmetic needs one step a level
        if rest <= FIT_TOLERANCE**2 * start or rest == 0.0:
            return state.select("b", "effect")
        means = cells.join(state.select("b", "p"), "b").groupBy("a").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("m"))
        taken = cells.join(means, "a").groupBy("b").agg(F.sum(F.col("n") * F.col("m")).alias("t"))
        state = state.join(taken, "b").withColumn("q", F.col("n_b") * F.col("p") - F.col("t"))
        state = cut_lineage(state.select("b", "n_b", "effect", "r", "p", "q"))
        curve = state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not curve > 0:
            return state.select("b", "effect")
        step = rest / curve
        state = state.withColumn("effect", F.col("effect") + F.lit(step) * F.col("p")).withColumn("r", F.col("r") - F.lit(step) * F.col("q"))
        new = state.agg(F.sum(F.col("r") ** 2)).first()[0]
        state = state.select("b", "n_b", "effect", "r", (F.col("r") + F.lit(new / rest) * F.col("p")).alias("p"))
        rest = new
    raise RuntimeError("the additive fit did not settle")


def anova_two_way(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Two factors with interaction, Type II sums of squares, from cell means and counts.

    Cells stay distributed, whatever their number; the additive fit sees them once a step.
    """
    y, known = column(value).cast("double"), column(value).isNotNull() & column(a).isNotNull() & column(b).isNotNull()
    rows = df.filter(known)
    middle = rows.agg(F.avg(y)).first()[0] or 0.0
    cells = cut_lineage(rows.groupBy(column(a).cast("string").alias("a"), column(b).cast("string").alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(y - F.lit(middle)).alias("y"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("var")))
    sizes = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
                      F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")).first()
    flip = sizes["kb"] > sizes["ka"]  # the factor of fewer levels is solved for, the other one eliminated
    turned = cells.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "y") if flip else cells.select("a", "b", "n", "y")

    def left(parts: DataFrame, key: str, rest: Column) -> DataFrame:
        """Cells with ``rest`` less its weighted mean within each level of ``key``."""
        means = parts.groupBy(key).agg((F.sum(F.col("n") * rest) / F.sum("n")).alias("_m"))
        return parts.join(means, key).withColumn("rest", rest - F.col("_m")).drop("_m")

    def total(parts: DataFrame) -> float:
        return float(parts.agg(F.sum(F.col("n") * F.col("rest") ** 2)).first()[0] or 0.0)

    only_a, only_b = total(left(turned, "a", F.col("y"))), total(left(turned, "b", F.col("y")))
    fitted = turned.join(_level_effects(turned), "b")
    both = total(left(fitted, "a", F.col("y") - F.col("effect")))
    ss_a, ss_b = (only_b - both, only_a - both) if not flip else (only_a - both, only_b - both)
    within = float(sizes["within"] or 0.0)
    df_within = float((sizes["n"] or 0) - sizes["cells"])
    table = []
    for source, ss, dof in ((a, ss_a, sizes["ka"] - 1.0), (b, ss_b, sizes["kb"] - 1.0), (f"{a} * {b}", both, sizes["cells"] - sizes["ka"] - sizes["kb"] + 1.0)):
        f = (ss / dof) / (within / df_within) if dof > 0 and df_within > 0 and within > 0 else None
        p = float(D.f_sf(f, dof, df_within)[0]) if f is not None else None
        table.append((source, ss, dof, ss / dof if dof else None, f, p, ss / (ss + within) if ss + within else None))
    table.append(("Residual", within, df_within, within / df_within if df_within else None, None, None, None))
    return df.sparkSession.createDataFrame(table, "source string, ss double, df double, ms double, f double, p double, partial_eta_squared double")


def tukey_hsd(df: DataFrame, value: str, group: str) -> DataFrame:
    """All group pairs with the studentised-range p-value."""
    moments = group_moments(df, value, group)
    pooled = _one_way(moments).select(F.col("k"), F.col("df_within"), F.col("ms_within"), F.lit(1).alias("_k"))
    pairs = _pairs(moments).withColumn("_k", F.lit(1)).join(F.broadcast(pooled), "_k").drop("_k")  # a one-row side
    diff = F.col("mean_a") - F.col("mean_b")
    se = F.sqrt(F.col("ms_within") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    out = pairs.select("label_a", "label_b", "mean_a", "mean_b", diff.alias("difference"), se.alias("se"),
                       ratio(F.abs(diff), se).alias("q"), "k", "df_within")
    return out.withColumn("p", D.tukey_p(F.col("q"), F.col("k").cast("double"), F.col("df_within")))


def pairwise_t_tests(df: DataFrame, value: str, group: str, method: str = "bonferroni") -> DataFrame:
    """All group pairs by t-test with Bonferroni or Holm correction."""
    tests = _t_columns(_pairs(group_moments(df, value, group)), None)
    tests = tests.withColumn("p", D.t_two_sided_p(F.col("t"), F.col("dof")))
    if method not in ("bonferroni", "holm"):
        raise ValueError(f"unknown correction {method!r}")
    tests = cut_lineage(tests)
    m = tests.filter(F.col("p").isNotNull()).count()
    if method == "bonferroni":
        return tests.withColumn("p_adjusted", F.least(F.col("p") * m, F.lit(1.0)))
    return holm(tests, ["label_a", "label_b"], m)


def holm(tests: DataFrame, ties: list[str], m: int) -> DataFrame:
    """``p_adjusted`` by Holm's step-down rule: running maxima of ``p`` times the tests that are left.

    Tests are numbered by a sort across the cluster; the largest step of the ranges before joins the
    running maximum within a range, so no task holds all tests. Tests without a p get none and count for nothing.
    """
    placed = numbered(tests.filter(F.col("p").isNotNull()), [F.col("p"), *map(F.col, ties)])
    stepped = placed.withColumn("_step", F.least(F.col("p") * (F.lit(m) - F.col("_rank") + 1), F.lit(1.0)))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    tops = stepped.groupBy(F.col("_part").alias("_of")).agg(F.max("_step").alias("_top"))  # one row a range
    tops = tops.select("_of", F.coalesce(F.max("_top").over(earlier), F.lit(0.0)).alias("_over"))
    inside = Window.partitionBy("_part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    out = stepped.join(F.broadcast(tops), F.col("_part") == F.col("_of")).withColumn("p_adjusted", F.greatest(F.max("_step").over(inside), F.col("_over")))
    return out.select(*tests.columns, "p_adjusted").unionByName(tests.filter(F.col("p").isNull()).withColumn("p_adjusted", F.lit(None).cast("double")))


def post_hoc(df: DataFrame, value: str, group: str, method: str = "tukey") -> DataFrame:
    return tukey_hsd(df, value, group) if method == "tukey" else pairwise_t_tests(df, value, group, method)


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Homogeneity of variance: ANOVA on distances from the group medians."""
    middle = medians(df.filter(column(group).isNotNull()), [value], [group]).select(column(group).alias("_g"), F.col("median").alias("_m"))
    rows = df.join(middle, column(group) == F.col("_g")).withColumn("_z", F.abs(column(value) - F.col("_m")))
    table = _one_way(group_moments(rows, "_z", "_g"))
    p = D.f_p(F.col("f"), F.col("df_between"), F.col("df_within"))
    return table.select("k", "n", F.col("f").alias("w"), "df_between", "df_within", p.alias("p")).withColumn("equal_var", F.col("p") > 0.05)


def normality(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Jarque-Bera, and the KS distance to the fitted normal, per column."""
    names = numeric_columns(df) if names is None else list(names)
    long = melt(df, names, cast="double")
    moments = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"),
    )
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    cells = ranked_cells(df, names).join(F.broadcast(moments.select("column", "mean", "std")), "column")  # one row per column
    upper = D.normal_two_sided_p(ratio(F.col("value") - F.col("mean"), F.col("std"))) / 2.0
    cdf = F.when(F.col("value") >= F.col("mean"), 1.0 - F.col("_tail")).otherwise(F.col("_tail"))
    reach = F.greatest(
        F.abs(F.col("cum_n") / F.col("tot_n") - cdf), F.abs((F.col("cum_n") - F.col("n")) / F.col("tot_n") - cdf)
    )
    distance = cells.withColumn("_tail", upper).groupBy("column").agg(F.max(reach).alias("ks_d"))
    out = moments.join(distance, "column").withColumn("jb", jb)
    return out.select(
        "column", "n", "skew", "kurtosis", "jb", D.chi2_p(F.col("jb"), F.lit(2.0)).alias("jb_p"), "ks_d",
        D.kolmogorov_p(F.sqrt(F.col("n").cast("double")) * F.col("ks_d")).alias("ks_p"),
    ).withColumn("is_normal", F.col("jb_p") > 0.05)


def mann_whitney(df: DataFrame, names: Sequence[str], group: str, first, second) -> DataFrame:
    """U of the ``first`` group, tie-corrected normal p (two-sided), rank-biserial r per column."""
    parts = {"n1": column(group) == F.lit(first), "n2": column(group) == F.lit(second)}
    rows = df.filter(column(group).isin([first, second]))
    cells = ranked_cells(rows, names, parts=parts)
    t = F.col("n").cast("double")
    s = cells.groupBy("column").agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("n1") * mid_rank()).alias("_r1"), F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - ratio(F.col("_ties"), n * (n - 1), 0.0)))
    z = ratio(F.greatest(F.abs(u - n1 * n2 / 2.0) - 0.5, F.lit(0.0)), sd)
    out = s.select("column", "n1", "n2", u.alias("u"), z.alias("z"), (1.0 - ratio(2.0 * u, n1 * n2)).alias("rank_biserial"))
    return out.withColumn("p", D.normal_two_sided_p(F.col("z"))).withColumn("significance", stars(F.col("p")))


def cohen_d(df: DataFrame, names: Sequence[str], group: str, first, second) -> DataFrame:
    """Standardised mean difference ``first - second`` (pooled SD) with its size label."""
    long = melt(df.filter(column(group).isin([first, second])), names, [group], cast="double")
    one, two = column(group) == F.lit(first), column(group) == F.lit(second)
    v = F.col("value")
    s = long.groupBy("column").agg(
        F.count(F.when(one, v)).alias("n1"), F.count(F.when(two, v)).alias("n2"),
        F.avg(F.when(one, v)).alias("m1"), F.avg(F.when(two, v)).alias("m2"),
        F.var_samp(F.when(one, v)).alias("v1"), F.var_samp(F.when(two, v)).alias("v2"),
    )
    pooled = F.sqrt(ratio((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    d = ratio(F.col("m1") - F.col("m2"), pooled)
    return s.select("column", "n1", "n2", "m1", "m2", d.alias("cohen_d")).withColumn(
        "size", labelled(F.abs("cohen_d"), [(0.2, "very small"), (0.5, "small"), (0.8, "medium")], "large"))


# ---------------------------------------------------------------- categorical association

def contingency(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Complete tables, zero cells included: ``(column, level, other, n, row_n, col_n, total)``."""
    long = melt(df, names, [target], name="column", value="level").select(
        "column", "level", column(target).cast("string").alias("other")).dropna()
    seen = long.groupBy("column", "level", "other").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.groupBy("column", "level").agg(F.sum("n").alias("row_n"))
    cols = seen.groupBy("column", "other").agg(F.sum("n").alias("col_n"))
    totals = seen.groupBy("column").agg(F.sum("n").alias("total"))
    return (
        rows.join(cols, "column").join(totals, "column")  # the table itself: levels x classes
        .join(seen, ["column", "level", "other"], "left").fillna(0, ["n"])
    )


def chi_square(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Independence test per column, Yates-corrected when dof = 1, with Cramer's V."""
    cells = contingency(df, names, target)
    r = cells.select("column", "level").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("r"))
    c = cells.select("column", "other").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("c"))
    sized = cells.join(r, "column").join(c, "column")
    expected = F.col("row_n") * F.col("col_n") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    one = (F.col("r") - 1) * (F.col("c") - 1) == 1
    fixed = F.when(one, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    s = sized.groupBy("column").agg(
        F.max("total").alias("n"), F.max("r").alias("rows"), F.max("c").alias("cols"), F.sum(ratio(fixed * fixed, expected)).alias("chi2"))
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    k = F.least("rows", "cols") - 1
    out = s.select("column", "n", dof.alias("dof"), "chi2", F.sqrt(ratio(F.col("chi2"), F.col("n") * k, 0.0)).alias("cramers_v"))
    return out.select("*", D.chi2_p(F.col("chi2"), F.when(F.col("dof") > 0, F.col("dof").cast("double"))).alias("p"),
                      labelled(F.col("cramers_v"), [(0.1, "very small"), (0.3, "small"), (0.5, "medium")], "large").alias("size"))


def association_strength(v: Column) -> Column:
    return F.when(v > 0.5, "very strong").when(v > 0.3, "strong").when(v > 0.1, "moderate").otherwise("weak")


def odds_ratios(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Odds of the positive class per level against the first sorted level, +0.5 per cell."""
    long = melt(df, names, [target], name="column", value="level").filter(F.col("level").isNotNull() & column(target).isNotNull())
    levels = long.groupBy("column", "level").agg(
        count_if(column(target) == 1).alias("pos"), count_if(column(target) != 1).alias("neg"))
    first = levels.groupBy("column").agg(F.min(F.struct("level", "pos", "neg")).alias("_ref"))
    joined = levels.join(first, "column")
    odds = (F.col("pos") + 0.5) * (F.col("_ref.neg") + 0.5) / ((F.col("neg") + 0.5) * (F.col("_ref.pos") + 0.5))
    return joined.select("column", "level", F.col("_ref.level").alias("reference"), "pos", "neg",
                         F.when(F.col("level") == F.col("_ref.level"), F.lit(1.0)).otherwise(odds).alias("odds_ratio"))


def extreme_odds(odds: DataFrame) -> DataFrame:
    """Largest, smallest and (on the log scale) farthest-from-one odds ratio per column."""
    far = F.min(F.struct((-F.abs(F.log("odds_ratio"))).alias("k"), F.col("level"), F.col("odds_ratio"))).alias("_f")
    return odds.groupBy("column").agg(F.max("odds_ratio").alias("max_or"), F.min("odds_ratio").alias("min_or"), far).select(
        "column", "max_or", "min_or", F.col("_f.level").alias("extreme_level"), F.col("_f.odds_ratio").alias("extreme_or"))


# ---------------------------------------------------------------- rank correlation

def _pair_cells(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(column(x).cast("double").alias("x"), column(y).cast("double").alias("y")).dropna().groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("n"))


def _axis_ranks(cells: DataFrame, axis: str, bounds: Sequence[float]) -> DataFrame:
    sums = cells.groupBy(axis).agg(F.sum("n").alias("n"), F.lit(1).cast("long").alias("one"))
    return running_totals(sums, axis, ["n", "one"], bucket=F.expr(bucket_sql(axis, bounds)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks, with p and Fisher-z CI95."""
    bounds = range_bounds(df, [x, y])
    cells = _pair_cells(df, x, y)
    rx = _axis_ranks(cells, "x", bounds[x]).select("x", mid_rank().alias("rx"))
    ry = _axis_ranks(cells, "y", bounds[y]).select("y", mid_rank().alias("ry"))
    both = cells.join(rx, "x").join(ry, "y")
    # average ranks of N rows have mean (N + 1) / 2
    s = both.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"),
    )
    n = F.col("n").cast("double")
    shift = n * F.pow((n + 1) / 2.0, F.lit(2.0))
    rho = ratio(F.col("xy") - shift, F.sqrt((F.col("xx") - shift) * (F.col("yy") - shift)))
    out = s.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", rho.alias("r"))
    half = 1.959963984540054 / F.sqrt(F.greatest(n - 3, F.lit(1e-9)))
    t = F.col("r") * F.sqrt(ratio(n - 2, 1.0 - F.col("r") * F.col("r")))
    return out.select(
        "*", D.t_two_sided_p(t, n - 2).alias("p"), F.tanh(F.atanh("r") - half).alias("ci95_low"), F.tanh(F.atanh("r") + half).alias("ci95_high"),
        labelled(F.abs("r"), [(0.1, "very small"), (0.3, "small"), (0.5, "medium")], "strong").alias("size"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b without comparing pairs of rows.

    Concordant pairs are counted bit by bit of the rank of ``y``: two values whose ranks
    first differ at a bit are ordered by that bit, so per (bit, shared prefix) a running sum
    along ``x`` counts them. Work is cells times the bits of the rank, all of it shuffled.
    """
    bounds = range_bounds(df, [x, y])
    cells = _pair_cells(df, x, y)
    ry = _axis_ranks(cells, "y", bounds[y]).select("y", (F.col("cum_one") - 1).alias("r"))
    ranked = cells.join(ry, "y").select("x", "r", "n")
    top = ranked.agg(F.max("r").alias("m")).first()["m"] or 0
    bits = F.array(*[F.lit(b) for b in range(max(1, int(top).bit_length()))])
    spread = ranked.select("x", "n", "r", F.explode(bits).alias("bit"))
    here = F.expr("shiftright(r, bit) & 1") == 1
    sides = spread.groupBy("bit", F.expr("shiftright(r, bit + 1)").alias("prefix"), "x").agg(
        F.sum(F.when(here, F.col("n")).otherwise(0)).alias("high"), F.sum(F.when(here, 0).otherwise(F.col("n"))).alias("low"))
    walked = running_totals(sides, "x", ["high", "low"], ["bit", "prefix"], F.expr(bucket_sql("x", bounds[x])))
    num = lambda c: F.col(c).cast("double")
    counted = walked.agg(
        F.sum(num("high") * (num("cum_low") - num("low"))).alias("concordant"),
        F.sum(num("low") * (num("cum_high") - num("high"))).alias("discordant"))
    pairs = lambda c: num(c) * (num(c) - 1) / 2.0
    tx = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("tx"), F.sum("n").alias("n"))
    ty = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("ty"))
    one = lambda t: t.withColumn("_k", F.lit(1))  # noqa: E731  single-row tables
    s = one(counted).join(one(tx), "_k").join(one(ty), "_k")
    tau = ratio(F.col("concordant") - F.col("discordant"), F.sqrt((pairs("n") - F.col("tx")) * (pairs("n") - F.col("ty"))))
    return s.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "concordant", "discordant", tau.alias("r"))


def _rank_correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All pairs at once for columns without gaps: each column is ranked a single time."""
    ranks = ranked_cells(df, names).select("column", "value", mid_rank().alias("_r")).persist()
    rows = df.select(*[(column(c).cast("double") + F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(names)])
    for i, c in enumerate(names):
        own = ranks.filter(F.col("column") == c).select(F.col("value").alias(f"_k{i}"), F.col("_r").alias(f"_r{i}"))
        rows = rows.join(own, F.col(f"_v{i}") == F.col(f"_k{i}")).drop(f"_v{i}", f"_k{i}")
    pairs = list(combinations(range(len(names)), 2))
    table = F.array(*[F.struct(F.lit(names[i]).alias("x"), F.lit(names[j]).alias("y"), F.count(F.lit(1)).alias("n"), F.corr(f"_r{i}", f"_r{j}").alias("r")) for i, j in pairs])
    return rows.agg(table.alias("_t")).select(F.explode("_t").alias("_t")).select("_t.*")


def correlation(df: DataFrame, names: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long correlation matrix ``(x, y, n, r)``, pairwise complete."""
    if method == "pearson":
        from cohort.operators.profile import correlation_matrix

        return correlation_matrix(df, names)
    if method == "spearman":
        present = [F.count(F.when(column(c).cast("double").isNull() | F.isnan(column(c).cast("double")), 1)) for c in names]
        if not any(df.agg(*present).first()):
            return _rank_correlations(df, names)
    fn = {"spearman": spearman, "kendall": kendall}[method]
    parts = [fn(df, a, b).select("x", "y", "n", "r") for a, b in combinations(names, 2)]
    return reduce(DataFrame.unionByName, parts)


def ks_two_sample(df: DataFrame, names: Sequence[str], sample: str, first, second) -> DataFrame:
    """Largest gap between the two samples' distribution functions per column."""
    parts = {"n1": column(sample) == F.lit(first), "n2": column(sample) == F.lit(second)}
    cells = ranked_cells(df.filter(column(sample).isin([first, second])), names, parts=parts)
    gap = F.abs(ratio(F.col("cum_n1"), F.col("tot_n1")) - ratio(F.col("cum_n2"), F.col("tot_n2")))
    s = cells.groupBy("column").agg(F.max("tot_n1").alias("n1"), F.max("tot_n2").alias("n2"), F.max(gap).alias("d"))
    lam = F.sqrt(ratio(F.col("n1").cast("double") * F.col("n2"), F.col("n1") + F.col("n2"))) * F.col("d")
    return s.select("*", D.kolmogorov_p(lam).alias("p")).withColumn("similar", F.col("p") > 0.05)


# ---------------------------------------------------------------- linear models on moments

def moment_matrix(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance over rows complete in ``names``; one pass."""
    present = reduce(lambda a, b: a & b, [column(c).isNotNull() & ~F.isnan(column(c).cast("double")) for c in names])
    v = [column(c).cast("double") for c in names]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)]]
    aggs += [F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i in range(len(v)) for j in range(i, len(v))]
    row = df.filter(present).agg(*aggs).first()
    k = len(v)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return int(row["n"]), np.array([row[f"m{i}"] or 0.0 for i in range(k)]), cov


def partial_correlation(df: DataFrame, x: str, y: str, covariates: Sequence[str]) -> DataFrame:
    n, _, cov = moment_matrix(df, [x, y, *covariates])
    precision = in_task(df.sparkSession, np.linalg.pinv, cov)
    r = float(-precision[0, 1] / np.sqrt(precision[0, 0] * precision[1, 1]))
    dof = n - len(covariates) - 2
    t = r * np.sqrt(dof / max(1.0 - r * r, 1e-300))
    half = 1.959963984540054 / np.sqrt(max(n - len(covariates) - 3, 1))
    row = (x, y, n, r, float(D.t_two_sided(t, dof)[0]), float(np.tanh(np.arctanh(r) - half)), float(np.tanh(np.arctanh(r) + half)))
    return df.sparkSession.createDataFrame([row], "x string, y string, n long, r double, p double, ci95_low double, ci95_high double")


def linear_regression(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """Ordinary least squares with SE, t and p per term; fit measures repeat on every row."""
    n, mean, cov = moment_matrix(df, [*predictors, target])
    k = len(predictors)
    sxx, sxy, syy = cov[:k, :k], cov[:k, k], cov[k, k]
    inverse = in_task(df.sparkSession, np.linalg.inv, sxx)
    beta = inverse @ sxy
    intercept = mean[k] - float(beta @ mean[:k])
    dof = n - k - 1
    rss = n * max(syy - float(beta @ sxy), 0.0)
    r2 = 1.0 - rss / (n * syy)
    s2 = rss / dof
    se = np.sqrt(s2 * np.diag(inverse) / n)
    se0 = np.sqrt(s2 * (1.0 / n + float(mean[:k] @ inverse @ mean[:k]) / n))
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / dof
    f = (r2 / k) / ((1.0 - r2) / dof)
    rows = []
    for name, b, e in [("intercept", intercept, se0), *zip(predictors, beta, se)]:
        t = float(b / e)
        rows.append((name, float(b), float(e), t, float(D.t_two_sided(t, dof)[0]), n, float(r2), float(adjusted), float(f), float(D.f_sf(f, k, dof)[0])))
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, se double, t double, p double, n long, r2 double, adj_r2 double, f double, f_p double")


def logistic_regression(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """Unpenalised logistic fit with SE, z, p and odds ratio per term, and model-level fit."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.select(column(target).cast("double").alias("_y"), *[column(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)]).dropna()
    table = VectorAssembler(inputCols=[f"x{i}" for i in range(len(predictors))], outputCol="_x").transform(rows).select("_y", "_x")
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y", maxIter=50, tol=1e-10).fit(table)
    summary = model.summary
    coefs = [*model.coefficients.toArray(), model.intercept]
    loglik, null = -summary.deviance / 2.0, -summary.nullDeviance / 2.0
    out = []
    for name, b, e, z, p in zip([*predictors, "intercept"], coefs, summary.coefficientStandardErrors, summary.tValues, summary.pValues):
        out.append((name, float(b), float(e), float(z), float(p), float(np.exp(b)), loglik, 1.0 - loglik / null, summary.numIterations < 50))
    return df.sparkSession.createDataFrame(
        out, "term string, coef double, se double, z double, p double, odds_ratio double, log_likelihood double, pseudo_r2 double, converged boolean")


def _varimax(loadings: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Varimax rotation with Kaiser normalisation."""
    scale = np.sqrt(np.maximum((loadings**2).sum(axis=1), 1e-12))[:, None]
    a = loadings / scale
    p, k = a.shape
    rotation, last = np.eye(k), 0.0
    for _ in range(rounds):
        b = a @ rotation
        u, s, vt = np.linalg.svd(a.T @ (b**3 - b * (b**2).sum(axis=0) / p))
        rotation = u @ vt
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    return (a @ rotation) * scale


def _extract_factors(cov: np.ndarray, n_factors: int, rotate: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the correlation matrix and least-squares loadings, largest factor first."""
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    values, _ = np.linalg.eigh(corr)
    communality = 1.0 - 1.0 / np.diag(np.linalg.pinv(corr))
    for _ in range(5000):  # alternate between communalities and the best low-rank fit
        reduced = corr.copy()
        np.fill_diagonal(reduced, communality)
        w, v = np.linalg.eigh(reduced)
        w, v = w[::-1][:n_factors], v[:, ::-1][:, :n_factors]
        loadings = v * np.sqrt(np.maximum(w, 0.0))
        fresh = np.clip((loadings**2).sum(axis=1), 0.0, 1.0)
        if np.max(np.abs(fresh - communality)) < 1e-9:
            break
        communality = fresh
    if rotate:
        loadings = _varimax(loadings)
    loadings = loadings * np.where(loadings.sum(axis=0) < 0, -1.0, 1.0)
    return values, loadings[:, np.argsort(-(loadings**2).sum(axis=0))]


def factor_analysis(df: DataFrame, names: Sequence[str], n_factors: int = 3, rotation: str | None = "varimax") -> dict[str, DataFrame]:
    """Least-squares factor extraction from the correlation matrix, then varimax."""
    if rotation not in (None, "varimax"):
        raise ValueError(f"unknown rotation {rotation!r}")
    _, _, cov = moment_matrix(df, names)
    values, loadings = in_task(df.sparkSession, _extract_factors, cov, n_factors, rotation == "varimax" and n_factors > 1)
    spark, k = df.sparkSession, len(names)
    cells = [(names[i], f"factor{j + 1}", float(loadings[i, j])) for i in range(k) for j in range(n_factors)]
    eigen = [(i + 1, float(e), float(e) / k) for i, e in enumerate(values[::-1])]
    shares = [(f"factor{j + 1}", float((loadings[:, j] ** 2).sum()), float((loadings[:, j] ** 2).sum()) / k) for j in range(n_factors)]
    return {
        "loadings": spark.createDataFrame(cells, "column string, factor string, loading double"),
        "eigenvalues": spark.createDataFrame(eigen, "position int, eigenvalue double, share double"),
        "variance": spark.createDataFrame(shares, "factor string, ss_loadings double, share double"),
    }
