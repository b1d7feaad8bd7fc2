"""Bounded training samples of labelled documents, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Labelled documents that a classifier is fitted on, at most (in expectation).
LABELLED = 20_000


def labelled(labels: DataFrame, key: str, columns: list[str], most: int = LABELLED) -> DataFrame:
    """``(key, columns...)`` of at most about ``most`` labelled keys, drawn by the hash of the key.

    Labels are 0 or 1; a key with several rows takes the largest of each label, rows without a key
    or with a missing label are left out.
    """
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*[F.max(F.col(c).cast("double")).alias(c) for c in columns]).dropna()
    count = known.count()
    return known if count <= most else known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * most / count))


def rare_first(labels: DataFrame, key: str, columns: list[str], most: int = LABELLED) -> DataFrame:
    """``(key, columns..., weight)`` like ``labelled``, but the rarer class of every label keeps up to its share of half the rows.

    ``weight`` is the inverse of the chance to be drawn, so weighted counts are those of all labelled keys.
    """
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*[F.max(F.col(c).cast("double")).alias(c) for c in columns]).dropna()
    counts = known.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).first()
    chance = F.lit(1.0)
    if counts["n"] > most:
        half = most / 2
        chance = F.lit(half / counts["n"])
        for c in columns:
            yes = counts[c]
            rarer, n = (1.0, yes) if 2 * yes <= counts["n"] else (0.0, counts["n"] - yes)
            chance = F.when(F.col(c) == rarer, F.greatest(chance, F.lit(min(1.0, half / len(columns) / max(n, 1))))).otherwise(chance)
    drawn = known.withColumn("chance", chance).filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("chance") * 1_000_000)
    return drawn.select("key", *columns, (1 / F.col("chance")).alias("weight"))


def best_cut(scored: DataFrame, score: str, label: str, weight: str | None = None) -> float:
    """The score that separates best by F1, from counts over a thousand bins; 0.5 if a class is missing."""
    each = F.col(weight) if weight else F.lit(1)
    table = scored.groupBy(F.least(F.floor(F.col(score) * 1000), F.lit(999)).alias("bin")).agg(F.sum(F.col(label) * each).alias("yes"), F.sum(each).alias("n")).collect()  # at most 1,000 rows
    rows = sorted([(r.bin, r.yes, r.n) for r in table if r.bin is not None], reverse=True)
    total, hit, taken, best, cut = sum(r[1] for r in rows), 0.0, 0, -1.0, 0.5
    if not 0 < total < sum(r[2] for r in rows):
        return cut
    for k, (place, yes, n) in enumerate(rows):
        hit, taken = hit + yes, taken + n
        f1 = 2 * hit / (taken + total)
        if f1 > best:
            below = rows[k + 1][0] + 1 if k + 1 < len(rows) else 0
            best, cut = f1, (place + below) / 2000  # midway to the next score that occurs
    return cut
