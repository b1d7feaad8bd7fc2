"""Document quality by hierarchical empirical Bayes.

A linear model of surface statistics gives each document a probability of its own. Hosts and
the paths below them have posterior means: a path shrinks towards its host and a host towards
the whole, by strengths that the variance between and within groups sets. What the path says
beyond the global mean, the document itself left out, is added to the document's log-odds.

All group work is grouped sums and joins on their keys; the classifier is fitted on a bounded
sample of labelled documents and applied to every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cohort.llm.labelled import LABELLED, best_cut, labelled
from cohort.llm.text import Words, byte_table, kept, read_table, slices, utf8

STATISTICS = ("log_words", "word_bytes", "short_words", "distinct_words", "lower", "upper", "digits", "stops", "symbols", "line_ends", "beyond_ascii", "word_ends")
_TABLE = byte_table(separators=" \t\n\x0b\x0c\r")
_EDGE = 1e-4


def _classes() -> np.ndarray:
    """Kind of every byte: lower, upper, digit, stop, symbol, line end, other white space, start and rest of other characters."""
    kind = np.full(256, 4, np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[ord(c) for c in ".,;:!?'\"-()"]] = 3
    kind[10] = 5
    kind[[ord(c) for c in " \t\x0b\x0c\r"]] = 6
    kind[128:], kind[128:192] = 7, 8
    return kind


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Surface statistics per row; all zero for a text without words."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    seen = np.bincount(owner * 9 + _classes()[raw], minlength=rows * 9).reshape(-1, 9).astype(float)
    chars = np.maximum(seen[:, :8].sum(axis=1), 1)
    words = Words(raw, offsets, _TABLE)
    counts = words.per_row()
    n = np.maximum(counts, 1)
    size = words.end - words.start
    order = np.lexsort((words.key, words.row))
    row, key = words.row[order], words.key[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.zeros(0, bool)
    stop = np.isin(raw[words.end - 1], [ord(c) for c in ".,;:!?"]) if len(size) else np.zeros(0, bool)
    per = lambda mask, of: np.bincount(of, weights=mask, minlength=rows)
    out = np.column_stack([
        np.log1p(counts), per(size, words.row) / n, per(size <= 3, words.row) / n, per(first, row) / n,
        *(seen[:, k] / chars for k in (0, 1, 2, 3, 4, 5, 7)), per(stop, words.row) / n])
    out[counts == 0] = 0
    return out


def described(docs: DataFrame, key: str, text: str, host: Column, path: Column) -> DataFrame:
    """``(key, host, path, stats)`` of every row."""
    rows = docs.select(F.col(key).alias("key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = statistics(*utf8(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(found), pa.list_(pa.float64()))], names=["key", "host", "path", "stats"])

    return rows.mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, host string, path string, stats array<double>")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Ratio of the variance within groups to that between them, from one row of sums (one-way analysis of variance).

    ``groups`` holds ``n``, ``s`` and ``q`` (count, sum, sum of squares) per group and ``mean`` the parent's mean.
    """
    r = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
                   F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r.g or r.g < 2 or r.n <= r.g:
        return 1.0
    inside = max(r.within / (r.n - r.g), 1e-9)
    between = (r.between - (r.g - 1) * inside) / max(r.n - r.nn / r.n, 1e-9)
    return inside / max(between, inside * 1e-4)


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """Per ``(host, path)``: count, sum and the posteriors of path and host; and the global mean.

    ``evidence`` holds ``(host, path, p)``. A null host or path is a group of its own.
    """
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = kept(evidence.groupBy("host", "path").agg(*sums), "paths")
    hosts = kept(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total.s / total.n if total.n else 0.5
    weight = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.lit(weight * mean) + F.col("s")) / (F.lit(weight) + F.col("n"))).alias("host_mean"))
    both = kept(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "paths")
    inner = _strength(both, F.col("host_mean"))
    return both.select("host", "path", "n", "s", "host_mean", F.lit(inner).alias("weight")), mean


def _odds(p: Column) -> Column:
    safe = F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), p))
    return F.log(safe / (1 - safe))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", key: str = "doc_id", text: str = "text", label_key: str = "doc_id", most: int = LABELLED) -> DataFrame:
    """``(key, p_document, host_posterior, path_posterior, p_quality, keep)`` of every row.

    Null, empty and wordless texts have zero statistics; without labelled documents of both kinds
    every document's own probability is one half. Repeated rows repeat their result and count as rows
    of their groups; null keys stay.
    """
    rows = kept(described(docs, key, text, host, path), "described").withColumn("features", array_to_vector("stats"))
    sample = labelled(labels, label_key, [label], most).withColumnRenamed(label, "_label")
    train = kept(rows.select("key", "features").join(F.broadcast(sample), "key"), "sample")  # bounded by ``most``
    if train.select("_label").distinct().count() < 2:
        scored, cut = rows.withColumn("p", F.lit(0.5)), 0.5
    else:
        model = LogisticRegression(featuresCol="features", labelCol="_label", maxIter=60, regParam=1e-4).fit(train)
        scored = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
        cut = best_cut(model.transform(train).withColumn("p", vector_to_array("probability")[1]).withColumn("bad", 1 - F.col("_label")).withColumn("risk", 1 - F.col("p")), "risk", "bad")
    scored = kept(scored.select("key", "host", "path", "p"), "evidence")
    groups, mean = posteriors(scored)
    groups = groups.withColumnsRenamed({"host": "_host", "path": "_path"})
    joined = scored.join(groups, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    alone = (F.col("weight") * F.col("host_mean") + F.col("s") - F.col("p")) / (F.col("weight") + F.col("n") - 1)
    mixed = joined.select(F.col("key").alias(key), F.col("p").alias("p_document"), F.col("host_mean").alias("host_posterior"), alone.alias("path_posterior"))
    odds = _odds(F.col("p_document")) + _odds(F.col("path_posterior")) - _odds(F.lit(mean))
    return mixed.withColumn("p_quality", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("p_quality") >= 1 - cut)


def op3_quality_empirical_bayes(spark, sf_dir: str) -> DataFrame:
    """The source of a document is its host; the language sections of a source are the paths."""
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
