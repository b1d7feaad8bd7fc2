"""Toxicity categories by a classifier chain.

Categories are predicted one after another: each linear model sees the words of the document
and the probabilities of the categories before it. The later models are fitted on out-of-fold
probabilities of the earlier ones, so they meet in training what they will meet in use.

The vocabulary and the models come from a bounded sample of labelled documents, in which the rarer
class of every category is kept first and rows are weighted back; the models of a category, one per fold left
out and one of all rows, are fitted side by side in one job. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohort.llm.labelled import LABELLED, best_cut, rare_first
from cohort.llm.text import Words, byte_table, kept, read_table, slices, utf8

FOLDS = 3
#: Words of the models at most, those that tell most about a category; and sample rows that must hold one.
VOCABULARY, LEAST = 1 << 14, 3
PENALTY, MIXING = 1e-2, 0.5
ROUNDS, TOLERANCE = 400, 1e-6
_TABLE = byte_table(words="0123456789abcdefghijklmnopqrstuvwxyz")


@dataclass
class Chain:
    """Sorted word keys and, per category, an intercept with the weights of the words and of the categories before."""

    categories: list[str]
    words: np.ndarray
    models: list[np.ndarray]
    cuts: list[float]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the distinct words of every text in lower case; general and CJK punctuation parts words too."""
    raw, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    raw = raw.copy()
    if len(raw) > 2:
        for lead, second, low, high, size in ((0xE2, 0x80, 0x80, 0xBF, 3), (0xE3, 0x80, 0x80, 0xBF, 3), (0xC2, None, 0x80, 0xBF, 2)):
            at = np.flatnonzero(raw[: len(raw) - size + 1] == lead)
            last = raw[at + size - 1]
            at = at[(last >= low) & (last <= high) & ((raw[at + 1] == second) if second else True)]
            if lead == 0xC2:
                at = at[~np.isin(raw[at + 1], (0xAA, 0xB5, 0xBA))]  # the letters of this block
            for k in range(size):
                raw[at + k] = 32
    words = Words(raw, offsets, _TABLE)
    order = np.lexsort((words.key, words.row))
    row, key = words.row[order], words.key[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], key[new]


def _known(key: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted vocabulary, and where."""
    at = np.searchsorted(vocabulary, key)
    known = at < len(vocabulary)
    known[known] = vocabulary[at[known]] == key[known]
    return known, at[known]


def elastic_logistic(row: np.ndarray, word: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Intercept, word weights and dense weights of a weighted logistic model with an elastic net on standardised columns.

    Accelerated proximal gradients; words are binary, and a column that never varies gets no weight.
    """
    share = weight / weight.sum()
    mean = np.bincount(word, share[row], size)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 0))
    middle = share @ dense
    scale = np.r_[spread, np.sqrt(share @ (dense - middle) ** 2)]
    scale = np.where(scale > 1e-6, 1 / np.maximum(scale, 1e-6), 0)

    def forward(beta: np.ndarray) -> np.ndarray:
        own = beta[1:] * scale
        return beta[0] + np.bincount(row, own[word], len(y)) + dense @ own[size:] - (mean @ own[:size] + middle @ own[size:])

    def back(rest: np.ndarray) -> np.ndarray:
        total = rest.sum()
        return np.r_[total, scale * np.r_[np.bincount(word, rest[row], size) - mean * total, rest @ dense - middle * total]]

    probe = np.random.default_rng(1).normal(size=1 + size + dense.shape[1])
    top = 1.0
    for _ in range(30):
        probe = back(share * forward(probe / np.linalg.norm(probe)))
        top = float(np.linalg.norm(probe)) or 1.0
    step = 1 / (0.3 * top)  # the curvature is at most a quarter of it
    lasso, ridge = PENALTY * MIXING, PENALTY * (1 - MIXING)
    beta = look = np.zeros(len(probe))
    speed = 1.0
    for _ in range(ROUNDS):
        slope = back(share * (1 / (1 + np.exp(-np.clip(forward(look), -35, 35))) - y))
        new = look - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lasso, 0) / (1 + step * ridge)
        if (look - new) @ (new - beta) > 0:
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        look, moved, beta, speed = new + (speed - 1) / faster * (new - beta), np.abs(new - beta).max(), new, faster
        if moved < TOLERANCE:
            break
    own = beta[1:] * scale
    return np.r_[beta[0] - mean @ own[:size] - middle @ own[size:], own]


def _chances(row: np.ndarray, word: np.ndarray, rows: int, model: np.ndarray, size: int, earlier: list[np.ndarray]) -> np.ndarray:
    margin = model[0] + np.bincount(row, model[1 + word], rows)
    for weight, chance in zip(model[1 + size:], earlier):
        margin = margin + weight * chance
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _vocabulary(rows: DataFrame, categories: list[str], most: int) -> np.ndarray:
    """The ``most`` words that tell most about any category, by chi-squared; sorted."""
    n = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()  # of the sample
    held = rows.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).filter(F.col("n") >= LEAST)

    def told(c: str):
        total, yes = float(n["n"]), float(n[c])
        expected = F.col("n") * (yes / total)
        return (F.col(c) - expected) ** 2 / F.greatest(expected * (1 - yes / total), F.lit(1e-9))

    best = held.select("word", F.array_max(F.array(*[told(c) for c in categories])).alias("told")).orderBy(F.desc("told"), "word").limit(most)
    return np.sort(np.array([r.word for r in best.collect()], np.int64).view(np.uint64))  # bounded by ``most``


def _fitter(vocabulary, earlier: list[str]):
    """Fits one model of a category on the rows of the bounded sample that it may see."""
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        flat = np.concatenate([np.zeros(0, np.int64), *frame["words"]]).astype(np.int64).view(np.uint64)
        row = np.repeat(np.arange(len(frame)), frame["words"].map(len))
        known, word = _known(flat, vocabulary.value)
        dense = frame[earlier].to_numpy(float).reshape(len(frame), -1)
        found = elastic_logistic(row[known], word, len(vocabulary.value), dense, frame["y"].to_numpy(), frame["weight"].to_numpy())
        return pd.DataFrame({"model": [int(frame["model"].iloc[0])], "weights": [found.tobytes()]})

    return one


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", label_key: str = "doc_id", most: int = LABELLED, folds: int = FOLDS) -> Chain | None:
    """The chain in the order of ``categories``; None if no labelled document is there."""
    spark = docs.sparkSession
    sample = rare_first(labels, label_key, categories, most)
    joined = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "key")  # bounded by ``most``
    joined = joined.select((F.crc32(F.col("key").cast("string")) % folds).cast("int").alias("fold"), "weight", *categories, "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, word = words_of(batch.column(batch.num_columns - 1))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(edges), pa.array(word.view(np.int64)))], names=["fold", "weight", *categories, "words"])

    rows = kept(joined.mapInArrow(tokens, f"fold int, weight double, {', '.join(f'`{c}` double' for c in categories)}, words array<long>"), "sample")
    if not rows.count():
        return None
    vocabulary = _vocabulary(rows, categories, VOCABULARY)
    size = len(vocabulary)
    shared = spark.sparkContext.broadcast(vocabulary)
    chances = [f"p_{k}" for k in range(len(categories))]
    models, cuts = [], []
    for number, category in enumerate(categories):
        earlier = chances[:number]
        dealt = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds)))).filter("model <> fold").select("model", F.col(category).alias("y"), "weight", "words", *earlier)

        fitted = {r.model: np.frombuffer(r.weights) for r in dealt.groupBy("model").applyInPandas(_fitter(shared, earlier), "model int, weights binary").collect()}  # folds + 1 rows
        whole = fitted[folds]
        apart = spark.sparkContext.broadcast([fitted.get(k, whole) for k in range(folds)])
        models.append(whole)
        names = rows.columns

        def out_of_fold(batches: Iterator[pa.RecordBatch], apart=apart, earlier=earlier) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold = batch.column(0).to_numpy()
                own = batch.column(batch.schema.get_field_index("words"))
                row = np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy(zero_copy_only=False))
                known, word = _known(own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), shared.value)
                before = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in earlier]
                chance = np.zeros(batch.num_rows)
                for k, model in enumerate(apart.value):
                    chance[fold == k] = _chances(row[known], word, batch.num_rows, model, len(shared.value), before)[fold == k]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=[*batch.schema.names, f"p_{len(earlier)}"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows = kept(rows.select(*names).mapInArrow(out_of_fold, f"{kinds}, p_{number} double"), "folds")
        cuts.append(best_cut(rows, f"p_{number}", category, "weight"))
    return Chain(categories, vocabulary, models, cuts)


def score(docs: DataFrame, chain: Chain | None, categories: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, p_<category>..., is_<category>...)`` of every row; without a chain all are null and false.

    A null, empty or wordless text has no words and gets what the models say of none. Repeated rows
    repeat their result, null keys stay, and other columns are not read.
    """
    if chain is None:
        return docs.select(key, *[F.lit(None).cast("double").alias(f"p_{c}") for c in categories], *[F.lit(False).alias(f"is_{c}") for c in categories])
    shared = docs.sparkSession.sparkContext.broadcast((chain.words, chain.models))
    pair = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, models = shared.value
        for batch in slices(batches, "text"):
            row, key = words_of(batch.column(1))
            known, word = _known(key, vocabulary)
            chances: list[np.ndarray] = []
            for model in models:
                chances.append(_chances(row[known], word, batch.num_rows, model, len(vocabulary), chances))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, chances)], names=["key", *[f"p{k}" for k in range(len(models))]])

    kinds = ", ".join([f"key {pair.schema['key'].dataType.simpleString()}", *[f"p{k} double" for k in range(len(categories))]])
    rows = pair.mapInArrow(work, kinds)
    return rows.select(F.col("key").alias(key), *[F.col(f"p{k}").alias(f"p_{c}") for k, c in enumerate(categories)], *[(F.col(f"p{k}") >= cut).alias(f"is_{c}") for k, (c, cut) in enumerate(zip(categories, chain.cuts))])


def op2_toxicity_classifier_chain(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    found = score(docs, fit(docs, marks, ["low_quality", "toxic"]), ["low_quality", "toxic"])
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
