"""Language identification with interpolated Kneser-Ney character models.

Counts of character 4-grams per language come from one pass over all learning texts; the
continuation counts of the lower orders, the context totals and the discounts are group-bys
over them. All are kept by whole gram in tables that grow with the corpus. Texts are scored
against one block of the tables after another: a block holds a range of the two letters before
the last, has sorted arrays of bounded size with one column per language, and adds the
log-probabilities of the grams in its range; sums over blocks make the score.

A text's score under a language is its cross-entropy per character; the lowest wins. Texts
whose best cross-entropy lies above what nearly all calibration texts of that language and
length reach are rejected. Calibration texts take no part in the counts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.text import kept, process_cache, read_table, slices, spare

ORDER = 4
#: Counts (grams x languages) of a block of the model.
CELLS = 1 << 22
UNKNOWN = "und"
#: Distance of a limit from the median, in upper quartile distances (the 99.9 % point of a normal curve), and the room above.
TAIL = 4.58
ROOM = 1.25
#: Rows that what a cell borrows counts as.
BORROWED = 20.0
BETAS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
_START = 1
_MERGE = 1 << 21
_tables = process_cache("letters")


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its folded symbol (space for what is no letter or mark), and whether it is a letter."""
    if "fold" not in _tables:
        fold, letter = np.full(0x110000, 32, np.uint64), np.zeros(0x110000, bool)
        for c in range(0x110000):
            char = chr(c)
            if char.isalpha():
                fold[c], letter[c] = ord(char.lower()[0]) & 0xFFFF, True
            elif unicodedata.category(char)[0] == "M":
                fold[c] = c & 0xFFFF
        _tables["fold"], _tables["letter"] = fold, letter
    return _tables["fold"], _tables["letter"]


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, gram, letters)``: every 4-gram packed into 64 bits with its row, and letters per row.

    Runs of other characters count as one space; three start marks stand before each text.
    """
    fold, letter = _letters()
    texts = [t or "" for t in texts]
    code = np.frombuffer("".join(["\0\0\0" + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    symbol = fold[code]
    counts = np.bincount(row, weights=letter[code], minlength=len(texts)).astype(np.int64) if len(row) else np.zeros(len(texts), np.int64)
    marks = (begin[:, None] + np.arange(ORDER - 1)).reshape(-1)
    symbol[marks] = _START
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 32) | (symbol[:-1] != 32)
    symbol, row = symbol[keep], row[keep]
    gram = symbol.copy()
    for k in range(1, ORDER):
        gram[k:] |= symbol[:-k] << np.uint64(16 * k)
    inner = symbol != _START
    return row[inner], gram[inner], counts


def _count(texts: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all rows; each task adds up its own counts first."""
    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(["lang", "gram"], as_index=False, sort=False)["n"].sum()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []
        for batch in slices(batches, "text"):
            row, gram, _ = grams_of(batch.column(1).to_pylist())
            langs = pd.Categorical(batch.column(0).to_pylist())
            for code, lang in enumerate(langs.categories):
                value, n = np.unique(gram[langs.codes[row] == code], return_counts=True)
                parts.append(pd.DataFrame({"lang": lang, "gram": value.view(np.int64), "n": n.astype(np.int64)}))
            if sum(map(len, parts)) > _MERGE:
                parts = [merged(parts)]
        if parts:
            yield from pa.Table.from_pandas(merged(parts), preserve_index=False).to_batches()

    return texts.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Per order: sorted grams with counts, and contexts with totals and kinds, by language; of the pairs from low to below high."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    discount: np.ndarray
    symbols: np.ndarray
    low: int = 0
    high: int = 1 << 32

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        """log2 of the interpolated probability of the last symbol of each gram, one column per language."""
        p = np.tile(1.0 / (self.symbols + 1.0), (len(gram), 1))
        for order in range(1, ORDER + 1):
            own = gram & np.uint64((1 << (16 * order)) - 1) if order < 4 else gram
            total, kinds = _lookup(self.contexts[order - 1], own >> np.uint64(16))
            (n,) = _lookup(self.grams[order - 1], own)
            d, some = self.discount[order - 1], total > 0
            known = np.where(some, total, 1.0)
            p = np.where(some, np.minimum(1.0, (np.maximum(n - d, 0) + d * kinds * p) / known), p)
        return np.log2(p)


def _lookup(table: tuple, wanted: np.ndarray) -> list[np.ndarray]:
    keys, *columns = table
    if not len(keys):
        return [np.zeros((len(wanted), c.shape[1])) for c in columns]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = (keys[at] == wanted)[:, None]
    return [np.where(hit, c[at], 0.0) for c in columns]


@dataclass
class Counts:
    """Tables ``(lang, ord, gram, pair, n)`` and ``(..., n, kinds)`` of grams and contexts; ``lang`` is a number."""

    langs: list[str]
    grams: DataFrame
    contexts: DataFrame
    discount: np.ndarray
    symbols: np.ndarray

    def blocks(self) -> list[tuple[int, int]]:
        """Ranges of pairs whose grams fit a block."""
        long = self.grams.filter("ord >= 3")
        rows = long.count()
        n = -(-rows * len(self.langs) // CELLS)
        if n < 2:
            return [(0, 1 << 32)]
        cuts = long.agg(F.percentile_approx("pair", [k / n for k in range(1, n)], max(10000, 20 * n)).alias("cuts")).first().cuts
        edges = [0, *sorted({c for c in cuts if c > 0}), 1 << 32]
        return list(zip(edges[:-1], edges[1:]))

    def model(self, low: int = 0, high: int = 1 << 32) -> Model:
        near = ((F.col("ord") == 1) | (F.col("ord") == 2) & F.shiftright("pair", 16).between(low >> 16, (high - 1) >> 16)
                | (F.col("ord") > 2) & (F.col("pair") >= low) & (F.col("pair") < high))
        return Model(self.langs, _arrays(self.grams.filter(near), len(self.langs), ["n"]), _arrays(self.contexts.filter(near), len(self.langs), ["n", "kinds"]),
                     self.discount, self.symbols, low, high)


def pairs(gram):
    """The two letters before the last, the nearer one first, as a number below 2^32; of arrays."""
    return ((gram >> np.uint64(16)) & np.uint64(0xFFFF)) << np.uint64(16) | ((gram >> np.uint64(32)) & np.uint64(0xFFFF))


def count(texts: DataFrame) -> Counts:
    """The counts of ``(lang, text)`` rows; the driver receives one row per language and order."""
    counts = kept(_count(texts), "grams")
    orders, above = [counts.withColumn("ord", F.lit(ORDER))], counts
    for order in range(ORDER - 1, 0, -1):
        above = above.groupBy("lang", F.col("gram").bitwiseAND((1 << (16 * order)) - 1).alias("gram")).agg(F.count("*").alias("n"))
        orders.append(above.withColumn("ord", F.lit(order)))
    grams = orders[0]
    for more in orders[1:]:
        grams = grams.unionByName(more)
    grams = kept(grams, "orders")
    rare = grams.groupBy("lang", "ord").agg(
        F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice"), F.count("*").alias("kinds")).toPandas()
    langs = sorted(rare["lang"].unique())
    column = {lang: k for k, lang in enumerate(langs)}
    discount, symbols = np.full((ORDER, len(langs)), 0.5), np.ones(len(langs))
    for r in rare.itertuples():
        if r.once and r.twice:
            discount[r.ord - 1, column[r.lang]] = r.once / (r.once + 2.0 * r.twice)
        if r.ord == 1:
            symbols[column[r.lang]] = r.kinds
    number = F.array_position(F.array(*[F.lit(lang) for lang in langs]).cast("array<string>"), F.col("lang")).cast("int") - 1
    letter = lambda k: F.shiftrightunsigned("gram", 16 * k).bitwiseAND(0xFFFF)
    pair = lambda k: F.shiftleft(letter(k), 16).bitwiseOR(letter(k + 1)).alias("pair")
    contexts = grams.groupBy("lang", "ord", F.shiftrightunsigned("gram", 16).alias("gram")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    return Counts(langs, grams.select(number.alias("lang"), "ord", "gram", pair(1), "n"), kept(contexts.select(number.alias("lang"), "ord", "gram", pair(0), "n", "kinds"), "contexts"), discount, symbols)


def fit(texts: DataFrame) -> Model:
    """The model of ``(lang, text)`` rows as one block."""
    return count(texts).model()


def _arrays(rows: DataFrame, langs: int, values: list[str]) -> list[tuple]:
    found = rows.select("lang", "ord", "gram", *values).toPandas()
    out = []
    for order in range(1, ORDER + 1):
        part = found[found["ord"] == order]
        gram = part["gram"].to_numpy(np.int64).view(np.uint64)
        keys = np.unique(gram)
        row, lang = np.searchsorted(keys, gram), part["lang"].to_numpy(np.int64)
        tables = []
        for v in values:
            table = np.zeros((len(keys), langs), np.float32)
            table[row, lang] = part[v].to_numpy()
            tables.append(table)
        out.append((keys, *tables))
    return out


def cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character of each text under each language, of the grams in the model's range, and letters of each text."""
    row, gram, letters = grams_of(texts)
    sizes = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    if model.low or model.high < 1 << 32:
        own = pairs(gram)
        own = (own >= np.uint64(model.low)) & (own < np.uint64(model.high))
        row, gram = row[own], gram[own]
    known, kinds = pd.factorize(gram)
    logs = model.log_probability(kinds.astype(np.uint64)) if len(kinds) else np.zeros((0, len(model.langs)))
    return np.column_stack([-np.bincount(row, weights=logs[known, k], minlength=len(texts)) / sizes for k in range(len(model.langs))]), letters


def _scored(rows: DataFrame, counts: Counts) -> DataFrame:
    """``(key, lang, part, letters, pred, best, bits, all_bits)`` of every row."""
    kind = rows.schema["key"].dataType.simpleString()
    blocks, found = counts.blocks(), None
    for number, (low, high) in enumerate(blocks):
        sent = rows.sparkSession.sparkContext.broadcast(vars(counts.model(low, high)))  # plain arrays: executors need not have this package

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Model(**sent.value)
            for batch in slices(batches, "text"):
                bits, letters = cross_entropies(known, batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(letters, pa.int64()), pa.array(list(bits), pa.list_(pa.float64()))], names=["key", "lang", "part", "print", "letters", "all_bits"])

        printed = rows.select("key", "lang", "part", F.xxhash64("text").alias("print"), "text")
        part = printed.mapInArrow(work, f"key {kind}, lang string, part long, print long, letters long, all_bits array<double>").withColumn("block", F.lit(number))
        if len(blocks) > 1:
            part = kept(part, "block")
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:  # rows that agree in everything have equal bits: once for each block, as often as they occur
        names = ["key", "lang", "part", "print", "letters"]
        once = found.groupBy(*names, "block").agg(F.first("all_bits").alias("all_bits"), F.count("*").alias("copies"))
        sums = [F.sum(F.col("all_bits")[k]) for k in range(len(counts.langs))]
        found = once.groupBy(*names).agg(F.array(*sums).alias("all_bits"), F.max("copies").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    best = F.array_position("all_bits", F.array_min("all_bits")).cast("int") - 1
    named = found.withColumn("best", best).withColumn("bits", F.array_min("all_bits"))
    pred = F.when(F.col("letters") > 0, F.element_at(F.array(*[F.lit(lang) for lang in counts.langs]), F.col("best") + 1))
    return named.select("key", "lang", "part", "letters", pred.alias("pred"), "best", "bits", "all_bits")


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", part=None) -> DataFrame:
    """``(key, held_out, lang_pred, score, bits, rejected)`` of every row.

    ``part`` is a number 0..3 per row (by default the CRC of the key modulo 4): 0 and 1 are
    counted, 3 calibrates, 2 is held out; rows without a language or a key are only predicted.
    ``score`` is a softmax over the languages' cross-entropies whose sharpness the calibration
    texts choose. Texts that are null or hold no letter are ``und`` with score 0 and rejected;
    so is everything if there is nothing to learn from. Ties go to the first language by name.
    Repeated rows repeat their result.
    """
    part = F.crc32(F.col(key).cast("string")) % 4 if part is None else part
    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), part.alias("part"), F.col(text).cast("string").alias("text"))
    model = count(rows.filter("part in (0, 1) and lang is not null and text is not null").select("lang", "text"))
    if not model.langs:
        return rows.select(F.col("key").alias(key), F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    scored = kept(_scored(rows, model), "scores")
    beta, limits = _calibrated(scored, model)
    usual = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map().cast("map<string,double>")
    longest = max((int(x.rsplit(":", 1)[1]) for x in limits), default=0)
    named = scored.withColumn("_size", F.concat_ws(":", "pred", F.least(F.floor(F.log2(F.greatest("letters", F.lit(1)))), F.lit(longest))))
    limit = F.try_element_at(usual, F.col("_size"))
    score = 1.0 / F.aggregate("all_bits", F.lit(0.0), lambda s, b: s + F.exp(F.lit(-beta) * (b - F.col("bits"))))
    return named.select(
        F.col("key").alias(key), F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out"), F.coalesce("pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("pred").isNull(), 0.0).otherwise(score).alias("score"), F.when(F.col("pred").isNotNull(), F.col("bits")).alias("bits"),
        F.coalesce(F.col("pred").isNull() | (F.col("bits") > limit), F.lit(False)).alias("rejected"))


def _calibrated(scored: DataFrame, model: Counts) -> tuple[float, dict[str, float]]:
    """The sharpness of the score, and the highest usual cross-entropy by language and length."""
    known = scored.filter("part = 3 and lang is not null and pred is not null")
    right = F.array_position(F.array(*[F.lit(lang) for lang in model.langs]), F.col("lang"))
    loss = [F.avg(_loss(right, beta)).alias(f"b{k}") for k, beta in enumerate(BETAS)]
    losses = known.agg(*loss).first()
    values = [x if x is not None else np.inf for x in losses]
    beta = BETAS[int(np.argmin(values))] if np.isfinite(values).any() else 1.0
    by_size = known.groupBy("pred", F.floor(F.log2(F.greatest("letters", F.lit(1)))).cast("int").alias("size"))
    table = by_size.agg(F.count("*").alias("n"), F.percentile_approx("bits", [0.5, 0.75], 10000).alias("q")).collect()  # languages x lengths
    return beta, _limits([(r.pred, r.size, r.n, r.q[0], r.q[1] - r.q[0]) for r in table], model.langs)


def _limits(cells: list[tuple], langs: list[str]) -> dict[str, float]:
    """The limit of every language and length from ``(language, length, rows, median, upper quartile distance)``.

    A curve over all languages goes from the longest texts down, each length shrunk towards the next
    longer one and never towards a shorter one. A language's own cells are shrunk towards the curve
    times its level, so sparse cells and languages without rows have limits by the same rule.
    """
    if not cells:
        return {}
    curve: dict[int, np.ndarray] = {}
    longest = max(c[1] for c in cells)
    for size in range(longest, -1, -1):
        own = np.array([(n, n * mid, n * wide) for _, at, n, mid, wide in cells if at == size]).reshape(-1, 3).sum(axis=0)
        above = BORROWED if size < longest else 0.0
        curve[size] = (own[1:] + above * curve.get(size + 1, np.zeros(2))) / (own[0] + above)
    limits = {}
    for lang in langs:
        mine = {at: (n, np.array([mid, wide])) for own, at, n, mid, wide in cells if own == lang}
        rows, total = BORROWED, BORROWED
        for size in curve:  # from the longest down
            n, q = mine.get(size, (0, np.zeros(2)))
            rows, total = rows + n, total + n * q[0] / max(curve[size][0], 1e-9)
            mid, wide = (n * q + BORROWED * total / rows * curve[size]) / (n + BORROWED)
            limits[f"{lang}:{size}"] = float(ROOM * (mid + TAIL * wide))
    return limits


def _loss(right, beta: float):
    """Log loss of the true language under sharpness ``beta``; null if it was not learned."""
    own = F.element_at("all_bits", F.greatest(right, F.lit(1)).cast("int")) - F.col("bits")
    return F.when(right > 0, F.lit(beta) * own + F.log(F.aggregate("all_bits", F.lit(0.0), lambda s, x: s + F.exp(F.lit(-beta) * (x - F.col("bits"))))))


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that are rejected; a row is judged by its own text."""
    mark, bad_key, bad_mark = spare(docs, "_print", "_bad", "_of")
    judged = docs.withColumn(mark, F.xxhash64(F.col(text)))
    rows = judged.select(F.struct(F.col(key).alias("id"), F.col(mark).alias("print")).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), (F.crc32(F.col(key).cast("string")) % 4).alias("_part"))
    bad = predict(rows, "_key", "_text", "_lang", F.col("_part")).filter("rejected").select(F.col("_key.id").alias(bad_key), F.col("_key.print").alias(bad_mark)).distinct()
    return judged.join(bad, F.col(key).eqNullSafe(F.col(bad_key)) & (F.col(mark) == F.col(bad_mark)), "left_anti").drop(mark)


def op6_langid_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return predict(read_table(spark, sf_dir, "documents"))
