"""Ranked lexical search: exact inner products by ball trees over sparse documents.

A document's vector holds, for every term that some item asks for, its weighted and saturated count;
an item's vector holds how often it asks. A score is their inner product in whole numbers. Each task
gathers documents into ball trees: a node knows the centroid of its documents, a radius around
it, and how far each single coordinate rises above it, so no document below can score more than
``q . centroid + |q| radius``, nor more than ``q . (centroid + rises)``. Trees are searched best
node first; nodes whose bound is below the tenth best score so far are left out with all below them,
and what is left is scored exactly. Bounds are rounded up, so nothing is lost to floating point.

Items reach the tasks in blocks of bounded size, one job each; a task hands on its ten best of each item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohort.llm.text import Words, byte_table, kept, read_table, slices, utf8

BEST = 10
#: UTF-8 bytes of distinct items in a block, in expectation.
BLOCK_BYTES = 1 << 17
#: Documents of a tree, and of a leaf.
TREE, LEAF = 2048, 16
#: Terms of the documents of a tree; one document may hold more.
ENTRIES = 1 << 22
#: Bytes of text looked at at once; longer ones are cut between terms.
PIECE = 1 << 22
SCALE = 1_000_000_000
_TABLE = byte_table(words="0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass
class Block:
    """Distinct items of a block over a sorted vocabulary: the terms of item k are ``terms[edges[k]:edges[k + 1]]``, asked ``times``."""

    texts: list[str]
    vocabulary: np.ndarray
    edges: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def _pieces(raw: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[Words]:
    """Terms of the rows, ``most`` bytes or one term at a time; rows outside a piece are empty in it."""
    a = 0
    while a < len(raw):
        b = min(a + most, len(raw))
        while b < len(raw):  # a cut lies at a separator
            gap = np.flatnonzero(_TABLE[raw[b: b + most]] == 0)
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + most, len(raw))
        yield Words(raw[a:b], np.clip(offsets, a, b) - a, _TABLE)
        a = b


def term_counts(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of every row, and ``(row, term, times)`` of those in the vocabulary, in this order."""
    total, found, times = np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = max(1, len(vocabulary))
    for words in _pieces(raw, offsets, most):
        total += words.per_row()
        at = np.searchsorted(vocabulary, words.key)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == words.key[known]
        pairs, n = np.unique(words.row[known].astype(np.int64) * size + at[known], return_counts=True)
        if len(found):
            pairs, inverse = np.unique(np.r_[found, pairs], return_inverse=True)
            n = np.bincount(inverse, np.r_[times, n]).astype(np.int64)
        found, times = pairs, n
    return total, found // size, found % size, times


def block_of(texts: list[str]) -> Block:
    raw, offsets = utf8(pa.array(texts, pa.string()))
    words = Words(raw, offsets, _TABLE)
    vocabulary = np.unique(words.key)
    _, row, term, times = term_counts(raw, offsets, vocabulary)
    return Block(texts, vocabulary, np.searchsorted(row, np.arange(len(texts) + 1)), term, times)


def _dots(place: np.ndarray, values: np.ndarray, edges: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Inner products of sparse rows (none of them empty) with a dense vector."""
    return np.add.reduceat(dense[place] * values, edges[:-1])


class BallTree:
    """A ball tree over sparse rows with whole, not negative values; no row is empty."""

    def __init__(self, place: np.ndarray, values: np.ndarray, edges: np.ndarray, size: int, leaf: int = LEAF):
        self.size, floats = size, values.astype(np.float64)
        square = np.add.reduceat(floats * floats, edges[:-1])
        counts = np.diff(edges)
        slack = (float(counts.max()) + size + 16) * 2.0**-50
        self.order = np.arange(len(counts))
        spans, centres, radii, tops, self.below = [], [], [], [], []
        todo = [(0, len(counts), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = self.order[a:b]
            n = counts[own]
            inner = np.r_[0, np.cumsum(n)]
            take = np.repeat(edges[own] - inner[:-1], n) + np.arange(inner[-1])
            p, v = place[take], floats[take]
            centre = np.bincount(p, v, size) / (b - a)
            middle = float(centre @ centre)
            apart = np.maximum(square[own] - 2 * _dots(p, v, inner, centre) + middle, 0)
            number = len(spans)
            spans.append((a, b))
            centres.append(centre)
            radii.append(math.sqrt(float((apart + slack * (square[own] + middle)).max())) * (1 + 1e-12))
            top = np.zeros(size, np.int64)
            np.maximum.at(top, p, values[take])
            tops.append(top)
            self.below.append([])
            if parent >= 0:
                self.below[parent].append(number)
            if b - a <= leaf:
                continue

            def distance(k: int) -> np.ndarray:
                dense = np.zeros(size)
                dense[p[inner[k]: inner[k + 1]]] = v[inner[k]: inner[k + 1]]
                return square[own] - 2 * _dots(p, v, inner, dense)

            one = distance(int(apart.argmax()))
            two = distance(int((one).argmax()))
            split = np.argsort(one - two, kind="stable")
            cut = int(np.count_nonzero(one < two))
            if not 0 < cut < b - a:
                cut = (b - a) // 2
            self.order[a:b] = own[split]
            todo += [(a, a + cut, number), (a + cut, b, number)]
        self.spans, self.centres, self.radii, self.tops = spans, np.array(centres), np.array(radii), np.array(tops)
        n = counts[self.order]
        self.edges = np.r_[0, np.cumsum(n)]
        take = np.repeat(edges[self.order] - self.edges[:-1], n) + np.arange(self.edges[-1])
        self.place, self.values = place[take], values[take]

    def search(self, terms: np.ndarray, times: np.ndarray, most: int, least: int, dense: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(rows, scores)`` of one leaf after another, best bound first; ``send`` a new least score that counts.

        ``dense`` are ``size`` zeros, and are so again after the search.
        """
        bounds = (self.centres[:, terms] @ times + math.sqrt(float(times @ times)) * self.radii) * (1 + 1e-9) + 1
        bounds = np.minimum(bounds, (self.tops[:, terms] @ times) * (1 + 1e-9) + 1)
        heap = [(-bounds[0], 0)]
        dense[terms] = times
        try:
            while heap and -heap[0][0] >= least:
                _, node = heapq.heappop(heap)
                if self.below[node]:
                    for child in self.below[node]:
                        if bounds[child] >= least:
                            heapq.heappush(heap, (-bounds[child], child))
                    continue
                a, b = self.spans[node]
                low, high = self.edges[a], self.edges[b]
                scores = _dots(self.place[low:high], self.values[low:high], self.edges[a: b + 1] - low, dense)
                good = np.flatnonzero(scores >= least)
                least = (yield self.order[a + good], scores[good]) or least
        finally:
            dense[terms] = 0


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def _search_block(docs: DataFrame, block: Block, most: int, tree: int, leaf: int) -> DataFrame:
    """``(item_text, key, score)``: the best ``most`` of every task; ``docs`` has ``key`` and ``text``."""
    spark = docs.sparkSession
    kind = docs.schema["key"].dataType.simpleString()
    words = spark.sparkContext.broadcast(block.vocabulary)  # bounded by the block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, row, term, times = term_counts(*utf8(batch.column(1)), words.value)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (term.astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), *lists], names=["key", "n", "terms", "times"])

    counted = kept(docs.mapInArrow(count, f"key {kind}, n long, terms array<int>, times array<long>"), "terms")
    n_docs, n_terms = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(block.vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # bounded by the block
        held[r["term"]] = r["count"]
    shared = spark.sparkContext.broadcast((block, weights(n_docs, held)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        n_items, dense = len(items.texts), np.zeros(len(items.vocabulary), np.int64)
        best: list[list] = [[] for _ in range(n_items)]  # (-score, no key, key), sorted

        def look(keys: list, n: np.ndarray, edges: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
            length = 25 + (75 * n * n_docs) // n_terms
            value = weight[terms] * ((SCALE * times) // (1000 * times + 8 * np.repeat(length, np.diff(edges))))
            ball = BallTree(terms, value, edges, len(weight), leaf)
            for k in range(n_items):
                a, b = items.edges[k], items.edges[k + 1]
                if a == b:
                    continue
                found = ball.search(items.terms[a:b], items.times[a:b], most, -best[k][-1][0] if len(best[k]) == most else 1, dense)
                step = next(found, None)
                while step is not None:
                    more = [(-int(s), keys[r] is None, keys[r]) for r, s in zip(*step)]
                    if more:
                        best[k] = sorted(best[k] + more, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:most]
                    try:
                        step = found.send(-best[k][-1][0] if len(best[k]) == most else 1)
                    except StopIteration:
                        step = None

        waiting: list[pa.RecordBatch] = []

        def flush() -> None:
            if waiting:
                table = pa.Table.from_batches(waiting).combine_chunks()
                terms, times = table.column("terms").combine_chunks(), table.column("times").combine_chunks()
                edges = np.r_[0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
                look(table.column("key").to_pylist(), table.column("n").to_numpy(), edges, terms.flatten().to_numpy(), times.flatten().to_numpy())
                waiting.clear()

        rows_held = entries = 0
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows, LEAF):
                part, more = batch.slice(a, LEAF), int(sizes[a: a + LEAF].sum())
                if rows_held + part.num_rows > tree or entries + more > ENTRIES:
                    flush()
                    rows_held = entries = 0
                waiting.append(part)
                rows_held, entries = rows_held + part.num_rows, entries + more
        flush()
        rows = [(items.texts[k], key, -score) for k in range(n_items) for score, _, key in best[k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], key_type), pa.array([r[2] for r in rows], pa.int64())], names=["item_text", "key", "score"])

    key_type = to_arrow_type(docs.schema["key"].dataType)
    return counted.filter(F.size("terms") > 0).mapInArrow(search, f"item_text string, key {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most: int = BEST,
           block_bytes: int = BLOCK_BYTES, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """``(item_key, rank, key, score)``: the ``most`` best documents of every item, best first.

    Null and wordless texts find nothing and are not found. Equal scores go by ascending key, a null
    key last; repeated documents hold a rank each. Items with equal texts are searched once, and
    each of them, repeated rows too, gets the whole list. Empty tables give no rows.
    """
    pair = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    named = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("item_text")).filter("item_text is not null")
    texts = kept(named.select("item_text").distinct(), "items")
    blocks = max(1, -(-(texts.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) // block_bytes))
    found = None
    for k in range(blocks):  # each reaches the driver by itself
        own = sorted(r.item_text for r in texts.filter(F.pmod(F.xxhash64("item_text"), F.lit(blocks)) == k).collect())
        part = _search_block(pair, block_of(own), most, tree, leaf)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_text").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)  # ``most`` rows of every task reach an item
    return named.join(best, "item_text").select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def op13_lexical_ball_tree(spark, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: All documents scored for all items.
OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
i AS MATERIALIZED (SELECT row_number() OVER () AS j, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT j, item_id, t, count(*) AS times FROM (SELECT j, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
v AS (SELECT DISTINCT t FROM q),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS MATERIALIZED (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) SEMI JOIN v USING (t) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY t, s.n),
x AS MATERIALIZED (SELECT r, doc_id, t, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * f.n * s.n) // s.l))) AS value FROM f JOIN w USING (t), s),
b AS (SELECT j, item_id, r, doc_id, sum(times * value)::BIGINT AS score FROM q JOIN x USING (t) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM b WHERE score > 0) WHERE rank <= 10
"""
