"""Benchmark decontamination with suffix arrays over the training texts.

Every task cuts its documents into shards and sorts, per shard, the word suffixes that could
start a match (those whose first words open some benchmark window; no other suffix can match
a window). Each benchmark suffix is then binary-searched in the array; the range it finds
holds all its locations, and runs of neighbouring suffixes give the longest verbatim matches.

The benchmark travels to the tasks in blocks of bounded size, one job per block; documents
are never shuffled for a single block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.text import Words, byte_table, chain, read_table, slices, spare, utf8

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
_TABLE = byte_table(words="0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEAD = 3
_BITS = 1 << 20


@dataclass
class Tests:
    """Distinct windows of a block of items, as rows of word keys, and where they stand."""

    keys: np.ndarray  # windows x width, zero beyond a window's own width
    width: np.ndarray
    owner: np.ndarray  # for each (window, place), ordered by window: the item
    place: np.ndarray
    first: np.ndarray  # offsets into owner and place
    ids: list
    heads: list  # per head length 1.._HEAD: sorted keys that open a window
    maybe: list  # the same as bitmaps


def _grams(key: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Keys of the runs of ``size`` words from each word on; zero where the row ends before."""
    out = key
    for k in range(1, size):
        shifted = np.zeros_like(key)
        shifted[:-k or None] = key[k:]
        out = chain(out, shifted)
    inside = np.zeros(len(key), bool)
    if len(key) >= size:
        inside[: len(key) - size + 1] = row[: len(key) - size + 1] == row[size - 1:]
    return np.where(inside, out, np.uint64(0))


def prepare(ids: list, texts: list, window: int = WINDOW) -> Tests:
    words = Words(*utf8(pa.array(texts, pa.string())), _TABLE)
    sizes = words.per_row()
    ends = np.cumsum(sizes)
    rest = ends[words.row] - np.arange(len(words.key))
    width = np.minimum(sizes[words.row], window)
    at = np.flatnonzero(rest >= width)
    width = width[at]
    spread = at[:, None] + np.arange(window)
    keys = np.where(np.arange(window) < width[:, None], words.key[np.minimum(spread, max(len(words.key) - 1, 0))] if len(at) else np.uint64(0), np.uint64(0))
    distinct, name = np.unique(np.column_stack([keys, width.astype(np.uint64)]), axis=0, return_inverse=True) if len(at) else (np.zeros((0, window + 1), np.uint64), np.zeros(0, int))
    name = name.reshape(-1)
    order = np.argsort(name, kind="stable")
    starts = ends - sizes
    heads, maybe = [], []
    for size in range(1, _HEAD + 1):
        of = distinct[:, window] == size if size < _HEAD else distinct[:, window] >= size
        part = distinct[of][:, :size].T
        head = part[0] if len(part) else np.zeros(0, np.uint64)
        for k in range(1, size):
            head = chain(head, part[k])
        heads.append(np.unique(head))
        bits = np.zeros(_BITS, bool)
        bits[(heads[-1] % np.uint64(_BITS)).astype(np.int64)] = True
        maybe.append(bits)
    return Tests(
        distinct[:, :window], distinct[:, window].astype(np.int64), words.row[at][order], (at - starts[words.row[at]])[order],
        np.searchsorted(name[order], np.arange(len(distinct) + 1)), ids, heads, maybe)


def _less(rows: np.ndarray, keys: np.ndarray, width: np.ndarray, equal: bool) -> np.ndarray:
    """Whether each row is below its key in the first ``width`` words (or equal, if asked)."""
    differ = (rows != keys) & (np.arange(keys.shape[1]) < width[:, None])
    column = differ.argmax(axis=1)
    pick = np.arange(len(keys))
    return np.where(differ[pick, column], rows[pick, column] < keys[pick, column], equal)


def _search(array: np.ndarray, tests: Tests, equal: bool) -> np.ndarray:
    low, high = np.zeros(len(tests.width), np.int64), np.full(len(tests.width), len(array), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        below = _less(array[np.minimum(middle, len(array) - 1)], tests.keys, tests.width, equal) & (low < high)
        low = np.where(below, middle + 1, low)
        high = np.where(below, high, np.minimum(high, middle))
    return low


def search_shard(raw: np.ndarray, offsets: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Words per row; hit words as (row, start, end) runs; longest match of each (row, item)."""
    words = Words(raw, offsets, _TABLE)
    sizes = words.per_row()
    none = np.zeros((0, 3), np.int64), pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "item", "n_words", "doc_word", "item_word")})
    if not len(tests.width) or not len(words.key):
        return sizes, *none
    keep = np.zeros(len(words.key), bool)
    for size, (heads, maybe) in enumerate(zip(tests.heads, tests.maybe), 1):
        if len(heads):
            gram = _grams(words.key, words.row, size)
            near = np.flatnonzero(maybe[(gram % np.uint64(_BITS)).astype(np.int64)])
            keep[near[heads[np.minimum(np.searchsorted(heads, gram[near]), len(heads) - 1)] == gram[near]]] = True
    at = np.flatnonzero(keep)
    if not len(at):
        return sizes, *none
    ends = np.cumsum(sizes)
    window = tests.keys.shape[1]
    spread = at[:, None] + np.arange(window)
    array = np.where(spread < ends[words.row[at]][:, None], words.key[np.minimum(spread, len(words.key) - 1)], np.uint64(0))
    order = np.lexsort(array.T[::-1])
    array, at = array[order], at[order]
    low, high = _search(array, tests, False), _search(array, tests, True)
    count = high - low
    found = np.repeat(np.arange(len(count)), count)
    if not len(found):
        return sizes, *none
    place = at[np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    width = tests.width[found]
    whole = place + width <= ends[words.row[place]]
    found, place, width = found[whole], place[whole], width[whole]
    cover = np.zeros(len(words.key) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + width, -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    first = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(words.row[hit]) > 0)]) if len(hit) else hit
    starts = ends - sizes
    last = np.r_[first[1:], len(hit)] - 1 if len(hit) else hit
    row = words.row[hit[first]]
    runs = np.column_stack([row, hit[first] - starts[row], hit[last] + 1 - starts[row]])
    many = tests.first[found + 1] - tests.first[found]
    which = np.repeat(tests.first[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, spot, place, width = tests.owner[which], tests.place[which], np.repeat(place, many), np.repeat(width, many)
    order = np.lexsort((place, place - spot, item))
    item, spot, place, width = item[order], spot[order], place[order], width[order]
    new = np.r_[True, (np.diff(item) != 0) | (np.diff(place - spot) != 0) | (np.diff(place) != 1) | (np.diff(words.row[place]) != 0)]
    run = np.flatnonzero(new)
    length = np.diff(np.r_[run, len(place)]) - 1 + width[run]
    best = pd.DataFrame({"row": words.row[place[run]], "item": item[run], "n_words": length, "doc_word": place[run] - starts[words.row[place[run]]], "item_word": spot[run]})
    best = best.sort_values(["row", "item", "n_words", "doc_word", "item_word"], ascending=[True, True, False, True, True]).drop_duplicates(["row", "item"])
    return sizes, runs, best


_HITS = "array<struct<start:long,end:long>>"
_ITEMS = "array<struct<item_id:string,n_words:long,doc_word:long,item_word:long>>"


def _scan(docs: DataFrame, block: Tests) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(vars(block))  # plain arrays: executors need not have this package

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        item_type = pa.list_(pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())]))
        tests = Tests(**sent.value)
        for batch in slices(batches, "text", SHARD_BYTES):
            sizes, runs, best = search_shard(*utf8(batch.column(2)), tests)
            hits, items = [[] for _ in sizes], [[] for _ in sizes]
            for row, start, end in runs.tolist():
                hits[row].append({"start": start, "end": end})
            for row, item, n, a, b in best.itertuples(index=False):
                items[row].append({"item_id": tests.ids[item], "n_words": int(n), "doc_word": int(a), "item_word": int(b)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hits, hit_type), pa.array(items, item_type)],
                names=["key", "print", "n_words", "hits", "items"])

    return docs.mapInArrow(work, f"key {docs.schema['key'].dataType.simpleString()}, print long, n_words long, hits {_HITS}, items {_ITEMS}")


def find_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: ``(key, n_words, hits, items)``.

    ``hits`` are runs of word positions covered by any occurrence of a window, ``items`` the
    longest match per item with its word positions on both sides. Null or wordless texts have
    neither; items without words are passed over, and items without an id mark words but are
    not listed. Repeated document rows give repeated results. Items of the same id count once.
    """
    pair = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.col(text).cast("string").alias("text"))
    tests = items.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).filter("text is not null").distinct()
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks))
    found = []
    for k in range(n_blocks):  # one bounded block at a time
        block = tests.filter(part == k).orderBy("id", "text").toPandas()
        ids = [None if pd.isna(i) else i for i in block["id"]]
        found.append(_scan(pair, prepare(ids, block["text"].tolist(), window)))
    if n_blocks == 1:
        out = found[0]
    else:
        parts = found[0]
        for more in found[1:]:
            parts = parts.unionByName(more)
        merged = parts.filter(F.size("hits") > 0).groupBy("key", "print").agg(
            F.flatten(F.collect_set("hits")).alias("_hits"), F.flatten(F.collect_set("items")).alias("_items"))
        words = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["start"], h["end"] - 1)))))
        merged = merged.select("key", "print", F.transform(words, lambda w: F.struct(w.alias("start"), (w + 1).alias("end"))).alias("_hits"), "_items")
        base, more = found[0].select("key", "print", "n_words").alias("a"), merged.alias("b")
        out = base.join(more, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.print") == F.col("b.print")), "left").select(
            F.col("a.key").alias("key"), "n_words", F.coalesce("_hits", F.array().cast(_HITS)).alias("hits"), F.coalesce("_items", F.array().cast(_ITEMS)).alias("items"))
    return out.select(F.col("key").alias(key), "n_words", "hits", "items")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold any window of an item; all columns as they were.

    A document is judged by its own text: rows of one key with different texts are judged apart.
    """
    mark, bad_key, bad_mark = spare(docs, "_print", "_bad", "_of")
    judged = docs.withColumn(mark, F.xxhash64(F.col(text)))
    pair = judged.select(F.struct(F.col(key).alias("id"), F.col(mark).alias("print")).alias("_key"), F.col(text).alias("_text"))
    bad = find_matches(pair, items, "_key", "_text").filter(F.size("hits") > 0).select(F.col("_key.id").alias(bad_key), F.col("_key.print").alias(bad_mark)).distinct()
    return judged.join(bad, F.col(key).eqNullSafe(F.col(bad_key)) & (F.col(mark) == F.col(bad_mark)), "left_anti").drop(mark)


def op7_decontaminate_suffix_arrays(spark, sf_dir: str) -> DataFrame:
    found = find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("items", lambda i: i["item_id"]), lambda i: i.isNotNull())))
    return found.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"]).alias("n_hit"), names.alias("_names"),
        F.coalesce(F.array_max(F.transform("items", lambda i: i["n_words"])), F.lit(0).cast("long")).alias("longest"),
    ).select(
        "doc_id", "n_words", "n_hit", F.size("_names").cast("long").alias("n_items"), F.sha2(F.array_join("_names", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest")


#: Windows of item words looked up among windows of document words of the same length.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, p, k FROM dw JOIN iw USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
r AS (SELECT m.doc_id, m.item_id, m.p, m.k, iq.p AS q FROM m JOIN (SELECT item_id, k, s, p FROM (SELECT item_id, least(len(w), 10) AS k, p, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0))) AS iq
  ON iq.item_id = m.item_id AND iq.k = m.k JOIN dw ON dw.doc_id = m.doc_id AND dw.k = m.k AND dw.p = m.p AND dw.s = iq.s),
l AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, item_id, p - q AS diag, g, k + count(*) - 1 AS n FROM (SELECT DISTINCT *, p - dense_rank() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS g FROM r) GROUP BY doc_id, item_id, p - q, g, k) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(c.n, 0)::BIGINT AS n_items, sha256(coalesce(c.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(l.longest, 0)::BIGINT AS longest
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""
