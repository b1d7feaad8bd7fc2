"""Substring deduplication by sliding sentence spans.

Texts fall into sentences; from every sentence on, and up to every sentence, the shortest run of
at least two sentences and twenty words is hashed. Runs that occur more than once keep their first occurrence, by
key and place, and the sentences of every other occurrence are removed.

A first pass only counts hashes. The repeated ones reach a second pass as a bitmap sized by their
number, and only occurrences of these travel with their place and a 128-bit name. They are ranked
name by name; those of very common names are not gathered in one task but compared as whole rows.

Very long sentences are cut after words chosen by their hash. Passages that begin and end inside
sentences are found by windows of twenty words, whatever the sentences: of every sixteen windows in
a row the one of the smallest hash is named, so any 35 words in common hold a common named window,
and all but fifteen words at either end of a longer passage lie in some. Their words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohort.llm.text import Words, bitmap, byte_table, chain, kept, marked, mix, read_table, slices, utf8

SENTENCES = 2
WORDS = 20
LONG = 24
#: Windows in a row of which one is named; a power of two.
WINNOW = 16
#: Bits of the bitmap: eight slots a repeated hash, between these; the largest is 64 MB.
BITMAP_BITS = (20, 29)
#: A name with more occurrences is common; the bitmap of these has a fixed size, 128 KB.
COMMON = 1024
COMMON_BITS = 20
#: One name per salt; the first is counted, both together tell names apart.
SALTS = (1, 1 << 40)
_TABLE = byte_table(words="0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = np.isin(np.arange(256), [ord(c) for c in " \t\n\x0b\x0c\r"])
#: UTF-8 of the full-width stops.
_WIDE = ((0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F))


@dataclass
class Sentences:
    """Sentences that hold words: row, number in the row, byte range from the row's start, words and a hash per salt."""

    row: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    keys: tuple[np.ndarray, ...]


def sentences(raw: np.ndarray, offsets: np.ndarray, words: Words | None = None, salts: tuple[int, ...] = SALTS) -> Sentences:
    """Cut after stops before white space, after line ends and full-width stops, and inside long sentences."""
    after = np.zeros(len(raw) + 1, bool)
    if len(raw):
        after[1:-1] |= _STOPS[raw[:-1]] & _BLANK[raw[1:]]
        after[1:] |= raw == 10
        for a, b, c in _WIDE:
            after[3:] |= (raw[:-2] == a) & (raw[1:-1] == b) & (raw[2:] == c)
    after[offsets] = True
    words = words or Words(raw, offsets, _TABLE)
    if not len(words.key):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, none, tuple(none.astype(np.uint64) for _ in salts))
    unit = np.cumsum(after)[words.start]
    size = np.bincount(unit)
    new = np.r_[True, unit[1:] != unit[:-1]]
    new[1:] |= (size[unit[1:]] > LONG) & (words.key[:-1] % np.uint64(8) == 0)
    first = np.flatnonzero(new)
    row = words.row[first]
    start = words.start[first]
    start[np.r_[True, row[1:] != row[:-1]]] = offsets[row[np.r_[True, row[1:] != row[:-1]]]]
    end = np.r_[start[1:], 0]
    end[np.r_[row[1:] != row[:-1], True]] = offsets[row[np.r_[row[1:] != row[:-1], True]] + 1]
    inside = (np.arange(len(words.key)) - np.repeat(first, np.diff(np.r_[first, len(words.key)]))).astype(np.uint64)
    keys = tuple(mix(np.add.reduceat(mix(words.key ^ mix(inside + np.uint64(salt))), first)) for salt in salts)
    begin = np.searchsorted(row, row, side="left")
    return Sentences(row, np.arange(len(row)) - begin, start - offsets[row], end - offsets[row], np.diff(np.r_[first, len(words.key)]), keys)


def runs(found: Sentences, least: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """``(first, count, name per hash)`` of the shortest runs that are long enough, from every sentence on and up to every sentence."""
    n = len(found.row)
    sums, place = np.r_[0, np.cumsum(found.words)], np.arange(n)
    stop = np.maximum(np.searchsorted(sums, sums[:-1] + words, side="left"), place + least)
    onward = stop <= np.searchsorted(found.row, found.row, side="right")
    start = np.minimum(np.searchsorted(sums, sums[1:] - words, side="right") - 1, place + 1 - least)
    back = np.flatnonzero(start >= np.searchsorted(found.row, found.row, side="left"))
    back = back[~(onward[start[back]] & (stop[start[back]] == back + 1))]  # each run once
    first, count = np.r_[place[onward], start[back]], np.r_[stop[onward] - place[onward], back + 1 - start[back]]
    names = []
    for key in found.keys:
        total = np.zeros(len(first), np.uint64)
        for k in range(int(count.max()) if len(count) else 0):
            part = count > k
            total[part] = mix(total[part] * np.uint64(0x9E3779B97F4A7C15) + key[first[part] + k])
        names.append(mix(total + count.astype(np.uint64)))
    return first, count, *names


def windows(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(first, name)`` of the named windows of ``size`` words; ``first`` counts words over all rows."""
    n = len(words.key) - size + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64)
    part, total, done, length, rest = mix(words.key ^ np.uint64(3)), None, 0, 1, size
    while rest:  # a window is joined from parts whose lengths are powers of two
        if rest & 1:
            own = part[done: done + n]
            total = own if total is None else chain(total[:n], own)
            done += length
        rest >>= 1
        if rest:
            part, length = chain(part[:-length], part[length:]), 2 * length
    name = mix(total)
    inside = words.row[:n] == words.row[size - 1:]
    low = np.where(inside, name, _TOP)
    reach = 1
    while reach < WINNOW:
        low[:-reach] = np.minimum(low[:-reach], low[reach:].copy()) if reach < n else low[:-reach]
        reach *= 2
    start, stop = begins(words)[words.row[:n]], begins(words)[words.row[:n] + 1] - size + 1
    place = np.arange(n)
    whole = inside & ((place + WINNOW <= stop) | (place == start))  # a row of fewer windows names one
    top = np.where(whole, low, np.uint64(0))
    reach = 1
    while reach < WINNOW:
        top[reach:] = np.maximum(top[reach:], top[:-reach].copy()) if reach < n else top[reach:]
        reach *= 2
    first = np.flatnonzero(inside & (name == top))
    return first, name[first]


def second(words: Words, first: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The second names of the windows that begin at ``first``."""
    total = mix(words.key[first] ^ np.uint64(3 << 40))
    for k in range(1, size):
        total = chain(total, words.key[first + k])
    return mix(total)


def begins(words: Words) -> np.ndarray:
    """The number of the first word of every row, and that of all words."""
    return np.r_[0, np.cumsum(words.per_row())]


def later(spots: DataFrame) -> DataFrame:
    """Spots that are not the first of their name, by key, print and place; all spots of a name agree in ``common``."""
    few, common = spots.filter("not common").drop("common"), spots.filter("common").drop("common").distinct()
    order = Window.partitionBy("name", "more").orderBy("key", "print", "spot")
    others = few.withColumn("rank", F.rank().over(order)).filter("rank > 1").drop("rank")
    firsts = common.groupBy("name", "more").agg(F.min(F.struct("key", "print", "spot")).alias("low")).select("low.*", "name", "more")
    return others.unionByName(common.subtract(firsts.select(common.columns)))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``(key, print, places, windows)`` of the rows that hold a non-first occurrence.

    ``places`` are the sentences to remove, ``windows`` the first words of windows of ``words`` words to remove.
    """
    pair = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.col(text).cast("string").alias("text"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = utf8(batch.column(0))
            apart = Words(raw, offsets, _TABLE)
            _, _, name = runs(sentences(raw, offsets, apart, SALTS[:1]), least, words)
            _, more = windows(apart, words)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[name, more].view(np.int64))], names=["name"])

    def slots(names: DataFrame, bits: int) -> np.ndarray:
        return bitmap(names.select(F.shiftrightunsigned("name", 64 - bits).alias("slot")), "slot", bits)

    spark = docs.sparkSession
    counted = kept(pair.select("text").mapInArrow(names, "name long").groupBy("name").count().filter("count > 1"), "names")
    bits = min(max(BITMAP_BITS[0], (8 * counted.count()).bit_length()), BITMAP_BITS[1])
    wanted = spark.sparkContext.broadcast(slots(counted, bits))
    many = spark.sparkContext.broadcast(slots(counted.filter(F.col("count") > COMMON), COMMON_BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = utf8(batch.column(2))
            apart = Words(raw, offsets, _TABLE)
            found = sentences(raw, offsets, apart)
            first, count, name, more = runs(found, least, words)
            use = marked(wanted.value, (name >> np.uint64(64 - bits)).astype(np.int64))
            first, count, name, more = first[use], count[use], name[use], more[use]
            word, named = windows(apart, words)
            use = marked(wanted.value, (named >> np.uint64(64 - bits)).astype(np.int64))
            word, named = word[use], named[use]
            rows = pa.array(np.r_[found.row[first], apart.row[word]])
            spot = np.r_[(found.place[first] << 32) + count, (word - begins(apart)[apart.row[word]]) << 32]
            name, more = np.r_[name, named], np.r_[more, second(apart, word, words)]
            common = marked(many.value, (name >> np.uint64(64 - COMMON_BITS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(name.view(np.int64)), pa.array(more.view(np.int64)), pa.array(spot), pa.array(common)],
                names=["key", "print", "name", "more", "spot", "common"])

    # a spot is a run's first sentence and number of sentences, or a window's first word and 0
    kind = pair.schema["key"].dataType.simpleString()
    spots = kept(pair.mapInArrow(places, f"key {kind}, print long, name long, more long, spot long, common boolean"), "spots")
    all_ = later(spots).groupBy("key", "print").agg(F.collect_set("spot").alias("all"))
    place, count = (lambda x: F.shiftright(x, 32).cast("int")), (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    long_ = F.transform(F.filter("all", lambda x: count(x) > 0), lambda x: F.sequence(place(x), place(x) + count(x) - 1))
    return all_.select("key", "print", F.array_distinct(F.flatten(long_)).alias("places"), F.transform(F.filter("all", lambda x: count(x) == 0), place).alias("windows"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``(key, n_sentences, n_removed, removed, text)`` of every row; ``removed`` holds byte ranges of the old text.

    ``n_removed`` counts sentences that are gone as a whole. Null texts stay null, with no sentences. Rows that agree in key and text are one document and
    are cut alike; null keys come first in the order of occurrences.
    """
    pair = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.col(text).cast("string").alias("text"))
    cut = repeated(docs, key, text, least, words).withColumnsRenamed({"key": "_key", "print": "_print"})
    rows = pair.join(cut, F.col("key").eqNullSafe(F.col("_key")) & (F.col("print") == F.col("_print")), "left").select("key", "text", "places", "windows")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = utf8(batch.column(1))
            apart = Words(raw, offsets, _TABLE)
            found, begin = sentences(raw, offsets, apart, ()), begins(apart)
            edges = np.searchsorted(found.row, np.arange(batch.num_rows + 1))
            counts, removed, texts = [], [], []
            for k, (a, b, old, places, wins) in enumerate(zip(edges[:-1], edges[1:], *(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                if not places and not wins:
                    counts.append((b - a, 0))
                    removed.append([])
                    texts.append(old)
                    continue
                bounds = np.r_[apart.start[begin[k]: begin[k + 1]] - offsets[k], offsets[k + 1] - offsets[k]]  # a word goes with what follows it
                bounds[0] = 0
                spans = sorted([(int(found.start[a + p]), int(found.end[a + p])) for p in places] + [(int(bounds[w]), int(bounds[w + words])) for w in wins])
                data, out, at, ranges = old.encode("utf-8"), [], 0, []
                for start, end in spans:
                    if ranges and start <= ranges[-1]["end"]:
                        ranges[-1]["end"] = max(ranges[-1]["end"], end)
                    else:
                        ranges.append({"start": start, "end": end})
                for r in ranges:
                    out.append(data[at:r["start"]])
                    at = r["end"]
                inside = np.searchsorted([r["start"] for r in ranges], found.start[a:b], side="right") - 1
                counts.append((b - a, int(((inside >= 0) & (np.array([r["end"] for r in ranges])[inside] >= found.end[a:b])).sum())))
                removed.append(ranges)
                texts.append(b"".join([*out, data[at:]]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.string())], names=["key", "n_sentences", "n_removed", "removed", "text"])

    kind = pair.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, n_sentences long, n_removed long, removed array<struct<start:long,end:long>>, text string").withColumnRenamed("key", key)


def op8_substring_sentence_spans(spark, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"))
