"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch has a fixed number of coordinates. In round after round every shingle is hashed into
one bin with a fresh hash, and a bin keeps the smallest value of the earliest round that met
it; after as many rounds as there are bins, round ``t + k`` sends all shingles to bin ``k``,
so that every coordinate fills whatever the size of the set. Equal coordinates estimate the
Jaccard similarity with concentration bounds, at about one hash per shingle for large sets.

Equal sets are one class from the start. Classes that agree in a band meet in its bucket. First
each is compared on the full sets with the smallest class it meets most often, which joins most
of a group of near copies at one comparison a class. What a bucket then still holds apart is
compared in blocks of bounded size: sketches tell which class may belong to which component, and
such a class is then compared with the full sets of all of that component. Blocks give out links
only, so pairs that fail never become rows, however large a group of near misses is.

With 32 bands of 4 coordinates a pair at similarity 0.8 misses all buckets with probability 5e-8,
and shares fewer than 80 of the 128 coordinates with about the same probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.text import Words, bitmap, byte_table, chain, kept, marked, mix, read_table, slices, slot_of, spare, utf8
from cohort.operators.cluster import connected_components

COORDINATES = 128
BAND = 4
SHINGLE = 5
PERCENT = 80
BITMAP_BITS = 24
#: Classes of either side in a block.
BLOCK = 512
#: Standard deviations below the threshold at which a pair of sketches is given up.
DEVIATIONS = 5.0
_TABLE = byte_table(separators=" \t\n\x0b\x0c\r")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the distinct shingles, ordered; a row of fewer words is one shingle."""
    words = Words(raw, offsets, _TABLE)
    counts = words.per_row()
    if not len(words.key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.cumsum(counts) - counts
    rest = (begin + counts)[words.row] - np.arange(len(words.key))
    gram, keep = words.key, np.zeros(len(words.key), bool)
    out = np.zeros(len(words.key), np.uint64)
    for n in range(1, size + 1):
        if n > 1:
            after = np.zeros_like(words.key)
            after[: 1 - n] = words.key[n - 1:]
            gram = chain(gram, after)
        ends = rest >= n if n == size else (rest == n) & (counts[words.row] == n)
        out[ends] = mix(gram[ends] + np.uint64(n))
        keep |= ends
    row, key = words.row[keep], out[keep]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
    return row[first], key[first]


def sketch(row: np.ndarray, key: np.ndarray, rows: int, size: int = COORDINATES) -> np.ndarray:
    """The coordinates (rows x size) of sets given as ordered ``(row, key)``; empty sets stay at the top value."""
    cells = np.full(rows * size, _EMPTY, np.uint64)
    names, slot = np.unique(row, return_inverse=True)
    for turn in range(2 * size):
        if not len(key):
            break
        value = mix(key ^ mix(np.array([turn + 1], np.uint64)))
        place = (value % np.uint64(size)).astype(np.int64) if turn < size else np.full(len(key), turn - size)
        np.minimum.at(cells, row * size + place, (np.uint64(turn) << np.uint64(56)) | (value >> np.uint64(8)))
        full = (cells.reshape(rows, size)[names] != _EMPTY).all(axis=1)
        open_ = ~full[slot]
        row, key = row[open_], key[open_]
        names, slot = np.unique(row, return_inverse=True)
    return cells.reshape(rows, size)


def band_keys(cells: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key per row and band, distinct between bands."""
    parts = cells.reshape(len(cells), -1, band)
    out = np.tile(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), (len(cells), 1))
    for k in range(band):
        out = chain(out, parts[:, :, k])
    return out.view(np.int64)


def _sums(row: np.ndarray, key: np.ndarray, rows: int, salt: int) -> np.ndarray:
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, mix(key ^ np.uint64(salt)))
    return total.view(np.int64)


def _sketches(pair: DataFrame, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, key = shingle_sets(*utf8(batch.column(1)), size)
            rows = batch.num_rows
            n = np.bincount(row, minlength=rows)
            cells = sketch(row, key, rows)
            bands = band_keys(cells)
            bytes_ = mix(cells).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, bands.shape[1], 0))], pa.int32()), pa.array(bands[n > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(_sums(row, key, rows, 1)), pa.array(_sums(row, key, rows, 2)), lists, pa.array([b.tobytes() for b in bytes_], pa.binary())],
                names=["key", "n", "set_a", "set_b", "bands", "sketch"])

    return pair.mapInArrow(work, f"key {pair.schema['key'].dataType.simpleString()}, n long, set_a long, set_b long, bands array<long>, sketch binary")


def _sets(pair: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """Full sets ``(key, set)`` of the documents whose key may be among ``needed``."""
    wanted = pair.sparkSession.sparkContext.broadcast(bitmap(needed.select(slot_of("key", BITMAP_BITS).alias("slot")), "slot", BITMAP_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(marked(wanted.value, batch.column(2).to_numpy())))
            if batch.num_rows:
                row, key = shingle_sets(*utf8(batch.column(1)), size)
                edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
                sets = [key[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["key", "set"])

    found = pair.filter("key is not null").select("key", "text", slot_of("key", BITMAP_BITS).alias("slot"))
    return found.mapInArrow(work, f"key {pair.schema['key'].dataType.simpleString()}, set binary").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough; sizes are compared before sets travel."""
    sizes = sets.select("key", (F.octet_length("set") / 8).cast("long").alias("n"))
    sized = pairs.join(sizes.withColumnsRenamed({"key": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"key": "b", "n": "nb"}), "b")
    likely = sized.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    both = likely.join(sets.withColumnsRenamed({"key": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"key": "b", "set": "sb"}), "b").select("a", "b", "sa", "sb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                good.append(100 * same >= percent * (len(x) + len(y) - same) and same > 0)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(work, f"a {kind}, b {kind}").distinct()


def _roots(links: DataFrame) -> DataFrame:
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return kept(connected_components(links, nodes), "roots")


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pd.DataFrame]:
    """Runs of rows that agree in the first ``keys`` columns, from rows sorted by them."""
    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        names = list(frame.columns[:keys])
        edges = np.flatnonzero((frame[names].to_numpy()[1:] != frame[names].to_numpy()[:-1]).any(axis=1)) + 1
        for x, y in zip([0, *edges[:-1]], edges):
            yield frame.iloc[x:y]
        rest = frame.iloc[edges[-1]:] if len(edges) else frame
    if rest is not None and len(rest):
        yield rest


def _blocked(members: DataFrame, others: DataFrame, group: str) -> DataFrame:
    """``(group, mb, sb, side, ...)``: every block of ``members`` beside every block of ``others`` of the group.

    Both sides hold ``group``, ``rep`` and the same further columns. A block has about ``BLOCK`` rows,
    so a group of any size becomes many small ones.
    """
    count = lambda rows, name: rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    sizes = kept(count(members, "nm").join(count(others, "ns"), group), "sizes")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(sizes, group).withColumn("mb", place("nm")).withColumn("sb", every("ns")).withColumn("side", F.lit(0))
    right = others.join(sizes, group).withColumn("sb", place("ns")).withColumn("mb", every("nm")).withColumn("side", F.lit(1))
    columns = [group, "mb", "sb", "side", *[c for c in members.columns if c != group]]
    both = left.select(*columns).unionByName(right.select(*columns))
    return both.repartition(group, "mb", "sb").sortWithinPartitions(group, "mb", "sb")


def _candidates(rows: DataFrame, stragglers: DataFrame, percent: int, kind: str) -> DataFrame:
    """``(rep, target)``: classes and the components, not their own, that a sketch of some member says they may join.

    Of two components the smaller one (or the one of the larger name) is moved.
    """
    share = percent / 100.0
    least = int(np.floor(COORDINATES * share - DEVIATIONS * np.sqrt(COORDINATES * share * (1 - share))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for frame in _by_group(batches, 3):
            side = frame["side"].to_numpy()
            if not side.any() or side.all():
                continue
            sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
            reps, roots, sizes = frame["rep"].to_numpy(), frame["root"].to_numpy(), frame["size"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            bands, bucket = np.stack(list(frame["bands"])), frame["bucket"].iloc[0]
            for i in right:
                near = left[(roots[left] != roots[i]) & ((sketches[left] == sketches[i]).sum(axis=1) >= least)]
                near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == bucket]  # each pair where it first meets, by whole band keys
                moved = (sizes[i] < sizes[near]) | ((sizes[i] == sizes[near]) & (roots[i] > roots[near]))
                seen.update((reps[i], r) for r in roots[near[moved]])
                seen.update((r, roots[i]) for r in reps[near[~moved]])
            if len(seen) > 100_000:
                yield _pair_batch(seen, "rep", "target")
                seen = set()
        yield _pair_batch(seen, "rep", "target")

    return _blocked(rows, stragglers, "bucket").mapInArrow(work, f"rep {kind}, target {kind}").distinct()


def _pair_batch(pairs: set[tuple], *names: str) -> pa.RecordBatch:
    table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=list(names))


def _joined(members: DataFrame, moved: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links ``(a, b)`` between classes and members of the components they may join, on full sets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: set[tuple] = set()
        for frame in _by_group(batches, 3):
            side, reps = frame["side"].to_numpy(), frame["rep"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in frame["set"]]
            left = np.flatnonzero(side == 0)
            if not len(left) or not side.any():
                continue
            flat, sizes = np.concatenate([sets[k] for k in left]), np.array([len(sets[k]) for k in left])
            begin = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(side == 1):
                own = sets[i]
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                same = np.add.reduceat(hit.astype(np.int64), begin)
                good = (100 * same >= percent * (sizes + len(own) - same)) & (reps[left] != reps[i])
                links.update((reps[i], r) for r in reps[left[good]][:1])  # one link joins it to the component
        yield _pair_batch(links, "a", "b")

    return _blocked(members, moved, "target").mapInArrow(work, f"a {kind}, b {kind}").distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row; keys are whole numbers.

    ``component_id`` is the smallest key linked to the row over any number of links. Null, empty
    and wordless texts have no shingles and are linked with nothing; a row without a key has no
    component. Rows of one key count as one document: what is linked to any of them is linked to all.
    """
    pair = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    drawn = kept(_sketches(pair, shingle), "sketches")
    classes = kept(drawn.filter("n > 0 and key is not null").groupBy("set_a", "set_b", "n").agg(
        F.min("key").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    posted = classes.select("rep", F.explode("bands").alias("bucket")).distinct()
    met = kept(posted.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").select("bucket", "lead"), "buckets")
    posted = kept(posted.join(met, "bucket"), "posted")
    reps = kept(posted.select("rep").distinct(), "reps")
    sets = kept(_sets(pair, reps.select(F.col("rep").alias("key")), shingle), "sets")

    to_lead = posted.filter("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("n"))
    most = to_lead.groupBy("rep").agg(F.max_by("lead", F.col("n")).alias("lead"))
    links = kept(_verified(most.select(F.col("rep").alias("a"), F.col("lead").alias("b")), sets, percent), "links")
    roots = _roots(links)

    placed = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"))
    size = kept(placed.groupBy("root").agg(F.count("*").alias("size")), "size")
    placed = kept(placed.join(size, "root"), "placed")
    in_bucket = posted.select("bucket", "rep").join(placed, "rep")
    by_root = kept(in_bucket.groupBy("bucket", "root").agg(F.count("*").alias("n")), "roots")
    mixed = kept(by_root.groupBy("bucket").agg(F.count("*").alias("k"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("k > 1").select("bucket", "main"), "mixed")
    look = classes.select("rep", "sketch", "bands")  # a key of several texts is in a bucket with those that are
    looked = in_bucket.join(mixed, "bucket").join(look, "rep").filter(F.array_contains("bands", F.col("bucket")))
    rows = kept(looked.select("bucket", "rep", "root", "size", "sketch", "bands", (F.col("root") != F.col("main")).alias("aside")), "rows")
    moved = kept(_candidates(rows.drop("aside"), rows.filter("aside").drop("aside"), percent, "long"), "moved")
    whole = sets.withColumnRenamed("key", "rep")
    members = placed.select("rep", F.col("root").alias("target")).join(moved.select("target").distinct(), "target").join(whole, "rep").select("target", "rep", "set")
    more = kept(_joined(members, moved.join(whole, "rep").select("target", "rep", "set"), percent, "long"), "links")
    roots = _roots(links.unionByName(more))

    named = kept(classes.select("set_a", "set_b", "n", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("root", "rep").alias("root")), "named")
    by_set = drawn.select("key", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
    return by_set.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("root", "key")).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest key; rows without a key stay."""
    [gone] = spare(docs, "_dropped")
    dropped = groups(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), "id", "body", shingle, percent).filter("id <> component_id").select(F.col("id").alias(gone)).distinct()
    return docs.join(dropped, F.col(key) == F.col(gone), "left_anti")


def op4_minhash_fast_similarity(spark, sf_dir: str) -> DataFrame:
    found = groups(read_table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: All pairs of documents by the shingles they share, then the closure of the links.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 80 * (u.n + v.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x) m USING (doc_id)
"""
