"""Words of whole texts as numpy arrays, and small helpers shared by the operators.

Texts stay UTF-8 bytes: separators of every word rule used here are ASCII, so a byte table
decides what belongs to a word, and no step depends on how long a text is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohort.sources.tables import scratch_path

SLICE_BYTES = 1 << 21
_SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class ProcessCache(dict):
    """Memory of one worker process: it travels to tasks by name only, and outlives them there."""

    def __init__(self, name: str):
        super().__init__()
        self.name = name

    def __reduce__(self):
        return process_cache, (self.name,)


def process_cache(name: str) -> ProcessCache:
    caches = sys.__dict__.setdefault("_cohort_process_caches", {})
    if name not in caches:
        caches[name] = ProcessCache(name)
    return caches[name]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again: a lineage cut that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_table(separators: str | None = None, words: str | None = None, fold: bool = True) -> np.ndarray:
    """256 entries: 0 for a separator byte, else the byte itself (A-Z folded to a-z).

    Bytes from 128 on, the parts of non-ASCII characters, always belong to words.
    """
    table = np.arange(256, dtype=np.uint8)
    if separators is not None:
        table[[ord(c) for c in separators]] = 0
    if words is not None:
        inside = np.zeros(256, bool)
        inside[[ord(c) for c in words]] = True
        inside[128:] = True
        table[~inside] = 0
    if fold:
        upper = np.arange(65, 91)
        table[upper] = np.where(table[upper] > 0, upper + 32, 0)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a key depends on all of its bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An ordered combination of two hash arrays."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``limit`` text bytes; a longer text is a range of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths) - 1) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers outlive their tasks


_powers = process_cache("powers")


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0..n-1, modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        grown = np.full(max(n, _SEGMENT + 1), base, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(grown)
    return _powers[base][:n]


class Words:
    """Words of concatenated rows: ``row``, ``start`` and ``end`` (bytes) and a 64-bit ``key`` each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, keys: bool = True):
        data = table[raw]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = data > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge))
        self.end = np.flatnonzero(before & (~inside | edge))
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        if keys:
            self.key = self._keys(data)
        self.rows = len(offsets) - 1

    def _keys(self, data: np.ndarray) -> np.ndarray:
        """Polynomial hashes from prefix sums, taken over segments that end between words."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(self.start):
                low = self.start[at]
                to = max(at + 1, int(np.searchsorted(self.end, low + _SEGMENT, side="right")))
                piece = data[low: self.end[to - 1]]
                power, inverse = _powers_of(_BASE, len(piece) + 1), _powers_of(_INVERSE, len(piece) + 1)
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(piece * power[:-1], out=sums[1:])
                s, e = self.start[at:to] - low, self.end[at:to] - low
                out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
                at = to
        return out

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def slot_of(key, bits: int):
    """Where a key falls in a bitmap of ``2^bits`` slots, as a Spark column."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def bitmap(slots: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of the slots that occur: ``2^(bits-3)`` bytes reach the driver, in pieces made by the tasks."""
    piece = min(bits, 16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for number in np.unique(at >> piece).tolist():
                own = at[at >> piece == number] & ((1 << piece) - 1)
                np.bitwise_or.at(pieces.setdefault(number, np.zeros(1 << (piece - 5), np.uint32)), own >> 5, np.uint32(1) << (own & 31).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([b.tobytes() for b in pieces.values()], pa.binary())], names=["number", "bits"])

    dealt = slots.select(F.col(column).cast("long").alias("slot")).repartition(F.shiftright("slot", piece))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for row in dealt.mapInArrow(work, "number long, bits binary").collect():
        out[row.number << (piece - 5): (row.number + 1) << (piece - 5)] = np.frombuffer(row.bits, np.uint32)
    return out


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot is set."""
    return ((bits[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1).astype(bool)
