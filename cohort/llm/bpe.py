"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of the last 8 bytes cuts every text where its value meets a fixed pattern, so equal
passages of different documents fall into equal chunks. A first pass counts chunk
fingerprints. A second pass encodes, where they are read, the documents of which no chunk
occurs twice, and hands out the chunks of the others; each distinct chunk among those is
encoded once and joined back, and the documents are put together again.

A cut can fall inside a word, so the join of two chunks is repaired: the text from the last
ASCII white space before the join to the first one after it is encoded anew, over as many
chunks as it takes. The tokenizer's rules never reach across such white space, so both sides
agree there exactly. Within a task, words are encoded once and remembered.

Shared fingerprints reach the second pass as a bitmap of fixed size; a false hit only sends a
document the longer way.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from cohort.llm.text import bitmap, kept, marked, process_cache, read_table, slices, utf8

CHUNK_BITS = 10
LEAST_CHUNK = 64
BITMAP_BITS = 26
#: Bytes of words and ids that a worker remembers, in each of two generations.
REMEMBERED = 1 << 24
_OVERHEAD = 200
_WINDOW = 8
_SPACE = " \t\n\r"
_STOPS = ".,;:!?"
_FACTOR = 0x9E3779B97F4A7C15


def default_tokenizer() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


class Coder:
    """A tokenizer that remembers what the words of earlier texts became."""

    def __init__(self, definition: str):
        self.inner = Tokenizer.from_str(definition)
        self.inner.no_padding()
        self.inner.no_truncation()
        size = self.inner.get_vocab_size(with_added_tokens=True)
        names = [self.inner.id_to_token(k) or "" for k in range(size)]
        self.plain = self.inner.decoder is None
        self.number = [str(k).encode() for k in range(size)]
        self.name = [n.encode("utf-8") for n in names]
        self.type = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _shortcut(self, word: str) -> tuple[str, str]:
        """The word as the tokenizer folds it, without stops that it cuts off in any case."""
        if "<|" in word or not word.isascii():
            return word, ""
        word = word.lower()
        core = word.rstrip(_STOPS)
        if core and core != word and core[-1].isalnum():
            return core, word[len(core):]
        return word, ""

    def learn(self, words: set[str]) -> None:
        """See to it that the ids of all these words are known; words of late are kept, older ones go."""
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        before = len(known)
        new = words.difference(known)
        for word in new:
            if word in older:
                known[word] = older[word]
        cut = [(w, *self._shortcut(w)) for w in new.difference(older)]
        parts = {p for _, core, stops in cut for p in (core, stops)}.difference(known)
        for part in parts:
            if part in older:
                known[part] = older[part]
        ask = list(parts.difference(older))
        for part, found in zip(ask, self.inner.encode_batch_fast(ask, add_special_tokens=False)):
            known[part] = np.array(found.ids, self.type).tobytes()
        for word, core, stops in cut:
            known[word] = known[core] + known[stops] if stops else known[core]
        self.held += _OVERHEAD * (len(known) - before) + sum(len(w) for w in new)

    def ids_of(self, text: str, learned: bool = False) -> list[int]:
        words = split(text)
        if not learned:
            self.learn(set(words))
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.type).tolist()

    def decoded(self, ids: list[int]) -> bytes:
        """What the tokenizer's own decode gives for the whole sequence."""
        if self.plain:  # without a decoder it joins the tokens by one space
            return b" ".join(map(self.name.__getitem__, ids))
        return self.inner.decode(ids, skip_special_tokens=False).encode("utf-8")

    def finished(self, ids: list[int]) -> tuple[int, str, str]:
        numbers = b" ".join(map(self.number.__getitem__, ids))
        return len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()


def split(text: str) -> list[str]:
    """Stretches between ASCII white space."""
    return [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]


def chunks_of(raw: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> Iterator[list[bytes]]:
    """The chunks of every row: cut where the hash of the last bytes ends in zeros, at least ``LEAST_CHUNK`` apart."""
    data = raw.tobytes()
    at = np.zeros(0, np.int64)
    if len(raw) >= _WINDOW:
        window = np.ndarray(len(data) - _WINDOW + 1, np.uint64, data, strides=(1,))  # the last 8 bytes, sliding
        with np.errstate(over="ignore"):
            at = np.flatnonzero((window * np.uint64(_FACTOR)) >> np.uint64(64 - bits) == 0) + _WINDOW
        at = at[at < len(raw)]
        at = at[(raw[at] & 0xC0) != 0x80]  # not inside a character
    edges = np.searchsorted(at, offsets, side="right")
    for k, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        out = []
        for cut in at[edges[k]: edges[k + 1]].tolist():
            if start + LEAST_CHUNK <= cut < end:
                out.append(data[start:cut])
                start = cut
        if start < end:
            out.append(data[start:end])
        yield out


def _print(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _slot(prints: list[bytes], bits: int) -> np.ndarray:
    return (np.frombuffer(b"".join(prints), np.dtype(">u8"))[::2].astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _count_prints(docs: DataFrame, bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = [_print(c) for row in chunks_of(*utf8(batch.column(1)), bits) for c in row]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary())], names=["print"])

    return docs.mapInArrow(work, "print binary").groupBy("print").count().filter("count > 1").select("print")


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """Slots of the shared fingerprints: their leading bits."""
    slot = F.shiftrightunsigned(F.conv(F.hex(F.substring("print", 1, 7)), 16, 10).cast("long"), 56 - bits)
    return bitmap(prints.select(slot.alias("slot")), "slot", bits)


_coders = process_cache("coders")


def _coder(definition) -> Coder:
    """One coder per worker process and tokenizer, kept from task to task."""
    key = hash(definition.value)
    if key not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        _coders[key] = Coder(definition.value)
    return _coders[key]


def _packed(ids: list[int], size: int) -> bytes:
    return np.array(ids, np.uint16 if size <= 1 << 16 else np.uint32).tobytes()


def _unpacked(data: bytes, size: int) -> list[int]:
    return np.frombuffer(data, np.uint16 if size <= 1 << 16 else np.uint32).tolist()


def _done_schema(key_type: str, with_ids: bool) -> str:
    return f"key {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = True,
           chunk_bits: int = CHUNK_BITS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256, ids)`` of every row.

    Equal to encoding the whole text without special tokens added and decoding all of it. A null
    or empty text has no tokens and an empty decoding. Repeated rows repeat their result, null
    keys stay, other columns are not read. The tokenizer's definition is read once on the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    pair = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_type = pair.schema["key"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(_bitmap(_count_prints(pair, chunk_bits), bitmap_bits))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, common_slots = _coder(definition), shared.value
        row = TaskContext.get().partitionId() << 40  # what this pass hands out is written once, so the number holds
        for batch in slices(batches, "text"):
            texts, rows = batch.column(1).to_pylist(), list(chunks_of(*utf8(batch.column(1)), chunk_bits))
            prints = [[_print(c) for c in r] for r in rows]
            flat = [p for r in prints for p in r]
            slot = _slot(flat, bitmap_bits) if flat else np.zeros(0, np.int64)
            twice = marked(common_slots, slot).tolist()
            edges = np.cumsum([0, *map(len, rows)]).tolist()
            marks = [twice[a:b] for a, b in zip(edges, edges[1:])]
            coder.learn({w for t, mark in zip(texts, marks) if t and not any(mark) for w in split(t)})
            out: list[tuple] = []
            for k, (chunks, own, mark) in enumerate(zip(rows, prints, marks)):
                row += 1
                if not any(mark):
                    ids = coder.ids_of(texts[k] or "", learned=True)
                    out.append((k, row, None, None, None, *coder.finished(ids), ids if with_ids else None))
                else:
                    for place, (chunk, name, common) in enumerate(zip(chunks, own, mark)):
                        out.append((k, row, place, name if common else None, chunk.decode("utf-8"), None, None, None, None))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [None, pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(columns[1:], kinds[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "row", "place", "print", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    read = kept(pair.mapInArrow(second, f"key {key_type}, row long, place int, print binary, text string, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"), "bpe")
    columns = ["key", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    done = read.filter("place is null").select(*columns)
    pieces = read.filter("place is not null")
    encoded = kept(_encode_chunks(pieces, definition), "chunks")
    twice = pieces.filter("print is not null").select("key", "row", "place", "print").join(encoded, "print")
    parts = twice.select("key", "row", "place", F.lit(None).cast("string").alias("text"), "head", "tail", "body", "parted").unionByName(
        pieces.filter("print is null").select("key", "row", "place", "text", *[F.lit(None).cast(t).alias(n) for n, t in (("head", "string"), ("tail", "string"), ("body", "binary"), ("parted", "boolean"))]))
    grouped = parts.groupBy("row").agg(F.first("key").alias("key"), F.collect_list(F.struct("place", "text", "head", "tail", "body", "parted")).alias("parts"))
    return done.unionByName(_assemble(grouped.select("key", "parts"), definition, key_type, with_ids)).select(F.col("key").alias(key), *columns[1:])


def _encode_chunks(pieces: DataFrame, definition) -> DataFrame:
    """Each shared chunk once: what lies before its first white space, after its last, and the ids between."""
    distinct = pieces.filter("print is not null").groupBy("print").agg(F.first("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition)
        for batch in slices(batches, "text"):
            out, texts = [], batch.column(1).to_pylist()
            coder.learn({w for t in texts for w in split(t)})
            for text in texts:
                first = next((k for k, c in enumerate(text) if c in _SPACE), None)
                if first is None:
                    out.append((text, "", b"", False))
                else:
                    last = len(text) - next(k for k, c in enumerate(reversed(text)) if c in _SPACE)
                    out.append((text[:first], text[last:], _packed(coder.ids_of(text[first:last]), len(coder.name)), True))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.bool_()))]], names=["print", "head", "tail", "body", "parted"])

    return distinct.mapInArrow(work, "print binary, head string, tail string, body binary, parted boolean")


def put_together(coder: Coder, parts: list[dict]) -> list[int]:
    """Ids of a whole text from its chunks in order: inner ids as they are, joins encoded anew."""
    out, open_text = [], ""
    for part in parts:
        if part["text"] is not None:
            open_text += part["text"]
        elif not part["parted"]:
            open_text += part["head"]
        else:
            out += coder.ids_of(open_text + part["head"])
            out += _unpacked(part["body"], len(coder.name))
            open_text = part["tail"]
    return out + coder.ids_of(open_text)


def _assemble(grouped: DataFrame, definition, key_type: str, with_ids: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                ids = [put_together(coder, sorted(p, key=lambda c: c["place"])) for p in piece.column(1).to_pylist()]
                out = [coder.finished(i) for i in ids]
                arrays = [piece.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out])]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return grouped.mapInArrow(work, _done_schema(key_type, with_ids))


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``(key, text)`` of id sequences, special tokens kept; null or empty sequences give an empty text."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = encoded.sparkSession.sparkContext.broadcast(file.read())
    pair = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition)
        for batch in batches:
            texts = coder.inner.decode_batch([i or [] for i in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return pair.mapInArrow(work, f"key {pair.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op5_bpe_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), with_ids=False)
