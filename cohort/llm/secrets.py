"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

Long tokens are judged under the smallest alphabet that spells them. Three tests ask whether
the token could be random: chi-squared uniformity over the alphabet, runs above and below its
middle, and lag-one serial correlation; the Bonferroni value of the three is the score. What
ordinary tokens of the same length and alphabet score is counted over the whole corpus from
tokens of letters only. The share of them that reaches a score is a p-value, and within each
stratum of alphabet and length the Benjamini-Hochberg bound picks the lowest score admitted.

The corpus is read twice: once for the two histograms (a table of fixed size), once to mark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.pii import SPANS, count_of, listed
from cohort.llm.text import process_cache, read_table, slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
FALSE_DISCOVERIES = 0.01
MASK = "[secret]"

#: The smallest alphabet first; letters alone come before all of them and are the reference.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Lower ends of the length strata.
LENGTHS = (16, 20, 24, 32, 40, 64, 128)
BINS = 64
#: References wanted before a stratum stands alone.
ENOUGH = 1000
_LOWEST = 1e-6

_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_TOKEN = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_LETTERS = re.compile("[A-Za-z]+")
_PLAIN = re.compile("[0-9+/_-]+")

_codes = process_cache("alphabets")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, matches that are too short dropped."""
    found = []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(word in folded for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def infer(token: str) -> str | None:
    """Name of the alphabet, ``letters`` for the reference, None for plain numbers and signs."""
    body = token.rstrip("=")
    if _LETTERS.fullmatch(body):
        return "letters"
    if _PLAIN.fullmatch(body):
        return None
    symbols = set(body)
    return next((name for name, letters in ALPHABETS.items() if symbols <= set(letters)), None)


def _table(name: str) -> np.ndarray:
    if name not in _codes:
        table = np.zeros(128, np.int64)
        table[[ord(c) for c in ALPHABETS[name]]] = np.arange(len(ALPHABETS[name]))
        _codes[name] = table
    return _codes[name]


def battery(tokens: list[str], name: str) -> np.ndarray:
    """The three p-values of every token, each uniform if the token is random."""
    erfc = np.vectorize(math.erfc, otypes=[float])
    size = len(ALPHABETS[name])
    lengths = np.array([len(t) for t in tokens])
    code = _table(name)[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), lengths)
    n = lengths.astype(float)
    seen = np.bincount(owner * size + code, minlength=len(tokens) * size).reshape(-1, size)
    chi = size / n * (seen.astype(float) ** 2).sum(axis=1) - n
    free = size - 1.0
    z = (np.cbrt(np.maximum(chi, 0) / free) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    uniform = 0.5 * erfc(z / math.sqrt(2))
    high = code >= size / 2
    ups = np.bincount(owner, weights=high, minlength=len(tokens))
    pair = owner[1:] == owner[:-1]
    runs = 1 + np.bincount(owner[1:][pair & (high[1:] != high[:-1])], minlength=len(tokens))
    both = 2 * ups * (n - ups)
    spread = both * (both - n) / (n * n * (n - 1))
    z = np.where(spread > 0, (runs - both / n - 1) / np.sqrt(np.where(spread > 0, spread, 1)), np.inf)
    run = erfc(np.abs(z) / math.sqrt(2))
    away = code - (np.bincount(owner, weights=code, minlength=len(tokens)) / n)[owner]
    power = np.bincount(owner, weights=away * away, minlength=len(tokens))
    shared = np.bincount(owner[1:][pair], weights=(away[1:] * away[:-1])[pair], minlength=len(tokens))
    z = np.where(power > 0, shared / np.where(power > 0, power, 1) * np.sqrt(n), np.inf)
    serial = erfc(np.abs(z) / math.sqrt(2))
    return np.column_stack([uniform, run, serial])


def score_bins(tokens: list[str], name: str) -> np.ndarray:
    """Bonferroni value of the battery on a logarithmic scale: the highest bin is the most random."""
    score = np.clip(3 * battery(tokens, name).min(axis=1), _LOWEST, 1.0)
    return np.minimum(BINS - 1, (BINS * (1 - np.log10(score) / math.log10(_LOWEST))).astype(int))


def stratum(name: str, length: int) -> int:
    return list(ALPHABETS).index(name) * len(LENGTHS) + int(np.searchsorted(LENGTHS, length, side="right")) - 1


def _tokens(texts: list[str | None]) -> Iterator[tuple[int, int, str, str]]:
    for row, text in enumerate(texts):
        for m in _TOKEN.finditer(text or ""):
            name = infer(m.group())
            if name:
                yield row, m.start(), m.group(), name


def _judged(found: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, int, int, int]]:
    """``(row, start, end, stratum, bin)`` of the candidates, scored together per alphabet."""
    for name in ALPHABETS:
        own = [f for f in found if f[3] == name]
        if own:
            bins = score_bins([f[2].rstrip("=") for f in own], name)
            for (row, start, token, _), b in zip(own, bins.tolist()):
                yield row, start, start + len(token), stratum(name, len(token.rstrip("="))), b


def _references(found: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int]]:
    words = [f[2].rstrip("=") for f in found if f[3] == "letters"]
    for name in ("base36", "base62", "base64", "base64url"):
        own = [w for w in words if name != "base36" or w.islower()]
        if own:
            for word, b in zip(own, score_bins(own, name).tolist()):
                yield stratum(name, len(word)), b


def fit(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES) -> list[int]:
    """Lowest admitted bin of each stratum, from counts over all tokens of all texts.

    An alphabet without reference tokens takes those of all alphabets; a length with few of them
    adds the shorter ones; with none at all nothing is admitted.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(ALPHABETS) * len(LENGTHS) * BINS
        counts = np.zeros((2, width), np.int64)
        for batch in slices(batches, "text"):
            found = list(_tokens(batch.column(0).to_pylist()))
            for _, _, _, s, b in _judged(found):
                counts[0, s * BINS + b] += 1
            for s, b in _references(found):
                counts[1, s * BINS + b] += 1
        which, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[which, cell], pa.int64())], names=["which", "cell", "n"])

    cells = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(work, "which int, cell int, n long")
    table = np.zeros((2, len(ALPHABETS) * len(LENGTHS), BINS))
    for row in cells.groupBy("which", "cell").agg(F.sum("n").alias("n")).collect():  # at most 2 x strata x bins
        table[row.which, row.cell // BINS, row.cell % BINS] = row.n
    return admitted(table[0], table[1], rate)


def admitted(tokens: np.ndarray, ordinary: np.ndarray, rate: float) -> list[int]:
    """The Benjamini-Hochberg cut of every stratum from its two histograms (strata x bins)."""
    by_length = ordinary.reshape(len(ALPHABETS), len(LENGTHS), BINS)
    cuts = []
    for s in range(len(tokens)):
        name, length = divmod(s, len(LENGTHS))
        null = _null(by_length[name] if by_length[name].sum() else by_length.sum(axis=0), length)
        cuts.append(BINS)
        if not null.sum() or not tokens[s].sum():
            continue
        p = (1 + null[::-1].cumsum()[::-1]) / (1 + null.sum())
        above = tokens[s][::-1].cumsum()[::-1]
        good = np.flatnonzero((above > 0) & (p * tokens[s].sum() <= rate * above))
        if len(good):
            cuts[-1] = int(good[0])
    return cuts


def _null(by_length: np.ndarray, length: int) -> np.ndarray:
    """Reference scores at a length, with those of ever shorter tokens until there are enough.

    Shorter ordinary tokens look more random, so borrowing from them can only hold back.
    """
    null = by_length[length].copy()
    while null.sum() < ENOUGH and length > 0:
        length -= 1
        null += by_length[length]
    return null


def find_spans(texts: list[str | None], cuts: list[int]) -> list[list[tuple[str, int, int]]]:
    """Spans of every text by start and kind; a random token inside a base span adds nothing."""
    found = [base_spans(t) if t else [] for t in texts]
    for row, start, end, s, b in _judged(list(_tokens(texts))):
        if b >= cuts[s] and not any(a <= start and end <= z for a, k, z in found[row] if k < 3):
            found[row].append((start, 3, end))
    return [[(KINDS[k], a, z) for a, k, z in sorted(spans)] for spans in found]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", cuts: list[int] | None = None) -> DataFrame:
    """``(key, spans)`` of every row; null and empty texts have none, repeated rows repeat their result."""
    cuts = fit(docs, text) if cuts is None else cuts
    pair = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            rows = find_spans(batch.column(1).to_pylist(), cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], kind)], names=["key", "spans"])

    return pair.mapInArrow(work, f"key {pair.schema['key'].dataType.simpleString()}, spans {SPANS}").select(F.col("key").alias(key), "spans")


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """``text`` with every stretch covered by spans replaced by one mask."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets masked in ``text``; every row and column stays. Null stays null."""
    cuts = fit(docs, text)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(at).to_pylist()
            clean = [masked(t, s) if s else t for t, s in zip(texts, find_spans(texts, cuts))]
            columns = batch.columns
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def op1_secrets_randomness_battery(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed("spans", BASE_KINDS), 256).alias("base_sha256"),
        listed("spans").alias("spans"), count_of("random").alias("n_random"))
