"""Personal data by anchor expansion.

An Aho-Corasick automaton walks the whole text once and stops at anchors: at-signs, plus
signs, digits, scheme marks and identifier cues. Beside each anchor a small parser reads the
longest span its rules allow and checks it. Parsers only ever move right, so the work is one
pass however long a text is and however many anchors it holds.

Kinds: email, ip, card (Luhn), phone; and, added by cues and schemes, login (user part of a
URL), iban (mod 97), ssn and account.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohort.llm.text import process_cache, read_table, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "ssn", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"
_ORDER = {k: n for n, k in enumerate(KINDS)}

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LABEL = _ALNUM | {"-"}
_LOCAL = _ALNUM | frozenset("._%+-")
_PHONE = _DIGITS | frozenset(" ().-")
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "passport": "account", "konto": "account"}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in _DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue, kind in _CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_machine = process_cache("pii")


def _luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if at % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(text, at + 1, _LABEL)
    if end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, _LABEL)
        if stop == end + 1:
            break
        end, labels = stop, labels + 1
    return (start, end) if labels else None


def _groups(text: str, at: int, joints: str) -> list[tuple[int, int]]:
    """Runs of digits from ``at``, joined by single characters of ``joints``."""
    found = []
    while True:
        end = _run(text, at, _DIGITS)
        found.append((at, end))
        if end + 1 < len(text) and text[end] in joints and text[end + 1] in _DIGITS:
            at = end + 1
        else:
            return found


def _small(digits: str) -> bool:
    """At most 255, whatever the leading zeros."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def _phone(text: str, at: int) -> tuple[int, int] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in _DIGITS:
        return None
    return (at, end) if 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15 else None


def _login(text: str, end: int, width: int) -> tuple[int, int] | None:
    start = end - width
    while start > 0 and text[start - 1] in _ALNUM | frozenset("+.-"):
        start -= 1
    stop = end
    while stop < len(text) and not text[stop].isspace() and text[stop] not in "/?#\"'<>":
        stop += 1
    user, at, host = text[end:stop].rpartition("@")
    if start == end - width or not at or not user or not host or host[0] not in _ALNUM:
        return None
    return start, end + len(user) + 1 + _run(host, 0, _LABEL | frozenset(".:"))


def _iban(value: str) -> bool:
    if not (15 <= len(value) <= 34 and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _after_cue(text: str, end: int, kind: str) -> tuple[int, int] | None:
    """The identifier that follows a cue: a few signs or words like ``no`` between them."""
    at, limit = end, min(len(text), end + 16)
    for word in ("number", "Number", "no", "No", "nummer"):
        skip = _run(text, at, frozenset(" :#=.\t"))
        if text.startswith(word, skip):
            at = skip + len(word)
            break
    at = _run(text, at, frozenset(" :#=.\t"))
    if at >= limit or at >= len(text) or at == end:
        return None
    if kind == "iban":
        stop, last = at, at
        while stop < len(text) and stop - at < 42 and (text[stop] in _ALNUM or text[stop] == " " and stop + 1 < len(text) and text[stop + 1] in _ALNUM):
            stop += 1
            if text[stop - 1] != " " and _iban(text[at:stop].replace(" ", "").upper()):
                last = stop
        return (at, last) if last > at else None
    groups = _groups(text, at, "-" if kind == "ssn" else " -") if text[at] in _DIGITS else []
    if not groups:
        return None
    sizes, stop = [b - a for a, b in groups], groups[-1][1]
    if kind == "ssn":
        return (at, stop) if sizes in ([3, 2, 4], [9]) else None
    return (at, stop) if 8 <= sum(sizes) <= 20 else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, in code points, ordered by start and then by kind."""
    if "anchors" not in _machine:
        _machine["anchors"] = _automaton()
    found: set[tuple[int, int, str, int]] = set()

    def add(kind: str, span: tuple[int, int] | None) -> None:
        if span:
            found.add((span[0], _ORDER[kind], kind, span[1]))

    mail, dotted, carded = 0, 0, 0
    for last, (anchor, width) in _machine["anchors"].iter(text):
        if anchor == "digit":
            if last >= dotted:
                groups = _groups(text, last, ".")
                for k in range(0, len(groups) - 3, 4):
                    if all(_small(text[a:b]) for a, b in groups[k: k + 4]):
                        add("ip", (groups[k][0], groups[k + 3][1]))
                dotted = groups[-1][1]
            if last >= carded:
                groups = _groups(text, last, " -")
                carded = groups[-1][1]
                digits = "".join(text[a:b] for a, b in groups)
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    add("card", (last, carded))
        elif anchor == "at":
            span = _email(text, last, mail)
            if span:
                mail = span[1]
                add("email", span)
        elif anchor == "plus":
            add("phone", _phone(text, last))
        elif anchor == "scheme":
            add("login", _login(text, last + 1, width))
        else:
            add(anchor, _after_cue(text, last + 1, anchor))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)`` for every row; other columns, whatever their names, are not read.

    A null or empty text has no spans. Rows are independent: repeated rows give repeated
    results and a null key stays null.
    """
    pair = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["key", "spans"])

    found = pair.mapInArrow(work, f"key {pair.schema['key'].dataType.simpleString()}, spans {SPANS}")
    return found.select(F.col("key").alias(key), "spans")


def listed(spans: Column | str, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` joined by commas, in the order of the array."""
    column = F.col(spans) if isinstance(spans, str) else spans
    if kinds:
        column = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op9_pii_anchor_expansion(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed("spans", BASE_KINDS), 256).alias("base_sha256"),
        listed("spans").alias("spans"), (F.size("spans") > 0).alias("has_pii"))
