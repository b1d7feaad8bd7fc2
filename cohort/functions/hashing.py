"""Deterministic randomness: every draw is a function of the row key and a tag."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from cohort.functions.columns import column


def uniform(key: str | Column, tag: str | Column) -> Column:
    """A double in [0, 1) from the first 32 bits of ``md5(key-tag)``."""
    tag = F.lit(tag) if isinstance(tag, str) else tag.cast("string")
    digest = F.md5(F.concat(column(key).cast("string"), F.lit("-"), tag))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(key: str | Column, tag: str) -> Column:
    """A standard normal draw (Box-Muller on two uniforms of the same key)."""
    first = F.greatest(uniform(key, tag + ":r"), F.lit(2.0**-33))
    second = uniform(key, tag + ":t")
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(6.283185307179586) * second)


def exponential(key: str | Column, tag: str, scale: float) -> Column:
    return F.lit(-float(scale)) * F.log(F.lit(1.0) - uniform(key, tag))


def shuffled_order(key: str, tag: str) -> list[Column]:
    """Sort keys of a reproducible shuffle; the row key breaks hash ties."""
    return [uniform(key, tag), column(key)]


# ---------------------------------------------------------------- the same draws for a block of rows

# Constants of MD5 (RFC 1321).
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_heads(words: Sequence, n: int) -> np.ndarray:
    """First 32 bits of the MD5 of ``n`` padded messages side by side; a word is an array, or a number that all messages share."""
    word = np.uint32
    state, f, spare = [np.full(n, s, word) for s in _STATE], np.empty(n, word), len(words) // 16 - 1
    for start in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        last = start == 16 * spare
        for i in range(61 if last else 64):  # the word asked for is ready three steps before the end
            if i < 16:
                g = i
                np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            else:
                g = 7 * i % 16
                np.bitwise_or(np.invert(d, out=f), b, out=f)
                np.bitwise_xor(f, c, out=f)
            part = words[start + g]
            np.add(a, f, out=a)
            if isinstance(part, int):
                np.add(a, word((_SINES[i] + part) & 0xFFFFFFFF), out=a)
            else:
                np.add(np.add(a, part, out=a), word(_SINES[i]), out=a)
            np.left_shift(a, word(_TURNS[i]), out=f)
            np.bitwise_or(np.right_shift(a, word(32 - _TURNS[i]), out=a), f, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        if last:
            return (state[0] + b).byteswap()
        for s, v in zip(state, (a, b, c, d)):
            s += v
    raise ValueError("no words")


class Keys:
    """Row keys as text, laid out so that one draw of all rows is a few hundred steps over whole arrays.

    ``text`` holds the UTF-8 bytes of the keys end to end, ``lengths`` their sizes.
    """

    def __init__(self, text: bytes, lengths: np.ndarray):
        sizes = np.asarray(lengths, np.int64)
        self.order = np.argsort(sizes, kind="stable")
        first = np.cumsum(sizes) - sizes
        data, self.groups = np.frombuffer(text, np.uint8), []
        for size in np.unique(sizes):
            at = self.order[np.searchsorted(sizes[self.order], size):np.searchsorted(sizes[self.order], size, "right")]
            padded = np.zeros((len(at), -(-int(size) // 4) * 4), np.uint8)
            padded[:, :size] = data[first[at][:, None] + np.arange(size)]
            self.groups.append((int(size), np.ascontiguousarray(padded.view("<u4").T) if size else np.empty((0, len(at)), np.uint32)))

    def uniforms(self, tails: Sequence[str]) -> np.ndarray:
        """One line per tail: ``uniform`` of a key and tag that spell out as the row's key and this tail."""
        lanes: dict[int, list] = {}
        for t, tail in enumerate(tails):
            for g, (size, own) in enumerate(self.groups):
                rest = tail.encode()
                total = size + len(rest)
                whole = -(-(total + 9) // 64) * 64
                fixed = bytes(size) + rest + b"\x80"
                fixed += bytes(whole - 8 - len(fixed)) + (8 * total).to_bytes(8, "little")
                lanes.setdefault(whole // 4, []).append((t, g, own, [int(w) for w in np.frombuffer(fixed, "<u4")]))
        found = {}
        for count, parts in lanes.items():
            ends = np.cumsum([p[2].shape[1] for p in parts])
            words = []
            for w in range(count):
                if all(w >= len(own) for _, _, own, _ in parts) and len({fixed[w] for *_, fixed in parts}) == 1:
                    words.append(parts[0][3][w])
                    continue
                line = np.empty(ends[-1], np.uint32)
                for (_, _, own, fixed), end in zip(parts, ends):
                    line[end - own.shape[1]:end] = own[w] | np.uint32(fixed[w]) if w < len(own) else np.uint32(fixed[w])
                words.append(line)
            heads = _md5_heads(words, int(ends[-1]))
            found |= {(t, g): heads[end - own.shape[1]:end] for (t, g, own, _), end in zip(parts, ends)}
        out = np.empty((len(tails), len(self.order)))
        for t in range(len(tails)):
            out[t, self.order] = np.concatenate([found[t, g] for g in range(len(self.groups))]) / 4294967296.0
        return out

    def normals(self, suffix: str, tag: str) -> np.ndarray:
        """``normal`` of the keys followed by ``suffix``."""
        first, second = self.uniforms([f"{suffix}-{tag}:r", f"{suffix}-{tag}:t"])
        return np.sqrt(-2.0 * np.log(np.maximum(first, 2.0**-33))) * np.cos(6.283185307179586 * second)
