"""Vectorised hashing of words, shingles and byte windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: A-Z to a-z, and the white space of [\x20\x09-\x0D].
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Letters, digits and all bytes beyond ASCII, for words without punctuation.
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        for name, b in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, b, U)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def forget() -> None:
    """Drops the tables of powers."""
    _POWERS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE**position; differences give polynomial hashes of any range."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=out[1:])
    return out


def words(raw: np.ndarray, offsets: np.ndarray, wordy: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and document of every word of documents that lie one after another; A-Z count as a-z."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z
    inside = WORDY[raw] if wordy else ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    ends = np.flatnonzero(last) + 1
    p = prefix(LOWER[raw])
    _, down = powers(n + 1)
    h = mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(U))
    return h, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words, document by document, and the offsets of the documents among them. A document with fewer words has its whole sequence as one; without words, none."""
    count = np.bincount(doc, minlength=n_docs).astype(np.int64)
    begin = np.zeros(n_docs + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    full = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_at = np.zeros(n_docs + 1, np.int64)
    np.cumsum(full, out=out_at[1:])
    of = np.repeat(np.arange(n_docs), full)
    at = np.arange(out_at[-1]) - out_at[of] + begin[of]
    length = np.minimum(count[of], width)
    out = length.astype(U)
    for j in range(width):
        here = at + j
        ok = j < length
        value = h[np.minimum(here, max(len(h) - 1, 0))] if len(h) else np.zeros(0, U)
        out = np.where(ok, mix(out * BASE + value), out)
    return out, out_at


def windows(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of every width bytes in a row."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    p = prefix(raw)
    _, down = powers(n)
    return mix((p[width : width + n] - p[:n]) * down)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width values in a row."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: n], x[width - have : width - have + n])
    return x
