"""Vectorised text kernels on UTF-8 bytes: words, rolling hashes of words and shingles."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed odd multipliers of the hashes.
BASE, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


#: A 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=U) * BASE)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse's powers modulo 2**64, for i up to n."""
    if len(_powers["up"]) <= n:
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            row = np.full(n + 1, b, U)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes in class `inside` (256 booleans); runs end where texts end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = mask[cut]
    last[cut - 1] = mask[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span (spans in order, not overlapping); equal bytes, equal hash, at any place."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + PIECE, "right")))
        hi = int(end[to - 1])
        up, down = powers(max(PIECE, hi - lo))
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return mix(out)


def windows(words: np.ndarray, of: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one text: (hash, text index, first word's index).

    words: word hashes in order; of: the text of each. A text with fewer words but one at least has one window: all its words.
    """
    n = len(words)
    count = np.bincount(of, minlength=n_docs)
    if n >= size:
        h = np.zeros(n - size + 1, U)
        for k in range(size):
            h += words[k : n - size + 1 + k] * mix(np.array([k + 1], U))[0]
        whole = of[: n - size + 1] == of[size - 1 :]
        at = np.flatnonzero(whole)
        h, doc = h[at], of[at]
    else:
        h, doc, at = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)[:-1]])[short]
        more = np.zeros(len(short), U)
        for k in range(size - 1):
            has = count[short] > k
            more[has] += words[first[has] + k] * mix(np.array([k + 1], U))[0]
        more += count[short].astype(U) * BASE
        h, doc, at = np.concatenate([h, more]), np.concatenate([doc, short]), np.concatenate([at, first])
        order = np.argsort(doc, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
    return mix(h), doc, at


def doc_words(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, word hashes and the text of each word."""
    low = LOWER[data]
    start, end = word_spans(low, off, ~SPACE if inside is None else inside)
    of = np.searchsorted(off, start, "right") - 1
    return low, start, end, span_hashes(low, start, end), of
