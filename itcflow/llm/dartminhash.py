"""Weighted signatures by thrown darts (DartMinHash).

A document is a weighted set. Its elements are hashes of ``n`` consecutive
lower-cased words; an element's weight is 1, or how often it occurs. Every
element owns a strip of the (weight, rank) plane, cut into cells of one weight
unit. Darts land in a cell as a Poisson process along the rank axis: the gaps
between ranks are exponential draws from hashes of (element, cell, dart
number), so the same darts fall in every document that holds the element. A
dart counts if its weight coordinate lies under the element's weight; it
belongs to one of ``k`` coordinates, and the earliest dart of each coordinate
is that coordinate's value. Two documents agree in a coordinate with a
probability equal to their weighted Jaccard similarity.

Darts are thrown only up to rank ``(k ln k + 2k) / total weight``: about
``k ln k + 2k`` a document however long it is. A document that leaves a
coordinate empty is thrown again with twice the rank, so the result never
depends on the limit.

The functions work on a block of documents at once, so that the numpy calls
are paid per block and not per document.
"""

from __future__ import annotations

import math

import numpy as np

K = 80
BAND = 4
SHINGLE = 5

#: Bytes of text that are hashed in one numpy call; each worker holds tables of 32 times as much.
BLOCK = 1 << 18

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_UNIT = 2.0 ** -53

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, others unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * _UNIT


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), mod 2**64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = 0xD1342543DE82EF95
_UP = _powers(_BASE, 2 * BLOCK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 2 * BLOCK)


def lower(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode("utf-8")


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every run of ``[^\\x20\\x09-\\x0D]+``: differences of
    one running polynomial sum, shifted back to position 0."""
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not _IS_SPACE[text[end]]:  # to the end of the word
            end += 1
        if end - at > len(_UP):  # one very long word
            hashes.append(_long_words(text[at:end]))
            starts.append(at + _word_starts(text[at:end]))
            at = end
            continue
        b = np.frombuffer(text, np.uint8, end - at, at)
        first, last = _bounds(b)
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _UP[:len(b)], out=run[1:])
        hashes.append(mix((run[last] - run[first]) * _DOWN[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[b]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _word_starts(text: bytes) -> np.ndarray:
    return _bounds(np.frombuffer(text, np.uint8))[0]


def _long_words(text: bytes) -> np.ndarray:
    """The same hashes one word at a time, for words longer than a block."""
    out = []
    for w in text.split():
        total, shift = 0, 1
        for i in range(0, len(w), BLOCK):
            b = np.frombuffer(w, np.uint8, min(BLOCK, len(w) - i), i)
            total += shift * int(np.sum(_BYTE[b] * _UP[:len(b)], dtype=np.uint64))
            shift = shift * pow(_BASE, len(b), 1 << 64) % (1 << 64)
        out.append((total + len(w)) % (1 << 64))
    return mix(np.array(out, np.uint64))


def elements(texts: list[bytes], n: int = SHINGLE):
    """For each text the sorted distinct shingle hashes and their counts.
    Fewer than ``n`` words make one shingle of all of them; no word, none."""
    block, at = b"\n".join(texts), np.cumsum([0] + [len(t) + 1 for t in texts])
    h, start = word_hashes(block)
    cut = np.searchsorted(start, at)
    windows = max(0, len(h) - n + 1)
    rolled = np.full(windows, np.uint64(n), np.uint64)
    for i in range(n):
        rolled = mix(rolled * _GOLD + h[i:i + windows])
    out = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(rolled[lo:hi - n + 1], return_counts=True))
        elif hi > lo:
            x = np.full(1, np.uint64(hi - lo), np.uint64)
            for i in range(lo, hi):
                x = mix(x * _GOLD + h[i:i + 1])
            out.append((x, np.ones(1, np.int64)))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """One row of ``k`` values for each (elements, weights > 0); no set may be empty."""
    size = np.array([len(e) for e, _ in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    el = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    cells = np.ceil(weight).astype(np.int64)
    if cells.max() > 1:
        number = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        el, doc, weight = np.repeat(el, cells), np.repeat(doc, cells), np.repeat(weight, cells) - number
        cell = mix(el + _GOLD * (number + 1).astype(np.uint64))
    else:
        cell = mix(el + _GOLD)
    total = np.bincount(doc, np.minimum(weight, 1.0), len(sets))
    limit = (k * math.log(k) + 2 * k) / total
    out = np.empty((len(sets), k), np.uint64)
    todo = np.ones(len(sets), bool)
    while todo.any():
        take = todo[doc]
        won, full = _winners(cell[take], doc[take], weight[take], limit, len(sets), k)
        done = todo & full
        out[done] = won[done]
        todo &= ~full
        limit = limit * 2
    return out


def _winners(cell, doc, top, limit, docs, k):
    """The earliest dart of each (document, coordinate); which documents have all."""
    early = np.full(docs * k, np.inf)
    best = np.full(docs * k, np.iinfo(np.uint64).max, np.uint64)
    rank, found, throw = np.zeros(len(cell)), [], 0
    while len(cell):
        throw += 1
        dart = mix(cell + np.uint64(2 * throw * int(_M2) % (1 << 64)))
        rank = rank - np.log1p(-unit(mix(dart ^ _GOLD)))
        live = rank <= limit[doc]
        cell, doc, top, rank, dart = cell[live], doc[live], top[live], rank[live], dart[live]
        under = np.ones(len(dart), bool) if len(top) and top.min() >= 1 else unit(mix(dart + _M1)) < top
        slot = doc[under] * k + (dart[under] % np.uint64(k)).astype(np.int64)
        found.append((slot, rank[under], dart[under]))
    slot, when, dart = (np.concatenate(x) for x in zip(*found, strict=True))
    np.minimum.at(early, slot, when)
    first = when == early[slot]
    np.minimum.at(best, slot[first], dart[first])
    return best.reshape(docs, k), np.isfinite(early).reshape(docs, k).all(axis=1)


def bands(sig: np.ndarray, size: int = BAND) -> np.ndarray:
    """One 64-bit key for every ``size`` consecutive coordinates of each row."""
    s = sig.reshape(len(sig), -1, size)
    out = np.arange(1, s.shape[1] + 1, dtype=np.uint64) * _M2 + np.zeros((len(sig), 1), np.uint64)
    for i in range(size):
        out = mix(out * _GOLD + s[:, :, i])
    return out
