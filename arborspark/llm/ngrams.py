"""Vectorised n-gram features of whole texts, as numpy arrays of hashed indices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PIECE = 1 << 16
_powers: list[np.ndarray] = []

#: Character classes of the shape of a text: letters by case, digits, blanks, line ends; other bytes are their own class.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[128:] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[[9, 11, 12, 13, 32]] = 4

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(_PIECE + 1, _P, np.uint64)) * np.uint64(pow(int(_P), -1, 1 << 64))
            inv = np.uint64(pow(int(_P), -1, 1 << 64))
            down = np.cumprod(np.full(_PIECE + 1, inv, np.uint64)) * _P
        _powers.extend((up, down))
    return _powers[0], _powers[1]


def pieces(raw: bytes) -> Iterator[np.ndarray]:
    """The bytes in pieces that end behind white space where that is possible."""
    at = 0
    while len(raw) - at > _PIECE:
        end = max(raw.rfind(b" ", at, at + _PIECE), raw.rfind(b"\n", at, at + _PIECE)) + 1
        end = end if end > at else at + _PIECE
        yield np.frombuffer(raw, np.uint8, end - at, at)
        at = end
    if len(raw) > at:
        yield np.frombuffer(raw, np.uint8, len(raw) - at, at)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    return edge[::2], edge[1::2]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, by sums of powers; the same bytes have the same hash anywhere."""
    up, down = powers()
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
        return (total[ends] - total[starts]) * down[starts]


def fold(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - bits)).astype(np.int64)


def word_prefixes(text: str, bits: int, lengths: tuple[int, ...] = (4, 5, 6, 7, 8, 9, 10, 12)) -> Iterator[np.ndarray]:
    """Hashed words and word beginnings of a text in lower case, occurrence by occurrence."""
    for b in pieces(text.lower().encode()):
        starts, ends = spans(_LETTER[b])
        if not len(starts):
            continue
        yield fold(span_hashes(b, starts, ends), 1, bits)
        for k in lengths:
            long = ends - starts > k
            s = starts[long]
            yield fold(span_hashes(b, s, s + k), 1 + k, bits)


def shape_ngrams(text: str, bits: int, most: int = 4) -> Iterator[np.ndarray]:
    """Hashed n-grams over the runs of character classes, over bytes, and over runs of one word.

    What an n-gram needs from before a cut is carried over it: the last runs, the last
    byte, and the last word with its number of repetitions.
    """
    runs_before, byte_before = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    word, times = None, 0
    for b in pieces(text.encode()):
        shape = _SHAPE[b]
        runs = shape[np.concatenate(([True], shape[1:] != shape[:-1]))].astype(np.uint64)
        if len(runs_before) and runs_before[-1] == runs[0]:
            runs = runs[1:]
        for n in range(1, most + 1):
            seq = np.concatenate((runs_before[len(runs_before) - min(n - 1, len(runs_before)) :], runs))
            if len(seq) >= n:
                h = seq[: len(seq) - n + 1]
                for k in range(1, n):
                    h = h * np.uint64(257) + seq[k : len(seq) - n + 1 + k]
                yield fold(h, n, bits)
        runs_before = np.concatenate((runs_before, runs))[-(most - 1) :]
        wide = np.concatenate((byte_before, b.astype(np.uint64)))
        if len(wide) > 1:
            yield fold(wide[:-1] * np.uint64(256) + wide[1:], 16, bits)
        byte_before = wide[-1:]
        starts, ends = spans(_WORD[b])
        if len(starts):
            w = span_hashes(b, starts, ends)
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            long = np.diff(np.append(first, len(w)))
            if word is not None and word == w[0]:
                long[0] += times
            elif times > 1:
                yield fold(np.array([min(times - 1, 6)], np.uint64), 17, bits)
            word, times = w[-1], int(long[-1])
            done = long[:-1][long[:-1] > 1]
            if len(done):
                yield fold(np.minimum(done - 1, 6).astype(np.uint64), 17, bits)
    if times > 1:
        yield fold(np.array([min(times - 1, 6)], np.uint64), 17, bits)


def indicators(features: Iterator[np.ndarray], mark: np.ndarray) -> np.ndarray:
    """The distinct indices; ``mark`` is a table of zeros, left as it was."""
    for x in features:
        mark[x] = 1
    found = np.flatnonzero(mark)
    mark[found] = 0
    return found
