"""Content-chosen anchors of all fixed-length strings of a text, inside a task.

Every string of ``length`` bytes has one anchor: the short gram of least hash in it (the
leftmost of equal ones). The strings of a text with one anchor stand in a row and make a
segment. Equal strings have equal anchors at equal places, so only segments with the
same anchor need be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tallyframe.llm.shingles import mix

#: Bytes of an anchor. Long ones seldom stand in two places by chance.
GRAM = 48
_POSITION = np.uint64((1 << 20) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURNED = mix(np.arange(1000, 1256, dtype=np.uint64) * _BASE)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class _Rolling:
    """Polynomial hashes of all substrings of a length, built by doubling."""

    def __init__(self, data: np.ndarray):
        self.by = {1: _BYTE[data]}

    def of(self, n: int) -> np.ndarray:
        if n not in self.by:
            low = 1 << (n.bit_length() - 1)
            if low == n:
                h = self.of(n // 2)
                self.by[n] = h[: len(h) - n // 2] * _power(n // 2) + h[n // 2 :]
            else:
                a, b = self.of(low), self.of(n - low)
                m = len(self.by[1]) - n + 1
                self.by[n] = a[:m] * _power(n - low) + b[low : low + m]
        return self.by[n]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, n = 1, len(x) - width + 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n]) if have < width else x[:n]


def _strings(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each gram, place of each string's anchor, hash of each string)."""
    rolling = _Rolling(data)
    grams = mix(rolling.of(GRAM))
    order = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    return grams, (_least(order, length - GRAM + 1) & _POSITION).astype(np.int64), rolling.of(length)


def _segments(grams: np.ndarray, place: np.ndarray, whole: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments of the strings that start at ``at``; a gap there changes the place."""
    place = place[at]
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    count = np.diff(np.append(cut, len(place)))
    start, place = at[cut], place[cut]
    # Two strings cover a segment, as it has fewer strings than a string has bytes.
    content = mix(whole[start] * np.uint64(0xD6E8FEB86659FD93) + mix(whole[start + count - 1]) + (count + 128 * (place - start)).astype(np.uint64))
    return grams[place], content, start, count


def pieces(data: np.ndarray, length: int = 100) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, content, start, count) of each segment of the bytes ``data``: 64-bit hashes
    of the anchor and of all bytes of the segment, first string, number of strings; about a
    mebibyte of the bytes at a time."""
    step = (1 << 20) - 2 * length
    for at in range(0, max(1, len(data) - length + 1), step):
        part = data[at : at + step + length - 1]
        if len(part) < length:
            break
        grams, place, whole = _strings(part, length)
        anchor, content, start, count = _segments(grams, place, whole, np.arange(len(place)))
        yield anchor, content, start + at, count


def segments(data: np.ndarray, length: int = 100) -> tuple[np.ndarray, ...]:
    """All ``pieces`` of ``data`` in one."""
    out = [*pieces(data, length)]
    if not out:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined_segments(texts: list[bytes], length: int = 100) -> tuple[np.ndarray, ...]:
    """(text, anchor, content, start, count): the ``segments`` of short texts, each of
    ``length`` bytes or more, together fewer than 2^20, in one pass over all their bytes."""
    sizes = np.array([len(t) for t in texts])
    begins = sizes.cumsum() - sizes
    grams, place, whole = _strings(np.frombuffer(b"".join(texts), np.uint8), length)
    inside = np.ones(len(place) + length - 1, bool)  # strings over the end of a text are none
    for back in range(1, length):
        inside[begins + sizes - back] = False
    anchor, content, start, count = _segments(grams, place, whole, np.flatnonzero(inside))
    text = np.searchsorted(begins, start, "right") - 1
    return text, anchor, content, start - begins[text], count


class _Cyclic(_Rolling):
    """The same by rotation and exclusive or: no two strings for which the polynomial's
    differences share a factor are the worse for it here."""

    def __init__(self, data: np.ndarray):
        self.by = {1: _TURNED[data]}

    def of(self, n: int) -> np.ndarray:
        if n not in self.by:
            low = 1 << (n.bit_length() - 1)
            left, right = (n // 2, n // 2) if low == n else (low, n - low)
            a, b, turn = self.of(left), self.of(right), np.uint64(right % 64)
            m = len(self.by[1]) - n + 1
            a = a[:m]
            a = a << turn | a >> (np.uint64(64) - turn) if turn else a
            self.by[n] = a ^ b[left : left + m]
        return self.by[n]


def string_hashes(data: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every string of ``length`` bytes, of unlike constructions and
    with tables of their own."""
    return mix(_Rolling(data).of(length)), mix(_Cyclic(data).of(length))
