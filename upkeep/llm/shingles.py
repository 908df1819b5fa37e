"""Vectorised word and shingle hashing on Arrow batches of texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text,
A-Z lower-cased.  Word hashes come from one prefix sum over all bytes of a
batch (a polynomial modulo 2**64 with a random value for each byte), so no
Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 1 << 22
_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
for _c in range(65, 91):
    _values[_c] = _values[_c + 32]
_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_MIX = [_U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64 by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * step
            done, step = done + more, step * step
    return out


_POWER: dict[str, np.ndarray] = {"up": powers(_BASE, 1), "down": powers(_INVERSE, 1)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER["up"]) < n:
        size = 1 << (n - 1).bit_length()
        _POWER.update(up=powers(_BASE, size), down=powers(_INVERSE, size))
    return _POWER["up"], _POWER["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _MIX[3]
        x = (x ^ (x >> _U(33))) * _MIX[4]
    return x ^ (x >> _U(33))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words in an array of bytes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = np.concatenate(([True], _space[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([_U(0)], np.cumsum(_values[raw] * up[: len(raw)], dtype=np.uint64)))
        h = (total[end] - total[start]) * down[start] + _U(1) * (end - start).astype(np.uint64) * _MIX[0]
    return start, mix(h)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5, bits: int = 64) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch.

    raw: the texts' bytes, each followed by one space; offsets: where texts begin,
    and the end.  A text with fewer words than ``width`` has its whole word
    sequence as its one shingle; a text without words has none.
    """
    start, h = word_hashes(raw)
    first = np.searchsorted(start, offsets)
    keep = _U((1 << bits) - 1)
    with np.errstate(over="ignore"):
        s = h.copy()
        for j in range(1, min(width, len(h))):
            s[: len(h) - j] = mix(s[: len(h) - j] * _MIX[1]) + h[j:]
        s = mix(s) & keep
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(s[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            x = h[a : a + 1]
            with np.errstate(over="ignore"):
                for j in range(a + 1, b):
                    x = mix(x * _MIX[2]) + h[j : j + 1]
                out.append(mix(x ^ _U(b - a)) & keep)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array as bytes with a space after each text; null: empty."""
    parts, offsets, at = [], [0], 0
    for t in texts:
        b = t.as_py().encode() if t.is_valid else b""
        parts += (b, b" ")
        at += len(b) + 1
        offsets.append(at)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(offsets, dtype=np.int64)
