"""Vectorised 64-bit hashes of byte and word windows, shared by the duplicate-search operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
ODD = U(0xBF58476D1CE4E5B9)
_BYTES = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(29)
    x *= ODD
    x ^= x >> U(32)
    return x


def window_hash(x: np.ndarray, k: int, base: int = int(ODD)) -> np.ndarray:
    """Polynomial hash of every ``k`` neighbours; one entry per window start."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, size, power, width = None, 0, x, 1
    while True:
        if k & width:
            if out is None:
                out, size = power, width
            else:
                m = len(x) - size - width + 1
                out = out[:m] * U(pow(base, width, 2**64)) + power[size : size + m]
                size += width
        if 2 * width > k:
            return mix(out[:n])
        m = len(power) - width
        power = power[:m] * U(pow(base, width, 2**64)) + power[width : width + m]
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def byte_hash(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes, or of one text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without 09-0D and 20) of the texts, and the number of words of each."""
    found, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for at, to in chunks(texts):
        data = np.frombuffer(b"\n".join(texts[at:to]) + b"\n", np.uint8)
        if lower:
            data = _LOWER[data]
        inside = ~_SPACE[data]
        edge = np.diff(inside.view(np.int8), prepend=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        lens = stops - starts
        powers = np.full(int(lens.max()), ODD)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        at_byte = np.flatnonzero(inside)
        first = np.cumsum(lens) - lens
        offset = np.arange(len(at_byte)) - np.repeat(first, lens)
        sums = np.add.reduceat(_BYTES[data[at_byte]] * powers[offset], first)
        found.append(mix(sums + lens.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        counts[at:to] = np.diff(np.searchsorted(starts, ends), prepend=0)
    return np.concatenate(found), counts


def six_bytes(keys: np.ndarray) -> bytes:
    """The lower 48 bits of every key."""
    return np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def bucket_bounds(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, equal ranges of the upper 32 bits, begin and end in sorted keys."""
    upper = (sorted_keys >> U(32)) * U(buckets) >> U(32)
    return np.searchsorted(upper, np.arange(buckets + 1, dtype=np.uint64))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; those that overlap or touch become one."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]
