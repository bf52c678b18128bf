"""64-bit hashes of words and word runs, vectorised over a chunk of texts."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: each input bit reaches all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, by rule.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Odd bases of polynomial hashes modulo 2 ** 64, and their inverses.
BASES = tuple((int(mix(np.array([k], np.uint64))[0]) << 1 | 1) & (1 << 64) - 1 for k in (101, 202))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2 ** 64; kept by a worker and grown as needed."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix_sums(values: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """S so that (S[b] - S[a]) * base ** -a is the polynomial hash of values[a:b]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    back = powers(inverse(base), len(sums))
    return mix((sums[end] - sums[start]) * back[start])


def token_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that ``inside`` marks, and how many runs each text has."""
    solid = inside[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    closes[last] = solid[last]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def anchored(hashes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor.

    ``hashes`` has one for each run of ``gram`` symbols, ``offsets`` where texts begin.  A
    window of ``length`` symbols has as anchor its gram with the smallest hash, the leftmost of
    equals, so equal windows have equal anchors at equal places.  Returns text number, first
    window's start, number of windows and the anchor's place, for each run inside a text.
    """
    none = np.zeros(0, np.int64)
    width, among = 1, length - gram + 1
    if len(hashes) < among:
        return none, none, none, none
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    while 2 * width <= among:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < among:
        least = np.minimum(least[: width - among], least[among - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(offsets[1:] - length + 1, offsets[:-1]) - offsets[:-1]
    start = np.arange(sizes.sum()) + np.repeat(offsets[:-1] - np.cumsum(sizes) + sizes, sizes)
    if not len(start):
        return none, none, none, none
    place = at[start]
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    first = start[cuts]
    return np.searchsorted(offsets, first, side="right") - 1, first, np.diff(np.append(cuts, len(start))), place[cuts]


def class_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes of one kind other than 0, and how many each text has."""
    kinds = kind[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    cuts = np.flatnonzero(begins)
    ends = np.append(cuts[1:], len(data))
    solid = kinds[cuts] > 0
    starts, ends = cuts[solid], ends[solid]
    return starts, ends, np.diff(np.searchsorted(starts, offsets))
