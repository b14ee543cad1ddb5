"""Word and shingle hashes of whole Arrow text columns, vectorised over the batch.

Words are ``[^ \\t-\\r]+`` over UTF-8 bytes; A-Z may be folded to a-z. Hashes have 64 bits, so
two different values among n meet with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=_U)
_BASE, _PLACES = 0x9E3779B97F4A7C15, np.random.default_rng(21).integers(0, 2**64, 64, dtype=_U) | _U(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 16), base, _U)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and their bounds; a null text is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s with (s[j] - s[i]) * inverse_power(i) a hash of bytes i to j."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    return sums


def inverse_powers(n: int) -> np.ndarray:
    return _powers(pow(_BASE, -1, 1 << 64), n)


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words by text."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = edges[edges > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, bounds))


def word_hashes(texts: pa.Array, fold: bool = True, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words by text."""
    data, bounds = raw(texts)
    if fold:
        data = FOLD[data]
    starts, ends, counts = word_spans(data, bounds, separator)
    sums = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * inverse_powers(len(data))[starts] + (ends - starts).astype(_U) * _PLACES[63]), counts


def shingles(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """By text, its sorted distinct hashed shingles; all words are one where there are fewer."""
    words, counts = word_hashes(texts)
    n = max(len(words) - width + 1, 0)
    grams = np.zeros(n, _U)
    for k in range(width if n else 0):
        grams += words[k : k + n] * _PLACES[k]
    grams = mix(grams)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            own = np.sort(grams[at : at + count - width + 1])
            keep = np.empty(len(own), bool)
            keep[0], keep[1:] = True, own[1:] != own[:-1]
            out.append(own[keep])
        elif count:
            own = (words[at : at + count] * _PLACES[8 : 8 + count]).sum(dtype=_U) + _U(count)
            out.append(mix(np.array([own], _U)))
        else:
            out.append(np.zeros(0, _U))
        at += count
    return out
