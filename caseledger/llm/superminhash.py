"""Word shingles and SuperMinHash signatures of whole texts, in numpy over batches of documents."""

import numpy as np
import xxhash

from .shared import mixed

_U = np.uint64
_COEFFICIENTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SHORT = 0xE7037ED1A0B428DB
#: Shingles hashed at once: bounds the memory of a batch, not what is read.
_AT_ONCE = 262_144


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    Words are lower-cased in A-Z and cut at ASCII white space. A text with fewer words than
    `width` is one shingle; a text without words has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter(map(digest, words), _U, len(words))
    powers = _coefficients(width)
    n = len(words) - width + 1
    if n < 1:
        total = (hashed * powers[: len(words)]).sum(dtype=_U, keepdims=True)
        return mixed(total + _U(len(words) * _SHORT % 2**64))
    total = hashed[:n] * powers[0]
    for k in range(1, width):
        total = total + hashed[k : n + k] * powers[k]
    return np.unique(mixed(total))


def _coefficients(width: int) -> np.ndarray:
    first = np.array(_COEFFICIENTS, _U)
    if width <= len(first):
        return first[:width]
    more = mixed(np.arange(width - len(first), dtype=_U) + _U(_SHORT)) | _U(1)
    return np.concatenate([first, more])


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that are equal for equal sets."""
    one = mixed(hashes ^ _U(_SHORT)).sum(dtype=_U)
    two = np.bitwise_xor.reduce(mixed(hashes + _U(_COEFFICIENTS[0]))) if len(hashes) else _U(0)
    return int(one.view(np.int64)), int(two.view(np.int64))


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values per set. Empty sets get rows of infinity.

    Every element walks through its own pseudorandom permutation of the m places. At step j it
    offers j + u, u in [0, 1), to the place its permutation names. Steps are taken for all
    elements of a document together, and a document stops as soon as its largest value is at most
    the next step: nothing later could be smaller. Long texts stop after one or two steps.
    """
    out = np.full((len(sets), m), np.inf)
    start, total = 0, 0
    for i, s in enumerate(sets):
        total += len(s)
        if total >= _AT_ONCE or i == len(sets) - 1:
            _fill(out[start : i + 1], sets[start : i + 1], m)
            start, total = i + 1, 0
    return out


def _draw(x: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    r = mixed(x + _U((2 * j + 1) * _COEFFICIENTS[0] % 2**64))
    value = j + (r >> _U(11)).astype(np.float64) * 2.0**-53
    k = mixed(x + _U((2 * j + 2) * _COEFFICIENTS[0] % 2**64)) >> _U(32)
    return value, j + ((k * _U(m - j)) >> _U(32)).astype(np.int64)


def _fill(out: np.ndarray, sets: list[np.ndarray], m: int) -> None:
    flat = out.reshape(-1)
    x = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(x):
        return
    value, swap = _draw(x, 0, m)
    np.minimum.at(flat, of * m + swap, value)
    places = None
    for j in range(1, m):
        busy = (out.max(axis=1) > j)[of]
        if not busy.any():
            return
        if places is None:
            x, of, swap = x[busy], of[busy], swap[busy]
            places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            _swap(places, 0, swap)
        elif not busy.all():
            x, of, places = x[busy], of[busy], places[busy]
        value, swap = _draw(x, j, m)
        _swap(places, j, swap)
        np.minimum.at(flat, of * m + places[:, j], value)


def _swap(places: np.ndarray, j: int, k: np.ndarray) -> None:
    rows = np.arange(len(places))
    held = places[:, j].copy()
    places[:, j] = places[rows, k]
    places[rows, k] = held


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` consecutive places."""
    bits = np.ascontiguousarray(signature).view(_U)
    bands = bits.shape[1] // rows
    bits = bits[:, : bands * rows].reshape(len(bits), bands, rows)
    total = np.zeros(bits.shape[:2], _U)
    for k in range(rows):
        total = mixed(total * _U(_COEFFICIENTS[1]) + bits[:, :, k])
    return mixed(total + np.arange(bands, dtype=_U)).view(np.int64)
