"""Counts over one whole text in UTF-8, shared by the line rules and the quality features."""

import numpy as np

#: Symbols that prose hardly uses. Fixed values of the result contract.
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUATION))


def word_chars(data: bytes) -> int:
    """Code points in words, that is outside ASCII white space."""
    return len(data.translate(None, _CONTINUATION + _SPACES))


def count_any(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more in the text, the first one included."""
    n = len(ids)
    if n < 4:
        return 0
    most = int(ids.max()) + 1
    pairs = np.unique(ids[:-2] * most + ids[1:-1], return_inverse=True)[1].reshape(-1)
    windows, counts = np.unique(pairs * most + ids[2:], return_inverse=True, return_counts=True)[1:]
    often = counts[windows.reshape(-1)] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())
