"""Code points of many texts at once."""

from __future__ import annotations

import sys

import numpy as np


def codepoints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points (uint32) of UTF-8 bytes and where each text begins among them (one offset more than texts)."""
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    order = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
    return np.frombuffer(data.tobytes().decode("utf-8").encode(order), np.uint32), begins[at]


def _letter(cp: int) -> int:
    c = chr(cp)
    if not c.isalpha():
        return 32
    low = c.lower()
    return ord(low) if len(low) == 1 else cp


_TABLE: list[np.ndarray] = []


def letters_only(points: np.ndarray) -> np.ndarray:
    """Letters in lower case; everything else is a space."""
    if not _TABLE:
        _TABLE.append(np.array([_letter(cp) for cp in range(1 << 16)], np.uint32))
    out = _TABLE[0][np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        out[high] = [_letter(int(cp)) for cp in points[high]]
    return out
