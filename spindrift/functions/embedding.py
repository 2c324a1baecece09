"""A deterministic stand-in for an embedding model: signed hashes of words."""

from __future__ import annotations

import re
import zlib

import numpy as np

DIMENSION = 64


def hash_embed(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors; every word adds 1 or -1 to one component. A text without words is zero."""
    out = np.zeros((len(texts), dimension))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"[a-z0-9]+", text.lower()):
            h = zlib.crc32(word.encode())
            row[h % dimension] += 1 if h & 0x80000000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)
