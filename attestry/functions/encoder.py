"""A deterministic stand-in for an embedding model: counts of hashed tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import regex


def hashed_encoder(texts: Sequence[str], dim: int = 64) -> np.ndarray:
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for tok in regex.findall(r"\p{L}+|[0-9]+", t.lower()):
            out[i, int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim] += 1
    return out
