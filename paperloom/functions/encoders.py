"""Text encoders that can be handed to the embedding operator.

An encoder is a factory: called once in every Python worker, it returns
``encode(list[str]) -> ndarray[n, width]``. A model-backed encoder loads its weights there.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import regex

from paperloom.constants import EMBEDDING_WIDTH, MAX_TOKENS

Encode = Callable[[Sequence[str]], np.ndarray]
EncoderFactory = Callable[[], Encode]

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")


def hash_encoder(width: int = EMBEDDING_WIDTH, max_tokens: int = MAX_TOKENS) -> EncoderFactory:
    """A stand-in for a model: each token is a one-hot slot, pooled by mean, unit length.

    A text longer than the ``max_tokens`` that a model takes at a time is encoded window by
    window, all of them, and the windows' means are weighted by their tokens. It exercises
    batching, windows, pooling and storage. It knows nothing of meaning, so
    its search quality says nothing about a model's.
    """

    def load() -> Encode:
        @functools.lru_cache(maxsize=200_000)
        def slot(token: str) -> int:
            return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % width

        def encode(texts: Sequence[str]) -> np.ndarray:
            pooled = np.zeros((len(texts), width), dtype=np.float64)
            for row, text in enumerate(texts):
                slots = [slot(token) for token in _TOKEN.findall(text.lower())]
                for start in range(0, len(slots), max_tokens):
                    window = slots[start : start + max_tokens]
                    mean = np.bincount(window, minlength=width) / len(window)
                    pooled[row] += mean * (len(window) / len(slots))
            length = np.linalg.norm(pooled, axis=1, keepdims=True)
            return (pooled / np.maximum(length, 1e-12)).astype(np.float32)

        return encode

    return load
