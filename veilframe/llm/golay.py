"""The perfect binary Golay code [23, 12, 7] over numpy integer arrays.

A 23-bit word is a message of 12 high bits and 11 parity bits. Every word lies within distance 3
of exactly one codeword, and a word at distance 3 has five more codewords at distance 4. Two words
that differ in at most two bits share a codeword within distance 4 of both (the codeword nearest
to a word halfway between them), which is what the keys rest on.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    parity = np.array([remainder(m << 11) for m in range(4096)], np.uint32)
    lead = np.zeros(2048, np.uint32)
    far = np.zeros((2048, 5), np.uint32)
    deep = np.zeros(2048, bool)
    filled = np.zeros(2048, int)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            syndrome = (error & 0x7FF) ^ int(parity[error >> 11])
            if weight < 4:
                lead[syndrome], deep[syndrome] = error, weight == 3
            else:
                far[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return parity, lead, far, deep


def nearby_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per 23-bit word, the 12-bit indices of all codewords within distance 4: (n, 6), and which are real."""
    parity, lead, far, deep = _tables()
    words = words.astype(np.uint32)
    syndrome = (words & np.uint32(0x7FF)) ^ parity[words >> np.uint32(11)]
    index = np.empty((len(words), 6), np.int64)
    index[:, 0] = (words ^ lead[syndrome]) >> np.uint32(11)
    index[:, 1:] = (words[:, None] ^ far[syndrome]) >> np.uint32(11)
    real = np.ones((len(words), 6), bool)
    real[:, 1:] = deep[syndrome][:, None]
    return index, real
