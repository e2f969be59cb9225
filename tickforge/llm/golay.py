"""Binary Golay code (23, 12, 7): nearby codewords of 23-bit words, by table."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _mod(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 12 message bits, and per syndrome the errors to nearby codewords.

    The code is perfect: a syndrome belongs to one error of at most three bits. If
    that error has three bits, the next codewords are five errors of four bits away.
    Unused places hold -1.
    """
    single = [_mod(1 << i) for i in range(23)]
    high = np.zeros(4096, np.int64)
    for m in range(4096):
        for i in range(12):
            if m >> i & 1:
                high[m] ^= single[i + 11]
    errors: list[list[int]] = [[] for _ in range(2048)]
    for size in range(5):
        for bits in combinations(range(23), size):
            s = e = 0
            for b in bits:
                s ^= single[b]
                e |= 1 << b
            if size < 4 or errors[s][0].bit_count() == 3:
                errors[s].append(e)
    near = np.full((2048, 6), -1, np.int64)
    for s, found in enumerate(errors):
        near[s, :len(found)] = found
    return high, near


def indices(word: np.ndarray) -> np.ndarray:
    """Codeword indices (n, 6) near each 23-bit word, -1 where there are fewer.

    Two words that differ in at most two bits share an index: either both decode to
    the same codeword, or the word between them has a codeword within distance three,
    which is within four of both and so listed by each (words within two of their
    own codeword have all words at distance two list it too).
    """
    high, near = tables()
    syndrome = high[word >> 11] ^ (word & 2047)
    errors = near[syndrome]
    return np.where(errors < 0, -1, (word[:, None] ^ errors) >> 11)
