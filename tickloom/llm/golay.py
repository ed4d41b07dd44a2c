"""The binary Golay code of length 23: every word has one codeword within three bits, and few more within four.

Two words that differ in at most one bit share a codeword: the nearest one of the first lies within four bits of the
second. So a word is stored under its nearest codeword and looked up under all that lie within four bits: six of them
where the nearest is three bits away, one otherwise.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DATA_BITS, REACH = 23, 12, 4
CHECK_BITS = LENGTH - DATA_BITS
#: Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Codewords within ``REACH`` bits of a word, at most.
MOST_NEAR = 6


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECK_BITS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits of the upper twelve bits; by syndrome, the errors of at most ``REACH`` bits, lightest first, and their number."""
    checks = np.array([_remainder(m << CHECK_BITS) for m in range(1 << DATA_BITS)], dtype=np.int64)
    single = [_remainder(1 << b) for b in range(LENGTH)]
    errors = np.zeros((1 << CHECK_BITS, MOST_NEAR), dtype=np.int64)
    found = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(REACH + 1):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            errors[syndrome, found[syndrome]] = sum(1 << b for b in bits)
            found[syndrome] += 1
    return checks, errors, found


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word the numbers (twelve data bits) of the codewords within four bits, the nearest first, and how many there are.

    Columns beyond that count hold the nearest again.
    """
    checks, errors, found = tables()
    syndrome = (words & ((1 << CHECK_BITS) - 1)) ^ checks[words >> CHECK_BITS]
    near = (words[:, None] ^ errors[syndrome]) >> CHECK_BITS
    count = found[syndrome]
    return np.where(np.arange(MOST_NEAR) < count[:, None], near, near[:, :1]), count
