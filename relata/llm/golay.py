"""The binary Golay code of length 23, and fuzzy keys of short words by its codewords.

Every 23-bit word lies within 3 bits of exactly one codeword.  A word's keys
are the index of that codeword and, where it is 3 bits away, of the five
codewords 4 bits away.  Any two words that differ in at most two bits then
share a key: the code is perfect, and any four positions lie in exactly one of
the supports of its codewords of weight 7.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS, REACH = 23, 11, 3
#: Fixed value: coefficients of a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
KEYS = 6


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits, and the error patterns leading to a word's key codewords (-1: none)."""
    unit = [remainder(1 << b) for b in range(LENGTH)]

    def spread(first: int, n: int) -> np.ndarray:
        out = np.zeros(1 << n, np.int64)
        for b in range(n):
            out[1 << b : 2 << b] = out[: 1 << b] ^ unit[first + b]
        return out

    errors = np.full((1 << CHECKS, KEYS), -1, np.int64)
    far = {}
    for weight in range(REACH + 2):
        for places in combinations(range(LENGTH), weight):
            s = pattern = 0
            for b in places:
                s, pattern = s ^ unit[b], pattern | 1 << b
            if weight <= REACH:
                errors[s, 0] = pattern
                if weight == REACH:
                    far[s] = 1
            elif s in far:
                errors[s, far[s]] = pattern
                far[s] += 1
    return spread(0, 12), spread(12, 11), errors


LOW, HIGH, ERRORS = _tables()


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words; -1 where a word has fewer."""
    errors = ERRORS[LOW[words & 0xFFF] ^ HIGH[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)
