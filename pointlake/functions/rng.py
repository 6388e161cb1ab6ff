"""Seeded draws as plain column arithmetic.

Every draw is a function of ``(seed, keys)`` only, so it does not depend on partitioning, retries or
executor loss, and integer arithmetic keeps it inside whole-stage codegen.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def draw(seed: int, *keys: Column) -> Column:
    """Pseudo-random BIGINT in ``[0, PRIME)``; products stay below 2**63.  Keys are whole numbers, or names,
    which count by a 64-bit hash."""
    x = F.lit(seed * 7919 % PRIME).cast("bigint")
    for key in keys:
        x = (x * 48271 + F.pmod(F.coalesce(key.try_cast("bigint"), string_key(key)), F.lit(PRIME))) % PRIME
    for step in (16807, 69621):
        x = (x * (x + step)) % PRIME
    return x


def uniform(seed: int, *keys: Column) -> Column:
    """Double in ``[0, 1)``."""
    return draw(seed, *keys) / F.lit(float(PRIME))


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by the Box-Muller transform of two draws."""
    u1 = (draw(seed, *keys) + 1) / F.lit(float(PRIME + 1))
    u2 = uniform(seed + 1, *keys)
    return F.sqrt(F.log(u1) * -2.0) * F.cos(u2 * (2 * math.pi))


def key_of(key: Column) -> Column:
    """What ``draw`` uses of a key, for ``normal_array``."""
    return F.pmod(F.coalesce(key.try_cast("bigint"), string_key(key)), F.lit(PRIME))


def normal_array(seed: int, *keys: np.ndarray) -> np.ndarray:
    """``normal`` for arrays of keys (as from ``key_of``, none negative) that broadcast together, the same numbers."""
    drawn = []
    for s in (seed, seed + 1):
        x = np.int64(s * 7919 % PRIME)
        for key in keys:
            x = (x * 48271 + key % PRIME) % PRIME
        for step in (16807, 69621):
            x = (x * (x + step)) % PRIME
        drawn.append(x)
    return np.sqrt(np.log((drawn[0] + 1) / (PRIME + 1.0)) * -2.0) * np.cos(drawn[1] / float(PRIME) * (2 * math.pi))


def coin(seed: int, p: float, *keys: Column) -> Column:
    """True with probability ``p``."""
    return uniform(seed, *keys) < F.lit(float(p))


def string_key(col: Column) -> Column:
    """A BIGINT key for string ids."""
    return F.xxhash64(col.cast("string"))
