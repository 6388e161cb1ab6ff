"""The seeded draws of ``functions.rng`` as SQL text."""

import math

P = 2147483647


def draw(seed: int, *keys: str) -> str:
    x = f"CAST({seed * 7919 % P} AS BIGINT)"
    for k in keys:
        x = f"({x} * 48271 + (CAST({k} AS BIGINT) % {P} + {P}) % {P}) % {P}"
    for step in (16807, 69621):
        x = f"(({x}) * (({x}) + {step})) % {P}"
    return f"({x})"


def uniform(seed: int, *keys: str) -> str:
    return f"({draw(seed, *keys)}/{float(P)})"


def normal(seed: int, *keys: str) -> str:
    return f"(sqrt(-2e0*ln(({draw(seed, *keys)} + 1)/{float(P + 1)}))*cos({uniform(seed + 1, *keys)}*{2 * math.pi}e0))"
