"""Deterministic hashing expressions: experiment buckets and seeded choices."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def assign_bucket(entity: Column, num_buckets: int = 2) -> Column:
    """SHA-256 of the id, as an integer, modulo num_buckets.

    The 256-bit remainder is folded over eight 32-bit pieces of the digest, so it stays a plain
    arithmetic expression and is exact for up to 2**31 buckets.
    """
    if num_buckets < 1:
        raise ValueError(f"{num_buckets} buckets cannot hold anything")
    if num_buckets > 2**31:
        raise ValueError(f"{num_buckets} buckets are beyond 2**31")
    digest = F.sha2(entity.cast("string"), 256)
    rest = F.lit(0).cast("long")
    for piece in range(8):
        part = F.conv(F.substring(digest, 8 * piece + 1, 8), 16, 10).cast("long")
        rest = (rest * F.lit(2**32) + part) % F.lit(num_buckets)
    return rest.cast("int")


def bucket_split(entity: Column, treatment_fraction: float = 0.5) -> Column:
    """True where SHA-256 of the id falls below the given fraction of the hash range."""
    if not 0 < treatment_fraction < 1:
        raise ValueError(f"a treatment share of {treatment_fraction} leaves one side empty")
    threshold = f"{int(treatment_fraction * 2**256):064x}"
    return F.sha2(entity.cast("string"), 256) < F.lit(threshold)


def seeded_key(seed: int, *cols: Column) -> Column:
    """md5 of seed and columns: a reproducible random order for choices and samples."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def seeded_int(seed: int, *cols: Column) -> Column:
    """A uniform 60-bit integer from the seeded key."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 15), 16, 10).cast("long")


def seeded_uniform(seed: int, *cols: Column) -> Column:
    """A uniform double in [0, 1) from the seeded key."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


#: Half rounds of a keyed permutation, those with a square, and how often a number that left its range is sent on.
HALVES, SQUARED, WALKS = 6, (1, 2, 3), 16
PRIME = 2**31 - 1


def permutation_sides(n: int) -> tuple[int, int]:
    """Width and height of the rectangle a permutation of [0, n) works in: it holds n places, and fewer than width more."""
    if not 0 < n <= PRIME * PRIME:
        raise ValueError(f"{n} numbers cannot be permuted")
    width = math.isqrt(n - 1) + 1
    return width, -(-n // width)


def permutation_keys(key: str) -> tuple[list[int], list[int]]:
    """A factor and a shift per half round."""

    def draw(name: str) -> int:
        return 1 + int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:15], 16) % (PRIME - 1)

    return [draw(f"factor {r}") for r in range(HALVES)], [draw(f"shift {r}") for r in range(HALVES)]


def permuted(number: Column, n: int, factors: Column, shifts: Column) -> Column:
    """A keyed permutation of the numbers 0 to n - 1, as an expression; the keys are array columns.

    The number is a place in a rectangle a little larger than n. Half rounds of a Feistel network move its column
    by a hash of its row, or its row by a hash of its column, which can be undone, so no two numbers meet. A number
    that falls outside n goes round again until it is back inside: a share below 1 / sqrt(n) each time.
    """
    width, height = permutation_sides(n)

    def once(place: Column) -> Column:
        x, y = place % F.lit(width), F.call_function("div", place, F.lit(width).cast("long"))
        for r in range(HALVES):
            hashed = ((y if r % 2 == 0 else x) * factors[r] + shifts[r]) % F.lit(PRIME)
            if r in SQUARED:
                hashed = (hashed * hashed) % F.lit(PRIME)
            if r % 2 == 0:
                x = (x + hashed) % F.lit(width)
            else:
                y = (y + hashed) % F.lit(height)
        return y * F.lit(width).cast("long") + x

    def inside(first: Column) -> Column:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda at, _: F.when(at < n, at).otherwise(once(at)))
        return F.when(first < n, first).otherwise(walk)

    return F.transform(F.array(once(number.cast("long"))), inside)[0]


def number_before(n: int, key: str):
    """The inverse of ``permuted`` under the keys of ``key``, as a function of integer arrays that ships by value."""
    width, height = permutation_sides(n)
    factors, shifts = permutation_keys(key)
    halves, squared, prime = HALVES, SQUARED, PRIME

    def before(numbers):
        import numpy as np

        def once(place):
            x, y = place % width, place // width
            for r in reversed(range(halves)):
                hashed = ((y if r % 2 == 0 else x) * factors[r] + shifts[r]) % prime
                if r in squared:
                    hashed = hashed * hashed % prime
                if r % 2 == 0:
                    x = (x - hashed) % width
                else:
                    y = (y - hashed) % height
            return y * width + x

        out = once(numbers.astype(np.int64))
        outside = np.flatnonzero(out >= n)
        while len(outside):
            out[outside] = once(out[outside])
            outside = outside[out[outside] >= n]
        return out

    return before
