"""Repeatable randomness from row keys.

A row's random choices come from an md5 of ``seed|key`` so that they do not
depend on partitioning, retries or row order, and any SQL engine can replay
them.  One md5 per row is enough: wide rows draw further uniforms from its two
28-bit words by an affine map modulo a prime, which keeps any two draws
independent at the cost of two multiplications.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
PRIME = 2147483647  # 2**31 - 1


def _digest(keys: Sequence[Column | str], seed: int | str) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.md5(text.cast("binary"))


def _hex(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def row_hash(*keys: Column | str, seed: int | str = 42) -> Column:
    """A 60-bit non-negative integer for each key."""
    return _hex(_digest(keys, seed), 1, HASH_BITS // 4)


def unit_hash(*keys: Column | str, seed: int | str = 42) -> Column:
    """A uniform double in [0, 1) for each key."""
    return row_hash(*keys, seed=seed) / F.lit(float(1 << HASH_BITS))


def row_words(*keys: Column | str, seed: int | str = 42) -> Column:
    """``struct<a: bigint, b: bigint>``: two 28-bit words of one digest."""
    digest = _digest(keys, seed)
    return F.struct(_hex(digest, 1, 7).alias("a"), _hex(digest, 8, 7).alias("b"))


def stream_constants(stream: str) -> tuple[int, int, int]:
    """The multipliers of one named draw."""
    raw = hashlib.md5(stream.encode()).digest()
    a, b, c = (int.from_bytes(raw[i:i + 4], "big") % (1 << 30) for i in (0, 4, 8))
    return a + 1, b + 1, c


def mix_uniform(words: Column, stream: str) -> Column:
    """A uniform double in (0, 1) for a named draw of the row behind ``words``."""
    a, b, c = stream_constants(stream)
    mixed = words["a"] * F.lit(a) + words["b"] * F.lit(b) + F.lit(c)
    return (F.pmod(mixed, F.lit(PRIME)) + F.lit(0.5)) / F.lit(float(PRIME))
