"""Reproducible pseudo-random columns.

A draw is a function of (row id, stream name, seed) only, so generated rows do not depend on how they are partitioned
and a recomputed task yields the same rows. MD5 is used because any SQL engine can reproduce it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.bands import _col

DRAW_RANGE = 1 << 32


def digest(key: Column | str, stream: str, seed: int) -> Column:
    """128 random bits of a row, as 32 hex digits; `draw` cuts up to four numbers out of one digest."""
    return F.md5(F.concat_ws(":", _col(key).cast("string"), F.lit(stream), F.lit(str(seed))))


def draw(bits: Column, part: int) -> Column:
    """Number `part` (0..3) of a digest, uniform in 0 .. 2^32-1."""
    return F.conv(F.substring(bits, 1 + 8 * part, 8), 16, 10).cast("bigint")


def uniform_int(bits: Column, part: int, low: int | Column, high: int | Column) -> Column:
    """Whole number in low..high, both included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return low + F.pmod(draw(bits, part), high - low + 1)


def choice(bits: Column, part: int, values: Sequence[str]) -> Column:
    picked = F.pmod(draw(bits, part), F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(value) for value in values]), picked)
