"""Reproducible ids, random-looking numbers and picks, independent of partitioning.

All of them come from md5 or sha2 of row content, so a retried or recomputed
task gives the same values again.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UINT32 = 2**32


def _text(value) -> Column:
    return F.coalesce(value.cast("string") if isinstance(value, Column) else F.lit(str(value)), F.lit(""))


def hash32(seed: int | str, *values: Column) -> Column:
    """A number in [0, 2^32) from the seed and the values."""
    digest = F.md5(F.concat(F.lit(str(seed)), *[_text(v) for v in values]))
    return hex_to_number(digest, 0)


def hex_to_number(digest: Column, block: int) -> Column:
    """The ``block``-th group of eight hex digits as a bigint."""
    return F.conv(F.substring(digest, block * 8 + 1, 8), 16, 10).cast("bigint")


def unit(seed: int | str, *values: Column) -> Column:
    """A number in [0, 1) from the seed and the values."""
    return hash32(seed, *values) / F.lit(float(UINT32))


def stable_id(*values: Column) -> Column:
    """A 32-digit id; the same content always gets the same id."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[_text(v) for v in values]), 256), 1, 32)


def text_key(text: Column) -> Column:
    """32 bytes that stand for a text of any length in a shuffle."""
    return F.unhex(F.sha2(text, 256))


def stable_date(start: str, days: int, *values: Column) -> Column:
    """A timestamp at ``start`` plus 0..``days`` whole days."""
    offset = F.pmod(hash32("date", *values), F.lit(days + 1)).cast("int")
    return F.date_add(F.to_date(F.lit(start)), offset).cast("timestamp")
