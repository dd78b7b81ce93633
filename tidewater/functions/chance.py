"""Randomness that reruns and other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from an MD5 hash of the seed and the keys as text.

    Null keys count as empty text. 32 bits are used, so that any engine with MD5
    gets the same doubles.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
