"""String cleaning for delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL_AND_SPACE = "".join(map(chr, range(0x21)))


def strip(text: Column) -> Column:
    """Drop spaces and control characters (up to U+0020) at both ends."""
    return F.btrim(text, F.lit(_CONTROL_AND_SPACE))
