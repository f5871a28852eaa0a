"""Token counts: the matches of `\\w+|[^\\w\\s]+` with Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and underscore make words; everything else but blanks makes runs of marks.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]+"


def token_count(text: Column) -> Column:
    """Number of tokens; null for a null text, 0 for an empty or blank one."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")
