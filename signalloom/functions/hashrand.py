"""Deterministic randomness: md5-based, the same on every engine and for any partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """A uniform number in (0, 1), a function of ``parts`` (columns or constants) alone."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    head = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8)
    return (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def gumbel(*parts) -> Column:
    return -F.log(-F.log(uniform(*parts)))


def uniform_sql(*parts: str) -> str:
    """The same number as DuckDB SQL."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"
