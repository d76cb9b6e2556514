"""Random numbers as pure functions of (seed, stream, ids): equal under any partitioning, and equal in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *parts: Column | str) -> Column:
    """In (0, 1): the first 48 bits of the md5 of "seed|part|...". Column names are columns; other strings need lit()."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def uniform_sql(seed: int | str, *parts: str) -> str:
    """The same as SQL text with md5(), for engines that read hexadecimal integers."""
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))
