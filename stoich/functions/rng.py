"""Hash-based randomness.

All randomness is a pure function of (seed, row key):

    u(seed, k1, k2, ...) = int(first 8 hex digits of md5("seed|k1|k2...")) / 2**32

It does not depend on partitioning, task retries or executor loss (unlike
``rand(seed)``), and DuckDB computes the same value:
``('0x' || substr(md5(concat_ws('|', ...)), 1, 8))::BIGINT / 4294967296.0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [
        (p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts
    ]
    return F.concat_ws("|", *cols)


def hash_u32(seed, *parts) -> Column:
    """Unsigned 32-bit integer from the md5 of ``seed|part|...``."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1) from ``seed`` and the row key parts."""
    return hash_u32(seed, *parts) / F.lit(TWO_32)


def sql_uniform(seed, *parts: str) -> str:
    """DuckDB spelling of :func:`uniform` (parts are SQL expressions)."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT / 4294967296.0)"
