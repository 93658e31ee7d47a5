"""Deterministic ranks: the first 64 bits of a SHA-256 over parts joined by U+001F. All random choices in data code use them."""

from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def rank_hex(*parts) -> Column:
    """16 hex digits, which order as the unsigned number does. A null part is left out with its separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[part(p) for p in parts]).cast("binary"), 256), 1, 16)


def rank_number(*parts) -> Column:
    return F.conv(rank_hex(*parts), 16, 10).cast("decimal(20,0)")


def rank_mod(n, *parts) -> Column:
    """The rank modulo n, a number or a column."""
    return (rank_number(*parts) % (n if isinstance(n, Column) else F.lit(n).cast("decimal(20,0)"))).cast("long")


def drawn(salt: str, resample: int, i: int, n: int) -> int:
    """rank_mod(n, salt, resample, i) of plain values, for tasks that make many."""
    return int.from_bytes(sha256(f"{salt}\x1f{resample}\x1f{i}".encode()).digest()[:8]) % n
