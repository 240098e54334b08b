"""Join a large table to a lookup without shuffling the large side where that is safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64


def size_in_bytes(df: DataFrame) -> int:
    """Measured size of the rows as JSON text (an upper-side estimate of their memory)."""
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.agg(F.coalesce(F.sum(F.octet_length(row)), F.lit(0))).first()[0]


def fits(lookup: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return size_in_bytes(lookup) <= limit


def lookup_join(
    large: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
    salt_by: Sequence[str] = ("candidate_id",),
    small: bool | None = None,
) -> DataFrame:
    """``large`` left or inner join ``lookup`` on a key that may be very hot in ``large``.

    The lookup is measured first. Up to ``limit`` bytes it is broadcast. Beyond that the
    hot keys of ``large`` are spread over ``salts`` sub-keys and the lookup rows are
    repeated once per sub-key, which gives the same rows from an ordinary shuffle join.
    ``small`` passes on an answer of ``fits`` for the same lookup.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    on = list(on)
    if fits(lookup, limit) if small is None else small:
        return large.join(F.broadcast(lookup), on, how)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    spread = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
