"""Keep the rows of wanted keys before they are shuffled.

A list of keys that fits a broadcast is joined on the map side. A longer one
is folded into a bitmap of fixed size, whatever the number of keys: it drops
most other rows before the exchange, and the exact join after it the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_BYTES, bounded_broadcast

#: Bits of the bitmap: 16 MB, in rows of 32,768 bits.
BITMAP_BITS = 1 << 27


def _slot(key: Column, bits: int) -> Column:
    """1 to ``bits``: Spark's bitmap functions count from 1."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(bits)) + 1


def key_bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """(_part, _bits): at most ``bits`` / 32,768 rows of 4 KB; tasks combine theirs before the exchange."""
    slots = keys.where(F.col(key).isNotNull()).select(_slot(F.col(key), bits).alias("_slot"))
    return (slots.groupBy(F.bitmap_bucket_number("_slot").alias("_part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))


def probably_in(df: DataFrame, bitmap: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows whose key may be in the bitmap: all that are, and few that are not."""
    slot = _slot(F.col(key), bits)
    rows = df.withColumns({"_part": F.bitmap_bucket_number(slot), "_at": F.bitmap_bit_position(slot)})
    # The bitmap's size is bounded by the number of its bits.
    joined = rows.join(F.broadcast(bitmap), "_part")
    byte = "cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)"
    return joined.where(F.expr(f"getbit({byte}, cast(_at % 8 as int)) = 1")).select(*[F.col(f"`{c}`") for c in df.columns])


def keep_keys(df: DataFrame, keys: DataFrame, key: str, exact: bool = True,
              max_bytes: int = DEFAULT_BROADCAST_BYTES, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys``; null is in no list.

    With ``exact=False`` a few rows of other keys may stay, for a caller that
    drops them itself. Then no row of ``df`` is shuffled at any size of
    ``keys``; with ``exact=True`` beyond the broadcast bound, only those that
    the bitmap lets through are.
    """
    wanted = keys.select(key)
    small = bounded_broadcast(wanted, max_bytes)
    if small is not wanted:
        return df.join(small, key, "left_semi").select(*df.columns)
    rows = probably_in(df, key_bitmap(wanted, key, bits), key, bits)
    return rows.join(wanted, key, "left_semi").select(*df.columns) if exact else rows
