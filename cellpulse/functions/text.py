"""Scalar column functions. All are compositions of Spark built-ins, so they
stay JVM-side and inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_decimal(c) -> Column:
    """Decimal string of a whole hex id of up to 32 digits (128 bits).

    Neither a long nor a decimal holds 128 bits, so the two 64-bit halves are
    multiplied out in base 10**18 with decimals that do not overflow. Null,
    empty, longer or non-hex text gives null.
    """
    c = _col(c)
    whole = F.lpad(F.when(c.rlike("^[0-9a-fA-F]{1,32}$"), c), 32, "0")
    step = 446744073709551616  # 2**64 = 18 * 10**18 + step

    def half(start: int) -> Column:
        return F.conv(F.substring(whole, start, 16), 16, 10).cast("decimal(20,0)")

    def split(x: Column) -> tuple[Column, Column]:
        """(quotient, rest) of a division by 10**18, cut from the digits: exact for any decimal."""
        text = F.lpad(x.cast("string"), 38, "0")
        return F.substring(text, 1, 20).cast("decimal(20,0)"), F.substring(text, 21, 18).cast("decimal(18,0)")

    high1, high0 = split(half(1))
    low1, low0 = split(half(17))
    t0 = high0 * F.lit(step).cast("decimal(18,0)") + low0
    carry, q0 = split(t0)
    t1 = (high1 * F.lit(step).cast("decimal(18,0)") + high0 * F.lit(18).cast("decimal(2,0)") + low1 + carry).cast("decimal(38,0)")
    carry, q1 = split(t1)
    q2 = (high1 * F.lit(18).cast("decimal(2,0)") + carry).cast("decimal(20,0)")
    digits = F.concat(q2.cast("string"), F.lpad(q1.cast("string"), 18, "0"), F.lpad(q0.cast("string"), 18, "0"))
    return F.regexp_replace(digits, "^0+(?!$)", "")


def bytes_to_hex(c, sep: str | None = None) -> Column:
    """Lower-case hex of the UTF-8 bytes of ``c``; ``sep`` between byte pairs."""
    h = F.lower(F.hex(_col(c)))
    if not sep:
        return h
    return F.regexp_replace(h, "(..)(?!$)", "$1" + sep.replace("$", "\\$"))


def strip_quotes(c, quote: str = '"') -> Column:
    """Remove every ``quote`` character."""
    return F.translate(_col(c), quote, "")


def zero_pad(c, width: int = 2) -> Column:
    """printf-style ``%0<width>d``; wider numbers keep all their digits."""
    return F.format_string(f"%0{width}d", _col(c))


def to_line(cols: Sequence, sep: str = ",") -> Column:
    """One text line from several columns; a null is an empty field, so no field moves."""
    return F.array_join(F.array(*[_col(c).cast("string") for c in cols]), sep, "")


def strict_cast(c, dtype: str, what: str = "value") -> Column:
    """Cast that fails the job on text that is not a ``dtype`` (null stays null), in any SQL mode."""
    c = _col(c)
    cast = c.try_cast(dtype)
    bad = F.raise_error(F.concat(F.lit(f"not a {dtype} in {what}: "), c))
    return F.when(c.isNotNull() & cast.isNull(), bad.cast(dtype)).otherwise(cast)


def array_to_columns(arr, names: Sequence[str]) -> list[Column]:
    """One column per array element, named in order (vector -> record)."""
    arr = _col(arr)
    return [arr[i].alias(n) for i, n in enumerate(names)]
