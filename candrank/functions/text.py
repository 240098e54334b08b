"""String columns: strip, cleaning, cutting and fixed-point formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candrank import constants as C

REPLACEMENT = "\ufffd"


def named(name: str, parent: str | None = None) -> Column:
    """A column by its exact name, whatever characters an input file put into it."""
    exact = "`" + name.replace("`", "``") + "`"
    return F.col(f"{parent}.{exact}" if parent else exact)


def strip(text: Column) -> Column:
    """Cut Unicode white space at both ends (linear in the text, no regex)."""
    return F.btrim(text, F.lit(C.WHITESPACE))


def strip_or_empty(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit(""))


def strip_or_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def drop_invalid(text: Column) -> Column:
    """Remove bytes that are not UTF-8; a valid text passes unchanged.

    Spark marks each bad byte with U+FFFD, so within an invalid text a genuine U+FFFD
    goes as well.
    """
    repaired = F.replace(F.make_valid_utf8(text), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def strip_fences(text: Column) -> Column:
    """Remove Markdown code fences at line starts and ends, then strip."""
    fence = r"(?mdU)^```(?:json)?[\s\x1c-\x1f]*|[\s\x1c-\x1f]*```$"
    return strip(F.regexp_replace(text, fence, ""))


def head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def fixed(x: Column, digits: int) -> Column:
    """Format a double with 1-3 decimals, rounding its exact binary value half to even.

    ``format_string`` rounds the shortest decimal text instead, so 8.1245 would print as
    8.125 although the stored double lies below the tie. Here the whole part is set aside,
    which leaves an exact fraction. Near a tie the fraction is scaled by a power of two,
    exactly too, and the tie is decided in decimal arithmetic. Doubles of 2^63 and above,
    which have no fraction, infinities and NaN are printed by ``format_string``.
    """
    unit = 10**digits
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole.cast("double")
    near = F.abs(F.pmod(part * F.lit(float(unit)), F.lit(1.0)) - F.lit(0.5)) < F.lit(1e-6)

    def scaled(power: int) -> Column:
        over = F.floor(part * F.lit(float(2**power))).cast("decimal(20,0)")
        half = F.lit(str(2**power)).cast("decimal(21,0)")
        bottom = F.lit(str(2 ** (power + 1))).cast("decimal(21,0)")
        top = over * F.lit(2 * unit).cast("decimal(5,0)") + half
        quotient = F.call_function("div", top, bottom)
        tie = (top % bottom) == F.lit(0)
        return F.when(tie, quotient - quotient % F.lit(2)).otherwise(quotient)

    exact = F.when(part < F.lit(2.0**-7), scaled(66)).otherwise(scaled(59))
    plain = F.floor(part * F.lit(float(unit)) + F.lit(0.5))
    units = F.when(near, exact).otherwise(plain)
    text = F.concat(
        F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")),
        (whole + F.call_function("div", units, F.lit(unit))).cast("string"),
        F.lit("."),
        F.lpad((units % F.lit(unit)).cast("string"), digits, "0"),
    )
    return F.when(size < F.lit(2.0**63), text).otherwise(F.format_string(f"%.{digits}f", x))
