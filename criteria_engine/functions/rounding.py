"""Rounding of doubles to decimal places by their exact binary value, halves to the even digit."""

from pyspark.sql import Column, functions as F

# A double below 2 with a bit above 2^-15 is hi / 2^32 + lo / 2^68, both whole.
HIGH, LOW = 32, 36


def round_exact(value: Column, places: int = 4) -> Column:
    """`value`, a double from 0 to 1, to at most 4 decimal places, correctly rounded.

    Engines round the shortest decimal text of a double, or its product with a power of ten;
    both differ from the double itself. Here the value is split into two whole numbers, the
    product is taken in decimals, and its rest is compared with a half. Null stays null; values
    out of range, infinite and NaN ones are an error.
    """
    if not 0 <= places <= 4:
        raise ValueError(f"0 to 4 places, not {places}")
    in_range = F.when(value.between(0.0, 1.0), value).when(
        value.isNotNull(), F.raise_error(F.lit("not from 0 to 1")).cast("double")
    )
    scaled = in_range * float(2**HIGH)
    high = F.floor(scaled)
    low = F.floor((scaled - high.cast("double")) * float(2**LOW))
    # bits below 2^-68 belong to values that round to 0 at 4 places
    step = F.lit(2**LOW).cast("decimal(12,0)")
    # 2^32 * 10^4 fits 64 bits; whole and rest of the high part first, then the low part's carry
    power = 10**places
    product = high * F.lit(power)
    whole, rest = F.shiftright(product, HIGH), product.bitwiseAND(F.lit(2**HIGH - 1))
    rest = rest.cast("decimal(11,0)") * step + (low * F.lit(power)).cast("decimal(16,0)")
    one = F.lit(str(2 ** (HIGH + LOW))).cast("decimal(21,0)")
    carry = F.floor(rest.cast("decimal(26,0)") / one).cast("long")
    rest = rest.cast("decimal(26,0)") - carry.cast("decimal(6,0)") * one
    units, twice = whole + carry, rest * F.lit(2).cast("decimal(1,0)")
    up = (twice > one) | ((twice == one) & (units % 2 == 1))
    return (units + up.cast("long")).cast("double") / float(power)
