"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double; NULL where the bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def round_half_up(x: Column, places: int) -> Column:
    """Round with ties going up, the same on every engine."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def remap(c: Column, mapping: Mapping[str, object]) -> Column:
    """Replace by dictionary; values without an entry stay as they are."""
    return F.coalesce(lookup(c, mapping), c)


def lookup(c: Column, mapping: Mapping) -> Column:
    """Dictionary lookup; NULL for values without an entry."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[c]


def right_closed_bin(share: Column, splits: int) -> Column:
    """1-based bin of a share in [0, 1] over ``splits`` equal right-closed bins.

    Compared with the breakpoints ``i / splits`` themselves, so a value on an edge belongs
    to the bin on its left."""
    edges = [F.when(share > F.lit(i / splits), 1).otherwise(0) for i in range(1, splits)]
    return sum(edges, F.lit(1))


# Suffix per power of one thousand.
THOUSANDS = ["", "K", "M", "B"]


def _digits(x: Column) -> Column:
    """Length of the number written without decimals (a minus sign counts)."""
    return F.length(F.format_string("%.0f", round_half_up(x, 0)))


def _fixed(x: Column, places: Column) -> Column:
    """Text with 0, 1 or 2 decimals."""
    return (
        F.when(places == 0, F.format_string("%.0f", round_half_up(x, 0)))
        .when(places == 1, F.format_string("%.1f", round_half_up(x, 1)))
        .otherwise(F.format_string("%.2f", round_half_up(x, 2)))
    )


def short_number(x: Column, whole: Column | None = None) -> Column:
    """Three significant places with a K/M/B suffix: 1234567 -> ``1.23M``.

    Where ``whole`` is true, numbers below one thousand have no decimals. The text is at
    least three characters wide, padded with zeros; beyond the last suffix B stays."""
    x = x.cast("double")
    size = _digits(x)
    power = F.least(F.floor((size - 1) / 3).cast("int"), F.lit(len(THOUSANDS) - 1))
    places = F.lit(2) - (size - 1) % 3
    if whole is not None:
        places = F.when(whole & (power == 0), 0).otherwise(places)
    text = _fixed(x * F.pow(F.lit(0.001), power), places)
    padded = (
        F.when(F.length(text) >= 3, text)
        .when(x < 0, F.concat(F.lit("-"), F.lpad(F.substring(text, 2, 2), 2, "0")))
        .otherwise(F.lpad(text, 3, "0"))
    )
    return F.concat(padded, lookup(power, dict(enumerate(THOUSANDS))))


def signed_short_number(x: Column) -> Column:
    """Like :func:`short_number` with a leading sign and no padding; size is taken from |x|."""
    x = x.cast("double")
    size = _digits(F.abs(x))
    power = F.least(F.floor((size - 1) / 3).cast("int"), F.lit(len(THOUSANDS) - 1))
    places = F.lit(2) - (size - 1) % 3
    scaled = x * F.pow(F.lit(0.001), power)
    sign = F.when(scaled < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, _fixed(F.abs(scaled), places), lookup(power, dict(enumerate(THOUSANDS))))
