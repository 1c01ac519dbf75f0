"""Key columns: area ids, block text and the integer block key.

A block key is the borough digit followed by the five-digit block. As an
integer it lies between 100000 and 999999, so a table with one row per block
key can never hold more than 900,000 rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractloom.fixed_values import BLOCK_KEY_WIDTH, BLOCK_WIDTH, TRACT_WIDTH

BLOCK_SPAN = 10**BLOCK_WIDTH


def padded_block(block: Column) -> Column:
    return F.lpad(block.cast("string"), BLOCK_WIDTH, "0")


def area_id(state: str, boroughs: Mapping[str, str], borough: Column, tract: Column) -> Column:
    """State, county of the borough, and the tract padded on the right.

    An unlisted borough has no county, which makes the whole id NULL.
    """
    (first, code), *others = boroughs.items()
    county = F.when(borough == first, F.lit(code))
    for number, code in others:
        county = county.when(borough == number, F.lit(code))
    return F.concat(F.lit(state), county, F.rpad(tract, TRACT_WIDTH, "0"))


def block_key(borough: Column, block: Column) -> Column:
    """Integer key of a borough and block given as numbers or number text.

    Values that are no number, or out of range, give NULL and match nothing.
    """
    digit = borough.try_cast("int")
    number = block.try_cast("int")
    in_range = digit.between(1, 9) & number.between(0, BLOCK_SPAN - 1)
    return F.when(in_range, digit * BLOCK_SPAN + number)


def block_key_of_lot(lot: Column) -> Column:
    """Integer key held by the first six characters of a lot or building id.

    Six characters that are not all digits give NULL or a number below 100000,
    neither of which is a block key.
    """
    return F.substring(lot, 1, BLOCK_KEY_WIDTH).try_cast("int")
