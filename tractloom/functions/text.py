"""Text column expressions: addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractloom.fixed_values import DEFAULT_ZIP

# A run of word characters, or a run of anything else.
_WORD_OR_GAP = r"[\p{L}\p{N}'._]+|[^\p{L}\p{N}'._]+"
_BRACKETED = r"\s\(.*?\)"


def title_case(text: Column) -> Column:
    """Capitalise every word, also the ones after a hyphen or a slash.

    ``initcap`` alone only starts a word after a blank.
    """
    pieces = F.regexp_extract_all(text, F.lit(_WORD_OR_GAP), F.lit(0))
    return F.array_join(F.transform(pieces, F.initcap), "")


def postal_address(street: Column, postcode: Column, default: str = DEFAULT_ZIP) -> Column:
    """``street, postcode``; only the postcode has a default."""
    return F.concat(street, F.lit(", "), F.coalesce(postcode, F.lit(default)))


def normalised_address(house: Column, street: Column, postcode: Column) -> Column:
    """``house Street Name, postcode``; NULL if any part is missing."""
    return F.concat(house, F.lit(" "), title_case(street), F.lit(", "), postcode)


def menu_label(group: Column, name: Column) -> Column:
    """``group: name`` without bracketed remarks such as survey years."""
    return F.concat(F.regexp_replace(group, _BRACKETED, ""), F.lit(": "), name)
