"""Column expressions."""

from tractloom.functions.keys import area_id, block_key, block_key_of_lot, padded_block
from tractloom.functions.numeric import display_text, ratio, scale_position
from tractloom.functions.text import menu_label, normalised_address, postal_address, title_case

__all__ = [
    "area_id",
    "block_key",
    "block_key_of_lot",
    "display_text",
    "menu_label",
    "normalised_address",
    "padded_block",
    "postal_address",
    "ratio",
    "scale_position",
    "title_case",
]
