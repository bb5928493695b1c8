"""Reusable DataFrame -> DataFrame steps."""

from .dedup import drop_repeated_keys, keep_first, latest_by_key
from .joins import (
    alias_names,
    any_left_join,
    dict_lookup,
    lookup_exactly_one,
    new_rows,
    semi_join,
)
from .panel import attach_years, densify, missing_keys
from .periods import in_previous_window, in_trailing_window, two_window_totals, window_rows
from .ranking import (
    global_position,
    number_rows_after,
    rank_change,
    rank_within,
    top_k_within,
    trophy,
    with_previous_rank,
)

__all__ = [
    "alias_names",
    "any_left_join",
    "attach_years",
    "densify",
    "dict_lookup",
    "drop_repeated_keys",
    "global_position",
    "in_previous_window",
    "in_trailing_window",
    "keep_first",
    "latest_by_key",
    "lookup_exactly_one",
    "missing_keys",
    "new_rows",
    "number_rows_after",
    "rank_change",
    "rank_within",
    "semi_join",
    "top_k_within",
    "trophy",
    "two_window_totals",
    "window_rows",
    "with_previous_rank",
]
