"""Column -> Column functions (built-in expressions only, no Python UDFs)."""

from refinery.functions.dates import (calendar_months_since, hours_between, parse_timestamp_coerce,
                                      parse_timestamp_strict)
from refinery.functions.lists import (any_outside_flag, append_item, argmax, contains_flag, join_items,
                                      list_template, lower_items, non_empty, remove_item)
from refinery.functions.numeric import (affine_scale, clip, equals_flag, finite_or_null, literal_map_lookup, not_in_flag,
                                        safe_ratio, to_flag, when_equals)
from refinery.functions.similarity import indel_ratio, indel_upper_bound_ok
from refinery.functions.text import (blank_to_null, code_key, display_name, fold_to_ascii, normalize_name,
                                     null_marker_to_null, parse_list_literal, snake_name, snake_name_py, strip,
                                     text_or_placeholder, title_case)

__all__ = [n for n in dir() if not n.startswith("_")]
