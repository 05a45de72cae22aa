"""Column expressions: text clean-up and readable durations."""

from tracewright.functions.durations import format_duration
from tracewright.functions.text import normalize_activity, simplify_name, strip_accents

__all__ = ["format_duration", "normalize_activity", "simplify_name", "strip_accents"]
