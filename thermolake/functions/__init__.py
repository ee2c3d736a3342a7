from .quality import is_valid, reject_reason, valid_filter
from .text import buffer_summary, describe_reading, one_decimal
from .times import (
    as_instant,
    end_of_given_day,
    instant_literal,
    parse_date_argument,
    parse_instant,
    parse_rfc3339,
    parse_rfc3339_argument,
    rfc3339,
    truncate_second,
    uptime_seconds,
)

__all__ = [
    "as_instant",
    "buffer_summary",
    "describe_reading",
    "end_of_given_day",
    "instant_literal",
    "is_valid",
    "one_decimal",
    "parse_date_argument",
    "parse_instant",
    "parse_rfc3339",
    "parse_rfc3339_argument",
    "reject_reason",
    "rfc3339",
    "truncate_second",
    "uptime_seconds",
    "valid_filter",
]
