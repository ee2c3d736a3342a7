"""Time model: UTC instants at whole-second precision. ``now`` is always an argument."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ZERO_TIME

# fixed values: accepted timestamp text
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
STORED_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
RFC3339_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_second(ts: Column | str) -> Column:
    return F.date_trunc("second", _col(ts).cast("timestamp"))


def zero_time() -> Column:
    return F.lit(ZERO_TIME).cast("timestamp")


def rfc3339(ts: Column | str) -> Column:
    """Instant to text such as ``2024-01-01T00:00:07Z``."""
    return F.date_format(ts, RFC3339_FORMAT)


def parse_rfc3339(text: Column | str) -> Column:
    """RFC 3339 text with a zone to an instant; NULL for anything else."""
    text = _col(text)
    return F.when(text.rlike(RFC3339_PATTERN), F.try_to_timestamp(text))


def parse_instant(text: Column | str) -> Column:
    """Stored or RFC 3339 text to an instant; zone-less text is UTC; NULL for anything else."""
    text = _col(text)
    return F.when(text.rlike(RFC3339_PATTERN) | text.rlike(STORED_PATTERN), F.try_to_timestamp(text))


def uptime_seconds(as_of: datetime | str, start_time: Column | str) -> Column:
    return F.unix_timestamp(instant_literal(as_of)) - F.unix_timestamp(start_time)


# ---- query arguments (plain Python values) ----------------------------------

def as_instant(value: datetime | date | str) -> datetime:
    """Query argument to a zone-less UTC datetime cut to the second."""
    if isinstance(value, str):
        value = (datetime.strptime(value[:19], "%Y-%m-%d %H:%M:%S")
                 if re.match(STORED_PATTERN, value) else parse_date_argument(value))
    elif not isinstance(value, datetime):
        value = datetime.combine(value, time())
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value.replace(microsecond=0)


def parse_rfc3339_argument(text: str) -> datetime:
    """``2024-01-02T03:04:05Z`` or an offset form to zone-less UTC; ValueError otherwise."""
    if not re.match(RFC3339_PATTERN, text):
        raise ValueError(f"not an RFC 3339 timestamp: {text!r}")
    return datetime.fromisoformat(text).astimezone(timezone.utc).replace(tzinfo=None)


def parse_date_argument(text: str) -> datetime:
    """RFC 3339, or a bare ``2024-01-02``; ValueError otherwise."""
    if re.match(DATE_PATTERN, text):
        return datetime.strptime(text, "%Y-%m-%d")
    return parse_rfc3339_argument(text)


def end_of_given_day(value: datetime) -> datetime:
    """The given instant plus 24 h minus 1 s, whatever its time of day is."""
    return value + timedelta(days=1) - timedelta(seconds=1)


def instant_literal(value: datetime | date | str) -> Column:
    """UTC instant as a literal that does not depend on the Python process zone."""
    return F.lit(as_instant(value).replace(tzinfo=timezone.utc))
