"""Time literals: YYYY, YYYY-MM, YYYY-MM-DD or RFC 3339, in UTC."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from certloom.errors import UsageError

_FORMS = ((r"\d{4}", "%Y"), (r"\d{4}-\d{2}", "%Y-%m"), (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"))
_RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})")


def parse_when(text: str) -> datetime:
    """The time, without zone, in UTC."""
    try:
        for pattern, form in _FORMS:
            if re.fullmatch(pattern, text, re.ASCII):
                return datetime.strptime(text, form)
        if m := _RFC3339.fullmatch(text):
            fraction = (m[2] or ".0")[1:7].ljust(6, "0")
            t = datetime.fromisoformat(f"{m[1]}.{fraction}{m[3].replace('Z', '+00:00')}")
            return t.astimezone(timezone.utc).replace(tzinfo=None)
    except ValueError:
        pass
    raise UsageError(f"{text!r}: use YYYY, YYYY-MM, YYYY-MM-DD or RFC 3339")


def format_when(t: datetime) -> str:
    """The shortest literal that parses back: a date at midnight, else RFC 3339."""
    if t == t.replace(hour=0, minute=0, second=0, microsecond=0):
        return t.strftime("%Y-%m-%d")
    fraction = f".{t.microsecond:06d}".rstrip("0") if t.microsecond else ""
    return f"{t:%Y-%m-%dT%H:%M:%S}{fraction}Z"
