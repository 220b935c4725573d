"""Numbers as people read them."""

from __future__ import annotations

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def plural(n: int, one: str, many: str = "") -> str:
    """1 row, 2 rows, 12,345 rows."""
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def human_bytes(n: float) -> str:
    """Bytes with a unit of 1024s, three digits at least where there are any: 999 B, 1.50 KiB, 12.3 MiB, 512 GiB."""
    unit = 0
    while abs(n) >= 1000 and unit < len(UNITS) - 1:
        n, unit = n / 1024, unit + 1
    if not unit:
        return f"{n:.0f} B"
    return f"{n:.{2 if abs(n) < 10 else 1 if abs(n) < 100 else 0}f} {UNITS[unit]}"
