"""A strict DER reader.

Elements are (tag, raw, body) with one-byte tags; lengths must be definite and minimal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps
from typing import NamedTuple

BOOLEAN, INTEGER, BIT_STRING, OCTET_STRING, NULL, OID = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06
UTF8, NUMERIC, PRINTABLE, TELETEX, IA5, UTC_TIME, GENERALIZED_TIME, VISIBLE, UNIVERSAL, BMP = (
    0x0C, 0x12, 0x13, 0x14, 0x16, 0x17, 0x18, 0x1A, 0x1C, 0x1E,
)
SEQUENCE, SET = 0x30, 0x31


def context(n: int, constructed: bool = False) -> int:
    """The tag of a context-specific element."""
    return 0x80 | n | (0x20 if constructed else 0)


class Malformed(ValueError):
    """Bytes that are not the DER expected."""


class Element(NamedTuple):
    tag: int
    raw: bytes
    body: bytes


_new = tuple.__new__


def recurring(f: Callable, size: int = 4096, widest: int = 1024) -> Callable:
    """f of some bytes, with its last results kept, which nobody may change; those of longer bytes are not kept.

    What a certificate says of its issuer recurs in one certificate after another.
    """
    kept = lru_cache(size)(f)

    @wraps(f)
    def g(data: bytes):
        return kept(data) if len(data) <= widest else f(data)

    g.cache_info = kept.cache_info
    return g


def element(data: bytes, at: int = 0) -> Element:
    """The element that starts at a place."""
    n = len(data)
    if n - at < 2:
        raise Malformed("short element")
    tag, size = data[at], data[at + 1]
    start = at + 2
    if tag & 0x1F == 0x1F:
        raise Malformed("long tag")
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or n - start < width:
            raise Malformed("bad length")
        size = int.from_bytes(data[start : start + width], "big")
        if size < 0x80 or size >> (8 * (width - 1)) == 0:
            raise Malformed("length not minimal")
        start += width
    end = start + size
    if n < end:
        raise Malformed("element ends early")
    return _new(Element, (tag, data[at:end], data[start:end]))


def elements(data: bytes) -> list[Element]:
    """All elements of a body."""
    out, at, n = [], 0, len(data)
    while at < n:
        e = element(data, at)
        out.append(e)
        at += len(e[1])
    return out


def only(data: bytes, tag: int) -> bytes:
    """The body of the single element of a tag that data is."""
    e = element(data)
    if e.tag != tag or len(e.raw) != len(data):
        raise Malformed("another element, or more")
    return e.body


def body_of(e: Element, tag: int) -> bytes:
    if e.tag != tag:
        raise Malformed("another tag")
    return e.body


def sequence(data: bytes) -> list[Element]:
    """The elements of the single SEQUENCE that data is."""
    return elements(only(data, SEQUENCE))


@lru_cache(4096)
def oid(body: bytes, widest: int | None = 2**31 - 1) -> str:
    """An object identifier in dotted form; widest: the greatest arc (None: any)."""
    if not body or body[-1] & 0x80:
        raise Malformed("bad OID")
    arcs, value, fresh = [], 0, True
    for b in body:
        if fresh and b == 0x80:
            raise Malformed("padded OID arc")
        value, fresh = value << 7 | b & 0x7F, not b & 0x80
        if widest is not None and value > widest:
            raise Malformed("OID arc too large")
        if fresh:
            arcs.append(value)
            value = 0
    top = min(arcs[0] // 40, 2)
    return ".".join(map(str, [top, arcs[0] - 40 * top, *arcs[1:]]))


def boolean(body: bytes) -> bool:
    if body not in (b"\x00", b"\xff"):
        raise Malformed("bad BOOLEAN")
    return body == b"\xff"


def integer(body: bytes) -> int:
    """A minimally encoded INTEGER."""
    if not body or (len(body) > 1 and (body[0] == 0 and body[1] < 0x80 or body[0] == 0xFF and body[1] >= 0x80)):
        raise Malformed("bad INTEGER")
    return int.from_bytes(body, "big", signed=True)


def bit_string(body: bytes) -> tuple[bytes, int]:
    """The bytes of a BIT STRING and how many low bits of the last are unused."""
    if not body or body[0] > 7 or (len(body) == 1 and body[0]) or (len(body) > 1 and body[-1] & ((1 << body[0]) - 1)):
        raise Malformed("bad BIT STRING")
    return body[1:], body[0]


# --- building, for rebuilt certificates and for tests ---


def make(tag: int, *parts: bytes) -> bytes:
    """An element of a tag around its parts."""
    body = b"".join(parts)
    n = len(body)
    if n < 0x80:
        return bytes([tag, n]) + body
    size = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag, 0x80 | len(size)]) + size + body


@lru_cache(1024)
def make_oid(dotted: str) -> bytes:
    a, b, *rest = map(int, dotted.split("."))
    out = bytearray()
    for arc in [40 * a + b, *rest]:
        groups = [arc & 0x7F]
        while arc := arc >> 7:
            groups.append(arc & 0x7F | 0x80)
        out += bytes(reversed(groups))
    return make(OID, bytes(out))
