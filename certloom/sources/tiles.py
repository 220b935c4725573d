"""Tiled logs: paths, data tiles, checkpoints, signatures."""

from __future__ import annotations

import base64
import binascii
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from certloom.errors import VerificationError
from certloom.functions.leaf import Reader, Short

WIDTH = 256


def index_path(n: int) -> str:
    """A tile's number in groups of three digits, all but the last marked: 1234067 is x001/x234/067."""
    groups = [f"{n % 1000:03d}"]
    while n := n // 1000:
        groups.insert(0, f"x{n % 1000:03d}")
    return "/".join(groups)


def tile_path(level: int | str, n: int, width: int = WIDTH) -> str:
    return f"tile/{level}/{index_path(n)}" + ("" if width == WIDTH else f".p/{width}")


def data_path(n: int, width: int = WIDTH) -> str:
    return tile_path("data", n, width)


def issuer_path(fingerprint: bytes) -> str:
    return f"issuer/{fingerprint.hex()}"


def tile_width(level: int, n: int, size: int) -> int:
    """The width of a tile in a tree: full, partial at the right edge, or 0 beyond it."""
    return max(0, min(WIDTH, (size >> 8 * level) - n * WIDTH))


class MalformedTile(ValueError):
    """A tile whose entries cannot be told apart."""


@dataclass
class TileEntry:
    timestamped: bytes
    precert: bytes | None
    fingerprints: list[bytes]

    def leaf_input(self) -> bytes:
        return b"\x00\x00" + self.timestamped

    def extra_data(self, issuer: Callable[[bytes], bytes]) -> bytes:
        """As a log without tiles serves it, the chain's bytes taken from issuer(fingerprint)."""
        vec = lambda b: len(b).to_bytes(3, "big") + b
        chain = vec(b"".join(vec(issuer(f)) for f in self.fingerprints))
        return (vec(self.precert) if self.precert is not None else b"") + chain


def parse_data_tile(data: bytes, count: int) -> list[TileEntry]:
    """The entries of a data tile, which must be `count` and nothing more."""
    r, out = Reader(data), []
    try:
        while len(out) < count:
            start = r.at
            r.take(8)
            kind = r.number(2)
            if kind > 1:
                raise MalformedTile(f"entry {len(out)}: type {kind}")
            r.take(32 * kind)
            r.vector(3)
            r.vector(2)
            stamped = data[start : r.at]
            pre = r.vector(3) if kind else None
            prints = r.vector(2)
            if len(prints) % 32:
                raise MalformedTile(f"entry {len(out)}: fingerprints")
            out.append(TileEntry(stamped, pre, [prints[i : i + 32] for i in range(0, len(prints), 32)]))
    except Short:
        raise MalformedTile(f"ends in entry {len(out)} of {count}") from None
    if not r.empty:
        raise MalformedTile(f"goes on after {count} entries")
    return out


# --- checkpoints ---

LONGEST, MOST_SIGNATURES = 1 << 20, 64


class MalformedNote(ValueError):
    """A checkpoint that cannot be read."""


def key_id(name: str, log_id: bytes) -> bytes:
    return hashlib.sha256(name.encode() + b"\n\x05" + log_id).digest()[:4]


def _canonical(text: str) -> bytes:
    try:
        raw = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        raise MalformedNote("not base64") from None
    if base64.b64encode(raw).decode() != text:
        raise MalformedNote("base64 is not canonical")
    return raw


@dataclass
class SignedHead:
    size: int
    timestamp: int
    root: bytes
    signature: bytes


def parse_checkpoint(note: bytes, name: str, log_id: bytes) -> SignedHead:
    """The head in a signed note of the log; the signature is not yet checked.

    The note must be three lines and exactly one signature by the log's key; others are ignored.
    """
    try:
        text = note.decode()
    except UnicodeDecodeError:
        raise MalformedNote("not UTF-8") from None
    if len(note) > LONGEST or any(c < " " and c != "\n" for c in text) or not text.endswith("\n") or "\n\n" not in text:
        raise MalformedNote("not a signed note")
    at = text.rindex("\n\n")
    body, tail = text[:at].split("\n"), text[at + 2 : -1]
    signatures = []
    for line in tail.split("\n") if tail else []:
        words = line.split(" ")
        if len(words) != 3 or words[0] != "—" or not words[1] or "+" in words[1]:
            raise MalformedNote("signature line")
        raw = _canonical(words[2])
        if len(raw) < 5:
            raise MalformedNote("short signature")
        signatures.append((words[1], raw))
    if not signatures or len(signatures) > MOST_SIGNATURES or len(body) != 3:
        raise MalformedNote("lines")
    who, size, root = body
    if not who or len(who.encode()) > 255 or not size.isascii() or not size.isdigit() or str(int(size)) != size or int(size) >> 64:
        raise MalformedNote("origin or size")
    digest = _canonical(root)
    if len(digest) != 32:
        raise MalformedNote("root")
    if who != name:
        raise VerificationError(f"the checkpoint is of {who!r}, not {name!r}")
    mine = [raw[4:] for n, raw in signatures if n == name and raw[:4] == key_id(name, log_id)]
    if len(mine) != 1:
        raise VerificationError(f"{len(mine)} signatures by the log's key where one is needed")
    if len(mine[0]) < 12 or len(mine[0]) != 12 + int.from_bytes(mine[0][10:12], "big"):
        raise MalformedNote("signature body")
    return SignedHead(int(size), int.from_bytes(mine[0][:8], "big"), digest, mine[0][8:])


def signed_bytes(head: SignedHead) -> bytes:
    """What the log signs of a head (RFC 6962, 3.5)."""
    return b"\x00\x01" + head.timestamp.to_bytes(8, "big") + head.size.to_bytes(8, "big") + head.root


def verify_head(spark, head: SignedHead, key: bytes) -> None:
    """Checks a head's signature (SHA-256 with ECDSA or RSA) with the driver JVM's own cryptography."""
    kinds = {b"\x04\x03": ("EC", "SHA256withECDSA"), b"\x04\x01": ("RSA", "SHA256withRSA")}
    kind = kinds.get(head.signature[:2])
    if not kind or len(head.signature) != 4 + int.from_bytes(head.signature[2:4], "big"):
        raise VerificationError("unknown signature algorithm or wrong length")
    jvm = spark.sparkContext._jvm
    try:
        public = jvm.java.security.KeyFactory.getInstance(kind[0]).generatePublic(jvm.java.security.spec.X509EncodedKeySpec(bytearray(key)))
        check = jvm.java.security.Signature.getInstance(kind[1])
        check.initVerify(public)
        check.update(bytearray(signed_bytes(head)))
        good = check.verify(bytearray(head.signature[4:]))
    except Exception as e:  # the JVM raises for malformed keys and signatures
        raise VerificationError(f"the head's signature cannot be checked: {e}") from None
    if not good:
        raise VerificationError("the head's signature is wrong")


def check_heads(old: SignedHead | None, new: SignedHead) -> None:
    """A log may not shrink, change a root, or go back in time."""
    if old is None:
        return
    if new.size < old.size:
        raise VerificationError(f"the tree shrank from {old.size} to {new.size}")
    if new.size == old.size and new.root != old.root:
        raise VerificationError(f"the root of the tree of {new.size} changed")
    if new.timestamp < old.timestamp:
        raise VerificationError("the head is older than the one before")
