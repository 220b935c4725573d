"""Signed heads of followed logs: fetched, checked, kept, and tied to a batch by a consistency proof."""

from __future__ import annotations

import base64
import hashlib
import time

from certloom.errors import VerificationError
from certloom.functions.merkle import node_hash, verify_consistency
from certloom.plans.ingest import Head
from certloom.sources.ctlog import Rfc6962, Tiled
from certloom.sources.dataset import Dataset
from certloom.sources.loglist import check_key, origin
from certloom.sources.tiles import WIDTH, MalformedNote, SignedHead, check_heads, parse_checkpoint, tile_path, tile_width, verify_head


def fetch_head(log: Rfc6962 | Tiled, pinned: dict | None) -> SignedHead:
    """The log's head as it serves it; the signature is not yet checked."""
    if isinstance(log, Rfc6962):
        h = log.head()
        return SignedHead(h["tree_size"], h["timestamp"], base64.b64decode(h["sha256_root_hash"]), base64.b64decode(h.get("tree_head_signature") or ""))
    note = log.get(f"{log.url}/checkpoint")
    if pinned and pinned.get("key"):
        return parse_checkpoint(note, origin(pinned["submission_url"] or pinned["url"]), hashlib.sha256(base64.b64decode(pinned["key"])).digest())
    lines = note.decode().split("\n")
    if len(lines) < 3 or not lines[1].isdigit():
        raise MalformedNote("size")
    return SignedHead(int(lines[1]), 0, base64.b64decode(lines[2]), b"")


class HashTiles:
    """Hashes of a tiled log's tree of a size, from its tiles."""

    def __init__(self, log: Tiled, size: int):
        self.log, self.size, self._tiles = log, size, {}

    def _tile(self, level: int, n: int) -> bytes:
        if (level, n) not in self._tiles:
            width = tile_width(level, n, self.size)
            try:
                data = self.log.get(f"{self.log.url}/{tile_path(level, n, width)}")
            except FileNotFoundError:
                if width == WIDTH:
                    raise
                data = self.log.get(f"{self.log.url}/{tile_path(level, n)}")  # it has become full
            if len(data) < 32 * width:
                raise VerificationError(f"tile {level}/{n} is cut short")
            self._tiles[level, n] = data
        return self._tiles[level, n]

    def node(self, level: int, index: int) -> bytes:
        """The root of the 2^level leaves from index * 2^level on."""
        inner = level % 8
        first = index << inner
        tile, at = self._tile(level // 8, first // WIDTH), first % WIDTH
        row = [tile[32 * i : 32 * i + 32] for i in range(at, at + (1 << inner))]
        while len(row) > 1:
            row = [node_hash(a, b) for a, b in zip(row[::2], row[1::2], strict=True)]
        return row[0]

    def root(self, low: int, high: int) -> bytes:
        """The root of leaves low to high - 1, low being a multiple of the subtree's size."""
        n = high - low
        if n & (n - 1) == 0:
            return self.node(n.bit_length() - 1, low // n)
        k = 1 << (n - 1).bit_length() - 1
        return node_hash(self.root(low, low + k), self.root(low + k, high))

    def consistency(self, first: int) -> list[bytes]:
        """The proof that the tree of the first leaves is a prefix (RFC 9162, 2.1.4.1)."""

        def part(m: int, low: int, high: int, whole: bool) -> list[bytes]:
            if m == high - low:
                return [] if whole else [self.root(low, high)]
            k = 1 << (high - low - 1).bit_length() - 1
            if m <= k:
                return [*part(m, low, low + k, whole), self.root(low + k, high)]
            return [*part(m - k, low + k, high, False), self.root(low, low + k)]

        return part(first, 0, self.size, True) if 0 < first < self.size else []


def consistency(log: Rfc6962 | Tiled, first: int, second: int) -> list[bytes]:
    if not 0 < first < second:
        return []
    return log.consistency(first, second) if isinstance(log, Rfc6962) else HashTiles(log, second).consistency(first)


def kept_head(dataset: Dataset, name: str) -> SignedHead | None:
    """The last head of a log that was checked."""
    path = f"heads/{name}.json"
    if not dataset.store.exists(path):
        return None
    h = dataset.store.read_json(path)
    return SignedHead(h["size"], h["timestamp"], bytes.fromhex(h["root"]), bytes.fromhex(h["signature"]))


class Heads:
    """What `follow` asks for a batch's end: the log's signed head, and the proof up to it.

    A head must be signed by the pinned key, if one is pinned, must not be older, smaller or of
    another root than the one kept before, and must be consistent with it. Then it is kept in
    heads/<log>.json.
    """

    def __init__(self, dataset: Dataset, name: str, log: Rfc6962 | Tiled, pinned: dict | None = None):
        self.dataset, self.name, self.log, self.pinned = dataset, name, log, pinned

    def check(self, new: SignedHead) -> None:
        if self.pinned and self.pinned.get("key"):
            verify_head(self.dataset.spark, new, check_key(self.pinned["key"], self.pinned["log_id"]))
        old = kept_head(self.dataset, self.name)
        check_heads(old, new)
        if old and not verify_consistency(old.size, new.size, old.root, new.root, consistency(self.log, old.size, new.size)):
            raise VerificationError(f"the tree of {new.size} does not extend the one of {old.size}")

    def newest(self) -> SignedHead:
        """The head now, checked and kept."""
        new = fetch_head(self.log, self.pinned)
        self.check(new)
        value = {"size": new.size, "timestamp": new.timestamp, "root": new.root.hex(), "signature": new.signature.hex(), "seen_at": time.time()}
        self.dataset.store.write_json(f"heads/{self.name}.json", value, overwrite=True)
        return new

    def __call__(self, size: int) -> tuple[Head, list[bytes]]:
        new = self.newest()
        if size > new.size:
            raise VerificationError(f"a batch ends at {size}, beyond the signed tree of {new.size}")
        return Head(new.size, new.root, new.timestamp), consistency(self.log, size, new.size)
