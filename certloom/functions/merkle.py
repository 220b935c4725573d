"""RFC 6962 / RFC 9162 Merkle trees: hashes, compact ranges, proofs, and a root over a DataFrame."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.errors import VerificationError


def leaf_hash(data: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + data).digest()


def node_hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


class CompactRange:
    """The roots of the perfect subtrees of the first `size` leaves, largest first."""

    def __init__(self, size: int = 0, nodes: list[bytes] | None = None):
        self.size, self.nodes = size, list(nodes or [])
        if len(self.nodes) != size.bit_count():
            raise VerificationError(f"a tree of {size} leaves has {size.bit_count()} perfect subtrees, not {len(self.nodes)}")

    def append(self, hashed: bytes, level: int = 0) -> None:
        """Adds one perfect subtree of 2^level leaves at a place that is a multiple of its size."""
        if self.size & ((1 << level) - 1):
            raise VerificationError("a subtree must start at a multiple of its size")
        left = self.size >> level
        while left & 1:
            hashed = node_hash(self.nodes.pop(), hashed)
            left >>= 1
        self.nodes.append(hashed)
        self.size += 1 << level

    def root(self) -> bytes:
        if not self.nodes:
            return hashlib.sha256(b"").digest()
        out = self.nodes[-1]
        for n in reversed(self.nodes[:-1]):
            out = node_hash(n, out)
        return out

    def to_json(self) -> str:
        return json.dumps({"size": self.size, "compact_range": [n.hex() for n in self.nodes]})

    @classmethod
    def from_json(cls, text: str) -> CompactRange:
        d = json.loads(text)
        return cls(d["size"], [bytes.fromhex(n) for n in d["compact_range"]])


def verify_inclusion(leaf: bytes, index: int, size: int, proof: list[bytes], root: bytes) -> bool:
    """RFC 9162, 2.1.3.2."""
    if not 0 <= index < size:
        return False
    fn, sn, at = index, size - 1, leaf
    for p in proof:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            at = node_hash(p, at)
            while not fn & 1 and fn:
                fn, sn = fn >> 1, sn >> 1
        else:
            at = node_hash(at, p)
        fn, sn = fn >> 1, sn >> 1
    return sn == 0 and at == root


def verify_consistency(first: int, second: int, first_root: bytes, second_root: bytes, proof: list[bytes]) -> bool:
    """RFC 9162, 2.1.4.2."""
    if first > second or first < 0:
        return False
    if first == 0:
        return not proof
    if first == second:
        return not proof and first_root == second_root
    nodes = list(proof)
    if first & (first - 1) == 0:
        nodes.insert(0, first_root)
    if not nodes:
        return False
    fn, sn = first - 1, second - 1
    while fn & 1:
        fn, sn = fn >> 1, sn >> 1
    old = new = nodes[0]
    for p in nodes[1:]:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            old, new = node_hash(p, old), node_hash(p, new)
            while not fn & 1 and fn:
                fn, sn = fn >> 1, sn >> 1
        else:
            new = node_hash(new, p)
        fn, sn = fn >> 1, sn >> 1
    return sn == 0 and old == first_root and new == second_root


def _pair(left, right):
    return F.unhex(F.sha2(F.concat(F.lit(b"\x01"), left, right), 256))


def fold_level(nodes: DataFrame) -> DataFrame:
    """(idx, hash) one level up: pairs are hashed, an odd last node is promoted."""
    up = nodes.groupBy(F.shiftright("idx", 1).alias("idx")).agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("r")
    )
    return up.select("idx", F.when(F.col("r").isNull(), F.col("l")).otherwise(_pair(F.col("l"), F.col("r"))).alias("hash"))


#: Levels folded inside one task: subtrees of 2^CHUNK_LEVELS leaves.
CHUNK_LEVELS = 12


def subtree_roots(nodes: DataFrame, levels: int = CHUNK_LEVELS) -> DataFrame:
    """(idx, hash) of the subtrees of 2^levels leaves; one shuffle, groups of a fixed size."""
    leaves = nodes.groupBy(F.shiftright("idx", levels).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("n"))
    layer = F.transform("n", lambda x: x["hash"])

    def fold(layer, _):
        return F.transform(
            F.sequence(F.lit(0), F.call_function("div", F.size(layer) - 1, F.lit(2)).cast("int")),
            lambda i: F.when(F.size(layer) > 2 * i + 1, _pair(layer[2 * i], F.get(layer, 2 * i + 1))).otherwise(layer[2 * i]),
        )

    return leaves.select("idx", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), layer, fold)[0].alias("hash"))


def merkle_root(leaves: DataFrame, size: int) -> bytes:
    """The root over leaves (idx from 0 to size - 1, hash)."""
    if size == 0:
        return CompactRange().root()
    level, width = 0, size
    nodes = leaves.select(F.col("idx").cast("long").alias("idx"), "hash")
    while width > 4096:
        nodes = subtree_roots(nodes)
        width = -(-width >> CHUNK_LEVELS) if width % (1 << CHUNK_LEVELS) == 0 else (width >> CHUNK_LEVELS) + 1
        level += 1
    rows = [bytes(r["hash"]) for r in nodes.orderBy("idx").collect()]  # 4096 nodes at most
    if len(rows) != width:
        raise VerificationError(f"{len(rows)} nodes where {width} were expected")
    while len(rows) > 1:
        rows = [node_hash(*rows[i : i + 2]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
    return rows[0]
