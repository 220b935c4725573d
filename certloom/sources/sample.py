"""Samples: captured ranges of a log with the proofs that tie them to a signed head, and measurements over them.

A sample is a folder <root>/<log>/<first>-<last>: `entries` (JSON lines), `proofs.json`, and `sample.json`,
which is written last. Proofs cover what is in the log's tree; a content hash covers the rest.
"""

from __future__ import annotations

import base64
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.errors import UsageError, VerificationError
from certloom.functions.codes import NO_CERTIFICATE
from certloom.functions.entries import decoded
from certloom.functions.merkle import CompactRange, leaf_hash, verify_consistency, verify_inclusion
from certloom.operators import stats
from certloom.operators.numbering import durable
from certloom.plans.heads import consistency, fetch_head
from certloom.plans.ingest import extend_tree
from certloom.sources.ctlog import LogSource, Rfc6962, open_log, read_capture, write_capture
from certloom.sources.dataset import content_sum
from certloom.sources.loglist import check_key
from certloom.sources.store import Store
from certloom.sources.tiles import SignedHead, verify_head

# The rules of a sample's range, and the bytes an entry may take before it is captured.
BOUNDARY, LEAST, MOST = 5000, 50_000, 500_000
SEED_BYTES = 7409
FORMAT = 1


def check_range(kind: str, start: int, count: int, boundary: int = BOUNDARY, least: int = LEAST, most: int = MOST) -> None:
    """Canonical samples start at 0, representative ones at a boundary; both have whole boundaries of entries."""
    if kind not in ("canonical", "representative"):
        raise UsageError(f"unknown kind of sample {kind!r}")
    if not least <= count <= most or count % boundary:
        raise UsageError(f"a sample has {least} to {most} entries, a multiple of {boundary}, not {count}")
    if start % boundary or kind == "canonical" and start:
        raise UsageError(f"a {kind} sample starts at {'0' if kind == 'canonical' else f'a multiple of {boundary}'}, not {start}")


def start_at_head(size: int, count: int, boundary: int = BOUNDARY) -> int:
    """The start of the last whole window below a tree's size."""
    if size < count:
        raise UsageError(f"the log has {size} entries, fewer than {count}")
    return (size - count) // boundary * boundary


def capture(
    spark: SparkSession, root: str, log: str, options: dict, kind: str, count: int, start: int | None = None, pinned: dict | None = None,
    boundary: int = BOUNDARY, least: int = LEAST, most: int = MOST,
) -> str:
    """Captures count entries from start on (None: the last whole window) and returns the verified sample's folder.

    options are those of the log source. The head must be signed by the pinned key, if there is one.
    """
    if start is None and kind != "representative":
        raise UsageError("only a representative sample can start at the head")
    check_range(kind, start or 0, count, boundary, least, most)
    source = open_log(options)
    head = fetch_head(source, pinned)
    if pinned and pinned.get("key"):
        verify_head(spark, head, check_key(pinned["key"], pinned["log_id"]))
    start = start_at_head(head.size, count, boundary) if start is None else start
    end = start + count
    if end > head.size:
        raise UsageError(f"the log has {head.size} entries; {start} to {end - 1} do not fit")
    folder = f"{root}/{log}/{start:012d}-{end - 1:012d}"
    store = Store(spark, folder)
    if store.exists("sample.json"):
        raise FileExistsError(folder)
    total, used = store.room() if store.exists("") else (0, 0)
    if total:
        stats.require_room(total, used, count * SEED_BYTES)
    spark.dataSource.register(LogSource)
    store.delete("entries")
    write_capture(spark.read.format("ctlog").options(**options, start=start, end=end).load(), store.path("entries"))
    at = range(boundary, end + 1, boundary) if kind == "canonical" else [end]
    proofs: dict = {"consistency": [[n, [base64.b64encode(x).decode() for x in consistency(source, n, head.size)]] for n in at if n < head.size]}
    if kind == "representative" and start:
        if not isinstance(source, Rfc6962):
            raise UsageError("a representative sample of a tiled log starts at 0")
        first = read_capture(spark, store.path("entries")).where(F.col("idx") == start).first()
        index, path = source.inclusion(leaf_hash(bytes(first["leaf_input"])), head.size)
        if index != start:
            raise VerificationError(f"the log proves entry {start} at {index}; choose another start")
        proofs["inclusion"] = [base64.b64encode(x).decode() for x in path]
    store.write_json("proofs.json", proofs, overwrite=True)
    rows = read_capture(spark, store.path("entries"))
    manifest = {
        "format": FORMAT, "kind": kind, "log": {"name": log} | {k: (pinned or {}).get(k) for k in ("log_id", "key", "url", "kind")}, "start": start, "count": count, "boundary": boundary,
        "head": {"size": head.size, "timestamp": head.timestamp, "root": head.root.hex(), "signature": head.signature.hex()},
        "content": rows.agg(content_sum(rows.columns).alias("c")).first()["c"], "captured_at": time.time(),
    }
    _check(spark, store, manifest, proofs)
    store.write_json("sample.json", manifest)
    return folder


def left_of(leaf: bytes, index: int, size: int, proof: list[bytes], root: bytes) -> CompactRange:
    """The tree of the entries before a leaf, which the leaf's inclusion proof holds."""
    if not verify_inclusion(leaf, index, size, proof, root):
        raise VerificationError(f"entry {index} is not in the signed tree")
    fn, sn, left = index, size - 1, []
    for p in proof:
        if fn & 1 or fn == sn:
            left.append(p)
            while not fn & 1 and fn:
                fn, sn = fn >> 1, sn >> 1
        fn, sn = fn >> 1, sn >> 1
    return CompactRange(index, left[::-1])


def _check(spark: SparkSession, store: Store, m: dict, proofs: dict) -> DataFrame:
    head = SignedHead(m["head"]["size"], m["head"]["timestamp"], bytes.fromhex(m["head"]["root"]), bytes.fromhex(m["head"]["signature"]))
    if m["log"].get("key"):
        verify_head(spark, head, check_key(m["log"]["key"], m["log"]["log_id"]))
    rows = read_capture(spark, store.path("entries"))
    start, end = m["start"], m["start"] + m["count"]
    facts = rows.agg(content_sum(rows.columns).alias("c"), F.min("idx").alias("a"), F.max("idx").alias("b"), F.count_distinct("idx").alias("n")).first()
    if facts["c"] != m["content"] or (facts["a"], facts["b"], facts["n"]) != (start, end - 1, m["count"]):
        raise VerificationError(f"{store.root}: not the entries captured")
    leaves = durable(rows.select("idx", F.unhex(F.sha2(F.concat(F.lit(b"\x00"), "leaf_input"), 256)).alias("leaf_hash")))
    tree = CompactRange()
    if start:
        first = bytes(leaves.where(F.col("idx") == start).first()["leaf_hash"])
        tree = left_of(first, start, head.size, [base64.b64decode(x) for x in proofs.get("inclusion") or []], head.root)
    nodes = {n: [base64.b64decode(x) for x in listed] for n, listed in proofs["consistency"]}
    for stop in range(m["boundary"], end + 1, m["boundary"]) if m["kind"] == "canonical" else [end]:
        tree = extend_tree(tree, leaves.where(F.col("idx").between(tree.size, stop - 1)), tree.size, stop - 1)
        if not verify_consistency(stop, head.size, tree.root(), head.root, nodes.get(stop, [])):
            raise VerificationError(f"{store.root}: entries below {stop} are not those of the signed tree")
    return rows


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A sample's raw entries (idx, leaf_input, extra_data), after all its checks."""
    store = Store(spark, folder)
    m = store.read_json("sample.json")
    if m["format"] != FORMAT:
        raise VerificationError(f"{folder}: unknown format {m['format']}")
    check_range(m["kind"], m["start"], m["count"], m["boundary"], 1, 2**62)
    return _check(spark, store, m, store.read_json("proofs.json"))


@F.arrow_udf(T.LongType())
def packed_size(der: pa.Array) -> pa.Array:
    """Bytes of each value after zstd."""
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    return pa.array([None if x is None else len(c.compress(x)) for x in der.to_pylist()], pa.int64())


def measure(raw: DataFrame) -> dict:
    """Figures of raw entries: links and their delays, repeated certificates, errors, and sizes after compression."""
    rows = durable(decoded(raw.withColumn("log", F.lit("sample"))))
    sha = F.sha2("cert", 256)
    certs = rows.where(F.col("cert").isNotNull()).select("idx", "entry_type", F.lower(F.hex("digest")).alias("digest"), F.col("ts_ms").cast("long").alias("ts_ms"), sha.alias("sha256"), "cert")
    chain = rows.where(F.col("chain").isNotNull()).select(F.explode("chain").alias("cert")).select(sha.alias("sha256"))
    different = certs.dropDuplicates(["sha256"])
    sizes = different.select(F.col("entry_type").alias("kind"), F.lit("none").alias("dictionary"), "entry_type", F.octet_length("cert").cast("long").alias("raw"), packed_size("cert").alias("stored"))
    one = lambda df: df.first().asDict()
    return {
        "entries": rows.count(),
        "links": one(stats.link_report(stats.link_facts(certs))),
        "leaf_certificates": one(stats.dedup_report(certs)),
        "chain_certificates": one(stats.dedup_report(chain)),
        "leaf_errors": [r.asDict() for r in stats.error_counts(rows, NO_CERTIFICATE).orderBy("leaf_error").collect()],
        "compression": [r.asDict() for r in stats.compression_groups(sizes).orderBy("kind").collect()],
        "stored_estimate": one(stats.scaled_estimate(sizes.withColumn("k", F.concat("kind", F.col("stored").cast("string"), F.col("raw").cast("string"))), "k", "stored")),
    }
