"""Ingest: one contiguous range of a log becomes a verified, committed batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.errors import UsageError, VerificationError
from certloom.functions.certificates import built, table_rows
from certloom.functions.entries import Made, hashed
from certloom.functions.merkle import CHUNK_LEVELS, CompactRange, subtree_roots, verify_consistency
from certloom.operators.numbering import discard, durable, numbered, pieces, stored, together
from certloom.operators.stats import SEEDS, batch_facts, bytes_per_entry, peak_bytes, require_room
from certloom.sources.dataset import Dataset, Snapshot
from certloom.sources.footers import canary
from certloom.sources.schemas import TABLES

#: Hashes and keys of one batch that are broadcast against the earlier batches; more are shuffled.
BROADCAST_KEYS = 2_000_000
#: Certificates whose ids are broadcast to their entries; of more, the entries are shuffled.
BROADCAST_IDS = 500_000
#: Batches that go through the same jobs; trees and manifests are theirs.
TOGETHER = 8
#: The share of its volume that a dataset may fill, and the setting that changes it.
DISK_CAP, CAP_CONF = 0.85, "spark.certloom.diskCap"
#: The tables that are not derived, in the order of their writes.
SOURCES = ("entries", "chains", "vault", "quarantine")
#: Columns whose Parquet files get bloom filters, by table.
BLOOM = {"certs": ("sha256",), "names": ("name", "etld1")}


@dataclass
class Head:
    """A signed tree head; its signature is checked where it is fetched."""

    size: int
    root: bytes
    timestamp: int = 0


def _sha(c) -> Column:
    return F.unhex(F.sha2(c, 256))


def chain_id(prints: Column) -> Column:
    """The hash of a chain's fingerprints one after another."""
    return _sha(F.aggregate(prints, F.lit(b""), lambda acc, x: F.concat(acc, x)))


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Each value of key once, with the struct `at` of its least order columns."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("at"))


def extend_tree(tree: CompactRange, leaves: DataFrame, first: int, last: int) -> CompactRange:
    """The tree with leaves (idx, leaf_hash) first..last added.

    Whole aligned subtrees are folded on the executors, so the driver gets one hash for each of
    them and the few leaves before and after.
    """
    unit = 1 << CHUNK_LEVELS
    low, high = -(-first // unit) * unit, (last + 1) // unit * unit
    out = CompactRange(tree.size, tree.nodes)
    nodes = leaves.select(F.col("idx"), F.col("leaf_hash").alias("hash"))
    edge = nodes.where((F.col("idx") < low) | (F.col("idx") >= high)) if low < high else nodes
    edges = sorted((r["idx"], bytes(r["hash"])) for r in edge.collect())  # less than 2 * unit rows
    inner = subtree_roots(nodes.where(F.col("idx").between(low, high - 1))) if low < high else None
    for idx, h in edges:
        if inner is not None and idx >= high:
            for r in sorted(inner.collect()):  # one row for each `unit` entries
                out.append(bytes(r["hash"]), CHUNK_LEVELS)
            inner = None
        out.append(h)
    if inner is not None:
        for r in sorted(inner.collect()):
            out.append(bytes(r["hash"]), CHUNK_LEVELS)
    return out


def check_tree(tree: CompactRange, head: Head | None, proof: list[bytes] | None) -> None:
    """The batch's tree is the head's, or a prefix of it by a consistency proof."""
    if head is None:
        return
    good = tree.root() == head.root if tree.size == head.size else verify_consistency(tree.size, head.size, tree.root(), head.root, proof or [])
    if not good:
        raise VerificationError(f"the first {tree.size} entries are not those of the signed tree of {head.size}")


def _among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column is among a batch's keys."""
    keys = keys.select(column)
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, column, "left_semi")


def read_entries(raw: DataFrame, log: str, tiled: bool = False) -> DataFrame:
    """Raw entries (idx, leaf_input, extra_data) of a log decoded and hashed, once for all that an ingest does with them."""
    return stored(hashed(raw.withColumn("log", F.lit(log)), tiled))


@dataclass
class Batch:
    """What one commit adds: raw entries of a log, and what is known of them."""

    raw: DataFrame | None
    log: str
    head: Head | None = None
    proof: list[bytes] | None = None
    tiled: bool = False
    fetch: dict | None = None


def ingest_batches(dataset: Dataset, batches: Iterable[tuple[DataFrame, str]]) -> list[dict]:
    """Commits batches (raw entries, log) in order and returns their manifests.

    TOGETHER of them at a time go through the same jobs: each job costs its plan and its start, however few its rows.
    """
    todo, out = [Batch(raw, log) for raw, log in batches], []
    for at in range(0, len(todo), TOGETHER):
        out += _ingest(dataset, todo[at : at + TOGETHER])
    return out


def ingest_parts(dataset: Dataset, raw: DataFrame | Made, logs: list[str]) -> list[dict]:
    """ingest_batches() of one table: raw entries with the column part (int), the place of their batch's log in logs.

    One pass decodes the batches: entries of one certificate that lie side by side are decoded together, whichever batch has them.
    """
    out = []
    for at in range(0, len(logs), TOGETHER):
        some, later = logs[at : at + TOGETHER], list(range(at + TOGETHER, len(logs)))

        def read(parts: list[int], at=at, some=some, later=later) -> DataFrame:
            if at or len(parts) < len(some):
                here = raw.where(F.col("part").isin([at + p for p in parts]))
            else:  # and what is of no batch, which is refused
                here = raw.where(~F.coalesce(F.col("part").isin(later), F.lit(False))) if later else raw
            named = here.withColumn("log", _placed(F.col("part") - at, some))
            return stored(hashed(named.withColumn("part", F.coalesce(_placed(F.col("part") - at, range(len(some))), F.lit(-1)))))

        out += _ingest(dataset, [Batch(None, log) for log in some], read)
    return out


def _placed(place: Column, values: Iterable) -> Column:
    return F.coalesce(*[F.when(place == p, F.lit(v)) for p, v in enumerate(values)])


def ingest_batch(
    dataset: Dataset, raw: DataFrame, log: str, head: Head | None = None, proof: list[bytes] | None = None, tiled: bool = False, fetch: dict | None = None
) -> dict:
    """Commits raw entries (idx, leaf_input, extra_data) of one log and returns the manifest.

    The entries must follow the log's last batch without gaps. A batch committed before is
    returned as it is, so a repeated micro-batch changes nothing. Before anything is written the
    volume must have room for it, and before the commit the written files are probed.

    Earlier batches are scanned twice, for the hashes of certificates and for issuance keys, against
    the batch's own ones, which are broadcast: nothing of the earlier batches is shuffled.
    """
    return _ingest(dataset, [Batch(raw, log, head, proof, tiled, fetch)])[0]


def _ingest(dataset: Dataset, batches: list[Batch], read: Callable[[list[int]], DataFrame] | None = None) -> list[dict]:
    """Commits batches in order, as if one by one: those before a wrong one are committed before it raises.

    read: the decoded entries of some of the batches, by their places, in one table with the place as part.
    """
    spark = dataset.spark
    if read:
        made = [read(list(range(len(batches))))]
        rows = made[0]
    else:
        made = together(spark, *[lambda b=b: read_entries(b.raw, b.log, b.tiled) for b in batches])
        rows = _union(r.withColumn("part", F.lit(p)) for p, r in enumerate(made))
    try:
        # most often all batches are new and right: what is known of them and their certificates are found side by side
        (out, new, wrong), firsts = together(spark, lambda: _checked(dataset, batches, rows), lambda: stored(_first_certificates(rows)))
        made.append(firsts)
        if new:
            if read and new[-1] >= len(new):  # what a batch committed before has of the bytes is not with the others
                made.append(read(new))
                rows = made[-1]
            if len(new) < len(batches):
                rows = rows.where(F.col("part").isin(new)).withColumn("part", F.coalesce(*[F.when(F.col("part") == p, F.lit(n)) for n, p in enumerate(new)]))
                firsts = stored(_first_certificates(rows))
                made.append(firsts)
            committed = _commit(dataset, [batches[p] for p in new], rows, firsts, [out[p] for p in new])
            for p, m in zip(new, committed, strict=True):
                out[p].update(m)
        if wrong:
            raise wrong
        return out
    finally:
        discard(*made)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _checked(dataset: Dataset, batches: list[Batch], rows: DataFrame) -> tuple[list[dict], list[int], Exception | None]:
    """(manifests, the places of those not committed before with what the entries tell of them, what is wrong with the next batch)."""
    snap = dataset.snapshot(allow_mixed=True)
    stats = {r["part"]: r for r in rows.groupBy("part").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), F.count_distinct("idx").alias("d")).collect()}
    if stats.keys() - set(range(len(batches))):
        return [], [], UsageError("entries of no batch")
    known = {(m["log"], m["first"], m["last"]): m for m in snap.batches}
    nexts = {log: m["last"] + 1 for log, m in snap.tips().items()}
    out, new = [], []
    for p, b in enumerate(batches):
        if p not in stats:
            return out, new, UsageError("no entries to ingest")
        first, last, n = stats[p]["first"], stats[p]["last"], stats[p]["n"]
        m = known.get((b.log, first, last))
        if m is None:
            at = nexts.get(b.log, 0)
            if first != at or last - first + 1 != n or stats[p]["d"] != n:
                return out, new, VerificationError(f"entries {first} to {last} ({n} rows) do not follow entry {at - 1} of {b.log}")
            m = known[b.log, first, last] = {"commit_seq": snap.as_of + len(new) + 1, "log": b.log, "first": first, "last": last, "entries": n}
            nexts[b.log] = last + 1
            new.append(p)
        out.append(m)
    return out, new, None


def _trees(dataset: Dataset, snap: Snapshot, batches: list[Batch], rows: DataFrame, ms: list[dict]) -> list[CompactRange]:
    """Each batch's tree, checked against its head: one log after another's entries, the logs side by side."""
    tips, out = snap.tips(), {}

    def of(log: str) -> None:
        old = tips.get(log)
        tree = CompactRange(old["tree"]["size"], [bytes.fromhex(x) for x in old["tree"]["compact_range"]]) if old else CompactRange()
        for n, (b, m) in enumerate(zip(batches, ms, strict=True)):
            if b.log == log:
                out[n] = tree = extend_tree(tree, rows.where(F.col("part") == n), m["first"], m["last"])
                check_tree(tree, b.head, b.proof)

    together(dataset.spark, *[lambda log=log: of(log) for log in sorted({b.log for b in batches})])
    return [out[n] for n in range(len(batches))]


def _first_certificates(rows: DataFrame) -> DataFrame:
    """Each certificate once (sha256, at: part, idx, slot, kind and digest of its first place, der)."""
    kinds = F.when(F.col("entry_type") == "precert", "precert").otherwise("final")
    leafs = rows.where(F.col("cert").isNotNull()).select("part", "idx", F.lit(0).alias("slot"), kinds.alias("kind"), "digest", "sha256", F.col("cert").alias("der"))
    linked = rows.where(F.col("chain").isNotNull()).select("part", "idx", F.posexplode(F.arrays_zip("chain", "prints")).alias("slot", "c"))
    chained = linked.select("part", "idx", (F.col("slot") + 1).alias("slot"), F.lit("chain").alias("kind"), F.lit(None).cast("binary").alias("digest"), F.col("c.prints").alias("sha256"), F.col("c.chain").alias("der"))
    return leafs.unionByName(chained).groupBy("sha256").agg(F.min(F.struct("part", "idx", "slot", "kind", "digest")).alias("at"), F.first("der").alias("der"))


def _delta_bases(certs: DataFrame, precerts: DataFrame) -> DataFrame:
    """certs with delta_base_cert_id: of a final certificate, the earliest precertificate with its issuance key logged before it.

    precerts: issuance_key, part, idx, cert_id. Of earlier parts the least id is the earliest.
    """
    a_part = precerts.groupBy("issuance_key", "part").agg(F.min(F.struct("idx", "cert_id")).alias("p"), F.min("cert_id").alias("least"))
    prior = a_part.groupBy("issuance_key").agg(F.collect_list(F.struct("part", "p", "least")).alias("prior"))  # a row a part
    part, idx = F.col("part"), F.col("idx")
    before = F.array_min(F.transform(F.filter("prior", lambda x: x["part"] < part), lambda x: x["least"]))
    within = F.array_min(F.transform(F.filter("prior", lambda x: (x["part"] == part) & (x["p"]["idx"] < idx)), lambda x: x["p"]["cert_id"]))
    found = certs.withColumn("issuance_key", F.substring("digest", 1, 16)).join(prior, "issuance_key", "left")
    return found.withColumn("delta_base_cert_id", F.when(F.col("kind") == "final", F.coalesce(before, within))).drop("prior", "digest")


def side_by_side(certs: DataFrame, n: int) -> DataFrame:
    """certs dealt to n partitions, a precertificate beside its certificate: what they share is parsed once."""
    pair = F.coalesce("issuance_key", F.substring("sha256", 1, 16))
    return certs.withColumn("pair", pair).repartition(n, "pair").sortWithinPartitions("pair")


def _commit(dataset: Dataset, batches: list[Batch], rows: DataFrame, firsts: DataFrame, ms: list[dict]) -> list[dict]:
    """Writes and commits batches that follow one another; rows: what is read of them, with their place as part; firsts: their first certificates."""
    spark, snap = dataset.spark, dataset.snapshot(allow_mixed=True)
    total, used = dataset.store.room()
    if total:
        sizes = bytes_per_entry(batch_facts(dataset, snap.as_of)).first() if snap.batches else None
        need = peak_bytes(sum(m["entries"] for m in ms), sizes["vault"] if sizes else SEEDS["vault"], sizes["parquet"] if sizes else SEEDS["parquet"])
        require_room(total, used, need, float(spark.conf.get(CAP_CONF, str(DISK_CAP))))

    began = time.time()

    def linked() -> tuple:
        """The new certificates with ids and bases, the ids' ranges by part, and the rows of entries and chains."""
        new, known = firsts.select("sha256", "at.*"), None
        if snap.batches:  # certificates of earlier batches drop out
            known = durable(_among(dataset.table("vault", snap).select("sha256", "cert_id"), firsts, "sha256"))
            new = new.join(known, "sha256", "left_anti")
        new = stored(numbered(new, [F.col("part"), F.col("idx"), F.col("slot")], "cert_id", snap.next_cert_id()))
        ids = new.select("sha256", "cert_id")
        ids = known.unionByName(ids) if known else ids
        ends = {r["part"]: r for r in new.groupBy("part").agg(F.min("cert_id").alias("low"), F.max("cert_id").alias("high"), F.count("*").alias("n")).collect()}
        n_certs = sum(r["n"] for r in ends.values())
        few_ids = F.broadcast(ids) if (ids.count() if known else n_certs) <= BROADCAST_IDS else ids
        entries = rows.join(few_ids, "sha256", "left").select(
            "part",
            "idx",
            F.when(F.col("ts_ms") > 0, F.timestamp_millis(F.col("ts_ms").cast("long")).cast("timestamp_ntz")).alias("ct_ts"),
            "entry_type",
            "cert_id",
            "leaf_hash",
            F.substring("digest", 1, 16).alias("issuance_key"),
            "issuer_key_hash",
            "chain_id",
            "leaf_error",
        )
        fresh = rows.where(F.col("chain").isNotNull()).groupBy("chain_id").agg(F.min("part").alias("part"), F.first("prints").alias("prints"))
        if snap.batches:
            fresh = fresh.join(dataset.table("chains", snap).select("chain_id"), "chain_id", "left_anti")
        chains = fresh.select("part", "chain_id", F.posexplode("prints").alias("position", "sha256")).join(few_ids, "sha256").select("part", "chain_id", "position", "cert_id")

        precerts = entries.where(F.col("entry_type") == "precert").select("issuance_key", "part", "idx", "cert_id")
        if snap.batches:
            keys = new.where((F.col("kind") == "final") & F.col("digest").isNotNull()).select(F.substring("digest", 1, 16).alias("issuance_key")).distinct()
            old = dataset.table("entries", snap).where(F.col("entry_type") == "precert").select("issuance_key", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("idx"), "cert_id")
            precerts = _among(old, keys, "issuance_key").unionByName(precerts)
        based = _delta_bases(new, precerts.where(F.col("issuance_key").isNotNull() & F.col("cert_id").isNotNull()))
        certs = stored(based.join(firsts.select("sha256", "der"), "sha256"))
        return new, certs, ends, n_certs, entries, chains

    trees, (new, certs, ends, n_certs, entries, chains) = together(spark, lambda: _trees(dataset, snap, batches, rows, ms), linked)

    # parsing is far more work than a certificate's bytes tell; the files of its tables are few again
    wide, few = pieces(certs, n_certs, 500), pieces(certs, n_certs, 20_000)
    versions = dataset.versions()
    # ids follow the batches
    part_of = F.coalesce(*[F.when(F.col("cert_id").between(r["low"], r["high"]), F.lit(p)) for p, r in ends.items()], F.lit(None).cast("int")).alias("part")
    parsed = None

    def derive() -> list:
        nonlocal parsed
        parsed = stored(built(side_by_side(certs, wide)))

        def one(t: str) -> list[dict]:
            version = versions[t]["active"]
            made = dataset.write_parts(table_rows(parsed, t).select("*", part_of).coalesce(few), t, ms, version, bloom=BLOOM.get(t, ()))
            return [f | {"version": version} for f in made]

        return together(spark, *[lambda t=t: one(t) for t in TABLES], lambda: table_rows(parsed, "certs").groupBy(part_of, "parse_status").count().collect())

    (*derived, statuses), in_vault, *written = together(
        spark,
        derive,
        lambda: {r["part"]: r for r in certs.groupBy("part").agg(F.coalesce(F.sum(F.octet_length("der")), F.lit(0)).alias("bytes"), F.count("delta_base_cert_id").alias("delta")).collect()},
        lambda: dataset.write_parts(entries, "entries", ms, sort=["idx"]),
        lambda: dataset.write_parts(chains, "chains", ms, sort=["chain_id", "position"]),
        lambda: dataset.write_parts(certs, "vault", ms, sort=["cert_id"], bloom=("sha256",)),
        lambda: dataset.write_parts(rows.where(F.col("leaf_error").isNotNull()), "quarantine", ms),
    )
    out = []
    for p, (b, m, tree) in enumerate(zip(batches, ms, trees, strict=True)):
        files = {t: f[p] for t, f in zip((*SOURCES, *TABLES), (*written, *derived), strict=True)}
        n = ends[p]["n"] if p in ends else 0
        if files["entries"]["rows"] != m["entries"] or files["vault"]["rows"] != n or files["certs"]["rows"] != n:
            raise VerificationError(f"rows read back differ: {files}")
        out.append(m | {
            "committed_at": began,
            "derived": {t: [versions[t]["active"]] for t in TABLES},
            "cert_id_range": [ends[p]["low"], ends[p]["high"]] if n else None,
            "counts": {"entries": m["entries"], "new_certs": n, "delta": in_vault[p]["delta"] if n else 0, "vault_bytes": in_vault[p]["bytes"] if n else 0, "chains": files["chains"]["rows"]},
            "parse_status": {r["parse_status"]: r["count"] for r in statuses if r["part"] == p},
            "files": files,
            "tree": {"size": tree.size, "root": tree.root().hex(), "compact_range": [x.hex() for x in tree.nodes]},
            "head": {"size": b.head.size, "root": b.head.root.hex(), "timestamp": b.head.timestamp} if b.head else None,
            "fetch": b.fetch or {},
        })
    probes = [(m, t) for m in out for t in ("certs", "names", "vault", "entries")]
    together(spark, *[lambda m=m, t=t: canary(dataset, m, t, m["files"][t].get("version"), ("sha256",) if t == "vault" else BLOOM.get(t, ())) for m, t in probes])
    for m in out:
        dataset.commit(m)
    discard(new, certs, parsed)
    return out
