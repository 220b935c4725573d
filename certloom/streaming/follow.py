"""Continuous ingest: a stream of raw entries becomes batches, each committed exactly once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from certloom.errors import VerificationError
from certloom.operators.numbering import durable
from certloom.plans.ingest import Head, ingest_batch
from certloom.plans.rebuild import rebuild
from certloom.sources.dataset import Dataset

#: Entries of one committed batch.
BATCH_SIZE = 500_000


def record_incident(dataset: Dataset, log: str, size: int, head: Head | None, problem: Exception) -> None:
    """Keeps what a log served that does not fit, in incidents/."""
    seen = {"log": log, "size": size, "head": head and {"size": head.size, "root": head.root.hex()}, "problem": str(problem), "at": time.time()}
    dataset.store.write_json(f"incidents/{log}-{size}-{time.time_ns()}.json", seen)


def follow(
    dataset: Dataset,
    stream: DataFrame,
    log: str,
    checkpoint: str,
    head: Callable[[int], tuple[Head | None, list[bytes] | None]] | None = None,
    tiled: bool = False,
    every: str | None = None,
    after: Callable[[dict], None] | None = None,
    batch_size: int = BATCH_SIZE,
    turns: int = 1,
) -> StreamingQuery:
    """Starts ingesting a stream (idx, leaf_input, extra_data).

    head gives the signed head and consistency proof for a batch that ends at a tree size. every:
    the trigger's interval; without it the stream ends when all that is there is ingested. after is
    called with each manifest. A micro-batch becomes batches of batch_size entries; run again after
    a failure, it skips what is committed. Entries that do not match the signed head are tried once
    more with a new head; then an incident is recorded and the stream stops. After each batch, `turns`
    old batches of every table that is being rebuilt are built.
    """

    def verified(part: DataFrame, size: int) -> dict:
        for attempt in (1, 2):
            signed = None
            try:
                signed, proof = head(size) if head else (None, None)
                return ingest_batch(dataset, part, log, signed, proof, tiled)
            except VerificationError as e:
                if attempt == 2:
                    record_incident(dataset, log, size, signed, e)
                    raise
        raise AssertionError

    def commit(batch: DataFrame, _: int) -> None:
        have = dataset.snapshot(allow_mixed=True)
        first = have.next_index(log)
        fresh = durable(batch.where(F.col("idx") >= first))
        last = fresh.agg(F.max("idx")).first()[0]
        for low in range(first, -1 if last is None else last + 1, batch_size):
            part = fresh.where(F.col("idx").between(low, low + batch_size - 1))
            manifest = verified(part, min(low + batch_size - 1, last) + 1)
            if after:
                after(manifest)
            for table, state in dataset.versions().items():
                if turns and state.get("building"):
                    rebuild(dataset, table, turns)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def stop_after_batch(query: StreamingQuery, seconds: float = 3600) -> bool:
    """Stops a stream between two micro-batches; false if one is still at work after so many seconds."""
    end = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"]:
        if time.monotonic() > end:
            return False
        time.sleep(0.2)
    query.stop()
    return True


def entry_windows(entries: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Entries and distinct certificates (approximate) by log and window of ct_ts, for streams with late data."""
    timed = entries.withColumn("at", F.col("ct_ts").cast("timestamp")).withWatermark("at", late)
    span = F.window("at", size, slide) if slide else F.window("at", size)
    return timed.groupBy(span, "log").agg(F.count("*").alias("entries"), F.approx_count_distinct("cert_id").alias("certs"))


def entry_sessions(entries: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Entries by log and session of activity."""
    timed = entries.withColumn("at", F.col("ct_ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "log").agg(F.count("*").alias("entries"))


def audit(dataset: Dataset, manifest: dict, sample: int = 8) -> list[str]:
    """Looks up some of a batch's certificates, names and domains through the whole dataset; returns what is not found.

    The outcome is kept in health.json with the last 100 failures.
    """
    snap = dataset.snapshot(allow_mixed=True)
    problems = []
    for table, column in (("certs", "sha256"), ("names", "name"), ("names", "etld1")):
        mine = dataset.table(table, snap, [manifest]).where(F.col(column).isNotNull())
        drawn = mine.groupBy(column).agg(F.min("cert_id").alias("cert_id")).orderBy(F.xxhash64(column), column).limit(sample).collect()
        every = dataset.table(table, snap).where(F.col(column).isin([r[column] for r in drawn])) if drawn else None
        wanted = F.col("cert_id").isin([r["cert_id"] for r in drawn])
        found = {(r[column], r["cert_id"]) for r in every.where(wanted).select(column, "cert_id").distinct().collect()} if drawn else set()
        problems += [f"commit {manifest['commit_seq']}: {column} {r[column]} of certificate {r['cert_id']} is not found" for r in drawn if tuple(r) not in found]
    old = dataset.store.read_json("health.json") if dataset.store.exists("health.json") else {"audits": 0, "failures": []}
    new = {"audits": old["audits"] + 1, "last_commit": manifest["commit_seq"], "failures": (old["failures"] + problems)[-100:]}
    dataset.store.write_json("health.json", new, overwrite=True)
    return problems
