"""Statistics over committed batches: rates, sizes, projections, and the report."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.errors import CapError
from certloom.functions.text import human_bytes
from certloom.sources.dataset import Dataset

#: Windows and least samples of the estimates.
RATE_WINDOW, RATE_BATCHES, RATE_SPAN = timedelta(hours=24), 3, timedelta(minutes=10)
GROWTH_WINDOW, GROWTH_SPAN = timedelta(days=7), timedelta(hours=1)
SIZE_BATCHES, SIZE_LEAST = 20, 5
#: Bytes an entry before SIZE_BATCHES batches are known: record bytes, table files, index.
SEEDS = {"vault": 840.0, "parquet": 265.0, "index": 80.0}

BATCH = (
    "commit_seq bigint, log string, first bigint, last bigint, committed_at timestamp_ntz, entries bigint, new_certs bigint, delta bigint, "
    "vault_bytes bigint, parquet_bytes bigint, requests bigint, rate_limited bigint, head_size bigint, head_at timestamp_ntz, parse_status map<string,bigint>"
)


def batch_facts(dataset: Dataset, as_of: int = 0) -> DataFrame:
    """One flat row a batch, the input of the functions below. Manifests are few; they are read on the driver."""
    rows = []
    for m in dataset.snapshot(as_of, allow_mixed=True).batches:
        head, fetch = m.get("head") or {}, m.get("fetch") or {}
        files = sum(f["bytes"] for t, f in m["files"].items() if t != "vault")
        at = lambda seconds: datetime(1970, 1, 1) + timedelta(seconds=seconds)
        rows.append((
            m["commit_seq"], m["log"], m["first"], m["last"], at(m["committed_at"]), m["entries"], m["counts"]["new_certs"], m["counts"]["delta"],
            m["counts"]["vault_bytes"], files, fetch.get("requests"), fetch.get("rate_limited"), head.get("size"),
            at(head["timestamp"] / 1000) if head.get("timestamp") else None, m["parse_status"],
        ))
    return dataset.spark.createDataFrame(rows, BATCH)


def _seconds(later, earlier):
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def ingest_rate(batches: DataFrame, now: datetime, by: list[str] | None = None) -> DataFrame:
    """rate: entries after the first batch of the window, a second; null for few batches or a short span."""
    since = F.lit(now - RATE_WINDOW).cast("timestamp_ntz")
    n = F.col("last") - F.col("first") + 1
    recent = batches.where(F.col("committed_at") >= since)
    out = recent.groupBy(*(by or [])).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.min_by(n, F.col("commit_seq")).alias("n0"), F.min("committed_at").alias("lo"), F.max("committed_at").alias("hi")
    )
    span = _seconds(F.col("hi"), F.col("lo"))
    return out.select(*(by or []), F.when((F.col("k") >= RATE_BATCHES) & (span >= RATE_SPAN.total_seconds()), (F.col("n") - F.col("n0")) / span).alias("rate"))


def limited_ratio(batches: DataFrame, now: datetime, by: list[str] | None = None) -> DataFrame:
    """ratio: refused requests of all in the rate window; null without requests."""
    recent = batches.where(F.col("committed_at") >= F.lit(now - RATE_WINDOW).cast("timestamp_ntz"))
    out = recent.groupBy(*(by or [])).agg(F.sum("requests").alias("r"), F.sum("rate_limited").alias("l"))
    return out.select(*(by or []), F.when(F.col("r") > 0, F.col("l") / F.col("r")).alias("ratio"))


def growth_rate(batches: DataFrame, now: datetime, by: list[str] | None = None) -> DataFrame:
    """growth: entries a second between the first and last signed head of the window; null for a short span."""
    recent = batches.where(F.col("head_at") >= F.lit(now - GROWTH_WINDOW).cast("timestamp_ntz"))
    out = recent.groupBy(*(by or [])).agg(
        F.min_by("head_size", "head_at").alias("s0"), F.max_by("head_size", "head_at").alias("s1"), F.min("head_at").alias("lo"), F.max("head_at").alias("hi")
    )
    span, more = _seconds(F.col("hi"), F.col("lo")), F.col("s1") - F.col("s0")
    return out.select(*(by or []), F.when((span >= GROWTH_SPAN.total_seconds()) & (more > 0), more / span).alias("growth"))


def bytes_per_entry(batches: DataFrame) -> DataFrame:
    """batches, vault, parquet, total: means of the last batches' ratios; no row for too few of them."""
    last = batches.orderBy(F.desc("commit_seq")).limit(SIZE_BATCHES).where(F.col("entries") > 0)
    means = last.agg(F.count("*").alias("batches"), F.avg(F.col("vault_bytes") / F.col("entries")).alias("vault"), F.avg(F.col("parquet_bytes") / F.col("entries")).alias("parquet"))
    return means.where(F.col("batches") >= SIZE_LEAST).withColumn("total", F.col("vault") + F.col("parquet"))


def totals(batches: DataFrame) -> DataFrame:
    return batches.agg(
        F.count("*").alias("batches"), F.sum("entries").alias("entries"), F.sum("new_certs").alias("new_certs"), F.sum("delta").alias("delta_records")
    ).withColumn("delta_share", F.when(F.col("new_certs") > 0, F.col("delta_records") / F.col("new_certs")))


def parse_statuses(batches: DataFrame) -> DataFrame:
    return batches.select(F.explode("parse_status").alias("status", "n")).groupBy("status").agg(F.sum("n").alias("n"))


def p95(samples: DataFrame, column: str, seed: float) -> DataFrame:
    """p95: the nearest-rank percentile, or the seed while there are fewer than SIZE_BATCHES samples."""
    out = samples.agg(F.count(column).alias("n"), F.expr(f"percentile_disc(0.95) within group (order by {column})").alias("p"))
    return out.select(F.when(F.col("n") < SIZE_BATCHES, F.lit(seed)).otherwise(F.col("p")).alias("p95"))


def peak_bytes(entries: int, vault: float, parquet: float, safety: float = 1.5) -> int:
    """Bytes a batch may need, with a reserve for metadata; never more than 2^64 - 1."""
    return min(int(entries * (vault + parquet) * safety) + (64 << 20), (1 << 64) - 1)


def require_room(total: float, used: float, need: float, cap: float = 0.85) -> None:
    """CapError if need more bytes would take a volume beyond cap of its total. cap is at most 0.95."""
    if not 0 < cap <= 0.95:
        raise CapError(f"the disk limit must be above 0 and at most 0.95, not {cap}")
    if not total or used + need > cap * total:
        raise CapError(f"{human_bytes(need)} more would take the volume beyond {cap:.0%} of {human_bytes(total)}")


def projected_cap(now: datetime, headroom: float, per_entry: float | None, remaining: int | None, rate: float | None, growth: float | None) -> tuple[datetime | None, str]:
    """When the disk limit is reached, and on what ground; None if an estimate is missing.

    The remaining entries come at the ingest rate, later ones at the logs' growth.
    """
    if headroom <= 0:
        return now, "the limit is reached"
    if per_entry is None or remaining is None:
        return None, "unknown: bytes an entry or a log's head are not known"
    fits, seconds = headroom / per_entry, 0.0
    if remaining:
        if not rate:
            return None, "unknown: no ingest rate"
        if fits <= remaining:
            return now + timedelta(seconds=fits / rate), "while catching up"
        seconds = remaining / rate
    if not growth or growth <= 0:
        return None, "unknown: no growth rate"
    return now + timedelta(seconds=seconds + (fits - remaining) / growth), "at the logs' growth"


def report(dataset: Dataset, now: datetime, heads: dict[str, int] | None = None, capacity: tuple[float, float] | None = None, cap: float = 0.85) -> dict:
    """All figures as a dictionary. heads: tree sizes of the logs' last heads; capacity: (total, used) bytes."""
    b = batch_facts(dataset).cache()
    per_log = {r["log"]: r.asDict() for r in b.groupBy("log").agg(F.max("last").alias("last")).collect()}
    for frame in (ingest_rate(b, now, ["log"]), limited_ratio(b, now, ["log"]), growth_rate(b, now, ["log"])):
        for r in frame.collect():
            per_log[r["log"]] |= r.asDict()
    for name, r in per_log.items():
        size = (heads or {}).get(name)
        r["committed_entries"] = r.pop("last") + 1
        r["remaining"] = None if size is None else max(0, size - r["committed_entries"])
        r["eta_seconds"] = r["remaining"] / r["rate"] if r["remaining"] is not None and r.get("rate") else None
    sizes = bytes_per_entry(b).first()
    left = [r["remaining"] for r in per_log.values()]
    growth = [r.get("growth") for r in per_log.values()]
    overall = ingest_rate(b, now).first()
    out = {
        "logs": per_log,
        "vault": totals(b).first().asDict() | {"parse_status": {r["status"]: r["n"] for r in parse_statuses(b).collect()}},
        "tables": dataset.versions(),
        "bytes_per_entry": sizes.asDict() if sizes else None,
    }
    if capacity:
        out["projected_cap"] = projected_cap(
            now, cap * capacity[0] - capacity[1], sizes["total"] if sizes else None, None if None in left else sum(left),
            overall["rate"] if overall else None, None if None in growth else sum(growth),
        )
    b.unpersist()
    return out


# --- measurement of a range of entries ---


def link_facts(entries: DataFrame) -> DataFrame:
    """Finals with their first precertificate: final_idx, linked (it is logged before), later, eligible, delay_ms.

    entries: idx, entry_type, digest, ts_ms, sha256.
    """
    first = (
        entries.where((F.col("entry_type") == "precert") & F.col("digest").isNotNull())
        .groupBy("digest").agg(F.min(F.struct("idx", "ts_ms")).alias("p"))
    )
    finals = entries.where((F.col("entry_type") == "x509") & F.col("digest").isNotNull())
    seen = entries.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min("idx").alias("first_idx"))
    joined = finals.join(seen, "sha256", "left").join(first, "digest", "left")
    linked = F.coalesce(F.col("p.idx") < F.col("idx"), F.lit(False))
    return joined.select(
        F.col("idx").alias("final_idx"),
        linked.alias("linked"),
        (F.col("p").isNotNull() & ~linked).alias("later"),
        (linked & (F.col("first_idx") == F.col("idx"))).alias("eligible"),
        F.when(linked, (F.col("ts_ms") - F.col("p.ts_ms")).cast("long")).alias("delay_ms"),
    )


def link_report(links: DataFrame) -> DataFrame:
    """finals, linked, precert_later, eligible, and nearest-rank percentiles of the delays."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by delay_ms)").cast("long").alias(f"p{int(p * 100)}")
    ones = lambda c: F.sum(F.col(c).cast("long")).alias(c if c != "later" else "precert_later")
    return links.agg(F.count("*").alias("finals"), ones("linked"), ones("later"), ones("eligible"), disc(0.5), disc(0.95), disc(0.99))


def compression_groups(records: DataFrame) -> DataFrame:
    """records, raw_bytes, stored_bytes, ratio and mean_stored by kind, dictionary and entry type."""
    out = records.groupBy("kind", "dictionary", "entry_type").agg(F.count("*").alias("records"), F.sum("raw").alias("raw_bytes"), F.sum("stored").alias("stored_bytes"))
    return out.withColumn("ratio", F.col("raw_bytes") / F.col("stored_bytes")).withColumn("mean_stored", F.col("stored_bytes") / F.col("records"))


def dedup_report(hashes: DataFrame, column: str = "sha256") -> DataFrame:
    """seen, unique, hits and hit_rate of repeated hashes."""
    out = hashes.agg(F.count(column).alias("seen"), F.count_distinct(column).alias("unique"))
    return out.withColumn("hits", F.col("seen") - F.col("unique")).withColumn("hit_rate", F.when(F.col("seen") > 0, F.col("hits") / F.col("seen")))


def error_counts(entries: DataFrame, structural: tuple[str, ...]) -> DataFrame:
    """Entries by error code, and whether the code leaves an entry without a certificate."""
    return entries.where(F.col("leaf_error").isNotNull()).groupBy("leaf_error").agg(F.count("*").alias("n")).withColumn("structural", F.col("leaf_error").isin(*structural))


def reservoir(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows drawn uniformly: the least of seeded random numbers, by a top-k plan."""
    return rows.orderBy(F.rand(seed)).limit(k)


def hash_sample(rows: DataFrame, column: str, every: int = 16) -> DataFrame:
    """The rows whose SHA-256 starts with a byte below 256 / every: the same ones in every run."""
    return rows.where(_sampled(F.col(column), every))


def _sampled(c: Column, every: int) -> Column:
    return F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("int") < 256 // every


def scaled_estimate(rows: DataFrame, column: str, value: str, every: int = 16) -> DataFrame:
    """approximate, records, sampled, sampled_sum and estimate: the sum of value over the hash sample of column, scaled to all rows."""
    flagged = rows.select(F.col(value).cast("long").alias("v"), _sampled(F.col(column), every).alias("s"))
    out = flagged.agg(F.count("*").alias("records"), F.count_if("s").alias("sampled"), F.coalesce(F.sum(F.when(F.col("s"), F.col("v"))), F.lit(0)).alias("sampled_sum"))
    scaled = F.when(F.col("sampled") > 0, F.call_function("div", F.col("sampled_sum") * F.col("records"), F.col("sampled")))
    return out.select(F.lit(True).alias("approximate"), "records", "sampled", "sampled_sum", scaled.alias("estimate"))
