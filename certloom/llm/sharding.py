"""Uniform sharding: a hypergeometric communication matrix, local permutations and one exchange."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certloom.llm.common import durable, packed, table

#: Source partitions and slot buckets a shard, at least; more where they would hold over WINDOW_ROWS
#: rows, which one task sorts. The driver holds shards numbers a partition.
PARTITIONS, BUCKETS, WINDOW_ROWS = 1024, 256, 2_000_000


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of draws rows, taken from good + bad without replacement, are good.

    Inversion from the mode outwards; the steps are about the standard deviation.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: dict[int, int], shards: list[int], seed: int) -> list[tuple[int, list[int]]]:
    """For each source partition the cumulative numbers of its rows that go to each shard.

    rows: rows of each partition; shards: exact shard sizes with the same sum.
    """
    assert sum(rows.values()) == sum(shards)
    rng, open_, out = random.Random(seed), list(shards), []
    for part in sorted(rows):
        left, total, ends, end = rows[part], sum(open_), [], 0
        for s, size in enumerate(open_):
            take = hypergeometric(rng, size, total - size, left)
            total -= size
            left -= take
            open_[s] -= take
            end += take
            ends.append(end)
        out.append((part, ends))
    return out


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 20240229, partitions: int | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """docs in random order over shards, plus shard (int) and slot (long, gapless from 0).

    Every row is placed; shard sizes differ by one at most, whatever the columns hold: nulls,
    empty texts, ties and repeated rows are rows like any other. An empty table gives an empty
    result. Columns of docs named shard or slot are replaced.

    The rows, with a row number of their own, are checkpointed first, so that every later step
    sees the same rows even when a lost executor has them read again; select only the columns
    that the result needs. Rows are dealt to source partitions by that row number, which no hot
    key can skew. The driver draws the matrix from one count a partition (partitions x shards
    numbers at most). Each partition permutes its rows and cuts them by the matrix; each shard
    permutes again in buckets of a random key, whose offsets come from a small aggregate.
    """
    spark = docs.sparkSession
    salt = [int.from_bytes(hashlib.sha256(f"{seed}/{k}".encode()).digest()[:7], "big") for k in "abc"]
    rid = F.monotonically_increasing_id()
    rows = durable(docs.select(packed(docs).alias("row"), rid.alias("rid")))
    total = rows.count()
    partitions = partitions or max(PARTITIONS, -(-total // window_rows))
    bits = max(int(math.log2(BUCKETS)), math.ceil(math.log2(max(1, total / shards / window_rows))))
    rows = rows.select(
        "row",
        "rid",
        F.pmod(F.xxhash64(F.lit(salt[0]), "rid"), F.lit(partitions)).cast("int").alias("part"),
    )
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = spark.createDataFrame(communication_matrix(counts, sizes, seed), "part int, ends array<bigint>")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(salt[1]), "rid"), "rid")
    dealt = (
        rows.join(F.broadcast(matrix), "part")
        .withColumn("nth", F.row_number().over(local))
        .select(
            "row",
            "rid",
            F.size(F.filter("ends", lambda end: end < F.col("nth"))).alias("shard"),
            F.xxhash64(F.lit(salt[2]), "rid").alias("key"),
        )
        .withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    )
    dealt = durable(dealt.select("row", "rid", "shard", "bucket", "key"))
    heads = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("shard", "bucket").orderBy("key", "rid")
    return (
        dealt.join(F.broadcast(heads), ["shard", "bucket"])
        .withColumn("slot", F.col("first") + F.row_number().over(inner) - 1)
        .select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes the rows as one folder a shard, in slot order within each file."""
    placed.repartition("shard", F.shiftright("slot", 20)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shuffle_to_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
