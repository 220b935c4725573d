"""Line dedup: lines that recur across documents are dropped everywhere but in one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm.common import ascii_fold, durable, hash128, packed, skew_join, table, text_hash

#: Characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Shared line keys, and positions of dropped lines, that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 1_000_000


def _line_keys(base: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th, pos and the 128-bit key hash of every line that is long enough to count."""
    lines = base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    stripped = lines.where(F.length("line") >= min_chars).select(
        "doc_id", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")
    )
    h1, h2 = hash128(ascii_fold(F.col("line")))
    return stripped.where(F.length("line") >= min_chars).select("doc_id", "th", "pos", h1.alias("h1"), h2.alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with its text rebuilt, plus n_lines and n_dropped.

    A line's key is the line without blanks at its ends and with A-Z as a-z. Keys of at least
    min_chars code points found in at least min_docs different doc_ids lose all their lines
    except in the largest doc_id that holds them. Other lines stay, joined by line feeds.

    Null or empty text is one empty line and becomes ''. Rows with a null doc_id count for
    nothing and keep their lines. Repeated rows and rows that share a doc_id count as one
    document; each keeps its row. An empty table gives an empty result. Columns of docs named
    n_lines or n_dropped are replaced, all others stay.

    Only hashes and positions travel through the shuffles that find the lines: lines are counted by
    document and then by key with map-side partial sums, so a line in a third of all documents
    costs each task one row. The keys that lose lines, and the positions, are broadcast up to
    BROADCAST_ROWS. Beyond, lines meet the keys in a shuffle that leaves out the most frequent ones,
    and texts move once, to meet the positions dropped from them.
    """
    base = docs.select(packed(docs).alias("row"), "doc_id", "text", text_hash(F.col("text")).alias("th"))
    keys = _line_keys(base.select("doc_id", "th", "text"), min_chars)
    shared = (
        keys.groupBy("h1", "h2", "doc_id")
        .agg(F.count("*").alias("rows"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"), F.sum("rows").alias("rows"))
        .where(F.col("n") >= min_docs)
    )
    shared = durable(shared.select("h1", "h2", "keeper", "rows"))
    found, total = shared.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    marked = keys.join(F.broadcast(shared), ["h1", "h2"]) if found <= BROADCAST_ROWS else skew_join(keys, shared, ["h1", "h2"], "rows", total)
    dropped = marked.where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    if total <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.transform(places, lambda i: F.get("lines", i))
    whole = base.join(dropped, ["doc_id", "th"], "left").withColumn("lines", lines)
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return whole.select(
        *others,
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(list) AS line, unnest(range(len(list))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
