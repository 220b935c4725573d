"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm.common import byte_chars, checked_broadcast, durable, packed, table, text_hash

WINDOW = 10
#: Windows broadcast at most. Of a larger benchmark only the windows' rarest words are, up to so many
#: at once; the windows themselves are then shuffled.
BLOCK_ROWS = 200_000
#: Documents with hits whose figures are broadcast at most.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text, folded as in ascii_fold(): runs of 0-9, A-Z, a-z and all beyond ASCII."""
    return F.array_remove(F.split(F.lower(byte_chars(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """One row for each different window: wtext, wlen, items (sorted different item_ids).

    An item with fewer words than a window, but not none, is one window. Null ids are left out of
    items; their windows stay.
    """
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    wlen = F.least(F.lit(window), F.size("words"))
    starts = words.select("item_id", "words", wlen.alias("wlen"), F.explode(F.sequence(F.lit(1), F.size("words") - wlen + 1)).alias("at"))
    text = F.array_join(F.slice("words", F.col("at"), F.col("wlen")), " ")
    return starts.groupBy(text.alias("wtext"), "wlen").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def rarest_tokens(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """windows plus token, the window's word that is rarest in docs, and back, its place in the window.

    For exact containment a prefix of one token is necessary and sufficient.
    """
    placed = windows.select("wtext", F.posexplode(F.split("wtext", " ")).alias("back", "token"))
    vocabulary = placed.select("token").distinct()
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("token"))
    if small:
        seen = seen.join(F.broadcast(vocabulary), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))  # partial sums come before the shuffle
    first = placed.join(counts, "token", "left").groupBy("wtext").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "token", "back")).alias("least")
    )
    return windows.join(first, "wtext").select("*", "least.token", "least.back").drop("least")


def contaminated_words(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """docs plus n_words, n_hit (words inside any occurrence of an item's window), n_items and
    items (sorted item_ids with occurring windows).

    Null or empty texts have no words; null or wordless items have no windows; null item_ids are
    left out of items though their windows hit. Repeated rows each keep their row, as do rows that
    share a doc_id. Empty tables give no rows or no hits. Columns of docs with the names of the
    results are replaced.

    Document words meet the windows' rarest words in a broadcast join, so that no document text is
    shuffled and a hot passage costs nothing but its own rows. The positional bound (the window must
    start and end inside the document) and the exact comparison of the window are part of the
    join's condition. Of more than block_rows windows only the rarest words are broadcast; the words
    around their occurrences then meet the windows in a shuffle. So the documents are read as often
    as for a small benchmark, unless there are more than block_rows different rarest words. Hits are
    reduced by document, and broadcast to the documents up to BROADCAST_ROWS.
    """
    windows = durable(item_windows(benchmark, window).withColumn("wid", F.monotonically_increasing_id()))
    small = windows.count() <= block_rows
    prefixes = durable(rarest_tokens(docs.select("text"), windows, small))
    base = docs.select(packed(docs).alias("row"), "doc_id", text_hash(F.col("text")).alias("th"), words_of(F.col("text")).alias("words"))
    tokens = base.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "token"))
    start = F.col("pos") - F.col("back")
    span = start.alias("start"), (start + F.col("wlen")).alias("end")
    if small:
        inside = (start >= 0) & (start + F.col("wlen") <= F.size("words"))
        same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("wlen")), " ") == F.col("wtext")
        hits = tokens.join(F.broadcast(prefixes), (tokens["token"] == prefixes["token"]) & inside & same).select("doc_id", "th", *span, "items")
    else:
        rare, hits = durable(prefixes.select("token").distinct()), None
        blocks = max(1, -(-rare.count() // block_rows))
        first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        for block in range(blocks):
            part = F.broadcast(rare.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == block))
            near = tokens.join(part, "token").select("doc_id", "th", "pos", "token", first.alias("first"), F.slice("words", first + 1, F.lit(2 * window - 1)).alias("around"))
            inside = (start >= F.col("first")) & (start - F.col("first") + F.col("wlen") <= F.size("around"))
            same = F.array_join(F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("wlen")), " ") == F.col("wtext")
            found = near.join(prefixes.hint("shuffle_hash"), (near["token"] == prefixes["token"]) & inside & same).select("doc_id", "th", *span, "items")
            hits = found if hits is None else hits.unionByName(found)
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n")),
        lambda acc, span: F.struct(
            F.greatest(acc["reach"], span["end"]).alias("reach"),
            (acc["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(acc["reach"], span["start"]))).alias("n"),
        ),
    )["n"]
    by_doc = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th")).agg(
        merged.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    by_doc = durable(by_doc)
    by_doc = checked_broadcast(by_doc, by_doc.agg(F.coalesce(F.sum(F.size("items") + 1), F.lit(0))).first()[0], BROADCAST_ROWS)
    names = ("n_words", "n_hit", "n_items", "items")
    sized = base.select("row", "doc_id", "th", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"))
    return sized.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("th").eqNullSafe(F.col("hit_th")), "left").select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in names],
        F.when(F.col("n_words") < 0, 0).otherwise(F.col("n_words")).alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast(by_doc.schema["items"].dataType)).alias("items"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS wlen, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS wtext
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT wlen FROM windows
), grams AS (
  SELECT doc_id, i, wlen, array_to_string(w[i:i + wlen - 1], ' ') AS wtext
  FROM (SELECT d.doc_id, d.w, l.wlen, unnest(range(1, len(d.w) - l.wlen + 2)) AS i
        FROM doc_words d, lengths l WHERE len(d.w) >= l.wlen)
), hits AS (
  SELECT g.doc_id, g.i, g.wlen, w.item_id FROM grams g JOIN windows w ON g.wtext = w.wtext AND g.wlen = w.wlen
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + wlen)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
