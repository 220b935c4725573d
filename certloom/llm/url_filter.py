"""URL filters: captures are judged by the list entries that were active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certloom.llm.common import durable, packed, table

#: Intervals broadcast at most; a longer list is joined by shuffle, with SALTS copies of each interval, so
#: that a pattern of very many captures, such as a top-level domain, is met in as many tasks.
BROADCAST_ROWS, SALTS = 200_000, 16


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def plain_url(url: Column) -> Column:
    """The URL without fragment, blanks at its ends and a final slash."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (null: open) of the entries' active times.

    entries: pattern, action ('add' or 'remove'), at. Of actions on one pattern at one time,
    remove wins. Rows with a null or another action are ignored.
    """
    good = entries.where(F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("at").isNotNull())
    last = good.groupBy("pattern", "at").agg(F.max("action").alias("action"))
    by = Window.partitionBy("pattern").orderBy("at")
    changes = last.withColumn("was", F.lag("action").over(by)).where(~F.col("action").eqNullSafe(F.col("was")))
    return (
        changes.withColumn("valid_to", F.lead("at").over(by))
        .where(F.col("action") == "add")
        .select("pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def candidates(url: Column) -> Column:
    """Every (rank, pattern) that could list the URL: itself, its host, the host's parent domains.

    Lower ranks are more specific.
    """
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct((i + 1).alias("rank"), F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")).alias("pattern")),
    )
    exact = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit("url:"), plain_url(url)).alias("pattern")),
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit("host:"), host_of(url)).alias("pattern")),
    )
    return F.concat(exact, suffixes)


def active_entries(captures: DataFrame, entries: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures (url, fetched_at, ...) plus blocked, matched (the most specific active pattern or
    null), listed_since and n_active.

    An entry counts from its add, included, to its next remove, excluded. A null url or fetch
    time matches nothing; so does an empty list. Repeated captures keep their rows. Columns of
    captures with the names of the results are replaced.

    Entries become validity intervals; the as-of join is an equality on the pattern with the
    fetch time inside the interval. At most one interval of a pattern holds a given time, so
    the join yields at most one row for each pattern of a capture. It runs over different (url,
    time) pairs, so a page captured again and again is judged once.
    """
    spans = durable(intervals(entries))
    different = captures.select("url", "fetched_at").where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).distinct()
    wanted = different.select("url", "fetched_at", F.explode(candidates(F.col("url"))).alias("c")).select("url", "fetched_at", "c.rank", "c.pattern")
    if spans.count() <= most_rows:
        met = wanted.join(F.broadcast(spans), "pattern")
    else:
        salted = wanted.withColumn("salt", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(SALTS)))
        met = salted.join(spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["pattern", "salt"])
    hits = met.where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    judged = hits.groupBy(F.col("url").alias("hit_url"), F.col("fetched_at").alias("hit_at")).agg(
        F.min(F.struct("rank", "pattern", "valid_from")).alias("best"), F.count("*").alias("n_active")
    )
    base = captures.select(packed(captures).alias("row"), "url", "fetched_at")
    names = ("blocked", "matched", "listed_since", "n_active")
    return base.join(judged, (F.col("url") == F.col("hit_url")) & (F.col("fetched_at") == F.col("hit_at")), "left").select(
        *[F.col(f"row.`{c}`") for c in captures.columns if c not in names],
        F.col("best").isNotNull().alias("blocked"),
        F.col("best.pattern").alias("matched"),
        F.col("best.valid_from").alias("listed_since"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
    )


def _digit(value: Column, place: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(value), place, 1)) - 1


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated block list over the pages' own URLs, hosts and domains, set by digits of their MD5."""
    urls = pages.where(F.col("url").isNotNull()).select(plain_url(F.col("url")).alias("u"), host_of(F.col("url")).alias("h"))
    domain = F.array_join(F.slice(F.split("h", r"\."), -2, 2), ".")
    names = (
        urls.select(F.concat(F.lit("url:"), F.col("u")).alias("pattern"))
        .where(_digit(F.col("pattern"), 1) == 0)
        .union(urls.select(F.concat(F.lit("host:"), F.col("h")).alias("pattern")).where(_digit(F.col("pattern"), 1) < 4))
        .union(
            urls.where(F.size(F.split("h", r"\.")) >= 2)
            .select(F.concat(F.lit("domain:"), domain).alias("pattern"))
            .where(_digit(F.col("pattern"), 1) < 8)
        )
        .distinct()
    )
    start = F.date_add(F.lit("2024-01-01").cast("date"), _digit(F.col("pattern"), 2) * 16 + _digit(F.col("pattern"), 3))
    dated = names.select("pattern", start.alias("start"), _digit(F.col("pattern"), 4).alias("d"))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), F.col("start").alias("at")),
        F.when(F.col("d") < 8, F.struct(F.lit("remove").alias("action"), F.date_add("start", F.col("d") * 8 + 1).alias("at"))),
        F.when(F.col("d") < 4, F.struct(F.lit("add").alias("action"), F.date_add("start", F.col("d") * 8 + 41).alias("at"))),
    )
    return dated.select("pattern", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("pattern", "s.action", "s.at")


def op9_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    found = active_entries(pages.withColumn("fetched_at", fetched), sample_entries(pages))
    return found.select("page_id", "fetched_at", "blocked", "matched", "listed_since", "n_active")


def _sql_digit(place: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5(pattern), {place}, 1)) - 1)"


OP9_SQL = rf"""
WITH p AS (
  SELECT page_id, trim(url) AS url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_at,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/$', '') AS u,
         lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h
  FROM pages
), named AS (
  SELECT DISTINCT pattern FROM (
    SELECT 'url:' || u AS pattern, 1 AS below FROM p WHERE u IS NOT NULL
    UNION ALL SELECT 'host:' || h, 4 FROM p WHERE h IS NOT NULL
    UNION ALL SELECT 'domain:' || array_to_string(string_split(h, '.')[-2:], '.'), 8 FROM p WHERE len(string_split(h, '.')) >= 2
  ) WHERE {_sql_digit(1)} < below
), dated AS (
  SELECT pattern, DATE '2024-01-01' + CAST({_sql_digit(2)} * 16 + {_sql_digit(3)} AS INTEGER) AS start, CAST({_sql_digit(4)} AS INTEGER) AS d FROM named
), spans AS (
  SELECT pattern, start AS valid_from, CASE WHEN d < 8 THEN start + (d * 8 + 1) END AS valid_to FROM dated
  UNION ALL SELECT pattern, start + (d * 8 + 41), NULL FROM dated WHERE d < 4
), cand AS (
  SELECT page_id, fetched_at, 0 AS rank, 'url:' || u AS pattern FROM p
  UNION ALL SELECT page_id, fetched_at, 1, 'host:' || h FROM p
  UNION ALL SELECT page_id, fetched_at, i + 1, 'domain:' || array_to_string(string_split(h, '.')[i:], '.')
    FROM (SELECT page_id, fetched_at, h, unnest(range(1, len(string_split(h, '.')) + 1)) AS i FROM p)
), hits AS (
  SELECT c.*, s.valid_from FROM cand c JOIN spans s ON c.pattern = s.pattern
    AND s.valid_from <= c.fetched_at AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
), judged AS (
  SELECT page_id, count(*) AS n_active, arg_min(pattern, rank) AS matched, arg_min(valid_from, rank) AS listed_since FROM hits GROUP BY page_id
)
SELECT p.page_id, p.fetched_at, j.page_id IS NOT NULL AS blocked, j.matched, j.listed_since, coalesce(j.n_active, 0) AS n_active
FROM p LEFT JOIN judged j ON p.page_id = j.page_id
"""
