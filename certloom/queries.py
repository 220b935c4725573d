"""The engine's operators over the driver's tables, each with SQL that must give the same rows.

The tables hold no certificates, so they play parts: customer is certs, the hosts of pages are names,
orders are entries (an order's customer is its certificate), lineitem and events are further streams.
The queries call the engine's functions on them; semi_join, anti_join, exists_share, full_outer_check,
count_distinct, approx_distinct, delay_median, names_having, names_explode, union_by_name, intersect,
except_distinct, rollup and previous_row only show that such SQL runs over the views. log_queries.py
runs the engine whole, over a dataset that it ingests.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certloom.functions import merkle, names as names_
from certloom.operators import search, stats, verify
from certloom.operators.fetch import nearest_links
from certloom.operators.numbering import numbered
from certloom.operators.query import Query
from certloom.plans import ingest
from certloom.sources.loglist import log_name_column
from certloom.streaming.follow import entry_sessions, entry_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (tables) -> DataFrame under its name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = (PARTS + sql) if sql.lstrip().startswith("SELECT") or sql.lstrip().startswith(",") else sql
        return f

    return register


class Tables:
    """The driver's tables, and the parts they play."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def certs(self) -> DataFrame:
        k, n = F.col("c_custkey"), F.col("c_nationkey")
        day = lambda d: (F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(d))
        return self.customer.select(
            k.alias("cert_id"),
            F.sha2("c_name", 256).alias("sha256"),
            F.when(k % 3 == 0, "precert").when(k % 3 == 1, "final").otherwise("chain").alias("kind"),
            F.col("c_mktsegment").alias("issuer_cn"),
            F.concat(F.lit("Org "), n.cast("string")).alias("issuer_o"),
            F.when(n % 3 == 0, "rsa").when(n % 3 == 1, "ecdsa").otherwise("other").alias("key_alg"),
            F.when(k % 5 == 0, "partial").otherwise("ok").alias("parse_status"),
            day((k % 1500).cast("int")).alias("not_before"),
            day((k % 1500).cast("int") + 400).alias("not_after"),
            (k % 4).cast("int").alias("n_dns_names"),
            (k % 2).cast("int").alias("n_ip_names"),
        )

    @property
    def names(self) -> DataFrame:
        host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]*)", 1))
        hosts = self.pages.select(F.col("page_id").alias("cert_id"), host.alias("name"))
        return hosts.select(
            "cert_id",
            F.lit("san_dns").alias("source"),
            "name",
            (F.col("cert_id") % 10 == 0).alias("is_wildcard"),
            F.array_join(F.slice(F.split("name", r"\."), -2, 2), ".").alias("etld1"),
        )

    @property
    def entries(self) -> DataFrame:
        key = F.unhex(F.md5(F.call_function("div", F.col("o_custkey"), F.lit(2)).cast("string").cast("binary")))
        return self.orders.select(
            F.col("o_orderkey").alias("idx"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("ct_ts"),
            F.when(F.col("o_orderkey") % 2 == 0, "precert").otherwise("x509").alias("entry_type"),
            F.col("o_custkey").alias("cert_id"),
            F.concat(F.lit("log"), F.substring("o_orderpriority", 1, 1)).alias("log"),
            key.alias("issuance_key"),
        )

    @property
    def batches(self) -> DataFrame:
        """Days of events as batches of a log."""
        day = F.date_trunc("day", F.col("ts"))
        days = self.events.groupBy(day.alias("day")).agg(
            F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("entries"),
            F.sum((F.col("event_type") == "error").cast("long")).alias("rate_limited"), F.max(F.col("ts")).alias("committed_at"),
            F.sum(F.octet_length("props").cast("long")).alias("vault_bytes"), F.count_distinct("user_id").alias("new_certs"),
        )
        seq = F.datediff(F.col("day").cast("date"), F.lit("2023-12-31").cast("date")).cast("long")
        return days.select(
            seq.alias("commit_seq"), F.lit("a").alias("log"), "first", "last", F.col("committed_at").cast("timestamp_ntz").alias("committed_at"), "entries", "new_certs",
            F.lit(0).cast("long").alias("delta"), "vault_bytes", (F.col("vault_bytes") * 2).alias("parquet_bytes"), F.col("entries").alias("requests"), "rate_limited",
            (F.col("last") + 1).alias("head_size"), F.col("committed_at").cast("timestamp_ntz").alias("head_at"),
            F.create_map(F.lit("ok"), F.col("entries"), F.lit("partial"), F.col("rate_limited")).alias("parse_status"),
        )

    @property
    def addresses(self) -> DataFrame:
        """Addresses of some of the certificates, as rows of names."""
        ip = F.concat(F.lit("192.0.2."), (F.col("cert_id") % 5).cast("string"))
        return self.names.where(F.col("cert_id") % 9 == 0).select("cert_id", F.lit("san_ip").alias("source"), ip.alias("name"), F.lit(False).alias("is_wildcard"), F.lit(None).cast("string").alias("etld1"))

    def found(self, q: Query) -> DataFrame:
        """A search over the parts, as the engine runs it."""
        q = q.checked()
        every = self.names.unionByName(self.addresses) if q.mode == "ip" else self.names
        names = search.matched_names(q, every, names_.session_suffixes(self.spark))
        return search.shaped(search.filtered(q, names, self.certs, self.entries.join(names.select("cert_id").distinct(), "cert_id", "left_semi")), q).drop(search.SORT, search.KEY)


PARTS = r"""
WITH certs AS (
  SELECT c_custkey AS cert_id, sha256(c_name) AS sha256,
    CASE c_custkey % 3 WHEN 0 THEN 'precert' WHEN 1 THEN 'final' ELSE 'chain' END AS kind,
    c_mktsegment AS issuer_cn, 'Org ' || c_nationkey AS issuer_o,
    CASE c_nationkey % 3 WHEN 0 THEN 'rsa' WHEN 1 THEN 'ecdsa' ELSE 'other' END AS key_alg,
    CASE WHEN c_custkey % 5 = 0 THEN 'partial' ELSE 'ok' END AS parse_status,
    TIMESTAMP '1996-01-01' + to_days(CAST(c_custkey % 1500 AS INTEGER)) AS not_before,
    TIMESTAMP '1996-01-01' + to_days(CAST(c_custkey % 1500 AS INTEGER) + 400) AS not_after,
    CAST(c_custkey % 4 AS INTEGER) AS n_dns_names, CAST(c_custkey % 2 AS INTEGER) AS n_ip_names
  FROM customer
), hosts AS (
  SELECT page_id AS cert_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS name FROM pages
), names AS (
  SELECT cert_id, name, 'san_dns' AS source, cert_id % 10 = 0 AS is_wildcard, array_to_string(string_split(name, '.')[-2:], '.') AS etld1 FROM hosts
), entries AS (
  SELECT o_orderkey AS idx, o_orderdate AS ct_ts, CASE WHEN o_orderkey % 2 = 0 THEN 'precert' ELSE 'x509' END AS entry_type,
    o_custkey AS cert_id, 'log' || substr(o_orderpriority, 1, 1) AS log, md5(CAST(o_custkey // 2 AS VARCHAR)) AS issuance_key
  FROM orders
), batches AS (
  SELECT date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS commit_seq, 'a' AS log, min(event_id) AS first, max(event_id) AS last,
    max(ts) AS committed_at, count(*) AS entries, count(DISTINCT user_id) AS new_certs, count(*) FILTER (WHERE event_type = 'error') AS rate_limited,
    CAST(sum(strlen(props)) AS BIGINT) AS vault_bytes
  FROM events GROUP BY 1
)
"""


def names_sql(where: str, certs: str = "kind IN ('precert', 'final')", entries: str = "") -> str:
    join = "JOIN" if entries else "LEFT JOIN"
    return f"""
, n AS (SELECT cert_id, name FROM names WHERE {where}),
c AS (SELECT * FROM certs WHERE {certs}),
e AS (SELECT cert_id, min(ct_ts) AS first_seen, max(ct_ts) AS last_seen FROM entries {'WHERE ' + entries if entries else ''} GROUP BY cert_id)
SELECT n.name AS name, min(e.first_seen) AS first_seen, max(e.last_seen) AS last_seen, count(DISTINCT n.cert_id) AS certs,
  list_slice(list_sort(list_distinct(list(c.issuer_cn))), 1, 5) AS issuers
FROM n JOIN c USING (cert_id) {join} e USING (cert_id) GROUP BY n.name"""


def certs_sql(where: str, certs: str = "kind IN ('precert', 'final')", entries: str = "") -> str:
    join = "JOIN" if entries else "LEFT JOIN"
    return f"""
, c AS (SELECT * FROM certs WHERE {certs} AND cert_id IN (SELECT cert_id FROM names WHERE {where})),
e AS (SELECT cert_id, min(ct_ts) AS first_seen, max(ct_ts) AS last_seen, list_sort(list_distinct(list(log))) AS logs FROM entries {'WHERE ' + entries if entries else ''} GROUP BY cert_id)
SELECT c.sha256, c.cert_id, c.kind, c.issuer_cn, c.not_before, c.not_after, c.n_dns_names + c.n_ip_names AS names, e.first_seen, e.last_seen, e.logs
FROM c {join} e USING (cert_id)"""


def _search(name: str, q: Query, sql: str) -> None:
    query(sql, name)(lambda t: t.found(q))


_search("search_domain_names", Query("etld1", "example.net"), names_sql("etld1 = 'example.net'"))
_search("search_suffix", Query("suffix", "blog.tiontion.example.com"), names_sql("etld1 = 'example.com' AND (name = 'blog.tiontion.example.com' OR ends_with(name, '.blog.tiontion.example.com'))"))
_search("search_exact", Query("exact", "Spam-Farm.example.org."), names_sql("name = 'spam-farm.example.org'"))
_search("search_ip", Query("ip", "192.0.2.1"), names_sql("true").replace("SELECT cert_id, name FROM names WHERE true", "SELECT cert_id, '192.0.2.1' AS name FROM names WHERE cert_id % 9 = 0 AND cert_id % 5 = 1"))
_search("search_contains", Query("contains", "BLOG"), names_sql("contains(lower(name), 'blog')"))
_search("search_regex", Query("regex", r"^(m|blog)\.th[a-z]+\."), names_sql(r"regexp_matches(name, '^(m|blog)\.th[a-z]+\.')"))
_search("search_wildcard", Query("contains", ".", wildcard=True), names_sql("contains(name, '.') AND is_wildcard"))
_search("search_certs", Query("etld1", "example.com", group="certs"), certs_sql("etld1 = 'example.com'"))
_search(
    "search_certs_chain", Query("contains", "example", kinds=["chain"], group="certs", fields=["cert_id", "kind", "names", "logs"]),
    certs_sql("contains(name, 'example')", "kind = 'chain'").replace("c.sha256, c.cert_id, c.kind, c.issuer_cn, c.not_before, c.not_after, c.n_dns_names + c.n_ip_names AS names, e.first_seen, e.last_seen, e.logs", "c.cert_id, c.kind, c.n_dns_names + c.n_ip_names AS names, e.logs"),
)
_search("filter_issuer", Query("contains", ".", issuer="machinery", issuer_org="ORG 19"), names_sql("contains(name, '.')", "kind IN ('precert', 'final') AND lower(issuer_cn) = 'machinery' AND lower(issuer_o) = 'org 19'"))
_search("filter_key_and_status", Query("contains", ".", key_alg="rsa", parse_status="partial", group="certs"), certs_sql("contains(name, '.')", "kind IN ('precert', 'final') AND key_alg = 'rsa' AND parse_status = 'partial'"))
_search("filter_valid_at", Query("contains", ".", valid_at=datetime(1996, 6, 1), group="certs"), certs_sql("contains(name, '.')", "kind IN ('precert', 'final') AND not_before <= TIMESTAMP '1996-06-01' AND TIMESTAMP '1996-06-01' < not_after"))
_search("filter_since_until", Query("contains", ".", since=datetime(1997, 1, 1), until=datetime(1998, 1, 1)), names_sql("contains(name, '.')", entries="ct_ts >= TIMESTAMP '1997-01-01' AND ct_ts < TIMESTAMP '1998-01-01'"))
_search("filter_by_not_before", Query("contains", ".", since=datetime(1996, 3, 1), by_not_before=True, group="certs"), certs_sql("contains(name, '.')", "kind IN ('precert', 'final') AND not_before >= TIMESTAMP '1996-03-01'"))
_search("filter_log", Query("contains", ".", log="log3", group="certs"), certs_sql("contains(name, '.')", entries="log = 'log3'"))
_search("filter_text_any_column", Query("contains", ".", filter="house", group="certs", fields=["cert_id", "issuer_cn", "logs"]), f"""
, g AS ({certs_sql("contains(name, '.')").strip().removeprefix(",").replace("c AS (", "WITH c AS (", 1)})
SELECT cert_id, issuer_cn, logs FROM g WHERE contains(lower(concat_ws(' ', CAST(cert_id AS VARCHAR), issuer_cn, CAST(logs AS VARCHAR))), 'house')""")  # fmt: skip
_search("search_issuances", Query("contains", ".", group="issuances"), """
, ei AS (SELECT * FROM entries WHERE cert_id IN (SELECT cert_id FROM names WHERE contains(name, '.')))
SELECT ei.issuance_key AS issuance_key, min(ei.ct_ts) AS first_seen, max(ei.ct_ts) AS last_seen, count(DISTINCT ei.cert_id) AS certs,
  bool_or(ei.entry_type = 'precert') AS precert, bool_or(ei.entry_type = 'x509') AS final, list_slice(list_sort(list_distinct(list(c.issuer_cn))), 1, 5) AS issuers
FROM ei JOIN (SELECT * FROM certs WHERE kind IN ('precert', 'final')) c USING (cert_id) GROUP BY ei.issuance_key""")  # fmt: skip

_SEEN = "SELECT c.cert_id, c.issuer_cn, e.last_seen FROM certs c LEFT JOIN (SELECT cert_id, max(ct_ts) AS last_seen FROM entries WHERE log = 'log1' GROUP BY cert_id) e USING (cert_id)"


def _seen(t: Tables) -> DataFrame:
    last = t.entries.where(F.col("log") == "log1").groupBy("cert_id").agg(F.max("ct_ts").alias("last_seen"))
    return t.certs.join(last, "cert_id", "left").select("cert_id", "issuer_cn", "last_seen")


@query(f", s AS ({_SEEN}) SELECT * FROM s ORDER BY last_seen DESC NULLS LAST, cert_id LIMIT 100")
def topk_nulls_last(t: Tables) -> DataFrame:
    return _seen(t).orderBy(*search.ordering("last_seen", True, "cert_id")).limit(100)


@query(f", s AS ({_SEEN}) SELECT * FROM s WHERE last_seen < TIMESTAMP '1998-01-01' OR last_seen IS NULL OR (last_seen = TIMESTAMP '1998-01-01' AND cert_id > 50) ORDER BY last_seen DESC NULLS LAST, cert_id LIMIT 51")
def keyset_page(t: Tables) -> DataFrame:
    rows = _seen(t)
    behind = search.after("last_seen", True, "cert_id", datetime(1998, 1, 1), 50, dict(rows.dtypes)["last_seen"])
    return rows.where(behind).orderBy(*search.ordering("last_seen", True, "cert_id")).limit(51)


@query(f", s AS ({_SEEN}), r AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC NULLS LAST, cert_id) AS nr FROM s) SELECT * FROM r WHERE nr > 200 AND nr <= 400")
def held_page(t: Tables) -> DataFrame:
    rows = numbered(_seen(t), search.ordering("last_seen", True, "cert_id"), "nr")
    return rows.where((F.col("nr") > 200) & (F.col("nr") <= 400))


@query("SELECT cert_id, kind FROM certs WHERE cert_id IN (SELECT cert_id FROM entries WHERE log = 'log1')")
def semi_join(t: Tables) -> DataFrame:
    return t.certs.join(t.entries.where(F.col("log") == "log1"), "cert_id", "left_semi").select("cert_id", "kind")


@query("SELECT cert_id, kind FROM certs c WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.cert_id = c.cert_id AND e.log = 'log1')")
def anti_join(t: Tables) -> DataFrame:
    return t.certs.join(t.entries.where(F.col("log") == "log1"), "cert_id", "left_anti").select("cert_id", "kind")


@query("SELECT issuer_cn, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM entries e WHERE e.cert_id = c.cert_id AND e.log = 'log1') THEN 1 ELSE 0 END)::BIGINT AS n_logged FROM certs c GROUP BY issuer_cn")
def exists_share(t: Tables) -> DataFrame:
    logged = t.entries.where(F.col("log") == "log1").select("cert_id").distinct().withColumn("logged", F.lit(1))
    return t.certs.join(logged, "cert_id", "left").groupBy("issuer_cn").agg(F.count("*").alias("n"), F.count("logged").alias("n_logged"))


@query("SELECT cert_id, n, kind FROM (SELECT cert_id, count(*) AS n FROM entries WHERE log = 'log2' GROUP BY 1) FULL JOIN (SELECT cert_id, kind FROM certs WHERE kind = 'final') USING (cert_id)")
def full_outer_check(t: Tables) -> DataFrame:
    counts = t.entries.where(F.col("log") == "log2").groupBy("cert_id").agg(F.count("*").alias("n"))
    return counts.join(t.certs.where(F.col("kind") == "final").select("cert_id", "kind"), "cert_id", "full_outer")


@query("""
, first AS (SELECT DISTINCT idx FROM entries WHERE log = 'log1'), ca AS (SELECT issuer_cn FROM certs WHERE cert_id = 7)
SELECT cert_id, issuer_cn FROM certs WHERE issuer_cn = (SELECT issuer_cn FROM ca)
  AND (cert_id IN (SELECT cert_id FROM entries WHERE idx IN (SELECT idx FROM first)) OR issuer_o = 'Org 3')""")
def issued_by_or_semi(t: Tables) -> DataFrame:
    certs = t.certs.withColumnsRenamed({"issuer_o": "authority_key_id"}).withColumn("issuer_der", F.col("issuer_cn"))
    chains = t.entries.where(F.col("log") == "log1").select(F.col("idx").alias("chain_id"), F.lit(0).alias("position"), F.lit(7).cast("long").alias("cert_id"))
    row = certs.where(F.col("cert_id") == 7).select(F.col("issuer_cn").alias("subject_der"), "cert_id", F.lit("Org 3").alias("subject_key_id")).first()
    return search.issued_by(certs, row, t.entries.withColumn("chain_id", F.col("idx")), chains).select("cert_id", "issuer_cn")


@query("""
, mine AS (SELECT cert_id, issuance_key, ct_ts FROM entries WHERE entry_type = 'precert'),
hits AS (SELECT m.cert_id, o.cert_id AS other_id, o.ct_ts FROM mine m JOIN entries o ON o.issuance_key = m.issuance_key AND o.entry_type = 'x509' AND o.cert_id <> m.cert_id
  AND o.ct_ts BETWEEN m.ct_ts - INTERVAL 7 DAY AND m.ct_ts + INTERVAL 7 DAY)
SELECT cert_id, linked_id FROM (SELECT cert_id, other_id AS linked_id, row_number() OVER (PARTITION BY cert_id ORDER BY ct_ts, other_id) AS r FROM hits) WHERE r = 1""")
def link_nearest_7d(t: Tables) -> DataFrame:
    return nearest_links(t.entries, t.entries.where(F.col("entry_type") == "precert"), "precert")


@query("SELECT cert_id, min(idx) AS first_idx, arg_min(entry_type, idx) AS first_type FROM entries GROUP BY cert_id")
def dedup_first_seen(t: Tables) -> DataFrame:
    return ingest.first_seen(t.entries, "cert_id", "idx", "entry_type").select("cert_id", F.col("at.idx").alias("first_idx"), F.col("at.entry_type").alias("first_type"))


@query("SELECT l_orderkey, sha256(string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, l_partkey)) AS chain_hash FROM lineitem GROUP BY l_orderkey")
def chain_hash(t: Tables) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string").cast("binary"))
    rows = t.lineitem.groupBy("l_orderkey").agg(parts.alias("prints"))
    return rows.select("l_orderkey", F.lower(F.hex(ingest.chain_id(F.col("prints")))).alias("chain_hash"))


@query("SELECT e.log, e.idx, date_diff('second', c.not_before, e.ct_ts) AS delay_s FROM entries e JOIN certs c USING (cert_id)")
def logging_delay(t: Tables) -> DataFrame:
    from certloom.sources.dataset import logging_delay as delays

    return delays(t.entries, t.certs).select("log", "idx", F.unix_seconds((F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + F.col("logging_delay")).cast("timestamp")).alias("delay_s"))


@query("SELECT e.log, median(date_diff('second', c.not_before, e.ct_ts)) AS median_s, count(DISTINCT e.cert_id) AS certs FROM entries e JOIN certs c USING (cert_id) GROUP BY e.log")
def delay_median(t: Tables) -> DataFrame:
    joined = t.entries.join(t.certs.select("cert_id", "not_before"), "cert_id")
    seconds = F.unix_seconds(F.col("ct_ts").cast("timestamp")) - F.unix_seconds(F.col("not_before").cast("timestamp"))
    return joined.withColumn("s", seconds).groupBy("log").agg(F.median("s").alias("median_s"), F.count_distinct("cert_id").alias("certs"))


_LINK_ENTRIES = "SELECT event_id AS idx, CASE event_type WHEN 'click' THEN 'precert' WHEN 'purchase' THEN 'x509' END AS entry_type, CAST(user_id AS VARCHAR) || '/' || CAST(CAST(value AS INTEGER) % 7 AS VARCHAR) AS digest, epoch_us(ts) // 1000 AS ts_ms, CAST(user_id AS VARCHAR) AS sha256 FROM events WHERE event_type IN ('click', 'purchase')"


@query(f"""
, x AS ({_LINK_ENTRIES}), p AS (SELECT digest, min(idx) AS p_idx, arg_min(ts_ms, idx) AS p_ms FROM x WHERE entry_type = 'precert' GROUP BY digest),
f AS (SELECT sha256, min(idx) AS first_idx FROM x GROUP BY sha256),
l AS (SELECT x.idx, coalesce(p_idx < x.idx, false) AS linked, p_idx IS NOT NULL AND p_idx > x.idx AS later, first_idx = x.idx AS new, x.ts_ms - p_ms AS d
  FROM x LEFT JOIN p USING (digest) JOIN f USING (sha256) WHERE entry_type = 'x509')
SELECT count(*) AS finals, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE later) AS precert_later, count(*) FILTER (WHERE linked AND new) AS eligible,
  quantile_disc(d, 0.5) FILTER (WHERE linked) AS p50, quantile_disc(d, 0.95) FILTER (WHERE linked) AS p95, quantile_disc(d, 0.99) FILTER (WHERE linked) AS p99 FROM l""")
def link_delays(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("string")
    rows = t.events.where(F.col("event_type").isin("click", "purchase")).select(
        F.col("event_id").alias("idx"),
        F.when(F.col("event_type") == "click", "precert").otherwise("x509").alias("entry_type"),
        F.concat(user, F.lit("/"), (F.rint("value").cast("int") % 7).cast("string")).alias("digest"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        user.alias("sha256"),
    )
    return stats.link_report(stats.link_facts(rows))


NOW = datetime(2024, 1, 20, 12)


@query("""
, w AS (SELECT * FROM batches WHERE committed_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR)
SELECT CASE WHEN count(*) >= 3 AND epoch(max(committed_at) - min(committed_at)) >= 600
  THEN (sum(last - first + 1) - arg_min(last - first + 1, commit_seq)) / epoch(max(committed_at) - min(committed_at)) END AS rate FROM w""")
def rate_window(t: Tables) -> DataFrame:
    return stats.ingest_rate(t.batches, NOW)


@query("""
, w AS (SELECT * FROM batches WHERE committed_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY)
SELECT (arg_max(last + 1, committed_at) - arg_min(last + 1, committed_at)) / epoch(max(committed_at) - min(committed_at)) AS growth FROM w""")
def growth_window(t: Tables) -> DataFrame:
    return stats.growth_rate(t.batches, NOW)


@query("""
, w AS (SELECT * FROM batches ORDER BY commit_seq DESC LIMIT 20)
SELECT count(*) AS batches, avg(vault_bytes / entries) AS vault, avg(2 * vault_bytes / entries) AS parquet, avg(vault_bytes / entries) + avg(2 * vault_bytes / entries) AS total FROM w""")
def bytes_per_entry(t: Tables) -> DataFrame:
    return stats.bytes_per_entry(t.batches)


@query("SELECT sum(rate_limited) / sum(entries) AS ratio FROM batches WHERE committed_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR")
def ratio_429(t: Tables) -> DataFrame:
    return stats.limited_ratio(t.batches, NOW)


@query("SELECT count(*) AS batches, sum(entries)::BIGINT AS entries, sum(new_certs)::BIGINT AS new_certs, 0::BIGINT AS delta_records, 0 / sum(new_certs) AS delta_share FROM batches")
def batch_totals(t: Tables) -> DataFrame:
    return stats.totals(t.batches)


@query("SELECT status, sum(n)::BIGINT AS n FROM (SELECT 'ok' AS status, entries AS n FROM batches UNION ALL SELECT 'partial', rate_limited FROM batches) GROUP BY status")
def parse_status_merge(t: Tables) -> DataFrame:
    return stats.parse_statuses(t.batches)


@query("SELECT CASE WHEN count(*) < 20 THEN 840.0 ELSE quantile_disc(vault_bytes / entries, 0.95) END AS p95 FROM batches")
def p95_seed(t: Tables) -> DataFrame:
    return stats.p95(t.batches.select((F.col("vault_bytes") / F.col("entries")).alias("v")), "v", 840.0)


@query("""
, r AS (SELECT *, lag(last) OVER (PARTITION BY log ORDER BY commit_seq) AS prev FROM batches WHERE commit_seq % 7 <> 0)
SELECT log, first, coalesce(prev + 1, 0) AS expected FROM r WHERE first <> coalesce(prev + 1, 0)""")
def contiguity_gaps(t: Tables) -> DataFrame:
    return verify.contiguity(t.batches.where(F.col("commit_seq") % 7 != 0))


@query(", s AS (SELECT commit_seq FROM batches WHERE commit_seq % 7 <> 0) SELECT * FROM (SELECT unnest(range(1, (SELECT max(commit_seq) FROM s) + 1)) AS commit_seq) WHERE commit_seq NOT IN (SELECT commit_seq FROM s)")
def seq_missing(t: Tables) -> DataFrame:
    return verify.missing_commits(t.batches.where(F.col("commit_seq") % 7 != 0))


@query("""
, r AS (SELECT commit_seq, first AS low, last + CASE WHEN commit_seq % 5 = 0 THEN 10 ELSE 0 END AS high FROM batches),
b AS (SELECT *, max(high) OVER (ORDER BY commit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT commit_seq, low, before FROM b WHERE low <= before""")
def id_range_overlap(t: Tables) -> DataFrame:
    high = F.col("last") + F.when(F.col("commit_seq") % 5 == 0, 10).otherwise(0)
    return verify.id_overlaps(t.batches.select("commit_seq", F.col("first").alias("low"), high.alias("high")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2))::INTEGER < 16")
def hash_sample_16(t: Tables) -> DataFrame:
    return stats.hash_sample(t.orders.withColumn("k", F.col("o_orderkey").cast("string")), "k").select("o_orderkey", "o_orderdate")


@query("""
, s AS (SELECT CAST(o_totalprice AS BIGINT) AS v, ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2))::INTEGER < 16 AS s FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders))
SELECT true AS approximate, count(*) AS records, count(*) FILTER (WHERE s) AS sampled, (sum(v) FILTER (WHERE s))::BIGINT AS sampled_sum, ((sum(v) FILTER (WHERE s)) * count(*) // count(*) FILTER (WHERE s))::BIGINT AS estimate FROM s""")
def scaled_estimate(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("k"), F.floor("o_totalprice").alias("v"))
    return stats.scaled_estimate(rows, "k", "v")


@query("""
, leaf AS (SELECT event_id AS idx, sha256(CAST(event_id AS VARCHAR)) AS h FROM events)
SELECT idx // 2 AS idx, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256('\\x01'::BLOB || unhex(min(CASE WHEN idx % 2 = 0 THEN h END)) || unhex(min(CASE WHEN idx % 2 = 1 THEN h END))) END AS hash FROM leaf GROUP BY idx // 2""")
def merkle_level(t: Tables) -> DataFrame:
    leaves = t.events.select(F.col("event_id").alias("idx"), F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("hash"))
    return merkle.fold_level(leaves).select("idx", F.lower(F.hex("hash")).alias("hash"))


_LEVEL = """l{1} AS (SELECT idx // 2 AS idx, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256('\\x01'::BLOB || unhex(min(CASE WHEN idx % 2 = 0 THEN h END)) || unhex(min(CASE WHEN idx % 2 = 1 THEN h END))) END AS h FROM l{0} GROUP BY idx // 2)"""


@query(", l0 AS (SELECT event_id AS idx, sha256(CAST(event_id AS VARCHAR)) AS h FROM events), " + ", ".join(_LEVEL.format(i, i + 1) for i in range(6)) + " SELECT idx, h AS hash FROM l6")
def merkle_subtrees(t: Tables) -> DataFrame:
    leaves = t.events.select(F.col("event_id").alias("idx"), F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("hash"))
    return merkle.subtree_roots(leaves, 6).select("idx", F.lower(F.hex("hash")).alias("hash"))


@query("SELECT entry_type, count(DISTINCT issuance_key) AS issuances, count(DISTINCT cert_id) AS certs FROM entries GROUP BY entry_type")
def count_distinct(t: Tables) -> DataFrame:
    return t.entries.groupBy("entry_type").agg(F.count_distinct("issuance_key").alias("issuances"), F.count_distinct("cert_id").alias("certs"))


@query()
def approx_distinct(t: Tables) -> DataFrame:
    return t.entries.agg(F.approx_count_distinct("issuance_key").alias("issuances"), F.lit(True).alias("approximate"))


@query("SELECT count(user_id) AS seen, count(DISTINCT user_id) AS \"unique\", count(user_id) - count(DISTINCT user_id) AS hits, (count(user_id) - count(DISTINCT user_id)) / count(user_id) AS hit_rate FROM events")
def dedup_rate(t: Tables) -> DataFrame:
    return stats.dedup_report(t.events, "user_id")


@query("SELECT event_type AS leaf_error, count(*) AS n, event_type = 'error' AS structural FROM events WHERE event_type <> 'view' GROUP BY event_type")
def error_code_counts(t: Tables) -> DataFrame:
    return stats.error_counts(t.events.withColumn("leaf_error", F.when(F.col("event_type") != "view", F.col("event_type"))), ("error",))


@query("SELECT l_returnflag AS kind, l_linenumber AS dictionary, l_linestatus AS entry_type, count(*) AS records, sum(CAST(l_quantity AS BIGINT))::BIGINT AS raw_bytes, sum(l_linenumber)::BIGINT AS stored_bytes, sum(CAST(l_quantity AS BIGINT)) / sum(l_linenumber) AS ratio, sum(l_linenumber) / count(*) AS mean_stored FROM lineitem GROUP BY 1, 2, 3")
def compression_by_group(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("dictionary"), F.col("l_linestatus").alias("entry_type"), F.col("l_quantity").cast("long").alias("raw"), F.col("l_linenumber").cast("long").alias("stored"))
    return stats.compression_groups(rows)


@query("SELECT name, count(*) AS n FROM names GROUP BY name HAVING count(*) > 1")
def names_having(t: Tables) -> DataFrame:
    return t.names.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > 1)


@query("SELECT cert_id, name, pos - 1 AS position, label FROM (SELECT cert_id, name, unnest(string_split(name, '.')) AS label, unnest(range(1, len(string_split(name, '.')) + 1)) AS pos FROM names)")
def names_explode(t: Tables) -> DataFrame:
    return t.names.select("cert_id", "name", F.posexplode(F.split("name", r"\.")).alias("position", "label")).withColumn("position", F.col("position").cast("long"))


_NORMAL = "regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\.$', '')"


@query(f"""
, raw AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN upper(h) || '.' WHEN page_id % 7 = 0 THEN '*.' || h WHEN page_id % 11 = 0 THEN h || '..x' ELSE h END AS u
  FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1) AS h FROM pages)),
n AS (SELECT page_id, {_NORMAL} AS name FROM raw),
b AS (SELECT page_id, name, regexp_replace(name, '^\\*\\.', '') AS rest FROM n)
SELECT page_id, name, valid, valid AND rest <> name AS wildcard, CASE WHEN valid THEN rest ELSE '' END AS base
FROM (SELECT *, length(name) <= 253 AND regexp_full_match(rest, '[a-z0-9_-]{{1,63}}(\\.[a-z0-9_-]{{1,63}})*') AS valid FROM b)""")
def normalize_dns(t: Tables) -> DataFrame:
    h = F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]*)", 1)
    k = F.col("page_id")
    raw = F.when(k % 3 == 0, F.concat(F.upper(h), F.lit("."))).when(k % 7 == 0, F.concat(F.lit("*."), h)).when(k % 11 == 0, F.concat(h, F.lit("..x"))).otherwise(h)
    return t.pages.select("page_id", names_.normalised(raw).alias("n")).select("page_id", "n.*")


@query(r"""
, u AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, [x for x in list_concat(list_reverse(string_split(trim(lower(path), '/'), '/')), [string_split(host, '.')[1]]) if regexp_full_match(x, '[a-z][a-z0-9_-]*[0-9][a-z0-9_-]*')] AS likes FROM u)
SELECT page_id, coalesce(likes[1], substr(trim(regexp_replace(lower(host || '/' || path), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64)) AS log_name FROM p""")
def log_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", log_name_column(F.lit(""), F.col("url")).alias("log_name"))


_LACKING = "(SELECT DISTINCT {0} AS cert_id FROM {1} WHERE {0} NOT IN (SELECT cert_id FROM certs WHERE kind <> 'chain'))"


@query(" UNION ALL ".join(f"SELECT cert_id, '{name}' AS \"table\" FROM {_LACKING.format(column, table)}" for name, column, table in (("names", "cert_id", "names"), ("entries", "cert_id", "entries"), ("chains", "l_partkey", "lineitem"))))
def dangling_references(t: Tables) -> DataFrame:
    chains = t.lineitem.select(F.col("l_partkey").alias("cert_id"))
    return verify.dangling(t.entries, chains, t.names, t.certs.where(F.col("kind") != "chain"))


@query("SELECT cert_id, log FROM entries WHERE log = 'log1' UNION ALL SELECT cert_id, NULL FROM names")
def union_by_name(t: Tables) -> DataFrame:
    return t.entries.where(F.col("log") == "log1").select("cert_id", "log").unionByName(t.names.select("cert_id"), allowMissingColumns=True)


@query("SELECT cert_id FROM entries WHERE log = 'log1' INTERSECT SELECT cert_id FROM entries WHERE log = 'log2'")
def intersect(t: Tables) -> DataFrame:
    return t.entries.where(F.col("log") == "log1").select("cert_id").intersect(t.entries.where(F.col("log") == "log2").select("cert_id"))


@query("SELECT cert_id FROM certs EXCEPT SELECT cert_id FROM names")
def except_distinct(t: Tables) -> DataFrame:
    return t.certs.select("cert_id").subtract(t.names.select("cert_id"))


@query("SELECT log, entry_type, count(*) AS n FROM entries GROUP BY ROLLUP (log, entry_type)")
def rollup(t: Tables) -> DataFrame:
    return t.entries.rollup("log", "entry_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(t: Tables) -> DataFrame:
    entries = t.events.select(F.col("event_type").alias("log"), F.col("ts").alias("ct_ts"), F.col("user_id").alias("cert_id"))
    return entry_windows(entries, "1 hour").select(F.col("log").alias("event_type"), F.col("window.start").cast("timestamp_ntz").alias("hour"), F.col("entries").alias("n"))


@query("""
, g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS jump, event_id FROM events),
s AS (SELECT user_id, ts, sum(jump) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(t: Tables) -> DataFrame:
    entries = t.events.select(F.col("user_id").alias("log"), F.col("ts").alias("ct_ts"))
    return entry_sessions(entries, "6 hours").select(F.col("log").alias("user_id"), F.col("session_window.start").cast("timestamp_ntz").alias("started"), F.col("entries").alias("n"))


@query("""
SELECT user_id, event_id, previous, running FROM (SELECT user_id, event_id, lag(event_id) OVER w AS previous,
  max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def previous_row(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.lag("event_id").over(w).alias("previous"), F.max("event_id").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("running"))


@query("SELECT cert_id, string_split(name, '.')[-1] AS tld, etld1 FROM names")
def public_suffixes(t: Tables) -> DataFrame:
    suffixes = names_.suffixes_udf(t.spark)
    found = t.names.select("cert_id", names_.normalised(F.col("name")).alias("n")).select("cert_id", suffixes("n.base").alias("s"))
    return found.select("cert_id", "s.tld", "s.etld1")
