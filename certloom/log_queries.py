"""The engine over a dataset of its own: a log whose entries are the driver's orders.

An order's customer is its certificate's number: entries, certificates, names, chains and all that is
parsed from them follow from orders and customer, so plain SQL over these tables gives the same rows.
Orders with an even key go to log a, in two batches, the others to log b. The dataset is ingested once a
session, into the folder that the session's executors share.
"""

from __future__ import annotations

import csv
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.engine import Engine
from certloom.functions import merkle
from certloom.operators import stats, verify
from certloom.operators.fetch import Fetcher
from certloom.operators.numbering import durable, numbered, scratch
from certloom.operators.query import parse_bar
from certloom.queries import Tables, query
from certloom.sources import ctlog, sample
from certloom.sources.dataset import entry_certs
from certloom.sources.loglist import read_log_list
from certloom.sources.synthetic import RAW, made_entries, raw_entries
from certloom.streaming.follow import entry_sessions, entry_windows

#: One entry in so many is malformed.
MALFORMED = 89
_ENGINES: dict[tuple[str, str], Engine] = {}


def _rows(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey")
    idx = F.call_function("div", F.col("o_orderkey"), F.lit(2).cast("long"))
    return orders.select(
        F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("log"), idx.alias("idx"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
        (idx % 2 == 0).alias("precert"), F.col("o_custkey").alias("number"), F.col("c_mktsegment").alias("unit"), F.col("c_nationkey").alias("team"),
    )


def engine(t: Tables) -> Engine:
    """The engine over the orders' log, ingested at first use."""
    key = t.spark.sparkContext.applicationId, t.dir
    if key not in _ENGINES:
        e = Engine(t.spark, f"{scratch(t.spark)}/orders-log-{len(_ENGINES)}", create=True)
        rows = durable(_rows(t))
        n_a = rows.where(F.col("log") == "a").count()
        part = F.when(F.col("log") == "b", 2).when(F.col("idx") < n_a // 2, 0).otherwise(1)
        e.ingest_parts(made_entries(rows.withColumn("part", part), MALFORMED), ["a", "a", "b"])
        _ENGINES[key] = e
    return _ENGINES[key]


PARTS = f"""
WITH n AS (SELECT (count(*) + 1) // 2 // 2 AS half FROM orders),
every AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS log, o_orderkey // 2 AS idx, o_orderdate AS ct_ts, o_custkey AS number, c_mktsegment AS unit, c_nationkey AS team,
    CASE WHEN o_orderkey // 2 % 2 = 0 THEN 'precert' ELSE 'x509' END AS entry_type, o_orderkey // 2 % {MALFORMED} = 0 AS bad,
    CASE WHEN o_orderkey % 2 = 1 THEN 3 WHEN o_orderkey // 2 < half THEN 1 ELSE 2 END AS seq
  FROM orders JOIN customer ON c_custkey = o_custkey, n),
e AS (SELECT *, CASE entry_type WHEN 'precert' THEN 'precert' ELSE 'final' END AS kind FROM every WHERE NOT bad),
c AS (SELECT number, unit, team, kind, 'h' || number || '.' || lower(unit) || '.example' AS host, 'CA ' || unit AS issuer_cn, 'Org ' || team AS issuer_o,
    TIMESTAMP '1996-01-01' + to_days(CAST(number % 1500 AS INTEGER)) AS not_before, TIMESTAMP '1996-01-01' + to_days(CAST(number % 1500 AS INTEGER) + 400) AS not_after,
    min(ct_ts) AS first_seen, max(ct_ts) AS last_seen, list_sort(list_distinct(list(log))) AS logs
  FROM e GROUP BY number, unit, team, kind),
nm AS (
  SELECT number, kind, 'san_dns' AS source, host AS name, false AS wild FROM c
  UNION ALL SELECT number, kind, 'san_dns', CASE WHEN number % 10 = 0 THEN '*.' ELSE 'www.' END || host, number % 10 = 0 FROM c
  UNION ALL SELECT number, kind, 'san_ip', '10.' || (number // 65536 % 256) || '.' || (number // 256 % 256) || '.' || (number % 256), false FROM c WHERE number % 4 = 0)
"""


def log_query(sql: str, name: str | None = None):
    return query(PARTS + sql, name)


def _names(where: str, certs: str = "true", entries: str = "true") -> str:
    return f"""
, s AS (SELECT number, kind, min(ct_ts) AS first_seen, max(ct_ts) AS last_seen FROM e WHERE {entries} GROUP BY number, kind)
SELECT nm.name, min(s.first_seen) AS first_seen, max(s.last_seen) AS last_seen, count(*) AS certs, list_sort(list_distinct(list(c.issuer_cn))) AS issuers
FROM nm JOIN c USING (number, kind) JOIN s USING (number, kind) WHERE {where} AND {certs} GROUP BY nm.name"""


def _search(name: str, bar: str, sql: str, as_of: int = 0, **more) -> None:
    log_query(sql, name)(lambda t: engine(t).search(parse_bar(bar), as_of, **more))


_UNIT = "source = 'san_dns' AND unit = 'MACHINERY'"
_search("log_search_domain", "machinery.example", _names(_UNIT))
_search("log_search_filters", 'machinery.example kind:final issuer:"ca machinery" key:rsa status:ok since:1996-06 log:a', _names(_UNIT, "kind = 'final' AND team % 3 = 0", "log = 'a' AND ct_ts >= TIMESTAMP '1996-06-01'"))
_search("log_search_exact", "exact:H3.Machinery.Example.", _names("name = 'h3.machinery.example'").replace("name = 'h3", "nm.name = 'h3"))
_search("log_search_address", "ip:10.0.0.4", _names("source = 'san_ip' AND name = '10.0.0.4'"))
_search("log_search_suffix", "suffix:h3.machinery.example", _names("(name = 'h3.machinery.example' OR ends_with(name, '.h3.machinery.example'))"))
_search("log_search_contains", "contains:WWW.H1 wildcard", _names("contains(lower(name), 'www.h1') AND wild"))
_search("log_search_wildcards", "building.example wildcard", _names("source = 'san_dns' AND unit = 'BUILDING' AND wild"))
_search("log_search_regex", r"regex:^h1[0-9]\.m", _names(r"regexp_matches(name, '^h1[0-9]\.m')"))
_search("log_search_regex_re2", r"regex:^(?P<host>h(?:[[:digit:]]+)+)\.\p{L}+\.example$", _names(r"regexp_matches(name, '^(?P<host>h(?:[[:digit:]]+)+)\.\p{L}+\.example$')"))
_search("log_search_as_of", "machinery.example", f"""
, e1 AS (SELECT * FROM e WHERE seq = 1), s AS (SELECT number, kind, min(ct_ts) AS first_seen, max(ct_ts) AS last_seen FROM e1 GROUP BY number, kind)
SELECT nm.name, min(s.first_seen) AS first_seen, max(s.last_seen) AS last_seen, count(*) AS certs, ['CA MACHINERY'] AS issuers
FROM nm JOIN c USING (number, kind) JOIN s USING (number, kind) WHERE {_UNIT} GROUP BY nm.name""", as_of=1)  # fmt: skip
_search("log_search_valid_at", "building.example valid-at:1997-01-01 org:\"org 3\"", _names("source = 'san_dns' AND unit = 'BUILDING'", "team = 3 AND not_before <= TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-01' < not_after"))
_search(
    "log_search_certs", "household.example until:1998", """
, s AS (SELECT number, kind, min(ct_ts) AS first_seen, max(ct_ts) AS last_seen, list_sort(list_distinct(list(log))) AS logs FROM e WHERE ct_ts < TIMESTAMP '1998-01-01' GROUP BY number, kind)
SELECT kind, issuer_cn, not_before, not_after, CAST(2 + CASE WHEN number % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS names, s.first_seen, s.last_seen, s.logs
FROM c JOIN s USING (number, kind) WHERE unit = 'HOUSEHOLD'""",
    group="certs", fields=["kind", "issuer_cn", "not_before", "not_after", "names", "first_seen", "last_seen", "logs"],
)
_search(
    "log_search_issuances", "furniture.example", """
SELECT min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS certs, bool_or(kind = 'precert') AS precert, bool_or(kind = 'final') AS final, [any_value(issuer_cn)] AS issuers
FROM c WHERE unit = 'FURNITURE' GROUP BY number""",
    group="issuances", fields=["first_seen", "last_seen", "certs", "precert", "final", "issuers"],
)
_search("log_search_top", "automobile.example", """
SELECT name, count(*) AS certs FROM nm JOIN c USING (number, kind) WHERE source = 'san_dns' AND unit = 'AUTOMOBILE' GROUP BY name ORDER BY count(*) DESC, name LIMIT 25""",
        sort="certs desc", limit=25, fields=["name", "certs"])


def _snap(t: Tables):
    e = engine(t)
    return e.dataset, e.snapshot()


def _table(t: Tables, name: str) -> DataFrame:
    dataset, snap = _snap(t)
    return dataset.table(name, snap)


def _merged(df: DataFrame) -> DataFrame:
    """df for a join of tables that both grow with the log: sorted and merged, neither is broadcast.

    Spark takes a table to be as large as its share of compressed files, and what recurs takes next to no room in them:
    of cert_extensions 14 million rows come to less than the 10 MB that are broadcast, far more than a driver holds.
    """
    return df.hint("merge")


@log_query("SELECT log, idx, CASE WHEN NOT bad THEN ct_ts END AS ct_ts, CASE WHEN bad THEN 'unknown' ELSE entry_type END AS entry_type, NOT bad AS has_cert, CASE WHEN bad THEN 'leaf_bad_version' END AS leaf_error FROM every")
def log_entries(t: Tables) -> DataFrame:
    return _table(t, "entries").select("log", "idx", "ct_ts", "entry_type", F.col("cert_id").isNotNull().alias("has_cert"), "leaf_error")


@log_query("SELECT log, idx, 'leaf_bad_version' AS leaf_error FROM every WHERE bad")
def log_quarantine(t: Tables) -> DataFrame:
    return _table(t, "quarantine").select("log", "idx", "leaf_error")


@log_query("""
SELECT kind, number + 1 AS serial, issuer_cn, issuer_o, host AS subject_cn, not_before, not_after, CASE WHEN team % 3 = 0 THEN 'rsa' ELSE 'ecdsa' END AS key_alg,
  CASE WHEN team % 3 = 0 THEN 2048 ELSE 256 END AS key_bits, kind = 'precert' AS has_ct_poison, 2 AS n_dns_names, CASE WHEN number % 4 = 0 THEN 1 ELSE 0 END AS n_ip_names,
  number % 10 = 0 AS has_wildcard, 'ok' AS parse_status FROM c""")
def log_certs(t: Tables) -> DataFrame:
    leaf = _table(t, "certs").where(F.col("kind") != "chain")
    serial = F.conv("serial", 16, 10).cast("long")
    return leaf.select("kind", serial.alias("serial"), *"issuer_cn issuer_o subject_cn not_before not_after key_alg key_bits has_ct_poison n_dns_names n_ip_names has_wildcard parse_status".split())


@log_query("SELECT DISTINCT issuer_cn AS subject_cn, issuer_o, 'chain' AS kind, true AS is_ca, 0 AS path_len FROM c")
def log_authorities(t: Tables) -> DataFrame:
    usage = _table(t, "cert_key_usage").select("cert_id", "is_ca", "path_len")
    return _table(t, "certs").where(F.col("subject_der").isNotNull()).join(_merged(usage), "cert_id").select("subject_cn", "issuer_o", "kind", "is_ca", "path_len")


@log_query("""
SELECT number + 1 AS serial, kind, source, name, source = 'san_dns' AS dns_valid, wild AS is_wildcard, CASE WHEN source = 'san_dns' THEN 'example' END AS tld,
  CASE WHEN source = 'san_dns' THEN lower(unit) || '.example' END AS etld1 FROM nm JOIN c USING (number, kind)""")
def log_names(t: Tables) -> DataFrame:
    certs = _table(t, "certs").select("cert_id", F.conv("serial", 16, 10).cast("long").alias("serial"), "kind")
    return _table(t, "names").join(_merged(certs.where(F.col("kind") != "chain")), "cert_id").select("serial", "kind", "source", "name", "dns_valid", "is_wildcard", "tld", "etld1")


@log_query("""
SELECT kind, oid, critical, sum(n)::BIGINT AS n FROM (
  SELECT kind, unnest(['2.5.29.17', '2.5.29.15', '2.5.29.37', '2.5.29.32', '1.3.6.1.5.5.7.1.1', '2.5.29.31', '2.5.29.35', CASE kind WHEN 'precert' THEN '1.3.6.1.4.1.11129.2.4.3' ELSE '1.3.6.1.4.1.11129.2.4.2' END]) AS oid,
    unnest([false, true, false, false, false, false, false, kind = 'precert']) AS critical, 1 AS n FROM c)
GROUP BY kind, oid, critical""")
def log_extensions(t: Tables) -> DataFrame:
    kinds = _table(t, "certs").where(F.col("kind") != "chain").select("cert_id", "kind")
    rows = _table(t, "cert_extensions").where(F.col("decode_error").isNull()).join(_merged(kinds), "cert_id")
    return rows.groupBy("kind", "oid", "critical").agg(F.count("*").alias("n"))


@log_query("SELECT '2.23.140.1.2.1' AS policy_oid, 'dv' AS validation, 'http://cps.' || lower(unit) || '.example/' AS cps_uri, 1::BIGINT AS n_qualifiers, count(*) AS n FROM c GROUP BY unit")
def log_policies(t: Tables) -> DataFrame:
    return _table(t, "cert_policies").groupBy("policy_oid", "validation", "cps_uri", "n_qualifiers").agg(F.count("*").alias("n"))


@log_query("SELECT 'ocsp' AS method, 'http://ocsp.' || lower(unit) || '.example' AS uri, count(*) AS n FROM c GROUP BY unit")
def log_access(t: Tables) -> DataFrame:
    return _table(t, "cert_aia").groupBy("method", "uri").agg(F.count("*").alias("n"))


@log_query("SELECT 'http://crl.' || lower(unit) || '.example/' || team || '.crl' AS uri, false AS has_reasons, count(*) AS n FROM c GROUP BY unit, team")
def log_distribution_points(t: Tables) -> DataFrame:
    return _table(t, "cert_crl_dps").groupBy("uri", "has_reasons").agg(F.count("*").alias("n"))


@log_query("SELECT '1.3.6.1.5.5.7.3.1' AS eku_oid, true AS digital_signature, false AS key_cert_sign, count(*) AS n FROM c")
def log_purposes(t: Tables) -> DataFrame:
    usage = _table(t, "cert_key_usage").select("cert_id", "digital_signature", "key_cert_sign")
    return _table(t, "cert_ekus").join(_merged(usage), "cert_id").groupBy("eku_oid", "digital_signature", "key_cert_sign").agg(F.count("*").alias("n"))


@log_query("SELECT number + 1 AS serial, sha256(unit) AS log_id, not_before AS timestamp, 4 AS hash_alg, 3 AS sig_alg FROM c WHERE kind = 'final'")
def log_scts(t: Tables) -> DataFrame:
    certs = _table(t, "certs").select("cert_id", F.conv("serial", 16, 10).cast("long").alias("serial"))
    return _table(t, "cert_scts").join(_merged(certs), "cert_id").select("serial", "log_id", "timestamp", "hash_alg", "sig_alg")


@log_query("SELECT unit, team, 1::BIGINT AS length, count(*) AS entries FROM e GROUP BY unit, team")
def log_chains(t: Tables) -> DataFrame:
    cas = _table(t, "certs").select("cert_id", F.replace("subject_cn", F.lit("CA "), F.lit("")).alias("unit"), F.replace("issuer_o", F.lit("Org "), F.lit("")).cast("int").alias("team"))
    links = _table(t, "chains").join(cas, "cert_id").groupBy("chain_id").agg(F.first("unit").alias("unit"), F.first("team").alias("team"), F.count("*").alias("length"))
    return _table(t, "entries").join(links, "chain_id").groupBy("unit", "team", "length").agg(F.count("*").alias("entries"))


@log_query("SELECT number + 1 AS serial, kind, list_sort(list_distinct(list(entry_type))) AS types, count(*) AS entries, count(DISTINCT log) AS logs FROM e GROUP BY number, kind")
def log_types_per_cert(t: Tables) -> DataFrame:
    certs = _table(t, "certs").select("cert_id", F.conv("serial", 16, 10).cast("long").alias("serial"), "kind")
    rows = _table(t, "entries").groupBy("cert_id").agg(F.array_sort(F.collect_set("entry_type")).alias("types"), F.count("*").alias("entries"), F.count_distinct("log").alias("logs"))
    return rows.join(_merged(certs), "cert_id").select("serial", "kind", "types", "entries", "logs")


@log_query("""
, f AS (SELECT number, kind, min(seq::BIGINT * 1000000000 + idx) AS at FROM e GROUP BY number, kind), p AS (SELECT * FROM f WHERE kind = 'precert')
SELECT f.number + 1 AS serial, p.at IS NOT NULL AND p.at < f.at AS linked FROM f LEFT JOIN p USING (number) WHERE f.kind = 'final'""")
def log_delta_bases(t: Tables) -> DataFrame:
    certs = _table(t, "certs").select("cert_id", F.conv("serial", 16, 10).cast("long").alias("serial"), "kind", "delta_base_cert_id")
    bases = certs.where(F.col("kind") == "precert").select(F.col("cert_id").alias("delta_base_cert_id"), F.col("serial").alias("base"))
    finals = certs.where(F.col("kind") == "final").join(_merged(bases), "delta_base_cert_id", "left")
    return finals.select("serial", F.coalesce(F.col("base") == F.col("serial"), F.lit(False)).alias("linked"))


@log_query("SELECT seq AS commit_seq, log, min(idx) AS first, max(idx) AS last, count(*) AS entries FROM every GROUP BY seq, log")
def log_manifests(t: Tables) -> DataFrame:
    return engine(t).dataset.batches().select("commit_seq", "log", "first", "last", "entries")


@log_query("SELECT log, printf('%012d-%012d', min(idx), max(idx)) AS batch, count(*) AS n FROM every GROUP BY log, seq")
def log_partitions(t: Tables) -> DataFrame:
    return _table(t, "entries").groupBy("log", "batch").agg(F.count("*").alias("n"))


@log_query("""
, f AS (SELECT number, kind, min(seq) AS seq FROM e GROUP BY number, kind UNION ALL SELECT team * 1000 + ascii(unit), unit, min(seq) FROM e GROUP BY team, unit)
SELECT s.seq AS commit_seq, s.log, s.entries, count(f.seq) AS new_certs FROM (SELECT seq, log, count(*) AS entries FROM every GROUP BY seq, log) s LEFT JOIN f USING (seq) GROUP BY s.seq, s.log, s.entries""")
def log_batch_facts(t: Tables) -> DataFrame:
    return stats.batch_facts(engine(t).dataset).select("commit_seq", "log", "entries", "new_certs")


def _fetcher(t: Tables, number: int) -> tuple[Fetcher, int]:
    """A fetcher and the id of the certificate (or precertificate) of a number."""
    dataset, snap = _snap(t)
    f = Fetcher(dataset, snap)
    row = dataset.table("certs", snap).where(F.col("kind") != "chain").where(F.conv("serial", 16, 10).cast("long") == number + 1).orderBy("kind").first()
    return f, row["cert_id"]


@log_query(", k AS (SELECT min(kind) AS kind FROM e WHERE number = 5) SELECT log, idx, ct_ts FROM e WHERE number = 5 AND kind = (SELECT kind FROM k)")
def log_fetch_entries(t: Tables) -> DataFrame:
    f, cert_id = _fetcher(t, 5)
    return f.entries(cert_id).select("log", "idx", "ct_ts")


@log_query("SELECT min(kind) AS kind, any_value(host) AS subject_cn, 1 AS chains, true AS same FROM c WHERE number = 5")
def log_fetch(t: Tables) -> DataFrame:
    f, cert_id = _fetcher(t, 5)
    by_id, by_hash = f.fetch(cert_id), f.fetch(f.row(cert_id)["sha256"])
    row = (by_id[0]["kind"], by_id[0]["subject_cn"], f.chains(cert_id).count(), by_id == by_hash)
    return t.spark.createDataFrame([row], "kind string, subject_cn string, chains int, same boolean")


@log_query("SELECT CAST(row_number() OVER (ORDER BY source, name) - 1 AS INTEGER) AS position, name FROM nm WHERE number = 8 AND kind = (SELECT min(kind) FROM c WHERE number = 8)")
def log_fetch_names(t: Tables) -> DataFrame:
    f, cert_id = _fetcher(t, 8)
    names = [r["name"] for r in f.names(cert_id).collect()]
    return t.spark.createDataFrame(list(enumerate(names)), "position int, name string")


@log_query("SELECT count(*) AS n FROM nm WHERE name = 'www.h3.' || (SELECT lower(any_value(unit)) FROM c WHERE number = 3) || '.example'")
def log_count_names(t: Tables) -> DataFrame:
    f, cert_id = _fetcher(t, 3)
    return t.spark.createDataFrame([(f.count_names("www." + f.row(cert_id)["subject_cn"]),)], "n long")


_HELD = "SELECT name, count(*) AS certs FROM nm JOIN c USING (number, kind) WHERE source = 'san_dns' AND unit = 'BUILDING'"


@log_query(f", h AS ({_HELD} GROUP BY name), o AS (SELECT *, row_number() OVER (ORDER BY certs DESC, name) AS r FROM h) SELECT name, certs FROM o WHERE r > 20 AND r <= 40")
def log_held_page(t: Tables) -> DataFrame:
    held = engine(t).hold("building.example", sort="certs desc", fields=["name", "certs"])
    page = held.page(1, 20)
    held.close()
    return t.spark.createDataFrame(page, "name string, certs long")


@log_query(f", h AS ({_HELD} GROUP BY name) SELECT name, certs FROM h WHERE contains(name, 'www.h2')")
def log_held_filter(t: Tables) -> DataFrame:
    held = engine(t).hold("building.example", fields=["name", "certs"])
    again = held.reorder("name asc", "WWW.h2")
    rows = durable(again.rows())
    again.close(), held.close()
    return rows


@log_query(f", h AS ({_HELD} GROUP BY name) SELECT name, certs FROM h")
def log_pages(t: Tables) -> DataFrame:
    rows, cursor = [], None
    while True:
        page, cursor = engine(t).page("building.example", cursor, 5000, sort="certs desc", fields=["name", "certs"])
        rows += page
        if cursor is None:
            return t.spark.createDataFrame(rows, "name string, certs long")


@log_query("SELECT name, count(*) AS certs FROM nm JOIN c USING (number, kind) WHERE source = 'san_dns' AND unit = 'FURNITURE' GROUP BY name")
def log_export(t: Tables) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:  # an export is a file of the user's, on the driver
        meta = engine(t).export("furniture.example", f"{folder}/found.csv", "csv", fields=["name", "certs"])
        with open(f"{folder}/found.csv", encoding="utf-8", newline="") as f:
            rows = [(r["name"], int(r["certs"])) for r in csv.DictReader(f)]
    assert meta["row_count"] == len(rows)
    return t.spark.createDataFrame(rows, "name string, certs long")


@log_query("SELECT c.kind, count(*) AS entries, sum(date_diff('second', c.not_before, e.ct_ts))::BIGINT AS seconds FROM e JOIN c USING (number, kind) GROUP BY c.kind")
def log_views(t: Tables) -> DataFrame:
    engine(t).views()
    return t.spark.sql("""SELECT kind, count(*) AS entries, sum(timestampdiff(SECOND, not_before, ct_ts)) AS seconds FROM entry_certs GROUP BY kind""")


@log_query("SELECT 'no certs row' AS problem, (SELECT count(*) FROM c) AS n UNION ALL SELECT 'no record', count(*) FROM (SELECT DISTINCT unit, team FROM e)")
def log_lost_records(t: Tables) -> DataFrame:
    """The vault's leaf certificates against the table's chain certificates: neither has the other."""
    kinds = _table(t, "certs").select("cert_id", "kind")
    leaf = _table(t, "vault").join(_merged(kinds.where(F.col("kind") != "chain")), "cert_id", "left_semi")
    return verify.record_mismatches(leaf, _table(t, "certs").where(F.col("kind") == "chain")).groupBy("problem").agg(F.count("*").alias("n"))


@log_query("SELECT 'n_ip_names' AS field, count(*) FILTER (WHERE number % 4 = 0) AS n FROM c")
def log_field_mismatches(t: Tables) -> DataFrame:
    certs = _table(t, "certs").where(F.col("kind") != "chain")
    changed = certs.withColumn("n_ip_names", F.lit(0))
    return verify.field_mismatches(certs, changed, "cert_id", ["n_ip_names", "subject_cn", "not_before"]).groupBy("field").agg(F.count("*").alias("n"))


@log_query("""
SELECT unnest(['batches are contiguous', 'no commit is missing', 'certificate ids do not overlap', 'files are as committed', 'trees end with their batches', 'checksums are as committed',
  'records match certs', 'references exist', 'entries hash to the committed roots', 'kept heads are signed', 'derived tables match their certificates']) AS check,
  unnest(['ok', 'ok', 'ok', 'ok', 'ok', 'ok', 'ok', 'ok', 'ok', 'skipped', 'ok']) AS status, 0::BIGINT AS n FROM n""")
def log_verify(t: Tables) -> DataFrame:
    return engine(t).verify(full=True).select("check", "status", "n")


@log_query("SELECT name, count(*) AS n FROM nm GROUP BY name UNION ALL SELECT issuer_cn, count(DISTINCT team) FROM c GROUP BY issuer_cn")
def log_repair(t: Tables) -> DataFrame:
    engine(t).repair("names", 1)
    return _table(t, "names").groupBy("name").agg(F.count("*").alias("n"))


@log_query("SELECT idx, bad FROM every WHERE log = 'a'")
def log_captures(t: Tables) -> DataFrame:
    path = f"{scratch(t.spark)}/capture-{uuid.uuid4().hex}"
    ctlog.write_capture(raw_entries(_rows(t).where(F.col("log") == "a"), MALFORMED), path)
    return ctlog.read_capture(t.spark, path).select("idx", (F.substring(F.hex("leaf_input"), 1, 2) != "00").alias("bad"))


@log_query("SELECT log, TIMESTAMP '1970-01-01' + to_days(CAST(epoch(ct_ts) AS INTEGER) // 2592000 * 30) AS started, count(*) AS entries FROM e GROUP BY 1, 2")
def log_windows(t: Tables) -> DataFrame:
    rows = entry_windows(_table(t, "entries").where(F.col("ct_ts").isNotNull()), "30 days")
    return rows.select("log", F.col("window.start").cast("timestamp_ntz").alias("started"), "entries")


@log_query("""
, g AS (SELECT log, ct_ts, CASE WHEN ct_ts > lag(ct_ts) OVER (PARTITION BY log ORDER BY ct_ts, idx) + INTERVAL 2 DAY THEN 1 ELSE 0 END AS jump, idx FROM e),
s AS (SELECT log, ct_ts, sum(jump) OVER (PARTITION BY log ORDER BY ct_ts, idx) AS k FROM g)
SELECT log, min(ct_ts) AS started, count(*) AS entries FROM s GROUP BY log, k""")
def log_sessions(t: Tables) -> DataFrame:
    rows = entry_sessions(_table(t, "entries").where(F.col("ct_ts").isNotNull()), "2 days")
    return rows.select("log", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "entries")


@log_query("""
, x AS (SELECT idx, number, kind FROM e WHERE log = 'a'), p AS (SELECT number, min(idx) AS at FROM x WHERE kind = 'precert' GROUP BY number),
f AS (SELECT number, kind, min(idx) AS first FROM x GROUP BY number, kind),
l AS (SELECT coalesce(p.at < x.idx, false) AS linked, coalesce(p.at > x.idx, false) AS later, f.first = x.idx AS new FROM x LEFT JOIN p USING (number) JOIN f USING (number, kind) WHERE kind = 'final')
SELECT (SELECT count(*) FROM every WHERE log = 'a') AS entries, count(*) AS finals, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE later) AS precert_later,
  count(*) FILTER (WHERE linked AND new) AS eligible, (SELECT count(*) FROM x) AS seen, (SELECT count(*) FROM f) AS different, (SELECT count(DISTINCT (unit, team)) FROM e WHERE log = 'a') AS authorities,
  (SELECT count(*) FROM every WHERE log = 'a' AND bad) AS malformed FROM l""")
def log_measure(t: Tables) -> DataFrame:
    m = sample.measure(raw_entries(_rows(t).where(F.col("log") == "a"), MALFORMED))
    links, leaf = m["links"], m["leaf_certificates"]
    row = (m["entries"], *(links[c] for c in ("finals", "linked", "precert_later", "eligible")), leaf["seen"], leaf["unique"], m["chain_certificates"]["unique"], sum(r["n"] for r in m["leaf_errors"]))
    return t.spark.createDataFrame([row], "entries long, finals long, linked long, precert_later long, eligible long, seen long, different long, authorities long, malformed long")


@query("""
WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, * FROM supplier)
SELECT 's' AS log, idx, TIMESTAMP '2020-01-01' + to_hours(CAST(idx AS INTEGER)) AS ct_ts, CASE WHEN idx % 2 = 0 THEN 'precert' ELSE 'x509' END AS entry_type,
  'h' || s_suppkey || '.supply.example' AS subject_cn, 'Org ' || s_nationkey AS issuer_o FROM s""")
def log_stream(t: Tables) -> DataFrame:
    """The suppliers as a log that is streamed into a dataset of its own, in batches."""
    durable(t.spark.range(1))
    root = f"{t.spark.sparkContext.getCheckpointDir()}/suppliers-log-{uuid.uuid4().hex}"
    rows = numbered(t.supplier, [F.col("s_suppkey")], "idx", 0).select(
        F.col("idx").cast("long").alias("idx"), (F.lit(1577836800000) + F.col("idx") * 3600000).cast("long").alias("ts_ms"), (F.col("idx") % 2 == 0).alias("precert"),
        F.col("s_suppkey").alias("number"), F.lit("SUPPLY").alias("unit"), F.col("s_nationkey").alias("team"),
    )
    raw_entries(rows).write.parquet(f"{root}-raw")
    e = Engine(t.spark, root, create=True)
    size = max(1, rows.count() // 2)
    e.start_stream(t.spark.readStream.schema(RAW).parquet(f"{root}-raw"), "s", f"{root}-progress", batch_size=size).awaitTermination()
    dataset, snap = e.dataset, e.snapshot()
    return entry_certs(dataset.table("entries", snap), dataset.table("certs", snap)).select("log", "idx", "ct_ts", "entry_type", "subject_cn", "issuer_o")


@query("""
WITH n AS (SELECT *, regexp_replace(lower(n_name), '[^a-z0-9]', '_', 'g') || n_nationkey AS name FROM nation)
SELECT name, r_name AS operator, 'rfc6962' AS kind, 'https://ct.example/' || name || '/' AS url, 'usable' AS state FROM n JOIN region ON r_regionkey = n_regionkey""")
def log_list(t: Tables) -> DataFrame:
    """A log list of one log a nation, its regions the operators."""
    durable(t.spark.range(1))
    nations = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name", "n_nationkey")
    name = F.concat(F.regexp_replace(F.lower("n_name"), "[^a-z0-9]", "_"), F.col("n_nationkey").cast("string"))
    log = F.struct(
        F.concat(F.lit("log of "), "n_name").alias("description"), F.lit("id").alias("log_id"), F.lit("key").alias("key"), F.concat(F.lit("https://ct.example/"), name, F.lit("/")).alias("url"),
        F.create_map(F.lit("usable"), F.struct(F.lit("2024").alias("timestamp"))).alias("state"),
    )
    operators = nations.groupBy("r_name").agg(F.collect_list(log).alias("logs")).select(F.col("r_name").alias("name"), "logs")
    listed = operators.agg(F.collect_list(F.struct("name", "logs")).alias("operators")).select(F.lit("3").alias("version"), "operators")  # one row a region
    path = f"{t.spark.sparkContext.getCheckpointDir()}/log-list-{uuid.uuid4().hex}"
    listed.coalesce(1).write.json(path)
    return read_log_list(t.spark, path).select("name", "operator", "kind", "url", "state")


@log_query("SELECT DISTINCT 'CN=' || issuer_cn || ',O=' || issuer_o AS issuer_dn, 'ecdsa-with-SHA256' AS sig_alg FROM c")
def log_issuer_names(t: Tables) -> DataFrame:
    return _table(t, "certs").select("issuer_dn", "sig_alg").distinct()


@log_query("SELECT log, max(idx) AS last, count(*) AS size, true AS same FROM every GROUP BY log")
def log_roots(t: Tables) -> DataFrame:
    """The logs' tips: their trees, folded anew from all leaves, have the committed roots."""
    dataset, snap = _snap(t)
    leaves = dataset.table("entries", snap).select("log", "idx", F.col("leaf_hash").alias("hash"))
    rows = []
    for log, m in sorted(snap.tips().items()):
        root = merkle.merkle_root(leaves.where(F.col("log") == log).drop("log"), m["tree"]["size"])
        rows.append((log, m["last"], m["tree"]["size"], root.hex() == m["tree"]["root"]))
    return t.spark.createDataFrame(rows, "log string, last long, size long, same boolean")
