"""Search: a Query over a snapshot, as one DataFrame."""

from __future__ import annotations

import re
from bisect import bisect_left
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.errors import UsageError
from certloom.functions.names import canonical_ip, normalise, session_suffixes
from certloom.operators.query import GROUPS, Query
from certloom.sources.dataset import Dataset, Snapshot

#: Matched certificates up to so many are known to the driver and prune files and row groups.
LITERAL_IDS = 1000
ISSUERS_SHOWN = 5
#: Patterns that Java's engine reads alike and runs without deep backtracking: anchors, literals,
#: escaped dots, plain classes, groups of alternatives that are not repeated, and at most two repetitions.
_PLAIN_ITEM = r"(?:[A-Za-z0-9_-]|\\[.-]|\[\^?(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9._])+-?\]|\.)"
_PLAIN = re.compile(rf"\^?(?:\((?:{_PLAIN_ITEM}|\|)+\)(?![*+?{{])|{_PLAIN_ITEM}[*+?]?(?![*+?{{]))*\Z")
SORT, KEY = "__sort", "__key"


def name_predicate(q: Query, psl) -> Column:
    """The mode's predicate on names. Equalities on name and etld1 reach the files' bloom filters."""
    name, etld1 = F.col("name"), F.col("etld1")
    text, valid, wild, base = normalise(q.text)
    domain = psl.registrable(base) if valid else None
    if q.mode == "etld1":
        if wild or domain is None or domain != base:
            raise UsageError(f"{q.text!r} is not a registrable domain; search below it with suffix:, or for one name with exact:")
        return etld1 == base
    if q.mode == "suffix":
        if wild or domain is None:
            raise UsageError(f"suffix: needs a DNS name under a registrable domain, not {q.text!r}")
        return (etld1 == domain) & ((name == text) | name.endswith("." + text))
    if q.mode == "exact":
        return name == (text if valid else q.text)
    if q.mode == "ip":
        ip = canonical_ip(q.text)
        if ip is None:
            raise UsageError(f"{q.text!r} is not an IP address")
        return (name == ip) & F.col("source").isin("san_ip", "cn")
    if q.mode == "contains":
        if not q.text:
            raise UsageError("contains: needs a text")
        return F.contains(F.lower(name), F.lit(q.text.lower()))
    return matches(name, q.text)


def checked_regex(pattern: str) -> str:
    """A pattern of RE2's syntax; Arrow's engine, which runs it, compiles it here."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as e:
        raise UsageError(f"regex: {e}") from None
    return pattern


def matches(text: Column, pattern: str) -> Column:
    """Whether a regular expression matches anywhere, in time linear in the text.

    Plain patterns run in the JVM; all others, whose syntax or backtracking would differ there, run
    in RE2 over Arrow batches.
    """
    pattern = checked_regex(pattern)
    if _PLAIN.match(pattern) and len(re.findall(r"[*+?]", pattern)) <= 2:
        return text.rlike(pattern)

    @F.arrow_udf("boolean")
    def linear(values: pa.Array) -> pa.Array:
        return pc.match_substring_regex(values, pattern)

    return linear(text)


def _at(t: datetime) -> Column:
    """A time at millisecond precision."""
    return F.lit(t.replace(microsecond=t.microsecond // 1000 * 1000)).cast("timestamp_ntz")


def issuer_list(c: Column) -> Column:
    """The first of the sorted different values."""
    return F.slice(F.array_sort(F.collect_set(c)), 1, ISSUERS_SHOWN)


def find_ca(dataset: Dataset, snap: Snapshot, arg: str):
    """The certs row of a SHA-256 or cert_id, for issued_by."""
    certs = dataset.table("certs", snap)
    if re.fullmatch(r"[0-9a-fA-F]{64}", arg):
        found = certs.where(F.col("sha256") == arg.lower())
    elif re.fullmatch(r"[0-9]+", arg):
        found = certs.where(F.col("cert_id") == int(arg))
    else:
        raise UsageError(f"issued-by: {arg!r} is neither a SHA-256 nor a cert_id")
    row = found.first()
    if row is None:
        raise UsageError(f"issued-by: no certificate {arg}")
    if row["subject_der"] is None:
        raise UsageError(f"issued-by: {arg} is not a CA certificate that a log served in a chain")
    return row


def issued_by(certs: DataFrame, ca, entries: DataFrame, chains: DataFrame) -> DataFrame:
    """certs whose issuer is the CA's subject, and that were served with a chain that starts with it,
    or carry its key identifier. Two ways to qualify, as one union of ids for a semi-join."""
    named = certs.where(F.col("issuer_der") == ca["subject_der"])
    first = chains.where((F.col("position") == 0) & (F.col("cert_id") == ca["cert_id"])).select("chain_id")
    ids = entries.join(first, "chain_id", "left_semi").select("cert_id")
    if ca["subject_key_id"] is not None:
        ids = ids.unionByName(named.where(F.col("authority_key_id") == ca["subject_key_id"]).select("cert_id"))
    return named.join(ids, "cert_id", "left_semi")


def batches_for(snap: Snapshot, ids: list[int]) -> tuple[list[dict], list[dict]]:
    """(batches that can hold these certificates, batches that can hold entries of them), by manifest alone."""
    ids = sorted(ids)

    def holds(m: dict) -> bool:
        low_high = m.get("cert_id_range")
        at = bisect_left(ids, low_high[0]) if low_high else len(ids)
        return at < len(ids) and ids[at] <= low_high[1]

    certs = [m for m in snap.batches if holds(m)]
    return certs, [m for m in snap.batches if certs and m["commit_seq"] >= certs[0]["commit_seq"]]


def grouped(q: Query, names: DataFrame, certs: DataFrame, entries: DataFrame, entry_filter: bool) -> DataFrame:
    """The rows of the query's group.

    names: matched (cert_id, name); certs: filtered; entries: filtered, of the matched certificates.
    With an entry filter only certificates with an entry that passes count.
    """
    how = "inner" if entry_filter else "left"
    seen = F.min("ct_ts").alias("first_seen"), F.max("ct_ts").alias("last_seen")
    if q.group == "issuances":
        # a right-sized scan: entries carry the key, certificates only filter and name issuers
        return (
            entries.where(F.col("issuance_key").isNotNull())
            .join(certs.select("cert_id", "issuer_cn"), "cert_id")
            .groupBy("issuance_key")
            .agg(
                *seen,
                F.count_distinct("cert_id").alias("certs"),
                F.bool_or(F.col("entry_type") == "precert").alias("precert"),
                F.bool_or(F.col("entry_type") == "x509").alias("final"),
                issuer_list(F.col("issuer_cn")).alias("issuers"),
            )
            .withColumn("issuance_key", F.lower(F.hex("issuance_key")))
        )
    per_cert = entries.groupBy("cert_id").agg(*seen, F.array_sort(F.collect_set("log")).alias("logs"))
    if q.group == "certs":
        found = certs.join(names.select("cert_id"), "cert_id", "left_semi").join(per_cert, "cert_id", how)
        return found.withColumn("names", F.col("n_dns_names") + F.col("n_ip_names"))
    return (
        names.join(certs.select("cert_id", "issuer_cn"), "cert_id")
        .join(per_cert, "cert_id", how)
        .groupBy("name")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.count_distinct("cert_id").alias("certs"),
            issuer_list(F.col("issuer_cn")).alias("issuers"),
        )
    )


def text_filter(columns: list[str], text: str) -> Column:
    """Whether the displayed columns, as text, hold a text in any case. Nulls are skipped."""
    shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return F.contains(F.lower(shown), F.lit(text.lower()))


def ordering(sort: str, descending: bool, key: str) -> list[Column]:
    """Sort column with nulls last either way, then the unique key, ascending."""
    c = F.col(sort)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key).asc()]


def after(sort: str, descending: bool, key: str, value, key_value, kind: str | None = None) -> Column:
    """The rows behind a row (value, key_value) in that order; kind: the sort column's type."""
    c, k = F.col(sort), F.col(key)
    if value is None:
        return c.isNull() & (k > key_value)
    v = F.lit(value).cast(kind) if kind and not isinstance(value, list) else F.lit(value)
    beyond = c < v if descending else c > v
    return beyond | c.isNull() | ((c == v) & (k > key_value))


def matched_names(q: Query, names: DataFrame, psl) -> DataFrame:
    """cert_id and name of the names that the query's mode finds."""
    where = name_predicate(q, psl)
    return names.where(where & F.col("is_wildcard") if q.wildcard else where).select("cert_id", "name")


def filtered(q: Query, names: DataFrame, certs: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of a checked query over matched names and the certificates and entries that can belong to them."""
    certs = certs.where(F.col("kind").isin(q.kinds))
    for column, value in (("issuer_cn", q.issuer), ("issuer_o", q.issuer_org)):
        if value:
            certs = certs.where(F.lower(column) == value.lower())
    for column, value in (("key_alg", q.key_alg), ("parse_status", q.parse_status)):
        if value:
            certs = certs.where(F.col(column) == value)
    if q.valid_at:
        certs = certs.where((F.col("not_before") <= _at(q.valid_at)) & (_at(q.valid_at) < F.col("not_after")))
    entry_filter = bool(q.log)
    if q.log:
        entries = entries.where(F.col("log") == q.log)
    for t, test in ((q.since, "__ge__"), (q.until, "__lt__")):
        if t and q.by_not_before:
            certs = certs.where(getattr(F.col("not_before"), test)(_at(t)))
        elif t:
            entries, entry_filter = entries.where(getattr(F.col("ct_ts"), test)(_at(t))), True
    return grouped(q, names, certs, entries, entry_filter)


def compiled(dataset: Dataset, snap: Snapshot, q: Query) -> DataFrame:
    """All rows of a checked query, unsorted, with every column of its group."""
    names = matched_names(q, dataset.table("names", snap), session_suffixes(dataset.spark))
    ca = find_ca(dataset, snap, q.issued_by) if q.issued_by else None
    cert_batches = entry_batches = None
    ids: list[int] = []
    if not q.full_scan:
        # a first, narrow query: selective modes match few certificates, whose ids prune everything else
        ids = [r[0] for r in names.select("cert_id").distinct().limit(LITERAL_IDS + 1).collect()]
        if len(ids) <= LITERAL_IDS:
            cert_batches, entry_batches = batches_for(snap, ids)
    certs, entries = dataset.table("certs", snap, cert_batches), dataset.table("entries", snap, entry_batches)
    if cert_batches is not None:
        certs, entries = certs.where(F.col("cert_id").isin(ids)), entries.where(F.col("cert_id").isin(ids))
    else:
        matched = names.select("cert_id").distinct()
        certs, entries = certs.join(matched, "cert_id", "left_semi"), entries.join(matched, "cert_id", "left_semi")
    if ca is not None:
        certs = issued_by(certs, ca, dataset.table("entries", snap), dataset.table("chains", snap))
    return filtered(q, names, certs, entries)


def search(dataset: Dataset, snap: Snapshot, q: Query) -> DataFrame:
    """The query's rows, sorted and limited, with its fields in their order."""
    q = q.checked()
    sort, descending = q.order
    key = GROUPS[q.group].key
    rows = shaped(compiled(dataset, snap, q), q).orderBy(*ordering(SORT, descending, KEY))
    return (rows.limit(q.limit) if q.limit else rows).drop(SORT, KEY)


def shaped(rows: DataFrame, q: Query) -> DataFrame:
    """The displayed columns that pass the text filter, with sort value and key beside them."""
    sort, _ = q.order
    out = rows.select(*q.columns, F.col(sort).alias(SORT), F.col(GROUPS[q.group].key).alias(KEY))
    return out.where(text_filter(q.columns, q.filter)) if q.filter else out


def search_page(dataset: Dataset, snap: Snapshot, q: Query, cursor: tuple | None, size: int) -> tuple[list, tuple | None]:
    """(rows, cursor of the next page or None). Pages ignore the query's limit."""
    q = q.checked()
    _, descending = q.order
    rows = shaped(compiled(dataset, snap, q), q)
    if cursor is not None:
        rows = rows.where(after(SORT, descending, KEY, *cursor, kind=dict(rows.dtypes)[SORT]))
    found = rows.orderBy(*ordering(SORT, descending, KEY)).limit(size + 1).collect()
    more = len(found) > size
    page = found[:size]
    return [tuple(r[c] for c in q.columns) for r in page], (page[-1][SORT], page[-1][KEY]) if more else None
