"""Rows of the nine certificate tables, from Arrow batches of certificates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.functions import extensions, x509
from certloom.functions.names import name_rows, session_suffixes
from certloom.functions.quiet import uncollected
from certloom.sources.schemas import TABLES, columns, ddl_of

CERT_INPUT = "cert_id long, sha256 binary, kind string, delta_base_cert_id long, der binary"


def _hex(b: bytes | None) -> str | None:
    return b.hex() if b else None


def _small(n: int) -> int:
    return min(n, 0xFFFF)


def cert_row(c: x509.Certificate, cert_id: int, sha256: bytes, kind: str, delta_base: int | None) -> tuple:
    """The row of certs."""
    one = lambda values: values[0] if values else None
    chain = kind == "chain"
    return (
        cert_id, sha256.hex(), kind, c.has_poison, None, None, None, delta_base, c.status, c.errors,
        None if c.serial is None else c.serial.hex(), str(c.issuer) if c.issuer.rdns else None,
        one(c.issuer.values(x509.ORGANIZATION)), one(c.issuer.values(x509.COMMON_NAME)), _hex(c.issuer.raw), _hex(c.authority_key_id),
        c.not_before, c.not_after, c.key_algorithm, _small(c.key_bits) or None, c.key_curve, c.key_oid, c.signature_algorithm,
        one(c.subject.values(x509.COMMON_NAME)), _small(len(c.dns_names)), _small(len(c.ip_addresses)),
        any(n.startswith("*.") for n in c.dns_names),
        _hex(c.subject_key_id) if chain else None, _hex(c.subject.raw) if chain else None,
    )


@lru_cache(16)
def _names(dns: tuple, ips: tuple, cns: tuple, psl) -> list[tuple]:
    """name_rows(), kept for the certificate beside its precertificate."""
    return list(name_rows(dns, ips, cns, psl))


def all_rows(c: x509.Certificate, cert_id: int, sha256: bytes, kind: str, delta_base: int | None, psl) -> dict[str, list[tuple]]:
    """The rows of one certificate in every table."""
    out = {"certs": [cert_row(c, cert_id, sha256, kind, delta_base)]}
    out["names"] = [(cert_id, *r) for r in _names(tuple(c.dns_names), tuple(c.ip_addresses), tuple(c.subject.values(x509.COMMON_NAME)), psl)]
    return out | {t: [(cert_id, *r) for r in rows] for t, rows in extensions.rows(c).items()}


def built(certs: DataFrame) -> DataFrame:
    """One row a certificate: for every table an array of its rows.

    Certificates (CERT_INPUT) are parsed once for all tables, in Arrow batches.
    """
    spark = certs.sparkSession
    psl = spark.sparkContext.broadcast(session_suffixes(spark))
    schema = ", ".join(f"{t} array<struct<{', '.join(f'{n}: {k}' for n, k in columns(ddl_of(t)))}>>" for t in TABLES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {t: _arrow(t) for t in TABLES}
        for batch in batches:
            for low in range(0, len(batch), 2000):
                out: dict[str, list] = {t: [] for t in TABLES}
                with uncollected():
                    for cert_id, sha256, kind, base, der in zip(*[c.to_pylist() for c in batch.slice(low, 2000).columns], strict=True):
                        rows = all_rows(x509.parse(der), cert_id, sha256, kind, base, psl.value)
                        for t in TABLES:
                            out[t].append(rows[t])
                    arrays = [_lists(out[t], kinds[t]) for t in TABLES]
                yield pa.RecordBatch.from_arrays(arrays, names=list(TABLES))

    return certs.select("cert_id", "sha256", "kind", "delta_base_cert_id", "der").mapInArrow(work, schema)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"), "array<string>": pa.list_(pa.string()),
}


def _arrow(table: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, _ARROW[k]) for n, k in columns(ddl_of(table))]))


def _lists(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Lists of rows as an array of lists of structs, made column by column."""
    fields = list(kind.value_type)
    flat = [r for some in rows for r in some]
    values = list(zip(*flat, strict=True)) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), structs)


def table_rows(rows: DataFrame, table: str) -> DataFrame:
    """The rows of one table of built()."""
    return rows.select(F.explode(table).alias("r")).select("r.*")
