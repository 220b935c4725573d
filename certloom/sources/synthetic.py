"""A log's raw entries made from rows, with certificates built from parts; keys and signatures are dummies.

For demonstrations and checks: what the certificates hold is known from the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from certloom.functions import der, extensions, x509
from certloom.functions.der import make, make_oid
from certloom.functions.entries import Made
from certloom.functions.quiet import uncollected

#: What a row says: the entry's place and time, and of its certificate number, unit and group.
ROWS = "idx long, ts_ms long, precert boolean, number long, unit string, team int"
_FIELDS = ("idx", "ts_ms", "precert", "number", "unit", "team")
RAW = "idx bigint, leaf_input binary, extra_data binary"
START = datetime(1996, 1, 1)
SIGNED_WITH = "1.2.840.10045.4.3.2"


def _name(cn: str, org: str) -> bytes:
    rdn = lambda oid, v: make(der.SET, make(der.SEQUENCE, make_oid(oid), make(der.UTF8, v.encode())))
    return make(der.SEQUENCE, rdn(x509.ORGANIZATION, org), rdn(x509.COMMON_NAME, cn))


def _ec_key(seed: str) -> bytes:
    point = b"\x04" + hashlib.sha512(seed.encode()).digest()
    return make(der.SEQUENCE, make(der.SEQUENCE, make_oid(x509.EC), make_oid("1.2.840.10045.3.1.7")), make(der.BIT_STRING, b"\x00", point))


def _rsa_key(seed: str) -> bytes:
    modulus = b"\x00" + b"".join(hashlib.sha512(f"{seed}/{i}".encode()).digest() for i in range(4))
    numbers = make(der.SEQUENCE, make(der.INTEGER, modulus[:1] + b"\xc1" + modulus[2:]), make(der.INTEGER, b"\x01\x00\x01"))
    return make(der.SEQUENCE, make(der.SEQUENCE, make_oid(x509.RSA), make(der.NULL)), make(der.BIT_STRING, b"\x00", numbers))


def _extension(oid: str, value: bytes, critical: bool = False) -> bytes:
    return make(der.SEQUENCE, make_oid(oid), make(der.BOOLEAN, b"\xff") if critical else b"", make(der.OCTET_STRING, value))


_VERSION = make(der.context(0, True), make(der.INTEGER, b"\x02"))
_ALGORITHM = make(der.SEQUENCE, make_oid(SIGNED_WITH))
_SIGNATURE = make(der.BIT_STRING, b"\x00sig")


@lru_cache(4096)
def _times(first: datetime, last: datetime) -> bytes:
    return make(der.SEQUENCE, *(make(der.UTC_TIME, t.strftime("%y%m%d%H%M%SZ").encode()) for t in (first, last)))


def _fields(serial: int, issuer: bytes, subject: bytes, key: bytes, first: datetime, last: datetime) -> bytes:
    """All of a TBSCertificate but its extensions."""
    number = make(der.INTEGER, serial.to_bytes(serial.bit_length() // 8 + 1, "big"))
    return b"".join((_VERSION, number, _ALGORITHM, issuer, _times(first, last), subject, key))


def _tbs(fields: bytes, *listed: bytes) -> bytes:
    return make(der.SEQUENCE, fields, make(der.context(3, True), make(der.SEQUENCE, *listed)))


def _signed(body: bytes) -> bytes:
    return make(der.SEQUENCE, body, _ALGORITHM, _SIGNATURE)


@lru_cache(1024)
def authority(unit: str, team: int) -> tuple[bytes, bytes, bytes]:
    """(name, key, certificate) of the authority of a unit and a group."""
    name, key = _name(f"CA {unit}", f"Org {team}"), _ec_key(f"{unit}/{team}")
    listed = [
        _extension(x509.SKI, make(der.OCTET_STRING, hashlib.sha1(key).digest())),
        _extension(extensions.BASIC_CONSTRAINTS, make(der.SEQUENCE, make(der.BOOLEAN, b"\xff"), make(der.INTEGER, b"\x00")), True),
    ]
    return name, key, _signed(_tbs(_fields(team + 1, name, name, key, START, START + timedelta(days=9000)), *listed))


@lru_cache(1024)
def _common(unit: str, team: int) -> bytes:
    """What all certificates of a unit and a group have after their names."""
    issuer_key = authority(unit, team)[1]
    uri = lambda text: make(extensions.URI, text.encode())
    cps = make(der.SEQUENCE, make(der.SEQUENCE, make_oid(extensions.CPS), make(der.IA5, f"http://cps.{unit.lower()}.example/".encode())))
    return b"".join((
        _extension(extensions.KEY_USAGE, make(der.BIT_STRING, b"\x07\x80"), True),
        _extension(x509.EKU, make(der.SEQUENCE, make_oid("1.3.6.1.5.5.7.3.1"))),
        _extension(extensions.POLICIES, make(der.SEQUENCE, make(der.SEQUENCE, make_oid("2.23.140.1.2.1"), cps))),
        _extension(extensions.AIA, make(der.SEQUENCE, make(der.SEQUENCE, make_oid("1.3.6.1.5.5.7.48.1"), uri(f"http://ocsp.{unit.lower()}.example")))),
        _extension(extensions.CRL_DPS, make(der.SEQUENCE, make(der.SEQUENCE, make(der.context(0, True), make(der.context(0, True), uri(f"http://crl.{unit.lower()}.example/{team}.crl")))))),
        _extension(x509.AKI, make(der.SEQUENCE, make(der.context(0), hashlib.sha1(issuer_key).digest()))),
    ))


@lru_cache(1024)
def _sct(unit: str, begins: datetime) -> bytes:
    sct = b"\x00" + hashlib.sha256(unit.encode()).digest() + (int((begins - datetime(1970, 1, 1)).total_seconds()) * 1000).to_bytes(8, "big") + b"\x00\x00\x04\x03\x00\x02ab"
    scts = len(sct).to_bytes(2, "big") + sct
    return _extension(x509.SCT_LIST, make(der.OCTET_STRING, len(scts).to_bytes(2, "big") + scts))


_POISON = _extension(x509.POISON, b"\x05\x00", True)


@lru_cache(64)
def certificate(number: int, unit: str, team: int) -> tuple[bytes, bytes, bytes]:
    """(what is logged of the precertificate, the precertificate, the certificate) of a number."""
    host, begins = f"h{number}.{unit.lower()}.example", START + timedelta(days=number % 1500)
    issuer, _, _ = authority(unit, team)
    dns = [host, f"*.{host}" if number % 10 == 0 else f"www.{host}"]
    ips = [bytes([10, number >> 16 & 255, number >> 8 & 255, number & 255])] if number % 4 == 0 else []
    listed = _extension(x509.SAN, make(der.SEQUENCE, *(make(der.context(2), d.encode()) for d in dns), *(make(der.context(7), i) for i in ips))) + _common(unit, team)
    key = _rsa_key(host) if team % 3 == 0 else _ec_key(host)
    fields = _fields(number + 1, issuer, _name(host, f"Customer {number}"), key, begins, begins + timedelta(days=400))
    return _tbs(fields, listed), _signed(_tbs(fields, listed, _POISON)), _signed(_tbs(fields, listed, _sct(unit, begins)))


def _vector(data: bytes, width: int) -> bytes:
    return len(data).to_bytes(width, "big") + data


@lru_cache(1024)
def _issuer(unit: str, team: int) -> tuple[bytes, bytes]:
    """(hash of the key, chain) of an authority, as its entries have them."""
    _, key, ca = authority(unit, team)
    return hashlib.sha256(key).digest(), _vector(_vector(ca, 3), 3)


@lru_cache(64)
def _after_time(precert: bool, number: int, unit: str, team: int) -> tuple[bytes, bytes]:
    """An entry's leaf_input after its timestamp, and its extra_data."""
    logged, pre, final = certificate(number, unit, team)
    key_hash, chain = _issuer(unit, team)
    if precert:
        return b"".join((b"\x00\x01", key_hash, _vector(logged, 3), b"\x00\x00")), _vector(pre, 3) + chain
    return b"".join((b"\x00\x00", _vector(final, 3), b"\x00\x00")), chain


def entry(ts_ms: int, precert: bool, number: int, unit: str, team: int, version: int = 0) -> tuple[bytes, bytes]:
    """(leaf_input, extra_data) as an RFC 6962 log serves them."""
    rest, extra = _after_time(precert, number, unit, team)
    return b"".join((bytes((version, 0)), ts_ms.to_bytes(8, "big"), rest)), extra


def made_entries(rows: DataFrame, malformed_every: int = 0) -> Made:
    """Raw entries (idx, leaf_input, extra_data) of ROWS; of every so many entries one has a leaf of another version.

    Rows are few bytes and much work: they are dealt to all cores in ranges of the number, however few
    files they come from, and a number's certificates are built once a range. A column part is kept.
    """
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(*_FIELDS, *(["part"] if "part" in rows.columns else [])).repartitionByRange(n, "number", "idx")

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(batch), 2000):
            part = batch.slice(low, 2000)
            with uncollected():
                made = [
                    entry(ts_ms, precert, number, unit, team, int(bool(malformed_every) and idx % malformed_every == 0))
                    for idx, ts_ms, precert, number, unit, team in zip(*[part.column(c).to_pylist() for c in _FIELDS], strict=True)
                ]
                raw = [part.column("idx"), pa.array([a for a, _ in made], pa.binary()), pa.array([b for _, b in made], pa.binary())]
            more = [c for c in part.schema.names if c not in _FIELDS]
            yield pa.RecordBatch.from_arrays([*raw, *[part.column(c) for c in more]], names=["idx", "leaf_input", "extra_data", *more])

    return Made(dealt.sortWithinPartitions("number", "idx"), build)


def raw_entries(rows: DataFrame, malformed_every: int = 0) -> DataFrame:
    """made_entries() as a table."""
    made = made_entries(rows.select(*_FIELDS), malformed_every)
    build = made.make
    return made.rows.mapInArrow(lambda batches: (b for x in batches for b in build(x)), RAW)
