"""Log entries: leaf and extra data, chains, issuance keys, and precertificate cross-checks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache

from certloom.functions import der
from certloom.functions.der import Element, Malformed
from certloom.functions.merkle import leaf_hash
from certloom.functions.x509 import AKI, EKU, POISON, PRECERT_SIGNING, SCT_LIST, SKI, key_identifier, read_extension


class Short(ValueError):
    """Fewer bytes than a field asks for."""


class Reader:
    """Reads big-endian numbers and length-prefixed vectors."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        at, end = self.at, self.at + n
        if len(self.data) < end:
            raise Short
        self.at = end
        return self.data[at:end]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def vector(self, width: int) -> bytes:
        return self.take(self.number(width))

    @property
    def empty(self) -> bool:
        return self.at == len(self.data)


@dataclass
class Entry:
    leaf_hash: bytes
    entry_type: str = "unknown"
    timestamp: int = 0
    cert: bytes | None = None
    tbs: bytes | None = None
    issuer_key_hash: bytes | None = None
    chain: list[bytes] | None = None
    digest: bytes | None = None
    code: str | None = None
    extensions: bytes = field(default=b"", repr=False)

    def fail(self, code: str) -> None:
        """Only the first problem is kept."""
        self.code = self.code or code

    @property
    def issuance_key(self) -> bytes | None:
        return self.digest[:16] if self.digest else None


class Problem(Exception):
    """A stable code."""


def decode(leaf_input: bytes, extra_data: bytes) -> Entry:
    """One entry as served. Never fails: problems are in code."""
    e = Entry(leaf_hash(leaf_input))
    try:
        _read_leaf(e, Reader(leaf_input))
    except Short:
        e.fail("leaf_truncated")
        return e
    except Problem as p:
        e.fail(str(p))
        return e
    if e.entry_type == "precert":
        e.digest = hashlib.sha256(e.tbs).digest()
    try:
        r = Reader(extra_data)
        first = r.vector(3) if e.entry_type == "precert" else None
        if first == b"":
            raise Problem("chain_cert_empty")
        e.chain = list(_chain(extra_data[r.at :]))
        if first:
            e.cert = first
            _check_precert(e)
    except Short:
        e.fail("extra_truncated")
    except Problem as p:
        e.fail(str(p))
    if e.entry_type == "x509":
        try:
            e.digest = hashlib.sha256(parts(e.cert).remade(SCT_LIST)).digest()
        except Malformed:
            e.fail("issuance_key_unavailable")
    return e


#: Where an entry's timestamp ends: what follows, and its extra data, recur whenever a certificate is logged again.
AFTER_TIME = 10
#: Bytes of an entry whose decoding is kept.
WIDEST = 16384


def decode_kept(leaf_input: bytes, extra_data: bytes) -> Entry:
    """decode(), once for entries that differ in their timestamps only; nobody may change their chain."""
    if len(leaf_input) < AFTER_TIME or leaf_input[:2] != b"\0\0" or len(leaf_input) + len(extra_data) > WIDEST:
        return decode(leaf_input, extra_data)
    e = Entry.__new__(Entry)
    e.__dict__.update(_timeless(leaf_input[AFTER_TIME:], extra_data).__dict__)
    e.leaf_hash, e.timestamp = leaf_hash(leaf_input), int.from_bytes(leaf_input[2:AFTER_TIME], "big")
    return e


@lru_cache(1024)
def _timeless(rest: bytes, extra_data: bytes) -> Entry:
    """An entry but for its leaf hash and timestamp."""
    return decode(bytes(AFTER_TIME) + rest, extra_data)


def _read_chain(data: bytes) -> tuple[bytes, ...]:
    r = Reader(data)
    certs = Reader(r.vector(3))
    chain = []
    while not certs.empty:
        chain.append(certs.vector(3))
        if not chain[-1]:
            raise Problem("chain_cert_empty")
    if not r.empty:
        raise Problem("extra_trailing_bytes")
    return tuple(chain)


_chain = der.recurring(_read_chain, 1024, 16384)


def _read_leaf(e: Entry, r: Reader) -> None:
    for code in ("leaf_bad_version", "leaf_bad_leaf_type"):
        if r.number(1):
            raise Problem(code)
    e.timestamp = r.number(8)
    kind = r.number(2)
    if kind > 1:
        raise Problem("leaf_unknown_entry_type")
    e.entry_type = ("x509", "precert")[kind]
    if kind:
        e.issuer_key_hash = r.take(32)
    signed = r.vector(3)
    if not signed:
        raise Short
    e.extensions = r.vector(2)
    if not r.empty:
        raise Problem("leaf_trailing_bytes")
    if kind:
        e.tbs = signed
    else:
        e.cert = signed


def check_leaf_index(e: Entry, index: int) -> None:
    """Of tiled logs: one extension of type 0 must hold the entry's index in five bytes, and no type come twice."""
    found = {}
    try:
        r = Reader(e.extensions)
        while not r.empty:
            kind = r.number(1)
            if kind in found:
                raise Short
            found[kind] = r.vector(2)
    except Short:
        found = {}
    if found.get(0) != index.to_bytes(5, "big"):
        e.fail("leaf_index_mismatch")


class Parts:
    """The raw pieces of a certificate that the cross-checks compare and copy."""

    def __init__(self, data: bytes):
        # the signature's fields are not looked at
        tbs = der.element(der.only(data, der.SEQUENCE))
        self.fields: list[Element] = der.sequence(tbs.raw)
        at = 1 if self.fields and self.fields[0].tag == der.context(0, True) else 0
        core = self.fields[at : at + 6]
        if len(core) < 6 or [core[i].tag for i in (0, 2, 4, 5)] != [der.INTEGER, *[der.SEQUENCE] * 3]:
            raise Malformed("fixed fields")
        self.issuer_at = at + 2
        self.issuer, self.subject, self.key = core[2].raw, core[4].raw, core[5].raw
        lists = [i for i in range(at + 6, len(self.fields)) if self.fields[i].tag == der.context(3, True)]
        if len(lists) > 1:
            raise Malformed("two lists of extensions")
        self.list_at = lists[0] if lists else None
        self.extensions: list[tuple[str, bool, bytes, bytes]] = []
        if lists:
            self.extensions = [(*read_extension(x), x.raw) for x in der.sequence(self.fields[lists[0]].body)]
        self.subject_key_id = self._last(SKI, lambda v: der.only(v, der.OCTET_STRING))
        self.authority_key_id = self._last(AKI, key_identifier)
        self._remade: dict[tuple, bytes] = {}
        self.signs_precerts = any(PRECERT_SIGNING in _readable_oids(v) for o, _, v, _ in self.extensions if o == EKU)

    def _last(self, oid: str, reader) -> bytes | None:
        out = None
        for o, _, value, _ in self.extensions:
            if o == oid:
                try:
                    out = reader(value) or out
                except Malformed:
                    pass
        return out

    def has(self, oid: str) -> bool:
        return any(x[0] == oid for x in self.extensions)

    def may_be_issued_by(self, other: Parts) -> bool:
        mine, theirs = self.authority_key_id, other.subject_key_id
        return other.subject == self.issuer and (mine is None or theirs is None or mine == theirs)

    def rebuilt(self, without: str, issuer: bytes | None = None, key_id: bytes | None = None) -> bytes:
        """The TBSCertificate without an extension, with another issuer and authority key id if given.

        All else is copied byte for byte; an empty list of extensions is left out.
        """
        kept = []
        for oid, critical, _, raw in self.extensions:
            if oid == AKI and key_id is not None and oid != without:
                value = der.make(der.OCTET_STRING, der.make(der.SEQUENCE, der.make(der.context(0), key_id)))
                raw = der.make(der.SEQUENCE, der.make_oid(AKI), der.make(der.BOOLEAN, b"\xff") if critical else b"", value)
            kept += [raw] if oid != without else []
        out = [f.raw for f in self.fields]
        if issuer is not None:
            out[self.issuer_at] = issuer
        if self.list_at is not None:
            out[self.list_at] = der.make(der.context(3, True), der.make(der.SEQUENCE, *kept)) if kept else b""
        return der.make(der.SEQUENCE, *out)


    def remade(self, *how) -> bytes:
        """rebuilt(), kept for the entries to come with this certificate."""
        if how not in self._remade:
            self._remade[how] = self.rebuilt(*how)
        return self._remade[how]


@lru_cache(1024)
def parts(data: bytes) -> Parts:
    """A certificate's pieces; a log repeats its chains, and many certificates, in entry after entry."""
    return Parts(data)


@der.recurring
def _readable_oids(value: bytes) -> list[str]:
    out: list[str] = []
    try:
        data = der.body_of(der.element(value), der.SEQUENCE)
        at = 0
        while at < len(data):
            e = der.element(data, at)
            out.append(der.oid(der.body_of(e, der.OID)))
            at += len(e.raw)
    except Malformed:
        pass
    return out


def _issuer_of(c: Parts, chain: list[Parts]) -> Parts:
    """The chain's certificate that can have issued c; cross-signed copies of one count once."""
    fits = [x for x in chain if c.may_be_issued_by(x)]
    if not fits:
        raise Problem("chain_issuer_missing")
    if len({(x.key, x.signs_precerts) for x in fits}) > 1:
        raise Problem("chain_issuer_ambiguous")
    return fits[0]


def _readable(certs: list[bytes]) -> list[Parts]:
    out = []
    for c in certs:
        try:
            out.append(parts(c))
        except Malformed:
            pass
    return out


def _check_precert(e: Entry) -> None:
    """Issuer key hash and TBS of the leaf against the precertificate and its chain."""
    try:
        pre = parts(e.cert)
    except Malformed:
        raise Problem("precert_tbs_mismatch") from None
    chain = _readable(e.chain)
    issuer = root = _issuer_of(pre, chain)
    name = key_id = None
    if issuer.signs_precerts:
        root = _issuer_of(issuer, chain)
        name = issuer.issuer
        if pre.has(AKI):
            key_id = issuer.authority_key_id
            if key_id is None:
                raise Problem("precert_tbs_mismatch")
    if hashlib.sha256(root.key).digest() != e.issuer_key_hash:
        raise Problem("issuer_key_hash_mismatch")
    if pre.remade(POISON, name, key_id) != e.tbs:
        raise Problem("precert_tbs_mismatch")


def poisonless_digest(cert: bytes) -> bytes | None:
    """SHA-256 of a precertificate's TBS without its poison; None for anything else."""
    try:
        c = Parts(cert)
        return hashlib.sha256(c.rebuilt(POISON)).digest() if c.has(POISON) else None
    except Malformed:
        return None


def chain_id(fingerprints: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(fingerprints)).digest()
