"""A lenient X.509 extractor: every field on its own, stable codes for what cannot be read."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from datetime import datetime

from certloom.functions import der
from certloom.functions.der import Element, Malformed

# Object identifiers and the names that columns show for them.
COMMON_NAME, ORGANIZATION = "2.5.4.3", "2.5.4.10"
SAN, SKI, AKI, EKU = "2.5.29.17", "2.5.29.14", "2.5.29.35", "2.5.29.37"
POISON, SCT_LIST, PRECERT_SIGNING = "1.3.6.1.4.1.11129.2.4.3", "1.3.6.1.4.1.11129.2.4.2", "1.3.6.1.4.1.11129.2.4.4"
SHORT_NAMES = {
    "2.5.4.3": "CN", "2.5.4.5": "serialNumber", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.9": "STREET",
    "2.5.4.10": "O", "2.5.4.11": "OU", "0.9.2342.19200300.100.1.1": "UID", "0.9.2342.19200300.100.1.25": "DC",
    "1.2.840.113549.1.9.1": "emailAddress",
}
SIGNATURES = {
    "1.2.840.113549.1.1.2": "md2WithRSAEncryption",
    "1.2.840.113549.1.1.4": "md5WithRSAEncryption",
    "1.2.840.113549.1.1.5": "sha1WithRSAEncryption",
    "1.2.840.113549.1.1.10": "rsassaPss",
    "1.2.840.113549.1.1.11": "sha256WithRSAEncryption",
    "1.2.840.113549.1.1.12": "sha384WithRSAEncryption",
    "1.2.840.113549.1.1.13": "sha512WithRSAEncryption",
    "1.2.840.113549.1.1.14": "sha224WithRSAEncryption",
    "1.2.840.10040.4.3": "dsa-with-SHA1",
    "1.2.840.10045.4.1": "ecdsa-with-SHA1",
    "1.2.840.10045.4.3.1": "ecdsa-with-SHA224",
    "1.2.840.10045.4.3.2": "ecdsa-with-SHA256",
    "1.2.840.10045.4.3.3": "ecdsa-with-SHA384",
    "1.2.840.10045.4.3.4": "ecdsa-with-SHA512",
    "1.3.101.112": "Ed25519",
    "1.3.101.113": "Ed448",
    "2.16.840.1.101.3.4.3.1": "dsa-with-SHA224",
    "2.16.840.1.101.3.4.3.2": "dsa-with-SHA256",
}
CURVES = {
    "1.2.840.10045.3.1.1": ("P-192", 192),
    "1.2.840.10045.3.1.7": ("P-256", 256),
    "1.3.132.0.10": ("secp256k1", 256),
    "1.3.132.0.33": ("P-224", 224),
    "1.3.132.0.34": ("P-384", 384),
    "1.3.132.0.35": ("P-521", 521),
}
RSA, RSA_PSS, EC, DSA = "1.2.840.113549.1.1.1", "1.2.840.113549.1.1.10", "1.2.840.10045.2.1", "1.2.840.10040.4.1"
EDWARDS = {"1.3.101.112": ("ed25519", 256, 32), "1.3.101.113": ("ed448", 456, 57)}


@dataclass
class Name:
    raw: bytes = b""
    rdns: list[list[tuple[str, Element]]] = field(default_factory=list)

    def values(self, oid: str) -> list[str]:
        """The values of an attribute type as columns show them, in DER order."""
        return [shown(e) for rdn in self.rdns for t, e in rdn if t == oid]

    def bad_strings(self) -> bool:
        return any(_undecodable(e) for rdn in self.rdns for _, e in rdn)

    @cached_property
    def _text(self) -> str:
        return ",".join("+".join(f"{SHORT_NAMES.get(t, t)}={_escaped(e)}" for t, e in rdn) for rdn in reversed(self.rdns))

    def __str__(self) -> str:
        """As RFC 4514 writes it: last RDN first."""
        return self._text


@dataclass
class Certificate:
    errors: list[str] = field(default_factory=list)
    version: int = 0
    serial: bytes | None = None
    signature_algorithm: str | None = None
    issuer: Name = field(default_factory=Name)
    subject: Name = field(default_factory=Name)
    not_before: datetime | None = None
    not_after: datetime | None = None
    key_oid: str | None = None
    key_algorithm: str | None = None
    key_bits: int = 0
    key_curve: str | None = None
    extensions: list[tuple[str, bool, bytes]] = field(default_factory=list)
    dns_names: list[str] = field(default_factory=list)
    ip_addresses: list[bytes] = field(default_factory=list)
    authority_key_id: bytes = b""
    subject_key_id: bytes = b""
    has_poison: bool = False

    @property
    def status(self) -> str:
        if {"cert_unreadable", "tbs_unreadable"} & set(self.errors):
            return "failed"
        return "partial" if self.errors else "ok"

    def note(self, *codes: str) -> None:
        self.errors += [c for c in dict.fromkeys(codes) if c not in self.errors]

    def first(self, oid: str) -> bytes | None:
        return next((v for o, _, v in self.extensions if o == oid), None)


# --- strings ---

_WIDTHS = {der.BMP: 2, der.UNIVERSAL: 4}


def decoded(e: Element) -> tuple[list[str | int] | None, bool]:
    """(characters, with undecodable bytes as numbers; whether there are any). None: not a string."""
    b, out = e.body, []
    if e.tag == der.UTF8:
        # surrogateescape marks each byte that is not part of valid UTF-8
        out = [ord(c) - 0xDC00 if 0xDC80 <= ord(c) <= 0xDCFF else c for c in b.decode("utf-8", "surrogateescape")]
    elif e.tag in (der.PRINTABLE, der.IA5, der.NUMERIC, der.VISIBLE):
        out = [chr(x) if x < 0x80 else x for x in b]
    elif e.tag == der.TELETEX:
        out = list(b.decode("latin-1"))
    elif width := _WIDTHS.get(e.tag):
        for at in range(0, len(b), width):
            unit = b[at : at + width]
            point = int.from_bytes(unit, "big")
            good = len(unit) == width and point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF
            out += [chr(point)] if good else list(unit)
    else:
        return None, False
    return out, any(isinstance(x, int) for x in out)


_TEXTS = {der.UTF8, der.PRINTABLE, der.IA5, der.NUMERIC, der.VISIBLE, der.TELETEX}


def _plain(b: bytes) -> str | None:
    """Printable ASCII without a backslash, which needs no escapes; None for anything else."""
    if b.isascii() and b"\\" not in b and (text := b.decode()).isprintable():
        return text
    return None


@lru_cache(4096)
def _undecodable(e: Element) -> bool:
    return not (e.tag in _TEXTS and e.body.isascii()) and decoded(e)[1]


def _hidden(x: str | int) -> str | None:
    """The escape of a raw byte or a control character."""
    code = x if isinstance(x, int) else ord(x)
    return f"\\{code:02X}" if isinstance(x, int) or code < 0x20 or code == 0x7F else None


#: Names of authorities, policies and places recur in certificate after certificate.
_recurring = lru_cache(4096)


@_recurring
def shown(e: Element) -> str:
    """A value in a column: backslashes doubled, bad bytes and controls escaped, # and hex for no string."""
    if e.tag in _TEXTS and (text := _plain(e.body)) is not None:
        return text
    chars, _ = decoded(e)
    if chars is None:
        return "#" + e.raw.hex()
    return "".join(_hidden(x) or ("\\\\" if x == "\\" else x) for x in chars)


@_recurring
def _escaped(e: Element) -> str:
    chars, _ = decoded(e)
    if chars is None:
        return "#" + e.raw.hex()
    last = len(chars) - 1
    plain = lambda i, x: not (x in '"+,;<>\\' or i == 0 and x in "# " or i == last and x == " ")
    return "".join(_hidden(x) or (x if plain(i, x) else "\\" + x) for i, x in enumerate(chars))


@_recurring
def ascii_shown(b: bytes) -> str:
    """Bytes of an IA5String, anything but printable ASCII escaped."""
    if (text := _plain(b)) is not None:
        return text
    return "".join("\\\\" if x == 0x5C else chr(x) if 0x20 <= x < 0x7F else f"\\{x:02X}" for x in b)


# --- fields ---


@der.recurring
def read_name(raw: bytes) -> tuple[Name, bool]:
    try:
        rdns = []
        for rdn in der.sequence(raw):
            pairs = [der.elements(der.body_of(p, der.SEQUENCE)) for p in der.elements(der.body_of(rdn, der.SET))]
            if not pairs or any(len(p) != 2 for p in pairs):
                raise Malformed("an RDN needs pairs of type and value")
            rdns.append([(der.oid(der.body_of(t, der.OID)), v) for t, v in pairs])
        return Name(raw, rdns), True
    except Malformed:
        return Name(raw), False


@lru_cache(4096)
def read_time(e: Element) -> datetime | None:
    form = {der.UTC_TIME: (12, "%Y%m%d%H%M%S"), der.GENERALIZED_TIME: (14, "%Y%m%d%H%M%S")}.get(e.tag)
    if not form or len(e.body) != form[0] + 1 or e.body[-1:] != b"Z" or not e.body[:-1].isdigit():
        return None
    digits = e.body[:-1].decode()
    if e.tag == der.UTC_TIME:
        digits = ("19" if digits[:2] >= "50" else "20") + digits
    try:
        parts = [int(digits[:4]), *(int(digits[i : i + 2]) for i in range(4, 14, 2))]
        return datetime(*parts)
    except ValueError:
        return None


def _serial_codes(v: bytes) -> list[str]:
    if 0 < v[0] < 0x80 and len(v) <= 20:
        return []
    tests = {
        "serial_negative": v[0] >= 0x80,
        "serial_not_minimal": len(v) > 1 and (v[0], v[1] >= 0x80) in ((0, False), (0xFF, True)),
        "serial_zero": not any(v),
        "serial_too_long": len(v) > 20,
    }
    return [code for code, found in tests.items() if found]


def _read_key(c: Certificate, raw: bytes) -> None:
    (c.key_oid, c.key_algorithm, c.key_bits, c.key_curve), codes = _key(raw)
    c.note(*codes)


@der.recurring
def _key(raw: bytes) -> tuple[tuple, list[str]]:
    """(oid, algorithm, bits, curve) of a key, and codes; a precertificate and its certificate have one key."""
    c = Certificate()
    _read_spki(c, raw)
    return (c.key_oid, c.key_algorithm, c.key_bits, c.key_curve), c.errors


def _read_spki(c: Certificate, raw: bytes) -> None:
    try:
        alg, bits = der.sequence(raw)
        parameters = der.body_of(alg, der.SEQUENCE)
        oid = der.element(parameters)
        c.key_oid = der.oid(der.body_of(oid, der.OID))
        parameters = parameters[len(oid.raw) :]
        key, unused = der.bit_string(der.body_of(bits, der.BIT_STRING))
    except (Malformed, ValueError):
        c.key_oid = None
        c.note("spki_unreadable")
        return
    if unused:
        key = (int.from_bytes(key, "big") >> unused).to_bytes(len(key), "big")
    try:
        if c.key_oid in (RSA, RSA_PSS):
            c.key_algorithm = "rsa"
            modulus = der.body_of(der.element(der.body_of(der.element(key), der.SEQUENCE)), der.INTEGER)
            if not modulus or modulus[0] >= 0x80:
                raise Malformed("modulus")
            c.key_bits = int.from_bytes(modulus, "big").bit_length()
        elif c.key_oid == EC:
            c.key_algorithm = "ecdsa"
            if len(key) > 1:
                c.key_bits = {4: (len(key) - 1) // 2 * 8, 2: (len(key) - 1) * 8, 3: (len(key) - 1) * 8}.get(key[0], 0)
            curve = der.oid(der.only(parameters, der.OID))
            c.key_curve, c.key_bits = CURVES.get(curve, (curve, c.key_bits))
        elif c.key_oid in EDWARDS:
            c.key_algorithm, bits_, size = EDWARDS[c.key_oid]
            if len(key) != size:
                raise Malformed("key size")
            c.key_bits = bits_
        elif c.key_oid == DSA:
            c.key_algorithm = "dsa"
            if parameters:
                prime = der.body_of(der.element(der.body_of(der.element(parameters), der.SEQUENCE)), der.INTEGER)
                c.key_bits = int.from_bytes(prime, "big").bit_length()
        else:
            c.key_algorithm = "other"
    except Malformed:
        c.note("key_unreadable")


def read_extension(e: Element) -> tuple[str, bool, bytes]:
    """(oid, critical, value) of one Extension."""
    return _extension_fields(der.body_of(e, der.SEQUENCE))


@der.recurring
def _extension_fields(body: bytes) -> tuple[str, bool, bytes]:
    parts = der.elements(body)
    if len(parts) not in (2, 3):
        raise Malformed("an extension has two or three fields")
    critical = der.boolean(der.body_of(parts[1], der.BOOLEAN)) if len(parts) == 3 else False
    return der.oid(der.body_of(parts[0], der.OID)), critical, der.body_of(parts[-1], der.OCTET_STRING)


def _read_san(c: Certificate, value: bytes) -> None:
    dns, ips, codes = _san(value)
    c.dns_names, c.ip_addresses = list(dns), list(ips)
    c.note(*codes)


@der.recurring
def _san(value: bytes) -> tuple[list[str], list[bytes], list[str]]:
    """(DNS names, addresses, codes) of alternative names."""
    names, codes = der.sequence(value), []
    for n in names:
        if n.tag == der.context(2) and not n.body.isascii():
            codes.append("san_dns_bad_string")
        if n.tag == der.context(7) and len(n.body) not in (4, 16):
            codes.append("san_ip_bad_len")
    return [ascii_shown(n.body) for n in names if n.tag == der.context(2)], [n.body for n in names if n.tag == der.context(7)], codes


def key_identifier(value: bytes) -> bytes | None:
    """The keyIdentifier of an authority key identifier."""
    rest = der.only(value, der.SEQUENCE)
    if rest and rest[0] == der.context(0):
        return der.element(rest).body
    return None


def _read_known(c: Certificate, oid: str, value: bytes) -> None:
    if oid not in (SAN, SKI, AKI, POISON):
        return
    readers = {
        SAN: ("san_unreadable", lambda: _read_san(c, value)),
        SKI: ("ski_unreadable", lambda: setattr(c, "subject_key_id", der.only(value, der.OCTET_STRING))),
        AKI: ("aki_unreadable", lambda: setattr(c, "authority_key_id", key_identifier(value) or b"")),
    }
    if oid == POISON:
        c.has_poison = True
        if value != b"\x05\x00":
            c.note("ext_unreadable")
    elif oid in readers:
        code, reader = readers[oid]
        try:
            reader()
        except Malformed:
            c.note(code)


def _read_extensions(c: Certificate, raw: bytes) -> None:
    try:
        wrapped = der.only(raw, der.context(3, True))
        data = der.only(wrapped, der.SEQUENCE)
    except Malformed:
        c.note("extensions_unreadable")
        return
    seen, at = set(), 0
    while at < len(data):
        try:
            e = der.element(data, at)
            if e.tag != der.SEQUENCE:
                raise Malformed("not an extension")
        except Malformed:
            c.note("extensions_unreadable")
            return
        at += len(e.raw)
        try:
            x = read_extension(e)
        except Malformed:
            c.note("ext_unreadable")
            continue
        c.extensions.append(x)
        if x[0] in seen:
            c.note("ext_duplicate")
        else:
            seen.add(x[0])
            _read_known(c, x[0], x[2])


_VERSION = der.context(0, True)
_OPTIONAL = {der.context(n, full) for n in (1, 2) for full in (False, True)} | {der.context(3, True)}


def parse(data: bytes) -> Certificate:
    """What can be read of a certificate. Never fails."""
    c = Certificate()
    try:
        outer = der.element(data)
        inner = der.element(der.body_of(outer, der.SEQUENCE))
        tbs = der.body_of(inner, der.SEQUENCE)
    except Malformed:
        c.note("cert_unreadable")
        return c
    if len(outer.raw) < len(data):
        c.note("cert_trailing_data")
    outer_algorithm = None
    try:
        algorithm, signature = der.elements(outer.body[len(inner.raw) :])
        der.body_of(algorithm, der.SEQUENCE)
        der.bit_string(der.body_of(signature, der.BIT_STRING))
        outer_algorithm = algorithm.raw
    except (Malformed, ValueError):
        c.note("signature_unreadable")

    fields: list[Element] = []
    at = 0
    while at < len(tbs):
        try:
            fields.append(der.element(tbs, at))
        except Malformed:
            if len(fields) - (bool(fields) and fields[0].tag == _VERSION) < 6:
                c.note("tbs_unreadable")
                return c
            c.note("extensions_unreadable")
            break
        at += len(fields[-1].raw)
    c.version = 1
    if fields and fields[0].tag == _VERSION:
        try:
            c.version = {0: 1, 1: 2, 2: 3}.get(der.integer(der.only(fields[0].body, der.INTEGER)), 0)
        except Malformed:
            c.version = 0
        if not c.version:
            c.note("version_bad")
        fields = fields[1:]
    optional = []
    while fields and fields[-1].tag in _OPTIONAL:
        optional.insert(0, fields.pop())
    if len(fields) < 6:
        c.version = 0
        c.note("tbs_unreadable")
        return c
    if len(fields) > 6:
        c.note("tbs_extra_fields")
    serial, algorithm, issuer, validity, subject, key = fields[:6]

    if serial.tag == der.INTEGER and serial.body:
        c.serial = serial.body
        c.note(*_serial_codes(serial.body))
    else:
        c.note("serial_unreadable")
    try:
        oid = der.oid(der.body_of(der.element(der.body_of(algorithm, der.SEQUENCE)), der.OID))
        c.signature_algorithm = SIGNATURES.get(oid, oid)
        if outer_algorithm not in (None, algorithm.raw):
            c.note("sig_alg_mismatch")
    except Malformed:
        c.note("sig_alg_unreadable")
    for which, e in (("issuer", issuer), ("subject", subject)):
        if which == "subject":
            _read_validity(c, validity)
        name, good = read_name(e.raw)
        setattr(c, which, name)
        c.note(*[f"{which}_unreadable"] * (not good), *["name_bad_string"] * (good and name.bad_strings()))
    _read_key(c, key.raw)
    if extensions := [e for e in optional if e.tag == der.context(3, True)]:
        _read_extensions(c, extensions[-1].raw)
    return c


def _read_validity(c: Certificate, e: Element) -> None:
    try:
        first, last = der.elements(der.body_of(e, der.SEQUENCE))
    except (Malformed, ValueError):
        c.note("validity_unreadable")
        return
    c.not_before, c.not_after = read_time(first), read_time(last)
    if c.not_before is None or c.not_after is None:
        c.note("time_bad_format")
