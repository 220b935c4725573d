"""Decoders of seven extensions: the whole value or nothing."""

from __future__ import annotations

from datetime import datetime, timedelta

from certloom.functions import der
from certloom.functions.der import Malformed
from certloom.functions.x509 import SCT_LIST, Certificate, ascii_shown

# Object identifiers and short names.
POLICIES, EKU, KEY_USAGE, BASIC_CONSTRAINTS, AIA, CRL_DPS = "2.5.29.32", "2.5.29.37", "2.5.29.15", "2.5.29.19", "1.3.6.1.5.5.7.1.1", "2.5.29.31"
VALIDATION = {"2.23.140.1.1": "ev", "2.23.140.1.2.1": "dv", "2.23.140.1.2.2": "ov", "2.23.140.1.2.3": "iv"}
PURPOSES = {
    "1.3.6.1.5.5.7.3.1": "server_auth", "1.3.6.1.5.5.7.3.2": "client_auth", "1.3.6.1.5.5.7.3.3": "code_signing",
    "1.3.6.1.5.5.7.3.4": "email_protection", "1.3.6.1.5.5.7.3.8": "time_stamping", "1.3.6.1.5.5.7.3.9": "ocsp_signing",
    "2.5.29.37.0": "any", "1.3.6.1.4.1.11129.2.4.4": "precert_signing",
}
METHODS = {"1.3.6.1.5.5.7.48.1": "ocsp", "1.3.6.1.5.5.7.48.2": "ca_issuers"}
CPS = "1.3.6.1.5.5.7.2.1"
USAGES = (
    "digital_signature", "content_commitment", "key_encipherment", "data_encipherment", "key_agreement",
    "key_cert_sign", "crl_sign", "encipher_only", "decipher_only",
)
URI = der.context(6)
#: GeneralName's tags: otherName, rfc822, dNS, x400, directory, ediParty, URI, IP, registeredID.
GENERAL_NAMES = {der.context(n, full) for n, full in ((0, True), (1, False), (2, False), (3, True), (4, True), (5, True), (6, False), (7, False), (8, False))}


def _oid(e: der.Element) -> str:
    return der.oid(der.body_of(e, der.OID), widest=None)


def policies(value: bytes) -> list[tuple]:
    """(policy_oid, validation, cps_uri, n_qualifiers)."""
    out = []
    for info in der.sequence(value):
        parts = der.elements(der.body_of(info, der.SEQUENCE))
        if len(parts) not in (1, 2):
            raise Malformed("policy")
        uris, n = [], 0
        for q in der.elements(der.body_of(parts[1], der.SEQUENCE)) if len(parts) == 2 else []:
            kind, text = _two(der.elements(der.body_of(q, der.SEQUENCE)))
            n += 1
            if _oid(kind) == CPS:
                uris.append(ascii_shown(der.body_of(text, der.IA5)))
        oid = _oid(parts[0])
        out.append((oid, VALIDATION.get(oid), uris[0] if uris else None, n))
    return out


def _two(parts: list[der.Element]) -> list[der.Element]:
    if len(parts) != 2:
        raise Malformed("two elements expected")
    return parts


def purposes(value: bytes) -> list[tuple]:
    """(eku_oid, eku_name)."""
    oids = [_oid(e) for e in der.sequence(value)]
    return [(o, PURPOSES.get(o)) for o in oids]


def key_usage(value: bytes) -> list[bool]:
    """The nine named bits."""
    data, unused = der.bit_string(der.only(value, der.BIT_STRING))
    bits = "".join(f"{b:08b}" for b in data)
    bits = bits[: len(bits) - unused].ljust(len(USAGES), "0")
    return [b == "1" for b in bits[: len(USAGES)]]


def basic_constraints(value: bytes) -> tuple[bool, int | None]:
    parts = der.sequence(value)
    ca, length = False, None
    if parts and parts[0].tag == der.BOOLEAN:
        ca = der.boolean(parts.pop(0).body)
    if parts:
        length = der.integer(der.body_of(parts.pop(0), der.INTEGER))
        if not 0 <= length <= 0xFFFF or parts:
            raise Malformed("path length")
    return ca, length


def access(value: bytes) -> list[tuple]:
    """(method, uri)."""
    out = []
    for d in der.sequence(value):
        method, where = _two(der.elements(der.body_of(d, der.SEQUENCE)))
        oid = _oid(method)
        if where.tag not in GENERAL_NAMES:
            raise Malformed("access location")
        out.append((METHODS.get(oid, oid), ascii_shown(where.body) if where.tag == URI else None))
    return out


def distribution_points(value: bytes) -> list[tuple[list[str], bool, bool]]:
    """(uris, has_reasons, has_crl_issuer) of each point."""
    out = []
    order = [der.context(0, True), der.context(1), der.context(2, True)]
    for point in der.sequence(value):
        parts = der.elements(der.body_of(point, der.SEQUENCE))
        tags = [p.tag for p in parts]
        if tags != [t for t in order if t in tags]:
            raise Malformed("distribution point")
        uris: list[str] = []
        if order[0] in tags:
            names = der.elements(parts[0].body)
            if len(names) != 1 or names[0].tag not in (der.context(0, True), der.context(1, True)):
                raise Malformed("distribution point name")
            for n in der.elements(names[0].body) if names[0].tag == der.context(0, True) else []:
                if n.tag not in GENERAL_NAMES:
                    raise Malformed("full name")
                uris += [ascii_shown(n.body)] if n.tag == URI else []
        out.append((uris, order[1] in tags, order[2] in tags))
    return out


#: The last time that a column holds, in milliseconds; a later one is null.
LAST_TIME = 253402300799999


def timestamps(value: bytes) -> list[tuple]:
    """(version, log_id, timestamp, hash_alg, sig_alg); of versions but 0 only the version."""
    data = der.only(value, der.OCTET_STRING)
    if len(data) < 2 or len(data) - 2 != int.from_bytes(data[:2], "big"):
        raise Malformed("SCT list")
    out, at = [], 2
    while at < len(data):
        end = at + 2 + int.from_bytes(data[at : at + 2], "big")
        sct = data[at + 2 : end]
        if len(data) < max(end, at + 3) or not sct:
            raise Malformed("SCT")
        at = end
        if sct[0]:
            out.append((sct[0], None, None, None, None))
            continue
        ext = 43 + int.from_bytes(sct[41:43], "big")
        if len(sct) < ext + 4 or len(sct) != ext + 4 + int.from_bytes(sct[ext + 2 : ext + 4], "big"):
            raise Malformed("SCT fields")
        ms = int.from_bytes(sct[33:41], "big")
        when = datetime(1970, 1, 1) + timedelta(milliseconds=ms) if ms <= LAST_TIME else None
        out.append((0, sct[1:33].hex(), when, sct[ext], sct[ext + 1]))
    return out


DECODERS = {
    POLICIES: (policies, "ext_policies_malformed"),
    EKU: (purposes, "ext_eku_malformed"),
    KEY_USAGE: (key_usage, "ext_key_usage_malformed"),
    BASIC_CONSTRAINTS: (basic_constraints, "ext_basic_constraints_malformed"),
    AIA: (access, "ext_aia_malformed"),
    CRL_DPS: (distribution_points, "ext_crl_dps_malformed"),
    SCT_LIST: (timestamps, "ext_sct_list_malformed"),
}
_RECURRING = {oid: (der.recurring(reader, 1024), code) for oid, (reader, code) in DECODERS.items()}


def decode(oid: str, value: bytes) -> tuple[object, str | None]:
    """(decoded value or None, code or None) of an extension of a decoded kind."""
    reader, code = _RECURRING[oid]
    try:
        return reader(value), None
    except Malformed:
        return None, code


def rows(c: Certificate) -> dict[str, list[tuple]]:
    """The rows of the seven extension tables, without cert_id."""
    out: dict[str, list[tuple]] = {t: [] for t in ("cert_extensions", "cert_policies", "cert_ekus", "cert_key_usage", "cert_aia", "cert_crl_dps", "cert_scts")}
    values: dict[str, object] = {}
    for at, (oid, critical, value) in enumerate(c.extensions):
        code = None
        if oid in DECODERS:
            if oid in values:
                code = "ext_duplicate"
            else:
                values[oid], code = decode(oid, value)
        out["cert_extensions"].append((at, oid, critical, len(value), code))
    for name, oid in (("cert_policies", POLICIES), ("cert_ekus", EKU), ("cert_aia", AIA), ("cert_scts", SCT_LIST)):
        out[name] = [(at, *r) for at, r in enumerate(values.get(oid) or [])]
    usage, constraints = values.get(KEY_USAGE), values.get(BASIC_CONSTRAINTS)
    if usage is not None or constraints is not None:
        out["cert_key_usage"] = [(*(usage or [None] * len(USAGES)), *(constraints or (None, None)))]
    out["cert_crl_dps"] = [(at, uri, r, i) for at, (uris, r, i) in enumerate(values.get(CRL_DPS) or []) for uri in uris or [None]]
    return out
