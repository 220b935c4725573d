"""Certificates and log entries built from parts, for tests. Keys and signatures are dummies."""

import hashlib

from certloom.functions import der, x509
from certloom.functions.der import make, make_oid

T0 = 1790000000000
SHA256_ECDSA = make(der.SEQUENCE, make_oid("1.2.840.10045.4.3.2"))
DAY = 86400


def name(cn, org=None):
    rdn = lambda oid, v: make(der.SET, make(der.SEQUENCE, make_oid(oid), make(der.UTF8, v.encode())))
    return make(der.SEQUENCE, *([rdn("2.5.4.10", org)] if org else []), rdn("2.5.4.3", cn))


def key(seed):
    point = b"\x04" + hashlib.sha512(seed.encode()).digest()
    return make(der.SEQUENCE, make(der.SEQUENCE, make_oid("1.2.840.10045.2.1"), make_oid("1.2.840.10045.3.1.7")), make(der.BIT_STRING, b"\x00", point))


def key_id(seed):
    return hashlib.sha1(key(seed)).digest()


def extension(oid, value, critical=False):
    return make(der.SEQUENCE, make_oid(oid), make(der.BOOLEAN, b"\xff") if critical else b"", make(der.OCTET_STRING, value))


def san(dns=(), ips=()):
    return extension(x509.SAN, make(der.SEQUENCE, *(make(der.context(2), d.encode()) for d in dns), *(make(der.context(7), i) for i in ips)))


def aki(seed):
    return extension(x509.AKI, make(der.SEQUENCE, make(der.context(0), key_id(seed))))


def ski(seed):
    return extension(x509.SKI, make(der.OCTET_STRING, key_id(seed)))


POISON = extension(x509.POISON, b"\x05\x00", True)


def scts():
    sct = b"\x00" + b"\x11" * 32 + T0.to_bytes(8, "big") + b"\x00\x00" + b"\x04\x03" + b"\x00\x02ab"
    listed = len(sct).to_bytes(2, "big") + sct
    return extension(x509.SCT_LIST, make(der.OCTET_STRING, len(listed).to_bytes(2, "big") + listed))


def tbs(serial, issuer, subject, spki, extensions, not_before="261001000000Z", not_after="261230000000Z", alg=SHA256_ECDSA, version=2):
    times = make(der.SEQUENCE, *(make(der.UTC_TIME, t.encode()) for t in (not_before, not_after)))
    v = make(der.context(0, True), make(der.INTEGER, bytes([version])))
    exts = make(der.context(3, True), make(der.SEQUENCE, *extensions)) if extensions else b""
    return make(der.SEQUENCE, v, make(der.INTEGER, serial), alg, issuer, times, subject, spki, exts)


def signed(body, alg=SHA256_ECDSA):
    return make(der.SEQUENCE, body, alg, make(der.BIT_STRING, b"\x00sig"))


CA, SIGNER = "Loom Test CA", "Loom Test Precert Signer"
CA_NAME = name(CA, "Loom Tests")
CA_CERT = signed(tbs(b"\x01", CA_NAME, CA_NAME, key("ca"), [ski("ca"), extension("2.5.29.19", make(der.SEQUENCE, make(der.BOOLEAN, b"\xff")), True)]))
SIGNER_NAME = name(SIGNER, "Loom Tests")
SIGNER_CERT = signed(tbs(b"\x02", CA_NAME, SIGNER_NAME, key("signer"), [ski("signer"), aki("ca"), extension(x509.EKU, make(der.SEQUENCE, make_oid(x509.PRECERT_SIGNING)))]))


def u(n, width):
    return n.to_bytes(width, "big")


def vec(data, width):
    return u(len(data), width) + data


def chain_bytes(chain):
    return vec(b"".join(vec(c, 3) for c in chain), 3)


def x509_leaf(cert, ts, ext=b""):
    return b"\x00\x00" + u(ts, 8) + u(0, 2) + vec(cert, 3) + vec(ext, 2)


def precert_leaf(ikh, body, ts, ext=b""):
    return b"\x00\x00" + u(ts, 8) + u(1, 2) + ikh + vec(body, 3) + vec(ext, 2)


def pair(i):
    """(precert entry, final entry), each (leaf_input, extra_data), of host i."""
    cn = f"host{i}.example.test"
    common = [
        san([cn, "www." + cn]),
        extension("2.5.29.15", make(der.BIT_STRING, b"\x07\x80"), True),
        extension("2.5.29.37", make(der.SEQUENCE, make_oid("1.3.6.1.5.5.7.3.1"))),
    ]
    serial, by_signer = u(1000 + i, 2), i % 3 == 2
    plain = lambda *more: tbs(serial, CA_NAME, name(cn), key(cn), [*common, aki("ca"), *more])
    logged = plain()
    if by_signer:
        pre = signed(tbs(serial, SIGNER_NAME, name(cn), key(cn), [*common, aki("signer"), POISON]))
        chain = [SIGNER_CERT, CA_CERT]
    else:
        pre, chain = signed(plain(POISON)), [CA_CERT]
    final = signed(plain(scts()))
    ikh = hashlib.sha256(key("ca")).digest()
    return (
        (precert_leaf(ikh, logged, T0 + 2000 * i), vec(pre, 3) + chain_bytes(chain)),
        (x509_leaf(final, T0 + 2000 * i + 1000), chain_bytes([CA_CERT])),
    )


def raw_entries(n_pairs):
    return [(2 * i + k, *e) for i in range(n_pairs) for k, e in enumerate(pair(i))]


RAW = "idx long, leaf_input binary, extra_data binary"
