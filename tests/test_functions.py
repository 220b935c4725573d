import hashlib
import random
from datetime import datetime

import certlog as log
import pytest

from certloom.errors import UsageError, VerificationError
from certloom.functions import codes, der, extensions, leaf, merkle, names, x509
from certloom.functions.der import make, make_oid
from certloom.functions.when import format_when, parse_when
from certloom.operators.query import Query, parse_bar
from certloom.sources import ctlog, tiles
from certloom.sources.loglist import log_name, origin

PSL = names.PublicSuffixes(["com", "uk", "co.uk", "*.ck", "!www.ck", "example", "blogspot.com", "// note", ""])


@pytest.mark.parametrize(
    ("raw", "name", "valid", "wild", "tld", "etld1"),
    [
        ("WWW.Example.COM.", "www.example.com", True, False, "com", "example.com"),
        ("*.example.co.uk", "*.example.co.uk", True, True, "co.uk", "example.co.uk"),
        ("foo_bar.example.com", "foo_bar.example.com", True, False, "com", "example.com"),
        ("com", "com", True, False, "com", None),
        ("localhost", "localhost", True, False, "localhost", None),
        ("a.b.blogspot.com", "a.b.blogspot.com", True, False, "blogspot.com", "b.blogspot.com"),
        ("www.ck", "www.ck", True, False, "ck", "www.ck"),
        ("a.b.ck", "a.b.ck", True, False, "b.ck", "a.b.ck"),
        ("x.unlisted", "x.unlisted", True, False, "unlisted", "x.unlisted"),
        ("a..b.example", "a..b.example", False, False, None, None),
        ("x" * 64 + ".com", "x" * 64 + ".com", False, False, None, None),
        ("*.*.example.com", "*.*.example.com", False, False, None, None),
        ("bad\\FFname.com", "bad\\FFname.com", False, False, None, None),
        ("a b.com", "a b.com", False, False, None, None),
        ("*", "*", False, False, None, None),
    ],
)
def test_dns_names(raw, name, valid, wild, tld, etld1):
    assert next(names.name_rows([raw], [], [], PSL)) == ("san_dns", name, valid, wild, tld, etld1)


def test_name_rows_order_and_repeats():
    rows = list(names.name_rows(["a.com", "a.com"], [b"\x01\x02\x03\x04", b"\x00" * 10 + b"\xff\xff\xc0\x00\x02\x01", b"12345"], ["a.com", "Plain Name", "192.0.2.7", "B.COM."], PSL))
    assert [r[:2] for r in rows] == [
        ("san_dns", "a.com"), ("san_dns", "a.com"), ("san_ip", "1.2.3.4"), ("san_ip", "::ffff:192.0.2.1"), ("san_ip", "3132333435"),
        ("cn", "Plain Name"), ("cn", "192.0.2.7"), ("cn", "b.com"),
    ]


def test_normalised_column_equals_function(spark):
    from pyspark.sql import functions as F

    texts = ["WWW.Example.COM.", "*.a.b", "*.*.a", "a..b", "x\\y", "", ".", "É.com", "a" * 254, "*."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.normalised(F.col("t")).alias("n")).collect()
    assert {r["t"]: tuple(r["n"]) for r in rows} == {t: names.normalise(t) for t in texts}


def cert(**more):
    fields = dict(serial=b"\x05", issuer=log.CA_NAME, subject=log.name("a.test"), spki=log.key("k"), extensions=[log.san(["a.test"])]) | more
    return log.signed(log.tbs(**fields))


def test_well_formed_certificate():
    c = x509.parse(cert(extensions=[log.san(["a.test", "*.b.test"], [b"\x7f\x00\x00\x01"]), log.ski("k"), log.aki("ca")]))
    assert (c.status, c.errors, c.version, c.serial) == ("ok", [], 3, b"\x05")
    assert (c.key_algorithm, c.key_bits, c.key_curve, c.signature_algorithm) == ("ecdsa", 256, "P-256", "ecdsa-with-SHA256")
    assert c.dns_names == ["a.test", "*.b.test"] and c.ip_addresses == [b"\x7f\x00\x00\x01"]
    assert (c.not_before, c.not_after) == (datetime(2026, 10, 1), datetime(2026, 12, 30))
    assert str(c.issuer) == f"CN={log.CA},O=Loom Tests"
    assert (c.subject_key_id, c.authority_key_id) == (log.key_id("k"), log.key_id("ca"))


MALFORMED = {
    "cert_unreadable": b"\x04\x01x",
    "cert_trailing_data": cert() + b"\x00",
    "signature_unreadable": make(der.SEQUENCE, log.tbs(b"\x05", log.CA_NAME, log.name("a"), log.key("k"), []), log.SHA256_ECDSA),
    "tbs_unreadable": make(der.SEQUENCE, make(der.SEQUENCE, make(der.INTEGER, b"\x01"))),
    "version_bad": cert(version=7),
    "serial_negative": cert(serial=b"\x80"),
    "serial_zero": cert(serial=b"\x00"),
    "serial_not_minimal": cert(serial=b"\x00\x01"),
    "serial_too_long": cert(serial=b"\x01" * 21),
    "serial_unreadable": cert(serial=b""),
    "sig_alg_mismatch": log.signed(log.tbs(b"\x05", log.CA_NAME, log.name("a"), log.key("k"), []), make(der.SEQUENCE, make_oid("1.3.101.112"))),
    "issuer_unreadable": cert(issuer=make(der.SEQUENCE, b"\x31\x00")),
    "subject_unreadable": cert(subject=make(der.SET)),
    "name_bad_string": cert(subject=make(der.SEQUENCE, make(der.SET, make(der.SEQUENCE, make_oid("2.5.4.3"), make(der.UTF8, b"a\xff"))))),
    "time_bad_format": cert(not_before="261301000000Z"),
    "spki_unreadable": cert(spki=make(der.SEQUENCE)),
    "key_unreadable": cert(spki=make(der.SEQUENCE, make(der.SEQUENCE, make_oid(x509.RSA)), make(der.BIT_STRING, b"\x00\x01"))),
    "ext_unreadable": cert(extensions=[make(der.SEQUENCE, make_oid(x509.SAN))]),
    "extensions_unreadable": cert(extensions=[b"\x04\x01x"]),
    "ext_duplicate": cert(extensions=[log.ski("a"), log.ski("b")]),
    "san_unreadable": cert(extensions=[log.extension(x509.SAN, b"\x30\x05x")]),
    "san_ip_bad_len": cert(extensions=[log.san([], [b"123"])]),
    "san_dns_bad_string": cert(extensions=[log.extension(x509.SAN, make(der.SEQUENCE, make(der.context(2), b"\xe9.test")))]),
    "aki_unreadable": cert(extensions=[log.extension(x509.AKI, b"\x04\x00")]),
    "ski_unreadable": cert(extensions=[log.extension(x509.SKI, b"\x30\x00")]),
}


@pytest.mark.parametrize("code", MALFORMED)
def test_malformed_certificate(code):
    c = x509.parse(MALFORMED[code])
    assert code in c.errors and code in codes.CERTIFICATE
    assert c.status == ("failed" if code in ("cert_unreadable", "tbs_unreadable") else "partial")


def test_parser_never_fails():
    rng, whole = random.Random(7), cert(extensions=[log.san(["a.test"]), log.aki("ca"), log.scts()])
    for _ in range(2000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randint(0, len(data))] if rng.random() < 0.2 else data)
        c = x509.parse(data)
        extensions.rows(c)
        assert set(c.errors) <= set(codes.CERTIFICATE)
        leaf.decode(data, data)


def test_name_rendering():
    attr = lambda oid, tag, v: make(der.SEQUENCE, make_oid(oid), make(tag, v))
    raw = make(
        der.SEQUENCE,
        make(der.SET, attr("2.5.4.6", der.PRINTABLE, b"DE")),
        make(der.SET, attr("2.5.4.10", der.BMP, "Ä, \\".encode("utf-16-be")), attr("1.2.3", der.INTEGER, b"\x05")),
        make(der.SET, attr("2.5.4.3", der.UTF8, b" a#\x01 ")),
    )
    n, good = x509.read_name(raw)
    assert good and str(n) == "CN=\\ a#\\01\\ ,O=Ä\\, \\\\+1.2.3=#020105,C=DE"
    assert n.values("2.5.4.10") == ["Ä, \\\\"] and n.values("1.2.3") == ["#020105"]


EXTENSIONS = {
    extensions.POLICIES: (make(der.SEQUENCE, make(der.SEQUENCE, make_oid("2.23.140.1.2.1"), make(der.SEQUENCE, make(der.SEQUENCE, make_oid(extensions.CPS), make(der.IA5, b"http://c"))))), [("2.23.140.1.2.1", "dv", "http://c", 1)]),
    extensions.EKU: (make(der.SEQUENCE, make_oid("1.3.6.1.5.5.7.3.1"), make_oid("1.2.3")), [("1.3.6.1.5.5.7.3.1", "server_auth"), ("1.2.3", None)]),
    extensions.KEY_USAGE: (make(der.BIT_STRING, b"\x07\x00\x80"), [False] * 8 + [True]),
    extensions.BASIC_CONSTRAINTS: (make(der.SEQUENCE, make(der.BOOLEAN, b"\xff"), make(der.INTEGER, b"\x02")), (True, 2)),
    extensions.AIA: (make(der.SEQUENCE, make(der.SEQUENCE, make_oid("1.3.6.1.5.5.7.48.1"), make(extensions.URI, b"http://o"))), [("ocsp", "http://o")]),
    extensions.CRL_DPS: (make(der.SEQUENCE, make(der.SEQUENCE, make(der.context(0, True), make(der.context(0, True), make(extensions.URI, b"http://r")))), make(der.SEQUENCE)), [(["http://r"], False, False), ([], False, False)]),
}


@pytest.mark.parametrize("oid", EXTENSIONS)
def test_extension_decoders(oid):
    value, expected = EXTENSIONS[oid]
    assert extensions.decode(oid, value) == (expected, None)
    for bad in (b"", value + b"\x00", value[:-1], make(der.SET, value)):
        assert extensions.decode(oid, bad) == (None, extensions.DECODERS[oid][1])


def test_extension_rows():
    usage = log.extension(extensions.KEY_USAGE, EXTENSIONS[extensions.KEY_USAGE][0], True)
    c = x509.parse(cert(extensions=[usage, usage, log.scts(), log.extension(extensions.CRL_DPS, EXTENSIONS[extensions.CRL_DPS][0])]))
    rows = extensions.rows(c)
    assert [r[4] for r in rows["cert_extensions"]] == [None, "ext_duplicate", None, None]
    assert rows["cert_key_usage"] == [(*[False] * 8, True, None, None)]
    assert rows["cert_crl_dps"] == [(0, "http://r", False, False), (1, None, False, False)]
    assert rows["cert_scts"] == [(0, 0, "11" * 32, datetime(2026, 9, 21, 14, 13, 20), 4, 3)]


def test_entries_link_and_check():
    for i in range(4):
        pre, final = (leaf.decode(*e) for e in log.pair(i))
        assert (pre.code, final.code) == (None, None)
        assert pre.entry_type == "precert" and final.entry_type == "x509" and pre.issuance_key == final.issuance_key
        assert len(pre.chain) == (2 if i % 3 == 2 else 1)


def test_entry_codes():
    (pl, pe), (fl, fe) = log.pair(0)
    flip = lambda data, at: data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    cases = {
        "leaf_bad_version": (b"\x01" + fl[1:], fe),
        "leaf_bad_leaf_type": (b"\x00\x01" + fl[2:], fe),
        "leaf_unknown_entry_type": (fl[:10] + b"\x00\x09" + fl[12:], fe),
        "leaf_truncated": (fl[:-3], fe),
        "leaf_trailing_bytes": (fl + b"\x00", fe),
        "extra_truncated": (fl, fe[:-1]),
        "extra_trailing_bytes": (fl, fe + b"\x00"),
        "chain_cert_empty": (fl, log.chain_bytes([b""])),
        "chain_issuer_missing": (pl, log.vec(leaf.decode(pl, pe).cert, 3) + log.chain_bytes([])),
        "issuer_key_hash_mismatch": (flip(pl, 12), pe),
        "precert_tbs_mismatch": (flip(pl, len(pl) - 5), pe),
        "issuance_key_unavailable": (log.x509_leaf(b"\x30\x00", 1), fe),
    }
    for code, (a, b) in cases.items():
        assert leaf.decode(a, b).code == code, code
    assert all(leaf.decode(*cases[c]).cert is None for c in codes.NO_CERTIFICATE)


def test_leaf_index_extension():
    c = leaf.decode(*log.pair(0)[1]).cert
    for ext, good in ((b"\x00\x00\x05" + (7).to_bytes(5, "big"), True), (b"", False), (b"\x00\x00\x05" + (8).to_bytes(5, "big"), False), (b"\x00\x00\x01\x07", False)):
        e = leaf.decode(log.x509_leaf(c, 1, ext), log.chain_bytes([]))
        leaf.check_leaf_index(e, 7)
        assert e.code == (None if good else "leaf_index_mismatch")


def tree_root(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return merkle.node_hash(tree_root(leaves[:k]), tree_root(leaves[k:]))


def consistency_proof(m, leaves, whole=True):
    n = len(leaves)
    if m == n:
        return [] if whole else [tree_root(leaves)]
    k = 1 << (n - 1).bit_length() - 1
    if m <= k:
        return [*consistency_proof(m, leaves[:k], whole), tree_root(leaves[k:])]
    return [*consistency_proof(m - k, leaves[k:], False), tree_root(leaves[:k])]


def inclusion_proof(i, leaves):
    if len(leaves) == 1:
        return []
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return [*inclusion_proof(i, leaves[:k]), tree_root(leaves[k:])] if i < k else [*inclusion_proof(i - k, leaves[k:]), tree_root(leaves[:k])]


def test_merkle_proofs():
    leaves = [merkle.leaf_hash(bytes([i])) for i in range(21)]
    range_ = merkle.CompactRange()
    for n in range(1, 22):
        range_.append(leaves[n - 1])
        assert range_.root() == tree_root(leaves[:n])
        assert merkle.CompactRange.from_json(range_.to_json()).root() == range_.root()
        for m in range(1, n + 1):
            proof = consistency_proof(m, leaves[:n])
            assert merkle.verify_consistency(m, n, tree_root(leaves[:m]), tree_root(leaves[:n]), proof)
            assert not merkle.verify_consistency(m, n, tree_root(leaves[:m]), b"x" * 32, proof)
        for i in range(n):
            proof = inclusion_proof(i, leaves[:n])
            assert merkle.verify_inclusion(leaves[i], i, n, proof, tree_root(leaves[:n]))
            assert not merkle.verify_inclusion(leaves[i], i, n, [*proof, b"x" * 32], tree_root(leaves[:n]))
    assert merkle.CompactRange().root() == hashlib.sha256(b"").digest()


def test_merkle_root_of_dataframe(spark):
    n = 5000
    leaves = [merkle.leaf_hash(str(i).encode()) for i in range(n)]
    df = spark.createDataFrame(list(enumerate(leaves)), "idx long, hash binary")
    assert merkle.merkle_root(df, n) == tree_root(leaves)
    roots = {r["idx"]: bytes(r["hash"]) for r in merkle.subtree_roots(df, 3).collect()}
    assert roots == {i: tree_root(leaves[8 * i : 8 * i + 8]) for i in range(n // 8)}


@pytest.mark.parametrize("text", ["2026", "2026-03", "2026-03-04", "2026-03-04T05:06:07Z", "2026-03-04T05:06:07.25+02:00"])
def test_times(text):
    assert parse_when(format_when(parse_when(text))) == parse_when(text)


@pytest.mark.parametrize("text", ["", "26", "2026-13", "2026-02-30", "yesterday", "2026-03-04T05:06:07"])
def test_bad_times(text):
    with pytest.raises(UsageError):
        parse_when(text)


@pytest.mark.parametrize(
    "bar",
    [
        "example.test", "suffix:a.example.test", 'exact:"a b"', "ip:2001:db8::1", 'contains:"x:y"', 'regex:"^a\\\\.b"', '"wildcard"',
        'example.test issuer:"Loom CA" org:Tests issued-by:12 key:rsa kind:precert,final status:ok valid-at:2026-10-15 wildcard log:a since:2026-01-01 until:2026-02-01T01:02:03.5Z by:not-before',
    ],
)
def test_bar_round_trip(bar):
    q = parse_bar(bar)
    assert parse_bar(q.bar()) == q


def test_bar_values():
    q = parse_bar('contains:"a \\" b\\\\c" KIND:" final , chain" issuer-org:x')
    assert (q.mode, q.text, q.kinds, q.issuer_org) == ("contains", 'a " b\\c', ["final", "chain"], "x")
    assert parse_bar("ip:2001:db8::1").text == "2001:db8::1"


@pytest.mark.parametrize("bar", ["", "a.test b.test", "wildcard", 'exact:"open', 'exact:"a"b', "a.test nope:1", "a.test by:x", "a.test since:x", "exact:"])
def test_bar_errors(bar):
    with pytest.raises(UsageError):
        parse_bar(bar)


@pytest.mark.parametrize("bad", [dict(group="x"), dict(kinds=["x"]), dict(parse_status="x"), dict(sort="x"), dict(sort="name up"), dict(fields=["x"]), dict(limit=-1), dict(mode="x")])
def test_query_validation(bad):
    with pytest.raises(UsageError):
        Query(text="a.test", **bad).checked()


def test_log_names():
    assert log_name("Some 'Wyvern2027h1' log", "https://x.test/") == "wyvern2027h1"
    assert log_name("plain", "https://ct.test/2027/Argon2027h1/") == "argon2027h1"
    assert log_name("plain", "https://tusk2028h1.ct.test/") == "tusk2028h1"
    assert log_name("plain", "https://ct.example.test/bogus/") == "ct-example-test-bogus"
    assert origin("https://ct.test/2027/") == "ct.test/2027"
    with pytest.raises(UsageError):
        origin("ct.test")


def test_tiles():
    assert tiles.index_path(1234067) == "x001/x234/067" and tiles.data_path(5, 17) == "tile/data/005.p/17"
    assert [tiles.tile_width(0, n, 700) for n in range(4)] == [256, 256, 188, 0] and tiles.tile_width(1, 0, 700) == 2
    (pl, pe), (fl, fe) = log.pair(2)
    pre, final = leaf.decode(pl, pe), leaf.decode(fl, fe)
    print_ = lambda c: hashlib.sha256(c).digest()
    prints = lambda e: log.vec(b"".join(map(print_, e.chain)), 2)
    tile = pl[2:] + log.vec(pre.cert, 3) + prints(pre) + fl[2:] + prints(final)
    entries = tiles.parse_data_tile(tile, 2)
    issuers = {print_(c): c for c in (log.CA_CERT, log.SIGNER_CERT)}
    assert [(e.leaf_input(), e.extra_data(issuers.get)) for e in entries] == [(pl, pe), (fl, fe)]
    for bad, n in ((tile, 1), (tile, 3), (tile[:-1], 2), (tile + b"x", 2)):
        with pytest.raises(tiles.MalformedTile):
            tiles.parse_data_tile(bad, n)


def checkpoint(name="log.test/a", size=5, root=b"r" * 32, log_id=b"i" * 32, extra=b""):
    import base64

    body = tiles.key_id(name, log_id) + (1234).to_bytes(8, "big") + b"\x04\x03\x00\x02ab" + extra
    return f"{name}\n{size}\n{base64.b64encode(root).decode()}\n\n— {name} {base64.b64encode(body).decode()}\n".encode()


def test_checkpoints():
    head = tiles.parse_checkpoint(checkpoint(), "log.test/a", b"i" * 32)
    assert (head.size, head.timestamp, head.root) == (5, 1234, b"r" * 32)
    for bad in (b"", checkpoint().replace(b"5\n", b"05\n"), checkpoint(extra=b"x"), checkpoint()[:-1], checkpoint().replace(b"\n\n", b"\nmore\n\n")):
        with pytest.raises(tiles.MalformedNote):
            tiles.parse_checkpoint(bad, "log.test/a", b"i" * 32)
    for name, log_id in (("other", b"i" * 32), ("log.test/a", b"j" * 32)):
        with pytest.raises(VerificationError):
            tiles.parse_checkpoint(checkpoint(), name, log_id)


def test_head_signature(spark):
    jvm = spark.sparkContext._jvm
    pairs = jvm.java.security.KeyPairGenerator.getInstance("EC")
    pairs.initialize(256)
    pair = pairs.generateKeyPair()
    head = tiles.SignedHead(9, 77, b"r" * 32, b"")
    signer = jvm.java.security.Signature.getInstance("SHA256withECDSA")
    signer.initSign(pair.getPrivate())
    signer.update(bytearray(tiles.signed_bytes(head)))
    raw = bytes(signer.sign())
    head.signature = b"\x04\x03" + len(raw).to_bytes(2, "big") + raw
    kind = jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
    key = bytes(jvm.java.security.KeyFactory.getInstance("EC").getKeySpec(pair.getPublic(), kind).getEncoded())
    tiles.verify_head(spark, head, key)
    head.size = 10
    with pytest.raises(VerificationError):
        tiles.verify_head(spark, head, key)
    with pytest.raises(VerificationError):
        tiles.check_heads(head, tiles.SignedHead(9, 78, b"r" * 32, b""))


def test_retries_and_pace():
    now, waits, calls = [0.0], [], []
    sleep = lambda s: (waits.append(s), now.__setitem__(0, now[0] + s))
    pacer = ctlog.Pacer(10, lambda: now[0], sleep)

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise ctlog.Refused(5)
        return b"ok"

    assert ctlog.get_retried(get, "u", 5, pacer, sleep) == b"ok" and len(calls) == 3
    assert max(waits) >= 5
    pacer.refused(), pacer.refused()
    assert pacer.rate == 5
    with pytest.raises(FileNotFoundError):
        ctlog.get_retried(lambda _: (_ for _ in ()).throw(FileNotFoundError()), "u", 5, pacer, sleep)
    assert [(r.start, r.end) for r in ctlog.ranges(5, 30, 30, 10)] == [(5, 10), (10, 20), (20, 30)]


def test_codes_are_frozen():
    assert [len(f) for f in (codes.ENTRY, codes.CERTIFICATE, codes.EXTENSION)] == [14, 28, 8]
    assert {f for f, _ in codes.explain("ext_duplicate")} == {"certificate", "extension"} and codes.explain("nope") == []


def test_numbers_as_text():
    from certloom.functions.text import human_bytes, plural

    assert [plural(n, "row") for n in (0, 1, 12345)] == ["0 rows", "1 row", "12,345 rows"] and plural(2, "entry", "entries") == "2 entries"
    assert [human_bytes(n) for n in (0, 999, 1536, 12_900_000, 512 * 2**30)] == ["0 B", "999 B", "1.50 KiB", "12.3 MiB", "512 GiB"]
