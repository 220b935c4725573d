"""The engine over a small log: ingest, search, paging, retrieval, exports, audit, versions, streams."""

import base64
import hashlib
import io
import json
from datetime import datetime, timedelta

import certlog as log
import pytest
from pyspark.sql import functions as F

from certloom import __main__ as command
from certloom.engine import Engine
from certloom.errors import CapError, DatasetError, NotFound, UsageError, VerificationError
from certloom.functions import leaf, merkle
from certloom.operators import stats
from certloom.operators.fetch import Fetcher
from certloom.operators.query import GROUPS, Query, parse_bar
from certloom.operators.search import checked_regex, matches
from certloom.operators.verify import content_hash
from certloom.plans import heads
from certloom.plans import rebuild as rebuilding
from certloom.plans.ingest import Head
from certloom.sources import ctlog, footers, sample, schemas, tiles
from certloom.sources.loglist import LogRegistry, find_log, read_log_list
from certloom.streaming.follow import audit, entry_sessions, entry_windows

N, STEP = 30, 20
ENTRIES = log.raw_entries(N)


def root_of(entries):
    tree = merkle.CompactRange()
    for _, a, _ in entries:
        tree.append(merkle.leaf_hash(a))
    return tree.root()


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("data") / "ds"), create=True)
    for at in range(0, 2 * N, STEP):
        part = spark.createDataFrame(ENTRIES[at : at + STEP], log.RAW)
        e.ingest_batch(part, "a", Head(at + STEP, root_of(ENTRIES[: at + STEP]), log.T0 + at))
    return e


def rows(engine, bar, group="names", **more):
    return engine.search(parse_bar(bar), group=group, **more).collect()


@pytest.mark.parametrize(
    ("bar", "group", "n"),
    [
        ("example.test", "names", 60), ("EXAMPLE.test.", "names", 60), ("exact:host1.example.test", "names", 1), ("suffix:host1.example.test", "names", 2),
        ("contains:HOST2", "names", 22), (r"regex:^host1[0-9]\.", "names", 10), ("other.test", "names", 0), ("ip:192.0.2.1", "names", 0),
        ("example.test", "certs", 60), ("example.test kind:final", "certs", 30), ('example.test issuer:"loom test ca"', "certs", 50), ("example.test log:other", "certs", 0),
        ("example.test log:a", "certs", 60), ("example.test since:2026-09-21T14:13:50Z", "certs", 30), ("example.test until:2026-09-21T14:13:50Z", "certs", 30),
        ("example.test valid-at:2026-10-15", "certs", 60), ("example.test valid-at:2020-01-01", "certs", 0), ("example.test by:not-before since:2026-10-02", "certs", 0),
        ("example.test issued-by:2", "certs", 50), ("example.test issued-by:7", "certs", 10), ("example.test key:ecdsa status:ok org:\"loom tests\"", "certs", 60),
        ("example.test wildcard", "names", 0), ("example.test", "issuances", 30),
    ],
)
def test_search_counts(engine, bar, group, n):
    assert len(rows(engine, bar, group)) == n


def test_search_values(engine):
    found = rows(engine, "exact:host1.example.test")[0]
    assert (found["certs"], found["issuers"]) == (2, [log.CA])
    assert found["last_seen"] - found["first_seen"] == timedelta(seconds=1)
    assert all(r["certs"] == 2 and r["precert"] and r["final"] for r in rows(engine, "example.test", "issuances"))
    assert [r["name"] for r in rows(engine, "example.test", sort="name asc", limit=3)] == ["host0.example.test", "host1.example.test", "host10.example.test"]
    assert len(rows(engine, "example.test", filter="HOST7.")) == 2
    assert [r.asDict() for r in rows(engine, "example.test", fields=["certs", "name"], limit=1)][0].keys() == {"certs", "name"}
    assert len(engine.search("example.test", as_of=1).collect()) == 20
    chain = rows(engine, "contains:x kind:chain", "certs")
    assert chain == []


@pytest.mark.parametrize("bar", ["host1.example.test", "test", "regex:(", r"regex:a(?=b)", "ip:300.1.1.1", 'suffix:"bad name"', "example.test issued-by:1", "example.test issued-by:zz", "example.test issued-by:999"])
def test_search_errors(engine, bar):
    with pytest.raises(UsageError):
        rows(engine, bar)


@pytest.mark.parametrize(("group", "sort"), [("names", "certs desc"), ("certs", "issuer_cn asc"), ("certs", "logs desc"), ("issuances", "first_seen desc")])
def test_pages_equal_the_whole(engine, group, sort):
    whole = [tuple(r) for r in rows(engine, "example.test", group, sort=sort)]
    paged, cursor = [], None
    while True:
        page, cursor = engine.page(Query(text="example.test", group=group, sort=sort), cursor, 17)
        paged += page
        if cursor is None:
            break
    assert paged == whole
    held = engine.hold(Query(text="example.test", group=group, sort=sort))
    assert held.total == len(whole) and held.page(0, 25) + held.page(1, 25) + held.page(2, 25) == whole
    held.close()


def test_held_results_reorder(engine):
    held = engine.hold("example.test", group="certs")
    again = held.reorder("cert_id asc", "final")
    assert again.total == 30 and [r[1] for r in again.page(0)] == sorted(r["cert_id"] for r in rows(engine, "example.test kind:final", "certs"))
    picked = [r["cert_id"] for r in held.rows([3, 4]).collect()]
    assert sorted(picked) == [3, 4]
    again.close(), held.close()


def test_retrieval(engine):
    f = Fetcher(engine.dataset, engine.snapshot())
    cert = leaf.decode(*log.pair(1)[1]).cert
    sha = hashlib.sha256(cert).hexdigest()
    row, der_ = f.fetch(sha)
    assert der_ == cert and f.fetch(row["cert_id"])[1] == cert and row["kind"] == "final"
    assert [r["name"] for r in f.names(row["cert_id"]).collect()] == ["host1.example.test", "www.host1.example.test"]
    assert [list(r["certs"]) for r in f.chains(row["cert_id"]).collect()] == [[2]]
    assert [(r["log"], r["idx"]) for r in f.entries(row["cert_id"]).collect()] == [("a", 3)]
    assert f.count_names("host1.example.test") == 2
    other = f.linked(row["cert_id"])
    assert f.row(other)["kind"] == "precert" and f.linked(other) == row["cert_id"] and f.linked(2) is None
    with pytest.raises(NotFound):
        f.row("0" * 64)
    assert engine.fetch(sha).startswith(b"-----BEGIN") and engine.fetch(sha, "der") == cert
    full = json.loads(engine.fetch(sha, "json", with_chain=True, with_entries=True))
    assert full["names"] == ["host1.example.test", "www.host1.example.test"] and full["entries"][0][1] == 3
    assert b"sha256: " + sha.encode() in engine.fetch(sha, "text")


def test_exports(engine, tmp_path):
    for form in ("csv", "md", "json"):
        path = str(tmp_path / f"out.{form}")
        meta = engine.export("example.test", path, form, sort="name asc")
        assert meta["row_count"] == 60 and meta["logs"][0]["verified_tree_size"] == 60
        with pytest.raises(FileExistsError):
            engine.export("example.test", path, form)
    text = (tmp_path / "out.csv").read_text().splitlines()
    assert text[0] == "name,first_seen,last_seen,certs,issuers" and text[1].startswith("host0.example.test,2026-09-21T14:13:20Z,")
    assert json.loads((tmp_path / "out.csv.meta.json").read_text())["query"]["text"] == "example.test"
    assert len(json.loads((tmp_path / "out.json").read_text())["rows"]) == 60
    meta = engine.export("example.test", str(tmp_path / "two.json"), "json", selection=["host0.example.test", "gone"], force=True)
    assert meta["row_count"] == 1 and meta["selection"]["values"] == ["gone", "host0.example.test"]


def test_views_take_sql(engine, spark):
    assert {"entries", "certs", "entry_certs", "logging_delay", "batches"} <= set(engine.views())
    assert spark.sql("SELECT count(*) FROM entry_certs WHERE kind = 'final'").first()[0] == 30
    assert spark.sql("SELECT count(DISTINCT e.cert_id) FROM entries e JOIN cert_scts s USING (cert_id)").first()[0] == 30
    assert spark.sql("SELECT count(*), median(logging_delay) FROM logging_delay").first()[0] == 60
    assert spark.sql("SELECT max(commit_seq) FROM batches").first()[0] == 3


def test_ingest_is_idempotent_and_strict(engine, spark):
    again = spark.createDataFrame(ENTRIES[:STEP], log.RAW)
    assert engine.ingest_batch(again, "a")["commit_seq"] == 1 and len(engine.dataset.manifests()) == 3
    for part in (ENTRIES[5:10], [(61, *ENTRIES[0][1:])], [(60, *ENTRIES[0][1:]), (60, *ENTRIES[1][1:])]):
        with pytest.raises(VerificationError):
            engine.ingest_batch(spark.createDataFrame(part, log.RAW), "a")
    with pytest.raises(VerificationError):
        engine.ingest_batch(spark.createDataFrame([(60, *ENTRIES[0][1:])], log.RAW), "a", Head(61, b"x" * 32))
    assert len(engine.dataset.manifests()) == 3


def test_verify(engine):
    found = {r["check"]: r["status"] for r in engine.verify(full=True).collect()}
    assert found.pop("kept heads are signed") == "skipped" and set(found.values()) == {"ok"} and len(found) == 10
    with pytest.raises(UsageError):
        engine.verify(as_of=9)


def test_audit_and_registry(engine):
    assert audit(engine.dataset, engine.dataset.manifests()[1]) == []
    registry = LogRegistry(engine.dataset)
    registry.add({"name": "a", "url": "https://a.test/", "kind": "rfc6962"})
    registry.add({"name": "a", "url": "https://a.test/", "kind": "rfc6962"})
    with pytest.raises(UsageError):
        registry.add({"name": "a", "url": "https://b.test/", "kind": "rfc6962"})
    assert registry.get("a")["url"] == "https://a.test/"


def test_report(engine):
    now = datetime.now() + timedelta(hours=1)
    r = engine.stats(now, heads={"a": 100}, capacity=(1e12, 1e11))
    assert r["logs"]["a"]["committed_entries"] == 60 and r["logs"]["a"]["remaining"] == 40
    assert r["vault"]["entries"] == 60 and r["vault"]["parse_status"] == {"ok": 62} and r["vault"]["delta_records"] == 30
    assert r["bytes_per_entry"] is None and r["projected_cap"][0] is None


def test_recovery_removes_unfinished_batches(engine):
    m = {"log": "a", "first": 60, "last": 61}
    engine.dataset.write(engine.spark.createDataFrame([], schemas.VAULT), "vault", m)
    assert engine.recover() == ["vault/log=a/batch=000000000060-000000000061"] and engine.recover() == []


def test_stream_equals_batches(engine, spark, tmp_path):
    """The same log through a tiled mirror and the streaming source, two micro-batches; a second log shares its certificates."""
    mirror = tmp_path / "mirror"
    tile = b""
    for _, a, b in ENTRIES:
        e = leaf.decode(a, b)
        tile += a[2:] + (log.vec(e.cert, 3) if e.entry_type == "precert" else b"")
        tile += log.vec(b"".join(hashlib.sha256(c).digest() for c in e.chain), 2)
    for name, data in {
        "checkpoint": b"log.test\n60\nx\n\n", "tile/data/000.p/60": tile,
        **{f"issuer/{hashlib.sha256(c).hexdigest()}": c for c in (log.CA_CERT, log.SIGNER_CERT)},
    }.items():
        (mirror / name).parent.mkdir(parents=True, exist_ok=True)
        (mirror / name).write_bytes(data)
    source = spark.read.format("ctlog").options(url=str(mirror), kind="tiled", partition=16).load()
    assert [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in source.orderBy("idx").collect()] == ENTRIES
    stream = spark.readStream.format("ctlog").options(url=str(mirror), kind="tiled").load()
    heads = lambda size: (Head(size, root_of(ENTRIES[:size])), None)
    q = engine.start_stream(stream, "b", str(tmp_path / "cp"), head=heads, batch_size=40)
    q.awaitTermination(300)
    tips = engine.snapshot().tips()
    assert tips["b"]["last"] == 59 and tips["b"]["tree"]["root"] == tips["a"]["tree"]["root"]
    assert tips["b"]["counts"]["new_certs"] == 0
    found = rows(engine, "example.test", "certs")
    assert len(found) == 60 and all(r["logs"] == ["a", "b"] for r in found)
    same = engine.search("example.test log:b", group="certs", fields=["cert_id"]).collect()
    assert len(same) == 60


def test_captures(spark, tmp_path):
    df = spark.createDataFrame(ENTRIES[:5], log.RAW)
    ctlog.write_capture(df, str(tmp_path / "cap"))
    assert sorted(map(tuple, ctlog.read_capture(spark, str(tmp_path / "cap")).collect())) == sorted(map(tuple, df.collect()))


def test_log_list(spark, tmp_path):
    text = {
        "version": "1", "operators": [
            {"name": "Op", "logs": [{"description": "Op 'Alpha2027'", "log_id": "x", "key": "k", "url": "https://ct.op.test/alpha/", "mmd": 1, "state": {"usable": {"timestamp": "t"}}}],
             "tiled_logs": [{"description": "tiled", "log_id": "y", "key": "k", "submission_url": "https://beta2027h1.op.test/", "monitoring_url": "https://m.op.test/", "mmd": 1, "state": {"readonly": {"timestamp": "t"}}}]},
        ],
    }
    (tmp_path / "list.json").write_text(json.dumps(text))
    logs = read_log_list(spark, str(tmp_path / "list.json"))
    assert [(r["name"], r["kind"], r["state"]) for r in logs.collect()] == [("alpha2027", "rfc6962", "usable"), ("beta2027h1", "tiled", "readonly")]
    assert find_log(logs, "Alpha2027")["operator"] == "Op"
    with pytest.raises(NotFound):
        find_log(logs, "nope")


def test_statistics_numbers(spark):
    """30 batches of 1000 entries, one every 20 minutes."""
    t0 = datetime(2026, 10, 4)
    rows_ = [
        (i + 1, "a", 1000 * i, 1000 * i + 999, t0 + timedelta(minutes=20 * i), 1000, 900, 300, 600000, 150000, 40, 2, 1000 * (i + 1) + 5000, t0 + timedelta(minutes=20 * i), {"ok": 899, "partial": 1})
        for i in range(30)
    ]
    b = spark.createDataFrame(rows_, stats.BATCH)
    now = t0 + timedelta(minutes=20 * 29)
    assert stats.ingest_rate(b, now).first()[0] == pytest.approx(29000 / 34800)
    assert stats.limited_ratio(b, now, ["log"]).first()["ratio"] == 0.05
    assert stats.growth_rate(b, now).first()[0] == pytest.approx(29000 / 34800)
    assert tuple(stats.bytes_per_entry(b).first()) == (20, 600, 150, 750)
    assert stats.bytes_per_entry(b.limit(4)).first() is None
    assert stats.ingest_rate(b.limit(2), now).first()[0] is None
    assert {r["status"]: r["n"] for r in stats.parse_statuses(b).collect()} == {"ok": 26970, "partial": 30}
    assert stats.p95(b.limit(10), "entries", 840.0).first()[0] == 840 and stats.p95(b, "commit_seq", 0.0).first()[0] == 29
    assert stats.projected_cap(now, 7.5e6, 750, 20000, 10, 1)[0] == now + timedelta(seconds=1000)
    assert stats.projected_cap(now, 7.5e6, 750, 5000, 10, 1)[0] == now + timedelta(seconds=500 + 5000)
    assert stats.projected_cap(now, 0, 750, 1, 1, 1)[1] == "the limit is reached" and stats.projected_cap(now, 1, None, 1, 1, 1)[0] is None
    assert stats.peak_bytes(10**30, 840, 265) == 2**64 - 1


def test_groups_have_their_columns(engine):
    for group, g in GROUPS.items():
        assert engine.search(Query(text="example.test", group=group)).columns == list(g.columns)


def test_samples_are_stable(spark):
    df = spark.range(4000).withColumn("k", F.col("id").cast("string"))
    assert stats.hash_sample(df, "k").count() == stats.hash_sample(df.repartition(7), "k").count() and 150 < stats.hash_sample(df, "k").count() < 350
    assert stats.reservoir(df, 10, 3).count() == 10


def test_footers_and_canary(engine):
    m = engine.dataset.manifests()[0]
    footers.canary(engine.dataset, m, "certs", 1, ("sha256",), engine.dataset.table("certs", engine.snapshot(), [m]).select("cert_id", "sha256").limit(3))
    folder = engine.dataset.store.path(engine.dataset.folder("names", m, 1))
    with_bloom = {c["column"] for c in footers.chunks(engine.spark, folder) if c["has_bloom"]}
    assert with_bloom == {"name", "etld1"} and {c["codec"] for c in footers.chunks(engine.spark, folder)} == {"ZSTD"}
    assert all("org.apache.spark.version" in kv for kv in footers.key_values(engine.spark, folder).values())
    with pytest.raises(VerificationError):
        footers.canary(engine.dataset, m, "certs", 1, ("issuer_cn",))


def test_event_time_windows(engine):
    entries = engine.dataset.table("entries", engine.snapshot()).where("log = 'a'")
    assert sum(r["entries"] for r in entry_windows(entries, "10 seconds").collect()) == 60
    assert [r["entries"] for r in entry_sessions(entries, "5 seconds").collect()] == [60]


def test_wrong_heads_stop_the_stream(engine, spark, tmp_path):
    spark.createDataFrame(ENTRIES[:4], log.RAW).coalesce(1).write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema(log.RAW).parquet(str(tmp_path / "raw"))
    q = engine.start_stream(stream, "c", str(tmp_path / "cp"), head=lambda size: (Head(size, b"x" * 32), None))
    with pytest.raises(Exception, match="signed tree"):
        q.awaitTermination(120)
    assert "c" not in engine.snapshot().tips() and engine.dataset.store.names("incidents")


def test_command_line(engine, spark, tmp_path):
    def call(*args):
        out = io.BytesIO()
        command.run(spark, command.parser().parse_args([engine.dataset.root, *args]), out)
        return out.getvalue().decode()

    table = call("search", "exact:host1.example.test", "--fields", "name,certs").splitlines()
    assert table == ["NAME                CERTS", "host1.example.test  2"]
    assert json.loads(call("search", "example.test", "--format", "csv", "--export", str(tmp_path / "x.csv")))["row_count"] == 60
    assert call("fetch", "2").startswith("-----BEGIN") and "FAIL" not in call("verify")
    assert {r["status"] for r in json.loads(call("verify", "--json"))} == {"ok"}
    assert call("explore", "exact:host1.example.test", "--size", "5").splitlines()[-1] == "1 row"
    assert "ext_duplicate (certificate)" in call("explain-error", "ext_duplicate")
    assert json.loads(call("stats"))["logs"]["a"]["committed_entries"] == 60
    with pytest.raises(UsageError):
        call("search", "nope:1")


def test_content_hash(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "x"), (2, None, "x")], "a int, b string, c string")
    moved = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (2, None, "x")], "a int, b string, c string")
    assert content_hash(df) == content_hash(df.orderBy(F.desc("a")).repartition(3)) != content_hash(moved)
    assert content_hash(df).startswith("3:") and content_hash(df.limit(0)) == "0:0" and content_hash(df.distinct()) != content_hash(df)


def test_store_replaces_and_refuses(engine):
    store = engine.dataset.store
    store.write("notes/x", "one")
    with pytest.raises(FileExistsError):
        store.write("notes/x", "two")
    assert store.read("notes/x") == "one"
    store.write("notes/x", "three", overwrite=True)
    assert store.read("notes/x") == "three" and [n for n in store.names("notes") if not n.endswith(".crc")] == ["x"]
    store.delete("notes")


def test_tasks_share_the_rate():
    for start, end, tasks in ((0, 5000, 4), (100, 300, 4), (250, 260, 4), (0, 100_000, 7), (10, 9000, 1)):
        parts = ctlog.ranges(start, end, end, 256, tasks)
        assert len(parts) <= tasks and parts[0].start == start and parts[-1].end == end and {p.share for p in parts} == {len(parts)}
        assert all(a.end == b.start and b.start % 256 == 0 for a, b in zip(parts, parts[1:], strict=False))


# --- signed heads ---


class TiledLog:
    """A tiled log in a folder, with a key from the JVM."""

    def __init__(self, spark, folder):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        maker = self.jvm.java.security.KeyPairGenerator.getInstance("EC")
        maker.initialize(256)
        self.pair = maker.generateKeyPair()
        spec = self.jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
        self.key = bytes(self.jvm.java.security.KeyFactory.getInstance("EC").getKeySpec(self.pair.getPublic(), spec).getEncoded())
        self.id = hashlib.sha256(self.key).digest()

    def write(self, name, data):
        (self.folder / name).parent.mkdir(parents=True, exist_ok=True)
        (self.folder / name).write_bytes(data)

    def publish(self, entries, size=None, at=log.T0, root=None, key_bytes=None):
        """Data and hash tiles of the entries, and a checkpoint of a size, by default of all."""
        size = len(entries) if size is None else size
        for n in range(-(-len(entries) // 256)):
            data = b""
            part = entries[256 * n : 256 * n + 256]
            for _, a, b in part:
                e = leaf.decode(a, b)
                data += a[2:] + (log.vec(e.cert, 3) if e.entry_type == "precert" else b"")
                data += log.vec(b"".join(hashlib.sha256(c).digest() for c in e.chain), 2)
            self.write(tiles.data_path(n, len(part)), data)
            self.write(tiles.tile_path(0, n, len(part)), b"".join(merkle.leaf_hash(a) for _, a, _ in part))
        for c in (log.CA_CERT, log.SIGNER_CERT):
            self.write(tiles.issuer_path(hashlib.sha256(c).digest()), c)
        head = tiles.SignedHead(size, at, root or root_of(entries[:size]), b"")
        signer = self.jvm.java.security.Signature.getInstance("SHA256withECDSA")
        signer.initSign(self.pair.getPrivate())
        signer.update(bytearray(tiles.signed_bytes(head)))
        made = bytes(signer.sign())
        raw = tiles.key_id("log.test", self.id) + at.to_bytes(8, "big") + b"\x04\x03" + len(made).to_bytes(2, "big") + made
        text = f"log.test\n{size}\n{base64.b64encode(head.root).decode()}\n\n— log.test {base64.b64encode(raw).decode()}\n"
        self.write("checkpoint", text.encode())

    def pinned(self):
        return {"name": "t", "kind": "tiled", "url": str(self.folder), "submission_url": "https://log.test/", "log_id": base64.b64encode(self.id).decode(), "key": base64.b64encode(self.key).decode(), "operator": "Op"}


def test_update_commits_only_what_a_signed_head_proves(spark, tmp_path):
    e, served = Engine(spark, str(tmp_path / "ds"), create=True), TiledLog(spark, tmp_path / "log")
    with pytest.raises(UsageError):
        e.update("t")
    e.logs.add(served.pinned())
    served.publish(ENTRIES[:14])
    out = io.BytesIO()
    command.run(spark, command.parser().parse_args([e.dataset.root, "update", "t"]), out)
    assert e.snapshot().tips()["t"]["head"]["size"] == 14 and e.dataset.store.read_json("health.json") == {"audits": 1, "last_commit": 1, "failures": []}
    served.publish(ENTRIES[:24], at=log.T0 + 1)
    e.update("t", until=20).awaitTermination()
    tip = e.snapshot().tips()["t"]
    assert (tip["last"], tip["head"]["size"], tip["tree"]["size"]) == (19, 24, 20)
    assert {r["check"]: r["status"] for r in e.verify(full=True).collect()}["kept heads are signed"] == "ok"
    forked = [*ENTRIES[:3], (3, *ENTRIES[5][1:]), *ENTRIES[4:30]]
    before = len(e.dataset.store.names("incidents"))
    for publish, problem in (
        (lambda: served.publish(forked, at=log.T0 + 2), "does not extend"),
        (lambda: served.publish(ENTRIES[:24], size=22, at=log.T0 + 2), "shrank"),
        (lambda: served.publish(ENTRIES[:24], at=log.T0 - 5), "older"),
        (lambda: served.publish(ENTRIES[:24], root=b"r" * 32, at=log.T0 + 2), "root"),
    ):
        publish()
        with pytest.raises(VerificationError, match=problem):
            e.update("t")
    other = TiledLog(spark, tmp_path / "log")
    other.id = served.id
    other.publish(ENTRIES[:26], at=log.T0 + 3)
    with pytest.raises(VerificationError, match="signature"):
        e.update("t")
    assert len(e.dataset.store.names("incidents")) >= before + 5 and e.snapshot().tips()["t"]["last"] == 19
    with pytest.raises(UsageError):
        e.update("t", url="https://elsewhere.test/")


def test_samples(spark, tmp_path):
    served = TiledLog(spark, tmp_path / "log")
    served.publish(ENTRIES[:44])
    options, small = {"url": str(tmp_path / "log"), "kind": "tiled"}, {"boundary": 10, "least": 10, "most": 40}
    folder = sample.capture(spark, str(tmp_path / "samples"), "t", options, "canonical", 40, 0, served.pinned(), **small)
    assert folder.endswith("t/000000000000-000000000039")
    raw = sample.load(spark, folder)
    assert sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in raw.collect()) == ENTRIES[:40]
    with pytest.raises(FileExistsError):
        sample.capture(spark, str(tmp_path / "samples"), "t", options, "canonical", 40, 0, served.pinned(), **small)
    for kind, start, count in (("canonical", 10, 20), ("canonical", 0, 15), ("representative", 5, 10), ("canonical", 0, 50), ("other", 0, 10), ("canonical", None, 10)):
        with pytest.raises(UsageError):
            sample.capture(spark, str(tmp_path / "more"), "t", options, kind, count, start, served.pinned(), **small)
    assert sample.start_at_head(44, 20, 10) == 20
    report = sample.measure(raw)
    assert report["entries"] == 40 and report["links"]["finals"] == report["links"]["linked"] == 20 and report["links"]["p50"] == 1000
    assert report["leaf_certificates"]["hits"] == 0 and report["chain_certificates"]["unique"] == 2 and report["leaf_errors"] == []
    assert sum(g["records"] for g in report["compression"]) == 40 and all(0 < g["ratio"] for g in report["compression"])
    out = io.BytesIO()
    Engine(spark, str(tmp_path / "ds"), create=True)
    command.run(spark, command.parser().parse_args([str(tmp_path / "ds"), "sample", "verify", folder]), out)
    assert out.getvalue() == b"40 entries verified\n"
    manifest = json.loads((tmp_path / "samples/t/000000000000-000000000039/sample.json").read_text())
    other = TiledLog(spark, tmp_path / "fork")
    other.publish([*ENTRIES[:7], (7, *ENTRIES[3][1:]), *ENTRIES[8:44]])
    with pytest.raises(VerificationError):
        forked = served.pinned() | {"key": None}
        (tmp_path / "fork" / "checkpoint").write_bytes((tmp_path / "log" / "checkpoint").read_bytes())
        sample.capture(spark, str(tmp_path / "bad"), "t", {"url": str(tmp_path / "fork"), "kind": "tiled"}, "canonical", 40, 0, forked, **small)
    assert manifest["content"].startswith("40:") and not (tmp_path / "bad/t/000000000000-000000000039/sample.json").exists()


def test_the_tree_left_of_a_leaf():
    leaves = [merkle.leaf_hash(str(i).encode()) for i in range(40)]

    def path(index, low, high):
        if high - low == 1:
            return []
        k = 1 << (high - low - 1).bit_length() - 1
        sub = lambda a, b: merkle_root(leaves[a:b])
        return [*path(index, low, low + k), sub(low + k, high)] if index < low + k else [*path(index, low + k, high), sub(low, low + k)]

    def merkle_root(part):
        tree = merkle.CompactRange()
        for x in part:
            tree.append(x)
        return tree.root()

    for size in (1, 2, 7, 8, 33, 40):
        for index in range(size):
            tree = sample.left_of(leaves[index], index, size, path(index, 0, size), merkle_root(leaves[:size]))
            assert tree.root() == merkle_root(leaves[:index])


def test_proofs_from_tiles():
    leaves = [merkle.leaf_hash(str(i).encode()) for i in range(700)]
    roots, tree = [merkle.CompactRange().root()], merkle.CompactRange()
    for x in leaves:
        tree.append(x)
        roots.append(tree.root())

    def served(size):
        level, out = leaves[:size], {}
        for number in range(3):
            for n in range(-(-len(level) // 256)):
                part = level[256 * n : 256 * n + 256]
                out[f"x/{tiles.tile_path(number, n, len(part))}"] = b"".join(part)
            whole = [level[i : i + 256] for i in range(0, len(level) - 255, 256)]
            level = []
            for row in whole:
                while len(row) > 1:
                    row = [merkle.node_hash(a, b) for a, b in zip(row[::2], row[1::2], strict=True)]
                level += row
        return ctlog.Tiled("x", lambda url: out[url], size)

    for second in (1, 2, 7, 255, 256, 257, 300, 512, 513, 700):
        source = served(second)
        hashes = heads.HashTiles(source, second)
        assert hashes.root(0, second) == roots[second]
        for first in {1, 2, 3, 64, 200, 255, 256, 257, 299, 511, 512, 640, second - 1, second}:
            if 0 < first <= second:
                proof = heads.consistency(source, first, second)
                assert merkle.verify_consistency(first, second, roots[first], roots[second], proof)
                assert first == second or not merkle.verify_consistency(first, second, roots[first - 1], roots[second], proof)


def test_heads_of_a_plain_log(engine):
    answers = {"get-sth": {"tree_size": 9, "timestamp": 5, "sha256_root_hash": base64.b64encode(b"r" * 32).decode(), "tree_head_signature": ""}}
    source = ctlog.Rfc6962("https://x.test", lambda url: json.dumps(answers[url.rsplit("/", 1)[1].split("?")[0]]).encode())
    answers["get-sth-consistency"] = {"consistency": []}
    h = heads.Heads(engine.dataset, "plain", source)
    assert h.newest().size == 9 and heads.kept_head(engine.dataset, "plain").root == b"r" * 32
    with pytest.raises(VerificationError):
        h(10)
    answers["get-sth"]["tree_size"] = 12
    with pytest.raises(VerificationError, match="extend"):
        h.newest()


REGEX = ["a" * 40 + "!", "été.example.test", "www.example.test", "x", "alph:", "", None, "a\rb"]


@pytest.mark.parametrize(
    ("pattern", "hits"),
    [(r"^\p{L}+\.", {1, 2}), (r"(?P<a>x)$", {3}), (r"^[[:alpha:]]+$", {3}), (r"(a+)+$", set()), (r"^www\.", {2}), (r"(?i)WWW", {2}), (r"^a.b$", {7}), (r"\Qh:\E", {4}), (r"(www|été)\.e", {1, 2}), (r"x{1,2}", {1, 2, 3})],
)
def test_regex_dialect(spark, pattern, hits):
    df = spark.createDataFrame(list(enumerate(REGEX)), "i int, name string")
    assert {r["i"] for r in df.where(matches(F.col("name"), pattern)).collect()} == hits


@pytest.mark.parametrize("pattern", ["a(?=b)", "a++", r"\1", "(", "(?>a)", "[[:nope:]]", r"\p{Nope}", "(?<=a)b"])
def test_regex_refusals(pattern):
    with pytest.raises(UsageError):
        checked_regex(pattern)


def test_room():
    stats.require_room(100, 50, 30)
    for args in ((100, 50, 36), (0, 0, 0), (100, 0, 1, 0.99)):
        with pytest.raises(CapError):
            stats.require_room(*args)


def test_versions(engine, monkeypatch):
    monkeypatch.setitem(schemas.DERIVED, ("cert_aia", 2), schemas.DERIVED["cert_aia", 1])
    with pytest.raises(DatasetError):
        rebuilding.begin_version(engine.dataset, "cert_aia", 9)
    n = len(engine.dataset.manifests())
    assert engine.rebuild("cert_aia", 2, batches=2) == n - 2 and engine.snapshot().active["cert_aia"] == 1
    assert {"cert_aia", "cert_aia_building"} <= set(engine.views())
    assert engine.rebuild("cert_aia", 2) == 0
    assert engine.snapshot().active["cert_aia"] == 2 and engine.dataset.versions()["cert_aia"]["retiring"] == 1
    assert engine.gc() == []
    assert rebuilding.collect_garbage(engine.dataset, now=4e9) == ["cert_aia.p1"]
    monkeypatch.setitem(schemas.DERIVED, ("cert_scts", 2), schemas.DERIVED["cert_scts", 1])
    scts = engine.dataset.table("cert_scts", engine.snapshot()).count()
    assert engine.rebuild("cert_scts", 2, in_place=True, batches=1) == n - 1
    with pytest.raises(DatasetError, match="in place"):
        engine.snapshot()
    mixed = engine.snapshot(allow_mixed=True)
    assert engine.dataset.table("cert_scts", mixed).count() == scts and "cert_scts" not in engine.views()
    assert engine.spark.table("cert_scts_building").count() + engine.spark.table("cert_scts_previous").count() == scts
    assert engine.rebuild("cert_scts", 2) == 0 and engine.dataset.versions()["cert_scts"] == {"active": 2}
    assert engine.dataset.table("cert_scts", engine.snapshot()).count() == scts and not engine.dataset.store.exists(engine.dataset.folder("cert_scts", engine.dataset.manifests()[0], 1))
    engine.repair("names", 2)
    assert len(rows(engine, "example.test")) == 60
    m = engine.dataset.manifests()[1]
    folder = engine.dataset.store.path(engine.dataset.folder("names", m, 1))
    engine.spark.createDataFrame([], schemas.ddl_of("names")).write.mode("overwrite").parquet(folder)
    failed = {r["check"] for r in engine.verify(full=True).collect() if r["status"] == "FAIL"}
    assert {"files are as committed", "checksums are as committed", "derived tables match their certificates"} <= failed
    engine.repair("names", 2)
    assert "FAIL" not in {r["status"] for r in engine.verify(full=True).collect()}
    with pytest.raises(VerificationError):
        rebuilding.repair(engine.dataset, "names", m, expected="1:2")
