"""Batches that go through the same jobs give the dataset that they give one by one."""

import pytest
from pyspark.sql import functions as F

from certloom import log_queries
from certloom.engine import Engine
from certloom.errors import VerificationError
from certloom.functions import certificates, entries, x509
from certloom.functions.names import load_suffixes
from certloom.plans import ingest
from certloom.queries import Tables
from certloom.sources import synthetic

SMALL = "/root/testdata/sf0.001"


def _raw(spark, low, high):
    i = F.col("id")
    rows = spark.range(low, high, 1, 1).select(
        i.alias("idx"), (i * 1000 + 1).alias("ts_ms"), (i % 3 == 0).alias("precert"), (i % 40).alias("number"), F.lit("UNIT").alias("unit"), (i % 40 % 4).cast("int").alias("team")
    )
    return synthetic.raw_entries(rows, 50)


@pytest.fixture(scope="module")
def batches(spark):
    # the last one brings no certificate that is new
    return [(_raw(spark, *at).localCheckpoint(), log) for log, *at in (("a", 0, 60), ("b", 0, 90), ("a", 60, 130), ("c", 0, 30))]


def _rows(e, table):
    df = e.dataset.table(table, e.snapshot())
    return sorted((str(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in df.select(sorted(df.columns)).collect()))


def test_batches_together_are_parsed_once_and_equal_those_one_by_one(spark, batches, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(ingest, "built", lambda certs, f=ingest.built: calls.append(1) or f(certs))
    both, alone = (Engine(spark, str(tmp_path / n), create=True) for n in ("both", "alone"))
    made = both.ingest_batches(batches)
    assert len(calls) == 1
    known = [alone.ingest_batch(raw, log) for raw, log in batches]
    for m, k in zip(made, known, strict=True):
        for field in ("commit_seq", "log", "first", "last", "entries", "cert_id_range", "counts", "parse_status", "tree", "derived"):
            assert m[field] == k[field], field
        assert {t: (f["rows"], f["content"]) for t, f in m["files"].items()} == {t: (f["rows"], f["content"]) for t, f in k["files"].items()}
    assert made[3]["counts"]["new_certs"] == 0 < made[0]["counts"]["delta"]
    for table in ("entries", "chains", "vault", "quarantine", "certs", "names"):
        assert _rows(both, table) == _rows(alone, table), table
    assert {r["status"] for r in both.verify(full=True).collect()} <= {"ok", "skipped"}
    assert both.ingest_batches(batches[1:3]) == both.dataset.manifests()[1:3]


def test_batches_before_a_wrong_one_are_committed(spark, batches, tmp_path):
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    with pytest.raises(VerificationError):
        e.ingest_batches([batches[0], (batches[2][0], "b"), batches[3]])
    assert [(m["log"], m["entries"]) for m in e.dataset.manifests()] == [("a", 60)]


def test_bytes_that_recur_are_only_on_the_first_entry(batches):
    rows = entries.hashed(batches[0][0].withColumn("log", F.lit("a")).coalesce(1).orderBy(F.desc("idx"))).collect()
    whole = {r["idx"]: r for r in entries.decoded(batches[0][0].withColumn("log", F.lit("a"))).collect()}
    for key, value in (("sha256", "cert"), ("chain_id", "chain")):
        for k in {r[key] for r in rows} - {None}:
            same = [r for r in rows if r[key] == k]
            least = min(r["idx"] for r in same)
            assert {r["idx"] for r in same if r[value] is not None} >= {least}
            assert {str(whole[r["idx"]][value]) for r in same} == {str(whole[least][value])}
    assert sum(r["cert"] is not None for r in rows) < sum(r["cert"] is not None for r in whole.values())


def test_a_capture_needs_no_dataset(spark, monkeypatch):
    monkeypatch.setattr(log_queries, "engine", None)
    t = Tables(spark, SMALL)
    assert log_queries.log_captures(t).count() == t.orders.where(F.col("o_orderkey") % 2 == 0).count()


def test_a_precertificate_lies_beside_its_certificate_and_shares_its_parts(spark):
    rows = [(i, bytes([i]) * 32, bytes([i % 7]) * 16) for i in range(14)] + [(20, b"a" * 32, None), (21, b"b" * 32, None)]
    dealt = ingest.side_by_side(spark.createDataFrame(rows, "cert_id long, sha256 binary, issuance_key binary"), 3)
    parts = dealt.select("cert_id", "issuance_key", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["cert_id"] for r in parts) == sorted(r[0] for r in rows)
    for p in {r["p"] for r in parts}:
        keys = [r["issuance_key"] for r in parts if r["p"] == p and r["issuance_key"]]
        assert keys[::2] == keys[1::2]
    _, pre, final = synthetic.certificate(12, "UNIT", 3)
    readers = x509._key, x509._san, certificates._names
    of = lambda der: certificates.all_rows(x509.parse(der), 1, b"", "final", None, load_suffixes())
    first, before = of(pre), [r.cache_info().hits for r in readers]
    second = of(final)
    assert all(r.cache_info().hits > b for r, b in zip(readers, before, strict=True))
    assert first["names"] == second["names"] and first["names"] and first["certs"] != second["certs"]
