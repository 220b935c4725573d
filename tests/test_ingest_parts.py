"""Batches of one table go through one decoding, where their entries are made, and give the dataset that they give one by one."""

import hashlib

import pytest
from pyspark.sql import functions as F

from certloom.engine import Engine
from certloom.errors import UsageError, VerificationError
from certloom.functions import entries, leaf
from certloom.plans import ingest
from certloom.sources import synthetic

PARTS = [("a", 0, 60), ("b", 0, 90), ("a", 60, 130), ("c", 0, 30)]


def _rows(spark, parts=PARTS):
    i, out = F.col("id"), None
    for p, (_, low, high) in enumerate(parts):
        some = spark.range(low, high, 1, 1).select(
            i.alias("idx"), (i * 1000 + 1).alias("ts_ms"), (i % 3 == 0).alias("precert"), (i % 40).alias("number"), F.lit("UNIT").alias("unit"),
            (i % 40 % 4).cast("int").alias("team"), F.lit(p).alias("part"),
        )
        out = out.unionByName(some) if out else some
    return out


def _made(spark, parts=PARTS):
    return synthetic.made_entries(_rows(spark, parts), 50)


def _table(e, table):
    df = e.dataset.table(table, e.snapshot())
    return sorted((str(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in df.select(sorted(df.columns)).collect()))


def _same(some, others):
    for m, k in zip(some, others, strict=True):
        for field in ("commit_seq", "log", "first", "last", "entries", "cert_id_range", "counts", "parse_status", "tree", "derived"):
            assert m[field] == k[field], field
        assert {t: (f["rows"], f["content"]) for t, f in m["files"].items()} == {t: (f["rows"], f["content"]) for t, f in k["files"].items()}


@pytest.fixture(scope="module")
def alone(spark, tmp_path_factory):
    """The dataset of the batches one by one."""
    e = Engine(spark, str(tmp_path_factory.mktemp("alone") / "ds"), create=True)
    for p, (log, _, _) in enumerate(PARTS):
        e.ingest_batch(synthetic.raw_entries(_rows(spark).where(F.col("part") == p), 50), log)
    return e


def test_parts_are_decoded_once_where_they_are_made(spark, alone, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(ingest, "hashed", lambda raw, *a, f=ingest.hashed: calls.append(1) or f(raw, *a))
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    _same(e.ingest_parts(_made(spark), [log for log, _, _ in PARTS]), alone.dataset.manifests())
    assert len(calls) == 1
    for table in ("entries", "chains", "vault", "quarantine", "certs", "names"):
        assert _table(e, table) == _table(alone, table), table
    assert {r["status"] for r in e.verify(full=True).collect()} <= {"ok", "skipped"}
    plan = entries.hashed(_made(spark).withColumn("log", F.lit("a")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_parts_that_are_known_leave_the_others_whole(spark, alone, tmp_path):
    """A certificate's bytes are with its first entry, which may be of a batch that was committed before."""
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    e.ingest_parts(_made(spark, PARTS[:1]), ["a"])
    _same(e.ingest_parts(_made(spark), [log for log, _, _ in PARTS]), alone.dataset.manifests())
    for table in ("entries", "vault", "certs"):
        assert _table(e, table) == _table(alone, table), table


def test_more_parts_than_go_together(spark, alone, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "TOGETHER", 3)
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    raw = _made(spark).withColumn("log", F.lit("?"))
    rows, make = raw.rows, raw.make
    table = rows.mapInArrow(lambda batches: (b for x in batches for b in make(x)), synthetic.RAW + ", part int, log string")
    _same(e.ingest_parts(table, [log for log, _, _ in PARTS]), alone.dataset.manifests())
    assert _table(e, "entries") == _table(alone, "entries")


def test_wrong_parts(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    with pytest.raises(UsageError):  # rows of a part that no log has are not left out
        e.ingest_parts(_made(spark), ["a", "b"])
    assert e.dataset.manifests() == []
    with pytest.raises(VerificationError):
        e.ingest_parts(_made(spark), ["a", "b", "b", "c"])
    assert [(m["log"], m["entries"]) for m in e.dataset.manifests()] == [("a", 60), ("b", 90)]


def test_an_entry_that_recurs_is_decoded_once(monkeypatch):
    calls = []
    monkeypatch.setattr(leaf, "decode", lambda *a, f=leaf.decode: calls.append(1) or f(*a))
    leaf._timeless.cache_clear()
    for precert in (True, False):
        calls.clear()
        for ts in (5, 6, 2**64 - 1):
            raw = synthetic.entry(ts, precert, 77, "UNIT", 3)
            e = leaf.decode_kept(*raw)
            assert (e.timestamp, e.leaf_hash) == (ts, hashlib.sha256(b"\0" + raw[0]).digest())
        assert len(calls) == 1


def test_kept_decodings_are_those_of_the_entry():
    for precert in (True, False):
        raw, extra = synthetic.entry(1234, precert, 77, "UNIT", 3)
        cut = [(raw[:n], extra) for n in (0, 1, 2, 9, 10, 11, 12, 13, 44, 60, len(raw) - 1)] + [(raw, extra[:n]) for n in (0, 2, 9, len(extra) - 1)]
        odd = [(b"\1" + raw[1:], extra), (raw[:1] + b"\1" + raw[2:], extra), (raw[:10] + b"\0\7" + raw[12:], extra), (raw + b"x", extra), (raw, extra + b"x")]
        flipped = [(raw[:50] + bytes([raw[50] ^ 1]) + raw[51:], extra), (raw + bytes(leaf.WIDEST), extra)]
        for args in [(raw, extra), *cut, *odd, *flipped]:
            for _ in range(2):
                assert vars(leaf.decode_kept(*args)) == vars(leaf.decode(*args)), args
