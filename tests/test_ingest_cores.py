"""An ingest keeps all cores busy, however few files and bytes its rows come from, and gives the same dataset."""

import threading

import pytest
from pyspark.sql import functions as F

from certloom.engine import Engine
from certloom.functions import certificates, der, extensions, leaf, x509
from certloom.functions.names import load_suffixes
from certloom.operators.numbering import pieces, together
from certloom.plans import ingest
from certloom.sources import footers, synthetic
from certloom.sources.dataset import Dataset

N = 400


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(0, N, 1, 1).select(
        i.alias("idx"), (i * 1000 + 1).alias("ts_ms"), (i % 2 == 0).alias("precert"), (i % 90).alias("number"), F.lit("UNIT").alias("unit"), (i % 90 % 4).cast("int").alias("team")
    )


@pytest.fixture(scope="module")
def raw(rows):
    return synthetic.raw_entries(rows, 50).localCheckpoint()


def test_one_file_of_rows_is_worked_on_by_all_cores(spark, rows, raw):
    busy = raw.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert busy >= spark.sparkContext.defaultParallelism
    made = {r["idx"]: (bytes(r["leaf_input"]), bytes(r["extra_data"])) for r in raw.collect()}
    assert made == {r["idx"]: synthetic.entry(r["ts_ms"], r["precert"], r["number"], r["unit"], r["team"], int(r["idx"] % 50 == 0)) for r in rows.collect()}


def test_one_number_with_all_rows_is_dealt_out_too(rows):
    one = synthetic.raw_entries(rows.withColumn("number", F.lit(7).cast("long")))
    assert one.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < N


def test_few_rows_are_not_torn(spark):
    df = spark.range(1)
    assert [pieces(df, n, 500) for n in (0, 1, 500, 501)] == [1, 1, 1, 2]
    assert pieces(df, 10**9, 500) == max(2 * spark.sparkContext.defaultParallelism, 4)


def test_work_side_by_side_gives_results_in_order_and_raises(spark):
    assert together(spark, lambda: spark.range(3).count(), lambda: "b") == [3, "b"]
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 / 0)


def test_parts_written_side_by_side_keep_their_bloom_filters(spark, raw, tmp_path):
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    m = e.ingest_batch(raw, "a")
    assert m["entries"] == N and e.dataset.table("entries", e.snapshot()).where(F.col("leaf_error").isNotNull()).count() == N // 50
    for table, version, columns in (("vault", None, {"sha256"}), ("certs", 1, {"sha256"}), ("names", 1, {"name", "etld1"})):
        found = footers.chunks(spark, e.dataset.store.path(e.dataset.folder(table, m, version)))
        assert {c["column"] for c in found if c["has_bloom"]} == columns


def test_a_table_without_batches_starts_no_python(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    for table in ("entries", "certs", "names"):
        df = e.dataset.table(table, e.snapshot())
        assert df.count() == 0 and "log" in df.columns
        assert "Scan ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_a_certificate_are_read_once():
    a, b = synthetic.entry(1, False, 3, "UNIT", 1)
    leaf.parts.cache_clear()
    first, again = leaf.decode(a, b), leaf.decode(a, b)
    assert first == again and leaf.parts.cache_info().hits >= 1


def test_what_recurs_in_certificates_is_read_once():
    of = lambda number: synthetic.certificate(number, "UNIT", 1)[2]
    readers = x509.read_name, x509._extension_fields, extensions._RECURRING[extensions.CRL_DPS][0]
    x509_rows = [certificates.all_rows(x509.parse(of(1)), 1, b"", "final", None, load_suffixes())]
    before = [r.cache_info().hits for r in readers]
    x509_rows.append(certificates.all_rows(x509.parse(of(2)), 1, b"", "final", None, load_suffixes()))
    assert all(r.cache_info().hits > b for r, b in zip(readers, before, strict=True))
    assert x509_rows[0]["cert_crl_dps"] == x509_rows[1]["cert_crl_dps"] and x509_rows[0]["names"] != x509_rows[1]["names"]
    long = b"x" * 2000
    kept = der.recurring(len)
    assert kept(long) == kept(long) == 2000 and kept.cache_info().currsize == 0


def test_rows_of_a_batch_become_columns():
    kind = certificates._arrow("cert_ekus")
    assert certificates._lists([[], [(1, 0, "a", None), (1, 1, "b", "c")], []], kind).to_pylist()[1][1] == {"cert_id": 1, "position": 1, "eku_oid": "b", "eku_name": "c"}
    for rows in ([], [[]], [[], []]):
        made = certificates._lists(rows, kind)
        assert made.type == kind and made.to_pylist() == rows
    with pytest.raises(ValueError):
        certificates._lists([[(1, 0, "a", None), (1, 1, "b")]], kind)


def test_the_next_batch_is_decoded_while_one_is_committed(spark, raw, tmp_path, monkeypatch):
    read = threading.Event()

    def read_entries(part, log, tiled=False, f=ingest.read_entries):
        out = f(part, log, tiled)
        if log == "b":
            read.set()
        return out

    def commit(self, m, f=Dataset.commit):
        assert read.wait(60)  # batch 2 is decoded before batch 1 is there
        f(self, m)

    monkeypatch.setattr(ingest, "read_entries", read_entries)
    monkeypatch.setattr(Dataset, "commit", commit)
    e = Engine(spark, str(tmp_path / "ds"), create=True)
    done = e.ingest_batches([(raw, "a"), (raw, "b")])
    assert [(m["commit_seq"], m["log"], m["entries"]) for m in done] == [(1, "a", N), (2, "b", N)]
    assert done[0]["tree"] == done[1]["tree"] and done[0]["counts"]["new_certs"] > 0 == done[1]["counts"]["new_certs"]
    assert e.ingest_batches([]) == []
