"""Parquet footers through the JVM's reader, wherever the files lie: statistics, bloom filters, key-value metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.errors import VerificationError
from certloom.sources.dataset import Dataset
from certloom.sources.schemas import columns, ddl_of


def files(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files directly in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))


def chunks(spark: SparkSession, folder: str) -> list[dict]:
    """One entry for each column of each row group: file, group, column, values, nulls, codec, has_bloom, bytes."""
    jvm, out = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in files(spark, folder):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            for group, block in enumerate(reader.getFooter().getBlocks()):
                for c in block.getColumns():
                    stats = c.getStatistics()
                    out.append({
                        "file": name, "group": group, "column": c.getPath().toDotString(), "values": c.getValueCount(),
                        "nulls": stats.getNumNulls() if stats is not None and stats.isNumNullsSet() else None, "codec": str(c.getCodec()),
                        "has_bloom": c.getBloomFilterOffset() > 0, "bytes": c.getTotalSize(),
                    })
        finally:
            reader.close()
    return out


def key_values(spark: SparkSession, folder: str) -> dict[str, dict[str, str]]:
    """The key-value metadata of each file."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name in files(spark, folder):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            out[name] = dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
        finally:
            reader.close()
    return out


def canary(dataset: Dataset, m: dict, table: str, version: int | None = None, bloom: tuple[str, ...] = (), sample: DataFrame | None = None) -> None:
    """Probes a written part of a table: declared columns, rows by the footers, bloom filters, ids in range, and a sample read back."""
    folder = dataset.store.path(dataset.folder(table, m, version))
    rows = dataset.spark.read.parquet(folder)
    declared = columns(ddl_of(table, version))
    if rows.dtypes != [(n, t) for n, t in declared]:
        raise VerificationError(f"{folder}: columns {rows.dtypes} where {declared} are declared")
    found = chunks(dataset.spark, folder)
    if sum(c["values"] for c in found if c["column"] == declared[0][0]) != m["files"][table]["rows"]:
        raise VerificationError(f"{folder}: not the rows committed")
    for column in bloom:
        if any(c["column"] == column and c["values"] and not c["has_bloom"] for c in found):
            raise VerificationError(f"{folder}: no bloom filter on {column}")
    if table in ("certs", "names", "vault") and m["files"][table]["rows"]:
        low, high = rows.agg(F.min("cert_id"), F.max("cert_id")).first()
        if not m["cert_id_range"] or low < m["cert_id_range"][0] or high > m["cert_id_range"][1]:
            raise VerificationError(f"{folder}: certificate ids out of range")
    if sample is not None and not sample.exceptAll(rows.select(sample.columns)).isEmpty():
        raise VerificationError(f"{folder}: a sampled row is not there")
