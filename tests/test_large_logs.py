"""What a log's size must not take from the memory of the driver or of a task."""

import re

import pytest
from pyspark.sql import functions as F

from certloom import log_queries
from certloom.operators.numbering import ROW_GROUP, discard, stored
from certloom.queries import Tables
from certloom.sources import dataset, footers

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "query",
    [
        log_queries.log_extensions, log_queries.log_authorities, log_queries.log_names, log_queries.log_purposes, log_queries.log_scts, log_queries.log_types_per_cert,
        log_queries.log_delta_bases, log_queries.log_lost_records,
    ],
)
def test_no_table_that_grows_with_the_log_is_broadcast(spark, query):
    """Files of few bytes may hold any number of rows: Spark would broadcast what it takes to be small."""
    plan = query(Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert re.search("SortMergeJoin", plan) and not re.search("Broadcast", plan)


def _bytes(spark, n):
    """n rows of 1 KB that does not compress, in one file."""
    return spark.range(0, n, 1, 1).select(F.concat(*[F.unhex(F.sha2(F.concat_ws("/", "id", F.lit(k)), 256)) for k in range(32)]).alias("der"))


def _row_groups(spark, folder):
    return [c["bytes"] for c in footers.chunks(spark, folder) if c["column"] == "der"]


def test_writers_keep_little(spark, tmp_path):
    df = stored(_bytes(spark, 50_000))
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    groups = _row_groups(spark, folder)
    assert df.count() == 50_000 and len(groups) > 2 and max(groups) < 1.25 * ROW_GROUP
    discard(df)
    dataset._writer(_bytes(spark, 50_000), ()).parquet(str(tmp_path / "t"))
    groups = _row_groups(spark, str(tmp_path / "t"))
    assert len(groups) > 1 and max(groups) < 1.25 * dataset.ROW_GROUP
