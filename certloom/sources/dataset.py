"""The dataset: manifests, snapshots, table scans by explicit folders, views.

Layout under the root: <table>/log=<log>/batch=<first>-<last>/ for entries, chains, vault and
quarantine, <table>.p<version>/log=.../batch=.../ for derived tables, manifests/<commit_seq>.json.
A batch exists when its manifest does; readers never list data folders.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from certloom.errors import DatasetError, VerificationError
from certloom.operators.numbering import ROW_GROUP
from certloom.sources.schemas import DERIVED, SOURCE, TABLES, columns, ddl_of, schema_hash
from certloom.sources.store import Store

#: A retired version's files stay so long for readers that began before.
GRACE_SECONDS = 24 * 3600
#: Rows of one file at most, some 500 MB of certificates.
FILE_ROWS = 500_000
#: Columns written without a dictionary in every table: Parquet's writers in one JVM share the settings of
#: the one opened last, so those of parts that are written side by side must agree.
PLAIN = ("sha256", "name", "etld1")


def batch_name(first: int, last: int) -> str:
    return f"{first:012d}-{last:012d}"


def content_sum(names: list[str]) -> Column:
    """An aggregate over rows, whatever their order: their number and the sum of their hashes."""
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in names])
    total = F.coalesce(F.sum(F.xxhash64(nulls, *[F.col(f"`{c}`") for c in names]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.concat_ws(":", F.count("*").cast("string"), total.cast("string"))


def _typed(df: DataFrame, table: str, version: int | None, *more: Column) -> DataFrame:
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in columns(ddl_of(table, version))], *more)


def _writer(df: DataFrame, bloom: tuple[str, ...]) -> DataFrameWriter:
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).option("parquet.block.size", ROW_GROUP)
    for c in {*PLAIN, *bloom}:
        # a column that is all dictionary pages would get no filter
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


@dataclass
class Snapshot:
    """A fixed list of committed batches and the version of each derived table to read."""

    as_of: int
    batches: list[dict] = field(default_factory=list)
    active: dict[str, int] = field(default_factory=dict)
    mixed: dict[str, bool] = field(default_factory=dict)

    def tips(self) -> dict[str, dict]:
        """The last batch of each log."""
        return {m["log"]: m for m in self.batches}

    def next_cert_id(self) -> int:
        return 1 + max((m["cert_id_range"][1] for m in self.batches if m.get("cert_id_range")), default=0)

    def next_index(self, log: str) -> int:
        return self.tips()[log]["last"] + 1 if log in self.tips() else 0


class Dataset:
    """Reads and commits batches under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, self.root)

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> Dataset:
        d = cls(spark, root)
        if not d.store.exists("dataset.json"):
            d.store.write_json("dataset.json", {"created": time.time(), "tables": {t: schema_hash(ddl_of(t)) for t in (*SOURCE, *TABLES)}})
            d.store.write_json("active.json", {t: {"active": max(v for n, v in DERIVED if n == t)} for t in TABLES})
        return d

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        d = cls(spark, root)
        if not d.store.exists("dataset.json"):
            raise DatasetError(f"no dataset at {root}")
        return d

    # --- manifests ---

    def manifests(self) -> list[dict]:
        """All manifests in commit order, checked for gaps."""
        names = [n for n in self.store.names("manifests") if n.endswith(".json")]
        found = [self.store.read_json(f"manifests/{n}") for n in names]
        for at, m in enumerate(found, 1):
            if m["commit_seq"] != at:
                raise VerificationError(f"commit {at} is missing")
        return found

    def batches(self, as_of: int = 0) -> DataFrame:
        """The manifests as a table."""
        folder = self.store.path("manifests")
        if not self.store.names("manifests"):
            return self.spark.createDataFrame([], "commit_seq bigint, log string, first bigint, last bigint")
        df = self.spark.read.option("multiLine", True).json(folder)
        return df.where(F.col("commit_seq") <= as_of) if as_of else df

    def versions(self) -> dict[str, dict]:
        """Of each derived table: active, and building or retiring versions if any."""
        return self.store.read_json("active.json")

    def snapshot(self, as_of: int = 0, allow_mixed: bool = False, parser_version: dict[str, int] | None = None) -> Snapshot:
        """The batches up to a commit (0: all). A table that rebuilds in place is refused unless asked for."""
        found = [m for m in self.manifests() if not as_of or m["commit_seq"] <= as_of]
        chosen, mixed = {}, {}
        for t, v in self.versions().items():
            chosen[t] = (parser_version or {}).get(t, v["active"])
            lacking = [m for m in found if chosen[t] not in m["derived"].get(t, [])]
            if lacking and not allow_mixed:
                state = "is being converted in place" if v.get("in_place") else "is not complete"
                raise DatasetError(f"version {chosen[t]} of {t} {state}; allow mixed versions to read it")
            mixed[t] = bool(lacking)
        return Snapshot(found[-1]["commit_seq"] if found else 0, found, chosen, {t: m for t, m in mixed.items() if m})

    # --- scans ---

    def folder(self, table: str, m: dict, version: int | None = None) -> str:
        name = table if table in SOURCE else f"{table}.p{version}"
        return f"{name}/log={m['log']}/batch={batch_name(m['first'], m['last'])}"

    def table(self, name: str, snap: Snapshot, batches: list[dict] | None = None) -> DataFrame:
        """A table's rows in a snapshot, with the partition columns log and batch.

        batches: only these, where a caller knows which can hold what it looks for.
        """
        use = snap.batches if batches is None else batches
        ddl = ddl_of(name, snap.active.get(name)) + ", log string, batch string"
        groups: dict[str, list[str]] = {}
        for m in use:
            versions = m.get("derived", {}).get(name, [])
            version = None if name in SOURCE else (snap.active[name] if snap.active[name] in versions or not versions else max(versions))
            groups.setdefault(name if name in SOURCE else f"{name}.p{version}", []).append(self.store.path(self.folder(name, m, version)))
        if not groups:  # a relation of the JVM's own; rows from Python would start its workers for nothing
            return self.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in columns(ddl)])
        out = None
        for base, paths in groups.items():
            part = self.spark.read.schema(ddl).option("basePath", self.store.path(base)).parquet(*paths)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def views(self, as_of: int = 0) -> list[str]:
        """Registers every table, batches, entry_certs and logging_delay as temporary views.

        A version that is being built is <table>_building. A table that is converted in place has no
        view of its own: what is still of the old version is <table>_previous.
        """
        snap, versions = self.snapshot(as_of, allow_mixed=True), self.versions()
        names = []

        def view(name: str, df: DataFrame) -> None:
            df.createOrReplaceTempView(name)
            names.append(name)

        for t in ("entries", "chains", "vault", *TABLES):
            state = versions.get(t, {})
            held = lambda v, t=t: [m for m in snap.batches if v in m["derived"].get(t, [])]
            if state.get("building"):
                view(f"{t}_building", self.table(t, replace(snap, active=snap.active | {t: state["building"]}), held(state["building"])))
            if state.get("in_place"):
                view(f"{t}_previous", self.table(t, snap, held(state["active"])))
                self.spark.catalog.dropTempView(t)
            else:
                view(t, self.table(t, snap))
        view("batches", self.batches(as_of))
        if "certs" in names:
            e, c = self.table("entries", snap), self.table("certs", snap)
            view("entry_certs", entry_certs(e, c))
            view("logging_delay", logging_delay(e, c))
        return names

    # --- writing ---

    def write(self, df: DataFrame, table: str, m: dict, version: int | None = None, sort: list[str] | None = None, bloom: tuple[str, ...] = ()) -> dict:
        """Writes a batch's part of a table and reads it back: rows, bytes, and a hash of the content. Columns are cast to the declared types."""
        folder = self.folder(table, m, version)
        path, names = self.store.path(folder), [n for n, _ in columns(ddl_of(table, version))]
        typed = _typed(df, table, version)
        if sort:
            typed = typed.repartitionByRange(*sort).sortWithinPartitions(*sort)
        _writer(typed, bloom).mode("overwrite").parquet(path)
        found = self.spark.read.schema(ddl_of(table, version)).parquet(path).agg(F.count("*").alias("n"), content_sum(names).alias("c")).first()
        return {"rows": found["n"], "bytes": self.store.size(folder), "content": found["c"]}

    def write_parts(self, df: DataFrame, table: str, ms: list[dict], version: int | None = None, sort: list[str] | None = None, bloom: tuple[str, ...] = ()) -> list[dict]:
        """write() of several batches in one job; df's column part is a row's place in ms."""
        if len(ms) == 1 or not all(re.fullmatch(r"[\w.-]+", m["log"], re.ASCII) for m in ms):  # Spark would write other folders for such names
            return [self.write(df.where(F.col("part") == p), table, m, version, sort, bloom) for p, m in enumerate(ms)]
        folders = [self.folder(table, m, version) for m in ms]
        for f in folders:
            self.store.delete(f)
        place = lambda *values: F.coalesce(*[F.when(F.col("part") == p, F.lit(v)) for p, v in enumerate(values)])
        by = [place(*[m["log"] for m in ms]).alias("log"), place(*[batch_name(m["first"], m["last"]) for m in ms]).alias("batch")]
        typed = _typed(df, table, version, *by)
        if sort:
            typed = typed.repartitionByRange("log", "batch", *sort).sortWithinPartitions("log", "batch", *sort)
        base = self.store.path(folders[0].split("/")[0])
        _writer(typed, bloom).partitionBy("log", "batch").mode("append").parquet(base)
        there = [f for f in folders if self.store.exists(f)]
        found = {}
        if there:
            rows = self.spark.read.schema(ddl_of(table, version) + ", log string, batch string").option("basePath", base).parquet(*[self.store.path(f) for f in there])
            facts = rows.groupBy("log", "batch").agg(F.count("*").alias("n"), content_sum([n for n, _ in columns(ddl_of(table, version))]).alias("c")).collect()
            found = {(r["log"], r["batch"]): r for r in facts}
        out = []
        for m, f in zip(ms, folders, strict=True):
            if f in there:
                r = found[m["log"], batch_name(m["first"], m["last"])]
                out.append({"rows": r["n"], "bytes": self.store.size(f), "content": r["c"]})
            else:  # a folder without rows has a file all the same
                empty = self.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in columns(ddl_of(table, version))])
                out.append(self.write(empty, table, m, version, sort, bloom))
        return out

    def commit(self, m: dict) -> None:
        """Makes a batch visible: the manifest is written last, and never over another."""
        self.store.write_json(f"manifests/{m['commit_seq']:012d}.json", m)

    def update_manifest(self, m: dict) -> None:
        self.store.write_json(f"manifests/{m['commit_seq']:012d}.json", m, overwrite=True)

    def recover(self) -> list[str]:
        """Deletes batch folders without a manifest, left by an interrupted ingest."""
        known = {(m["log"], batch_name(m["first"], m["last"])) for m in self.manifests()}
        gone = []
        for table in self.store.names(""):
            for log in (n for n in self.store.names(table) if n.startswith("log=")) if table != "manifests" and not table.endswith(".json") else ():
                for batch in self.store.names(f"{table}/{log}"):
                    if batch.startswith("batch=") and (log[4:], batch[6:]) not in known:
                        self.store.delete(f"{table}/{log}/{batch}")
                        gone.append(f"{table}/{log}/{batch}")
        return gone


def entry_certs(entries: DataFrame, certs: DataFrame) -> DataFrame:
    """Entries with their certificates' columns."""
    return entries.join(certs.drop("log", "batch"), "cert_id")


def logging_delay(entries: DataFrame, certs: DataFrame) -> DataFrame:
    """log, idx, cert_id, and the interval from not_before to the log's timestamp."""
    return entries.join(certs.select("cert_id", "not_before"), "cert_id").select(
        "log", "idx", "cert_id", "entry_type", (F.col("ct_ts") - F.col("not_before")).alias("logging_delay")
    )
