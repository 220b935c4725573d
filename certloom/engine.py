"""The engine: one object for all that a user of the command line can do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from certloom.errors import UsageError, VerificationError
from certloom.functions.codes import codes_table, explain
from certloom.functions.entries import Made
from certloom.operators import stats
from certloom.operators.fetch import Fetcher
from certloom.operators.query import Query, parse_bar
from certloom.operators.results import Results, hold
from certloom.operators.search import search, search_page
from certloom.operators.verify import verify
from certloom.plans import rebuild as rebuilding
from certloom.plans.heads import Heads
from certloom.plans.ingest import Head, ingest_batch, ingest_batches, ingest_parts
from certloom.sources import sample
from certloom.sources.ctlog import LogSource, open_log
from certloom.sources.dataset import Dataset
from certloom.sources.export import certificate_text, export
from certloom.sources.loglist import LogRegistry
from certloom.streaming.follow import BATCH_SIZE, audit, follow, record_incident


class Engine:
    """A dataset and the operations on it. Searches take a Query or the query bar's text."""

    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.dataset = Dataset.init(spark, root) if create else Dataset.open(spark, root)
        self.spark = spark
        spark.dataSource.register(LogSource)

    @property
    def logs(self) -> LogRegistry:
        return LogRegistry(self.dataset)

    @property
    def error_codes(self) -> DataFrame:
        return codes_table(self.spark)

    @staticmethod
    def explain_error(code: str) -> list[tuple[str, str]]:
        return explain(code)

    def snapshot(self, as_of: int = 0, **how):
        return self.dataset.snapshot(as_of, **how)

    @staticmethod
    def _query(q: Query | str, **more) -> Query:
        q = parse_bar(q) if isinstance(q, str) else q
        for name, value in more.items():
            setattr(q, name, value)
        return q

    def search(self, q: Query | str, as_of: int = 0, **more) -> DataFrame:
        return search(self.dataset, self.snapshot(as_of), self._query(q, **more))

    def page(self, q: Query | str, cursor: tuple | None = None, size: int = 200, as_of: int = 0, **more) -> tuple[list, tuple | None]:
        return search_page(self.dataset, self.snapshot(as_of), self._query(q, **more), cursor, size)

    def hold(self, q: Query | str, as_of: int = 0, **more) -> Results:
        return hold(self.dataset, self.snapshot(as_of), self._query(q, **more))

    def export(self, q: Query | str, path: str, form: str, as_of: int = 0, force: bool = False, selection: list | None = None, **more) -> dict:
        q, snap = self._query(q, **more).checked(), self.snapshot(as_of)
        if selection is not None:
            rows = hold(self.dataset, snap, q).rows(selection)
        else:
            rows = search(self.dataset, snap, q)
        return export(self.dataset, snap, q, rows, path, form, force, selection)

    def fetch(self, key: str | int, form: str = "pem", with_chain: bool = False, with_entries: bool = False, as_of: int = 0) -> bytes:
        f = Fetcher(self.dataset, self.snapshot(as_of))
        row, der = f.fetch(key)
        chains = [tuple(r) for r in f.chains(row["cert_id"]).collect()] if with_chain else None
        entries = [(r["log"], r["idx"], r["ct_ts"]) for r in f.entries(row["cert_id"]).collect()] if with_entries else None
        names = [r["name"] for r in f.names(row["cert_id"]).collect()] if form in ("text", "json") else None
        return certificate_text(row, der, form, names, chains, entries)

    def linked(self, cert_id: int, as_of: int = 0) -> int | None:
        return Fetcher(self.dataset, self.snapshot(as_of)).linked(cert_id)

    def views(self, as_of: int = 0) -> list[str]:
        return self.dataset.views(as_of)

    def ingest_batch(self, raw: DataFrame, log: str, head: Head | None = None, proof: list[bytes] | None = None, tiled: bool = False) -> dict:
        return ingest_batch(self.dataset, raw, log, head, proof, tiled)

    def ingest_batches(self, batches: Iterable[tuple[DataFrame, str]]) -> list[dict]:
        return ingest_batches(self.dataset, batches)

    def ingest_parts(self, raw: DataFrame | Made, logs: list[str]) -> list[dict]:
        return ingest_parts(self.dataset, raw, logs)

    def start_stream(self, stream: DataFrame, log: str, checkpoint: str, **how):
        return follow(self.dataset, stream, log, checkpoint, **how)

    def update(self, log: str, url: str = "", kind: str = "", until: int | None = None, every: str | None = None, batch_size: int = BATCH_SIZE):
        """Starts ingesting what a log has beyond its last batch, as a stream of verified and audited batches.

        A followed log's URL and kind are pinned. Its head is fetched for every batch, and batches are
        committed only if they are proved to belong to it.
        """
        pinned = self.logs.all().get(log)
        if pinned and ((url and url != pinned["url"]) or (kind and kind != pinned["kind"])):
            raise UsageError(f"log {log} is pinned to {pinned['kind']} {pinned['url']}")
        if not pinned and not url:
            raise UsageError(f"log {log} is not followed; give its URL")
        options = {"url": url or pinned["url"], "kind": kind or (pinned or {}).get("kind") or "rfc6962"}
        heads = Heads(self.dataset, log, open_log(options), pinned)
        try:
            heads.newest()
        except VerificationError as e:
            record_incident(self.dataset, log, self.snapshot(allow_mixed=True).next_index(log), None, e)
            raise
        start = {"start": self.snapshot(allow_mixed=True).next_index(log)} | ({"end": until} if until else {})
        stream = self.spark.readStream.format("ctlog").options(**options, **start).load()
        checked = lambda m: audit(self.dataset, m)
        return follow(self.dataset, stream, log, f"{self.dataset.root}/stream/{log}", heads, options["kind"] == "tiled", every, checked, batch_size)

    def stats(self, now, **more) -> dict:
        return stats.report(self.dataset, now, **more)

    def verify(self, full: bool = False, as_of: int = 0) -> DataFrame:
        return verify(self.dataset, full, as_of)

    def rebuild(self, table: str, version: int, in_place: bool = False, batches: int | None = None) -> int:
        if not self.dataset.versions()[table].get("building"):
            rebuilding.begin_version(self.dataset, table, version, in_place)
        return rebuilding.rebuild(self.dataset, table, batches)

    def gc(self) -> list[str]:
        return rebuilding.collect_garbage(self.dataset)

    def repair(self, table: str, commit_seq: int) -> None:
        batch = next(m for m in self.dataset.manifests() if m["commit_seq"] == commit_seq)
        rebuilding.repair(self.dataset, table, batch)

    def capture(self, folder: str, log: str, kind: str, count: int, start: int | None = None, **limits) -> str:
        """Captures a sample of a followed log."""
        pinned = self.logs.get(log)
        return sample.capture(self.spark, folder, log, {"url": pinned["url"], "kind": pinned["kind"]}, kind, count, start, pinned, **limits)

    def recover(self) -> list[str]:
        return self.dataset.recover()
