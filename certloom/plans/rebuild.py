"""Derived tables built again from the stored certificates: new versions, repair, retirement."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from certloom.errors import DatasetError, VerificationError
from certloom.functions.certificates import built, table_rows
from certloom.operators.numbering import durable
from certloom.operators.verify import content_hash
from certloom.plans.ingest import BLOOM
from certloom.sources.dataset import GRACE_SECONDS, Dataset
from certloom.sources.schemas import DERIVED, columns, ddl_of


def _rebuilt(dataset: Dataset, m: dict, table: str) -> DataFrame:
    """A batch's rows of a table from its certificates."""
    snap = dataset.snapshot(allow_mixed=True)
    kinds = dataset.table("certs", snap, [m]).select("cert_id", "kind")
    return table_rows(built(dataset.table("vault", snap, [m]).join(kinds, "cert_id")), table)


def begin_version(dataset: Dataset, table: str, version: int, in_place: bool = False) -> None:
    """Starts a version beside the active one, or in place of it.

    In place, each batch's old rows go when its new ones are committed; until all are converted
    readers must allow mixed rows.
    """
    if (table, version) not in DERIVED:
        raise DatasetError(f"{table} has no version {version}")
    active = dataset.versions()
    state = active[table]
    if state.get("building") or state["active"] == version:
        raise DatasetError(f"{table} is at version {state['active']}, building {state.get('building')}")
    active[table] = state | {"building": version, "in_place": in_place}
    dataset.store.write_json("active.json", active, overwrite=True)


def rebuild(dataset: Dataset, table: str, batches: int | None = None) -> int:
    """Builds the version in progress for the next `batches` old batches (all), and returns how many are left.

    When none is left the version becomes active in one step and the old one retires.
    """
    active = dataset.versions()
    version = active[table].get("building")
    if not version:
        return 0
    in_place = active[table].get("in_place")
    todo = [m for m in dataset.manifests() if version not in m["derived"].get(table, [])]
    for m in todo[:batches]:
        # the figures of the newest version; `repair` and `verify` read them
        m["files"][table] = dataset.write(_rebuilt(dataset, m, table), table, m, version, bloom=BLOOM.get(table, ())) | {"version": version}
        old = m["derived"].get(table, [])
        m["derived"][table] = [version] if in_place else [*old, version]
        dataset.update_manifest(m)
        for v in old if in_place else []:
            dataset.store.delete(dataset.folder(table, m, v))
    left = len(todo) - len(todo[:batches])
    if not left:
        retiring = {} if in_place else {"retiring": active[table]["active"], "switched_at": time.time()}
        active[table] = {"active": version} | retiring
        dataset.store.write_json("active.json", active, overwrite=True)
    return left


def collect_garbage(dataset: Dataset, now: float | None = None) -> list[str]:
    """Deletes retired versions after their time of grace, and returns what went."""
    gone, active = [], dataset.versions()
    for table, state in active.items():
        old = state.get("retiring")
        if old and (now or time.time()) - state["switched_at"] >= GRACE_SECONDS:
            for m in dataset.manifests():
                if old in m["derived"].get(table, []):
                    m["derived"][table] = [v for v in m["derived"][table] if v != old]
                    dataset.update_manifest(m)
            dataset.store.delete(f"{table}.p{old}")
            gone.append(f"{table}.p{old}")
            active[table] = {"active": state["active"]}
    dataset.store.write_json("active.json", active, overwrite=True)
    return gone


def repair(dataset: Dataset, table: str, m: dict, expected: str | None = None) -> None:
    """Writes a batch's part of a table again from its certificates.

    The rows must have the content hash that the manifest holds, or else `expected`. A version built
    after the commit has none there; then it must be given.
    """
    version = m["derived"][table][-1]
    rows = _rebuilt(dataset, m, table).select(*[n for n, _ in columns(ddl_of(table, version))])
    rows = durable(rows)
    content = expected or (m["files"][table].get("content") if version == m["files"][table].get("version", version) else None)
    if content_hash(rows) != content:
        raise VerificationError(f"{table} of batch {m['commit_seq']} cannot be rebuilt as committed")
    m["files"][table] |= dataset.write(rows, table, m, version, bloom=BLOOM.get(table, ()))
    dataset.update_manifest(m)
