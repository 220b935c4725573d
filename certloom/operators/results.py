"""Held results: a search run once, numbered, paged, sorted and filtered again, exported."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.errors import UsageError
from certloom.operators.numbering import numbered
from certloom.operators.query import GROUPS, Query
from certloom.operators.search import compiled, ordering, text_filter
from certloom.sources.dataset import Dataset, Snapshot

NUMBER = "__nr"


class Results:
    """Rows of a query in memory and on the executors' disks, with numbers from 1."""

    def __init__(self, rows: DataFrame, query: Query, as_of: int, users: list[int] | None = None):
        self.query, self.as_of, self._source = query, as_of, rows
        self._users = users if users is not None else [0]  # results that share the found rows
        self._users[0] += 1
        sort, descending = query.order
        key = GROUPS[query.group].key
        kept = rows.where(text_filter(query.columns, query.filter)) if query.filter else rows
        self._rows = numbered(kept, ordering(sort, descending, key), NUMBER).persist(StorageLevel.MEMORY_AND_DISK)
        self.total = self._rows.count()

    def page(self, number: int, size: int = 200) -> list[tuple]:
        """The rows of page `number`, from 0."""
        if number < 0 or size < 1:
            raise UsageError("pages count from 0 and hold a row at least")
        low = number * size
        found = self._rows.where((F.col(NUMBER) > low) & (F.col(NUMBER) <= low + size)).orderBy(NUMBER).collect()
        return [tuple(r[c] for c in self.query.columns) for r in found]

    def reorder(self, sort: str | None = None, filter: str | None = None) -> Results:
        """The same rows in another order or with another text filter, without searching again."""
        q = Query(**self.query.__dict__)
        q.sort, q.filter = sort if sort is not None else q.sort, filter if filter is not None else q.filter
        return Results(self._source, q.checked(), self.as_of, self._users)

    def rows(self, keys: list | None = None) -> DataFrame:
        """All rows in order, or those with the given keys."""
        out = self._rows.where(F.col(GROUPS[self.query.group].key).isin(keys)) if keys is not None else self._rows
        return out.orderBy(NUMBER).select(*self.query.columns)

    def close(self) -> None:
        """Frees the rows; those found by the search go with the last result that shares them."""
        self._rows.unpersist()
        self._users[0] -= 1
        if not self._users[0]:
            self._source.unpersist()


def hold(dataset: Dataset, snap: Snapshot, q: Query) -> Results:
    """Runs a query once; its limit is ignored."""
    q = q.checked()
    rows = compiled(dataset, snap, q).select(*GROUPS[q.group].columns).persist(StorageLevel.MEMORY_AND_DISK)
    return Results(rows, q, snap.as_of)
