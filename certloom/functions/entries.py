"""Decoding raw log entries over a DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from certloom.functions import leaf
from certloom.functions.codes import NO_CERTIFICATE
from certloom.functions.quiet import uncollected

DECODED = (
    "log string, idx bigint, leaf_hash binary, entry_type string, ts_ms decimal(20,0), cert binary, chain array<binary>, "
    "issuer_key_hash binary, digest binary, leaf_error string, leaf_input binary, extra_data binary"
)
_SCHEMA = pa.schema(
    [
        ("log", pa.string()), ("idx", pa.int64()), ("leaf_hash", pa.binary()), ("entry_type", pa.string()), ("ts_ms", pa.decimal128(20, 0)),
        ("cert", pa.binary()), ("chain", pa.list_(pa.binary())), ("issuer_key_hash", pa.binary()), ("digest", pa.binary()),
        ("leaf_error", pa.string()), ("leaf_input", pa.binary()), ("extra_data", pa.binary()),
    ]
)
#: Decoded entries with hashes; bytes that recur in the rows worked on together are only on the first of them, by part and idx.
HASHED = DECODED + ", sha256 binary, chain_id binary, prints array<binary>"
_HASHED = pa.schema([*_SCHEMA, ("sha256", pa.binary()), ("chain_id", pa.binary()), ("prints", pa.list_(pa.binary()))])


@dataclass(frozen=True)
class Made:
    """Raw entries that Python makes of rows, a batch of one of the other.

    They are decoded where they are made, in the same pass: their bytes, far more than those of the rows, stay out of the JVM.
    """

    rows: DataFrame
    make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]

    def where(self, condition) -> Made:
        return Made(self.rows.where(condition), self.make)

    def withColumn(self, name: str, value) -> Made:  # noqa: N802
        return Made(self.rows.withColumn(name, value), self.make)


def decoded(raw: DataFrame, tiled: bool = False) -> DataFrame:
    """Raw entries (log, idx, leaf_input, extra_data) decoded; tiled: their index extension is checked too."""
    return _map(raw, tiled, False)


def hashed(raw: DataFrame | Made, tiled: bool = False) -> DataFrame:
    """decoded() with sha256 (null without a certificate), chain_id and prints, for what needs each certificate and chain once.

    Of the rows with one sha256 that are worked on together, that of the least idx has cert; likewise chain and prints by
    chain_id. So the first row of a certificate or chain in any set of whole inputs has its bytes. Entries of several
    batches have a column part, which is kept and goes before idx.
    """
    return _map(raw, tiled, True)


def _map(raw: DataFrame | Made, tiled: bool, hashes: bool) -> DataFrame:
    make = raw.make if isinstance(raw, Made) else None
    parted = "part" in (raw.rows if make else raw).columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for x in batches for b in make(x)) if make else batches:
            for low in range(0, len(batch), 2000):
                part = batch.slice(low, 2000)
                with uncollected():
                    rows = []
                    for log, idx, leaf_input, extra in zip(*[part.column(c).to_pylist() for c in ("log", "idx", "leaf_input", "extra_data")], strict=True):
                        e = leaf.decode_kept(leaf_input, extra or b"")
                        if tiled:
                            leaf.check_leaf_index(e, idx)
                        kept = e.leaf_hash, e.entry_type, e.timestamp, e.cert, e.chain, e.issuer_key_hash, e.digest, e.code
                        rows.append((log, idx, *kept, *((leaf_input, extra) if e.code else (None, None))))
                    columns, schema = list(zip(*rows, strict=True)), _SCHEMA
                    place = columns[1]
                    if parted:
                        place = tuple(zip(part.column("part").to_pylist(), columns[1], strict=True))
                    if hashes:
                        columns, schema = with_hashes(columns, place), _HASHED
                    arrays, names = [_array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names
                    if parted:
                        arrays, names = [part.column("part"), *arrays], ["part", *names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = raw.rows if make else raw.select(*(["part"] if parted else []), "log", "idx", "leaf_input", "extra_data")
    return rows.mapInArrow(work, ("part int, " if parted else "") + (HASHED if hashes else DECODED))


@lru_cache(1024)
def _prints(chain: tuple[bytes, ...]) -> tuple[bytes, list[bytes]]:
    prints = [hashlib.sha256(c).digest() for c in chain]
    return leaf.chain_id(prints), prints


def with_hashes(columns: list[tuple], place: tuple) -> list[tuple]:
    """Columns of DECODED as those of HASHED; place: the rows' order."""
    at = {f.name: i for i, f in enumerate(_SCHEMA)}
    certs, chains, codes = (columns[at[c]] for c in ("cert", "chain", "leaf_error"))
    known: dict[bytes, bytes] = {}
    shas = [None if c is None or code in NO_CERTIFICATE else known.get(c) or known.setdefault(c, hashlib.sha256(c).digest()) for c, code in zip(certs, codes, strict=True)]
    links = [(None, None) if c is None else _prints(tuple(c)) for c in chains]
    ids = [i for i, _ in links]
    certs_at, chains_at = _firsts(place, shas), _firsts(place, ids)
    out = list(columns)
    out[at["cert"]] = tuple(c if n in certs_at else None for n, c in enumerate(certs))
    out[at["chain"]] = tuple(c if n in chains_at else None for n, c in enumerate(chains))
    return [*out, tuple(shas), tuple(ids), tuple(p if n in chains_at else None for n, (_, p) in enumerate(links))]


def _firsts(place: tuple, keys: list) -> set[int]:
    """The rows of each key's least place."""
    first: dict = {}
    for n, k in enumerate(keys):
        if k is not None and (k not in first or place[n] < place[first[k]]):
            first[k] = n
    return set(first.values())


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.uint64()).cast(kind) if pa.types.is_decimal(kind) else pa.array(values, kind)
