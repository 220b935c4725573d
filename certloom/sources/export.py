"""Rows as text: tables, Markdown, CSV and JSON, with metadata; written whole or not at all."""

from __future__ import annotations

import base64
import csv
import io
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from certloom import __version__
from certloom.errors import UsageError
from certloom.operators.query import GROUPS, Query
from certloom.sources.dataset import Dataset, Snapshot

FORMATS = ("md", "json", "csv")


def _time(t: datetime) -> str:
    fraction = f".{t.microsecond:06d}".rstrip("0") if t.microsecond else ""
    return f"{t:%Y-%m-%dT%H:%M:%S}{fraction}Z"


def text_of(v) -> str:
    """A value as every text format shows it."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, datetime):
        return _time(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return ", ".join(map(text_of, v))
    return str(v)


def _json_of(v):
    if isinstance(v, (list, tuple)):
        return [_json_of(x) for x in v]
    return text_of(v) if isinstance(v, (datetime, bytes, bytearray)) else v


def lines(form: str, columns: list[str], rows: Iterable[tuple]) -> Iterator[str]:
    """The text of rows in a format, line by line. A table needs all rows for its widths."""
    if form == "table":
        cells = [[c.upper() for c in columns], *([text_of(v) for v in r] for r in rows)]
        widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
        for r in cells:
            yield "  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip()
    elif form == "md":
        cell = lambda v: text_of(v).replace("|", "\\|").replace("\n", " ")
        yield f"| {' | '.join(columns)} |"
        yield f"|{'---|' * len(columns)}"
        for r in rows:
            yield f"| {' | '.join(map(cell, r))} |"
    elif form == "csv":
        for r in [columns, *rows] if isinstance(rows, list) else _with_head(columns, rows):
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow([text_of(v) for v in r])
            yield out.getvalue()
    elif form == "json":
        for r in rows:
            yield json.dumps({c: _json_of(v) for c, v in zip(columns, r, strict=True)}, ensure_ascii=False)
    else:
        raise UsageError(f"unknown format {form!r}")


def _with_head(columns: list[str], rows: Iterable[tuple]) -> Iterator:
    yield columns
    yield from rows


def metadata(dataset: Dataset, snap: Snapshot, q: Query, row_count: int, selection: list | None = None) -> dict:
    """What makes an export reproducible."""
    heads = [
        {"log": log, "verified_tree_size": (m["head"] or m["tree"])["size"], "root_hash": (m["head"] or m["tree"])["root"]} for log, m in snap.tips().items()
    ]
    out = {
        "version": __version__,
        "generated_at": _time(datetime.now(timezone.utc).replace(tzinfo=None)),
        "query": {k: _json_of(v) for k, v in asdict(q).items() if v},
        "as_of_commit_seq": snap.as_of,
        "builders": snap.active,
        "logs": heads,
        "row_count": row_count,
        "approximate": False,
    }
    if snap.mixed:
        out["mixed_tables"] = sorted(snap.mixed)
    if selection is not None:
        out["selection"] = {"key": GROUPS[q.group].key, "values": sorted(map(text_of, selection))}
    return out


def export(dataset: Dataset, snap: Snapshot, q: Query, rows: DataFrame, path: str, form: str, force: bool = False, selection: list | None = None) -> dict:
    """Writes rows in order, streamed partition by partition, and returns their metadata.

    CSV has its metadata beside it in <path>.meta.json. The file appears whole by a rename; an
    existing one is kept unless force is set.
    """
    if form not in FORMATS:
        raise UsageError(f"export format {form!r}: {', '.join(FORMATS)}")
    targets = [path, path + ".meta.json"] if form == "csv" else [path]
    if not force and any(os.path.exists(t) for t in targets):
        raise FileExistsError(f"{path} exists")
    n = 0

    def counted() -> Iterator[tuple]:
        nonlocal n
        for r in rows.toLocalIterator(prefetchPartitions=True):
            n += 1
            yield tuple(r)

    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    handle2, body = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle2, "w", encoding="utf-8", newline="") as f:
            for i, line in enumerate(lines(form, rows.columns, counted())):
                f.write(f"{',' if i and form == 'json' else ''}{chr(10) if i else ''}{line}")
        meta = metadata(dataset, snap, q, n, selection)
        text = json.dumps(meta, indent=2, ensure_ascii=False)
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f, open(body, encoding="utf-8", newline="") as b:
            if form == "json":
                f.write(f'{{"meta": {text},\n"rows": [\n')
            elif form == "md":
                f.write(f"<!--\n{text}\n-->\n\n")
            while chunk := b.read(1 << 20):
                f.write(chunk)
            f.write("\n]}\n" if form == "json" else "\n")
        if form == "csv":
            with open(targets[1], "w", encoding="utf-8") as f:
                f.write(text + "\n")
        os.replace(part, path)
    finally:
        for p in (part, body):
            if os.path.exists(p):
                os.unlink(p)
    return meta


def pem(der: bytes) -> str:
    text = base64.b64encode(der).decode()
    return "-----BEGIN CERTIFICATE-----\n" + "\n".join(text[i : i + 64] for i in range(0, len(text), 64)) + "\n-----END CERTIFICATE-----\n"


def certificate_text(row: dict, der: bytes, form: str, names: list | None = None, chains: list | None = None, entries: list | None = None) -> bytes:
    """A certificate as pem, der, text or json, with its names, chains and entries if given."""
    if form == "der":
        return der
    if form == "pem":
        return pem(der).encode()
    more = {k: v for k, v in (("names", names), ("chains", chains), ("entries", entries)) if v is not None}
    if form == "json":
        full = {k: _json_of(v) for k, v in row.items()} | {k: [_json_of(list(x)) if isinstance(x, tuple) else x for x in v] for k, v in more.items()}
        return (json.dumps(full | {"der": base64.b64encode(der).decode()}, indent=2, ensure_ascii=False, default=text_of) + "\n").encode()
    if form == "text":
        out = [f"{k}: {text_of(v)}" for k, v in row.items() if v is not None]
        return ("\n".join(out + [f"{k}: {text_of(x)}" for k, v in more.items() for x in v]) + "\n").encode()
    raise UsageError(f"unknown format {form!r}: pem, der, text or json")
