"""Log lists (v3) as a DataFrame, log names, and the registry of followed logs."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.errors import NotFound, UsageError
from certloom.sources.dataset import Dataset

# How names are recognised in descriptions and URLs.
QUOTED = r"'([A-Za-z0-9][A-Za-z0-9._-]{0,63})'"
NAME_LIKE = r"[a-z][a-z0-9_-]*[0-9][a-z0-9_-]*"
LIST_SCHEMA = (
    "version string, operators array<struct<name: string, "
    "logs: array<struct<description: string, log_id: string, key: string, url: string, mmd: bigint, state: map<string, struct<timestamp: string>>>>, "
    "tiled_logs: array<struct<description: string, log_id: string, key: string, submission_url: string, monitoring_url: string, mmd: bigint, "
    "state: map<string, struct<timestamp: string>>>>>>"
)


def log_name(description: str, url: str) -> str:
    """The permanent name of a log: quoted in its description, else like a name in its URL, else the URL itself."""
    if m := re.search(QUOTED, description or "", re.ASCII):
        return m[1].lower()
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    for piece in [*reversed(parts.path.strip("/").lower().split("/")), host.split(".")[0]]:
        if re.fullmatch(NAME_LIKE, piece, re.ASCII):
            return piece
    return re.sub(r"[^a-z0-9]+", "-", f"{host}/{parts.path}".lower()).strip("-")[:64]


def log_name_column(description, url):
    """log_name() from built-in functions."""
    quoted = F.lower(F.regexp_extract(description, QUOTED, 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    pieces = F.concat(F.reverse(F.split(F.btrim(F.lower(path), F.lit("/")), "/")), F.array(F.element_at(F.split(host, r"\."), 1)))
    like = F.get(F.filter(pieces, lambda p: p.rlike(rf"\A{NAME_LIKE}\z")), F.lit(0))
    slug = F.substring(F.btrim(F.regexp_replace(F.lower(F.concat(host, F.lit("/"), path)), "[^a-z0-9]+", "-"), F.lit("-")), 1, 64)
    return F.coalesce(F.when(quoted != "", quoted), like, slug)


def read_log_list(spark: SparkSession, path: str) -> DataFrame:
    """name, operator, kind (rfc6962, tiled), url, submission_url, log_id, key, mmd, state; sorted by name."""
    raw = spark.read.schema(LIST_SCHEMA).option("multiLine", True).json(path).where(F.col("version").isNotNull() & (F.size("operators") > 0))
    ops = raw.select(F.explode("operators").alias("o"))
    state = F.array_join(F.array_sort(F.map_keys("l.state")), ",")
    common = ["l.log_id", "l.key", "l.mmd", state.alias("state")]
    flat = ops.select(F.col("o.name").alias("operator"), F.explode("o.logs").alias("l")).select(
        log_name_column(F.col("l.description"), F.col("l.url")).alias("name"), "operator", F.lit("rfc6962").alias("kind"), "l.url", F.lit(None).cast("string").alias("submission_url"), *common
    )
    tiled = ops.select(F.col("o.name").alias("operator"), F.explode("o.tiled_logs").alias("l")).select(
        log_name_column(F.col("l.description"), F.col("l.submission_url")).alias("name"), "operator", F.lit("tiled").alias("kind"), F.col("l.monitoring_url").alias("url"), "l.submission_url", *common
    )
    return flat.unionByName(tiled).orderBy("name")


def find_log(logs: DataFrame, name: str) -> dict:
    """The one log of a name."""
    found = logs.where(F.col("name") == name.strip().lower()).limit(10).collect()
    if not found:
        raise NotFound(f"no log {name!r}")
    if len(found) > 1:
        raise UsageError(f"{name!r} is ambiguous: {', '.join(r['url'] for r in found)}")
    return found[0].asDict()


def origin(submission_url: str) -> str:
    """A tiled log's checkpoint origin: its submission URL without scheme and final slashes."""
    u = urlsplit(submission_url)
    out = (u.netloc + u.path).rstrip("/")
    if u.scheme not in ("http", "https") or not u.netloc or u.query or u.fragment or re.search(r"[ +]|%20|%2B", out):
        raise UsageError(f"no origin can be made of {submission_url!r}")
    return out


def check_key(key: str, log_id: str) -> bytes:
    """The DER of a log's key, whose SHA-256 must be its id."""
    der = base64.b64decode(key, validate=True)
    if base64.b64encode(hashlib.sha256(der).digest()).decode() != log_id:
        raise UsageError("the log's id is not the hash of its key")
    return der


class LogRegistry:
    """The logs that a dataset follows, pinned when added; a changed key or URL is never taken over."""

    def __init__(self, dataset: Dataset):
        self.dataset = dataset

    def all(self) -> dict[str, dict]:
        return self.dataset.store.read_json("logs.json") if self.dataset.store.exists("logs.json") else {}

    def add(self, log: dict) -> None:
        known = self.all()
        pinned = {k: log.get(k) for k in ("name", "kind", "url", "submission_url", "log_id", "key", "operator")}
        if log.get("key"):
            check_key(log["key"], log["log_id"])
        if log["name"] in known and known[log["name"]] != pinned:
            raise UsageError(f"log {log['name']} is pinned with other values")
        self.dataset.store.write("logs.json", json.dumps(known | {log["name"]: pinned}, indent=1), overwrite=True)

    def get(self, name: str) -> dict:
        if name not in self.all():
            raise NotFound(f"log {name!r} is not followed")
        return self.all()[name]
