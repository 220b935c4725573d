"""Log scans as Spark data sources: live logs, tiled ones, and captured ranges, batch and streaming.

    spark.dataSource.register(LogSource)
    spark.read.format("ctlog").options(url=..., start=0, end=1000).load()
    spark.readStream.format("ctlog").options(url=..., maxEntriesPerTrigger=500000).load()

Options: url (of the log, or of a folder with a tiled log's files), kind (rfc6962 or tiled), start,
end, page (entries a request), partition (least entries a task), tasks (most at a time, each with its
share of the rate), maxEntriesPerTrigger, retries, rate (requests a second to the log).
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from certloom.sources.tiles import WIDTH, data_path, issuer_path, parse_data_tile, tile_width

SCHEMA = "idx bigint, leaf_input binary, extra_data binary"
#: Waits between tries: doubled from the first to the last, in seconds.
FIRST_WAIT, LAST_WAIT = 1.0, 60.0


class Refused(IOError):
    """The server asks for fewer requests."""

    def __init__(self, after: float | None):
        super().__init__("too many requests")
        self.after = after


def http_get(url: str) -> bytes:
    """The bytes at a URL or a local path; FileNotFoundError if there is nothing."""
    if "://" not in url or url.startswith("file://"):
        with open(url.removeprefix("file://"), "rb") as f:
            return f.read()
    try:
        with urllib.request.urlopen(url, timeout=60) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise FileNotFoundError(url) from None
        if e.code == 429 or e.code >= 500:
            wait = e.headers.get("Retry-After", "")
            raise Refused(float(wait) if wait.isdigit() else None) from None
        raise


class Pacer:
    """Spaces requests; a refusal halves the rate, at most once in two seconds, and quiet seconds raise it by one."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most = self.rate = rate
        self.clock, self.sleep = clock, sleep
        self.next = self.changed = clock()

    def wait(self) -> None:
        now = self.clock()
        if now > self.changed + 1 and self.rate < self.most:
            self.rate, self.changed = min(self.most, self.rate + int(now - self.changed)), now
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + 1 / self.rate

    def refused(self) -> None:
        now = self.clock()
        if now - self.changed >= 2 or self.rate == self.most:
            self.rate, self.changed = max(self.rate / 2, 0.1), now


def get_retried(get: Callable[[str], bytes], url: str, retries: int, pacer: Pacer, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The bytes, after waits that double; FileNotFoundError is final."""
    for attempt in range(retries + 1):
        pacer.wait()
        try:
            return get(url)
        except FileNotFoundError:
            raise
        except (OSError, urllib.error.URLError) as e:
            if attempt == retries:
                raise
            if isinstance(e, Refused):
                pacer.refused()
            sleep(max(min(FIRST_WAIT * 2**attempt, LAST_WAIT), getattr(e, "after", None) or 0))
    raise AssertionError


class Rfc6962:
    """A log with the get-entries interface."""

    def __init__(self, url: str, get: Callable[[str], bytes]):
        self.url, self.get = url.rstrip("/"), get

    def call(self, what: str) -> dict:
        return json.loads(self.get(f"{self.url}/ct/v1/{what}"))

    def head(self) -> dict:
        return self.call("get-sth")

    def size(self) -> int:
        return self.head()["tree_size"]

    def consistency(self, first: int, second: int) -> list[bytes]:
        return [base64.b64decode(x) for x in self.call(f"get-sth-consistency?first={first}&second={second}")["consistency"]]

    def inclusion(self, leaf_hash: bytes, size: int) -> tuple[int, list[bytes]]:
        from urllib.parse import quote

        d = self.call(f"get-proof-by-hash?hash={quote(base64.b64encode(leaf_hash).decode(), safe='')}&tree_size={size}")
        return d["leaf_index"], [base64.b64decode(x) for x in d["audit_path"]]

    def entries(self, start: int, end: int, page: int) -> Iterator[tuple]:
        """Entries start..end-1; a server may give fewer than asked, but one at least, and never more."""
        while start < end:
            last = min(start + page, end) - 1
            got = self.call(f"get-entries?start={start}&end={last}")["entries"]
            if not 1 <= len(got) <= last - start + 1:
                raise ValueError(f"{len(got)} entries for {start} to {last}")
            for e in got:
                yield start, base64.b64decode(e["leaf_input"]), base64.b64decode(e["extra_data"])
                start += 1


#: Issuers that a worker keeps, by fingerprint, the one used last at the end. A worker runs one task at a time.
MOST_ISSUERS = 10_000
_ISSUERS: dict[bytes, bytes] = {}


class Tiled:
    """A log of static tiles, or a mirrored folder of them."""

    def __init__(self, url: str, get: Callable[[str], bytes], size: int | None = None):
        self.url, self.get, self._size = url.rstrip("/"), get, size

    def size(self) -> int:
        if self._size is None:
            self._size = int(self.get(f"{self.url}/checkpoint").split(b"\n")[1])
        return self._size

    def issuer(self, fingerprint: bytes) -> bytes:
        """An issuer's bytes, which must hash to the fingerprint. Those used last are kept by the worker for all its tasks."""
        der = _ISSUERS.pop(fingerprint, None)
        if der is None:
            der = self.get(f"{self.url}/{issuer_path(fingerprint)}")
            if hashlib.sha256(der).digest() != fingerprint:
                raise ValueError(f"issuer {fingerprint.hex()} has other bytes")
            if len(_ISSUERS) >= MOST_ISSUERS:
                _ISSUERS.pop(next(iter(_ISSUERS)))
        _ISSUERS[fingerprint] = der
        return der

    def entries(self, start: int, end: int, page: int) -> Iterator[tuple]:
        for n in range(start // WIDTH, -(-end // WIDTH)):
            width = tile_width(0, n, self.size())
            try:
                data = self.get(f"{self.url}/{data_path(n, width)}")
            except FileNotFoundError:
                if width == WIDTH:
                    raise
                data = self.get(f"{self.url}/{data_path(n)}")  # the tile has become full
                width = WIDTH
            for at, e in enumerate(parse_data_tile(data, width), n * WIDTH):
                if start <= at < end:
                    yield at, e.leaf_input(), e.extra_data(self.issuer)


def open_log(options: dict, size: int | None = None, share: int = 1):
    """The log that options name, with paced and retried requests: one share-th of its rate."""
    pacer = Pacer(float(options.get("rate", 20)) / share)
    retries = int(options.get("retries", 8))
    get = lambda url: get_retried(http_get, url, retries, pacer)
    return Tiled(options["url"], get, size) if options.get("kind") == "tiled" else Rfc6962(options["url"], get)


@dataclass
class Range(InputPartition):
    start: int
    end: int
    size: int
    share: int = 1


def ranges(start: int, end: int, size: int, step: int, tasks: int = 2**62) -> list[Range]:
    """At most so many tasks, which begin at multiples of the step, so that pages and tiles are asked for once."""
    step *= max(1, -(-(end - start) // step // max(1, tasks - 1)) if tasks > 1 else end - start)
    cuts = [start, *range(start - start % step + step, end, step), end]
    pairs = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return [Range(a, b, size, len(pairs)) for a, b in pairs]


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        size = open_log(self.options).size()
        end = min(int(self.options.get("end", size)), size)
        return self.split(int(self.options.get("start", 0)), end, size)

    def split(self, start: int, end: int, size: int) -> list[Range]:
        return ranges(start, end, size, int(self.options.get("partition", 32 * WIDTH)), int(self.options.get("tasks", 4)))

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None:
            return iter(())
        return open_log(self.options, partition.size, partition.share).entries(partition.start, partition.end, int(self.options.get("page", 32)))


class LogStream(LogReader, DataSourceStreamReader):
    """Offsets are indices; a micro-batch takes maxEntriesPerTrigger entries at most (all there are)."""

    def __init__(self, options: dict):
        super().__init__(options)
        self._at: int | None = None

    def initialOffset(self) -> dict:
        return {"idx": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:
        size = min(open_log(self.options).size(), int(self.options.get("end", 2**62)))
        at = self._at if self._at is not None else self.initialOffset()["idx"]
        most = int(self.options.get("maxentriespertrigger", self.options.get("maxEntriesPerTrigger", size)))
        self._at = max(at, min(size, at + most))
        return {"idx": self._at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._at = max(self._at or 0, end["idx"])
        return self.split(start["idx"], end["idx"], open_log(self.options).size())

    def commit(self, end: dict) -> None:
        self._at = max(self._at or 0, end["idx"])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ctlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStream:
        return LogStream(dict(self.options))


def read_capture(spark, path: str):
    """Captured entries from zstd or plain JSON lines {i, leaf_input, extra_data}, as the source gives them."""
    from pyspark.sql import functions as F

    raw = spark.read.schema("i bigint, leaf_input string, extra_data string").json(path)
    return raw.select(F.col("i").alias("idx"), F.unbase64("leaf_input").alias("leaf_input"), F.unbase64("extra_data").alias("extra_data"))


def write_capture(df, path: str) -> None:
    """The reverse of read_capture()."""
    from pyspark.sql import functions as F

    df.select(F.col("idx").alias("i"), F.base64("leaf_input").alias("leaf_input"), F.base64("extra_data").alias("extra_data")).write.option("compression", "gzip").json(path)
