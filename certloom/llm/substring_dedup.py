"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm.common import checked_broadcast, durable, packed, skew_join, table, text_bytes
from certloom.llm.suffix_groups import previous_factors, spread

#: Length of the strings that count, and of the anchors in them: the anchor of a string is the
#: leftmost of its ANCHOR-byte pieces with the least hash. Equal strings have equal anchors at one offset.
LENGTH, ANCHOR = 100, 16
#: Offsets that an anchor can have in a string, in PARTS of which the strings have a longer core in common.
OFFSETS = LENGTH - ANCHOR + 1
PARTS = ((0, 42), (43, OFFSETS - 1))
#: Different surroundings of one core whose suffixes are sorted together; those of more are parted
#: into cores of offsets so many apart. At one offset the core is the string, and nothing is left to sort.
TOGETHER, WIDTHS = 64, (8, 1)
#: Rows broadcast at most; beyond that the same joins run as shuffles.
BROADCAST_ROWS = 4_000_000
#: Bytes hashed at once (2^20 at most), symbols sorted at once, and bytes of texts in an output batch.
PIECE, SYMBOLS, BATCH_BYTES = 1 << 17, 700_000, 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Hashes:
    """64-bit hashes of any substring of data, of at most PIECE + 2 LENGTH bytes, from prefix sums."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_Hashes._up) <= n:
            size = max(n, PIECE + 2 * LENGTH) + 1
            _Hashes._up, _Hashes._down = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * self._up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._down[start])

    def of_all(self, width: int) -> np.ndarray:
        """Of every width bytes in a row."""
        out = self.sums[width:] - self.sums[:-width]
        return mix(out * self._down[: len(out)])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchored(data: np.ndarray, bounds: np.ndarray, whole: bool = True) -> tuple[np.ndarray, ...]:
    """(key, context, text, start, left, width) of the strings' surroundings in texts laid end to end.

    The strings of LENGTH bytes with one anchor start next to each other, at start to start + width;
    their bytes are the anchor's surroundings, in which it lies after left bytes. Strings whose
    offsets lie in different PARTS are kept apart. key: a hash of the core, the bytes that all such
    strings of the part have in common; context: a hash of the surroundings.
    """
    n, places = len(data), len(data) - LENGTH + 1
    first, last = bounds[:-1], bounds[1:] - LENGTH  # of each text the first and the last string
    solid = first <= last
    first, last = first[solid], last[solid]
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = _Hashes(data)
    order = hashes.of_all(ANCHOR) >> np.uint64(20) << np.uint64(20) | np.arange(n - ANCHOR + 1, dtype=np.uint64)
    anchor = (_least(order, OFFSETS) & np.uint64((1 << 20) - 1)).astype(np.int64)
    new = np.ones(places + 1, bool)
    new[1:places] = anchor[1:] != anchor[:-1]
    new[first] = new[last + 1] = True
    inside = np.zeros(places + 1, np.int8)
    inside[first] += 1
    inside[last + 1] -= 1
    a = np.flatnonzero(new)
    b = a[1:] - 1
    a = a[:-1]
    keep = np.cumsum(inside, dtype=np.int8)[a] > 0
    a, b = a[keep], b[keep]
    p = anchor[a]
    out = []
    for low, high in PARTS:
        start, end = np.maximum(a, p - high), np.minimum(b, p - low)
        some = start <= end
        start, end, at = start[some], end[some], p[some]
        key = hashes.of(at - low, at + LENGTH - high) + np.uint64(low)
        out.append((key.view(np.int64), start, at - start, end - start))
    key, start, left, width = (np.concatenate(x) for x in zip(*out, strict=True))
    if not whole:
        return key, key, key, start, left, width
    context = mix(hashes.of(start, start + width + LENGTH) + (left << 8 | width).astype(np.uint64)).view(np.int64)
    text = np.searchsorted(bounds, start, "right") - 1
    return key, context, text, start - bounds[text], left, width


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place in it, bytes, bounds): whole texts of PIECE bytes together, or pieces of one."""
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + PIECE, "right")) - 1)
        start, end = int(bounds[low]), int(bounds[high])
        if end - start <= PIECE:
            yield low, 0, data[start:end], bounds[low : high + 1] - start
        else:
            for at in range(0, end - start - LENGTH + 1, PIECE):
                part = data[start + at : min(start + at + PIECE + LENGTH - 1, end)]
                yield low, at, part, np.array([0, len(part)])
        low = high


def _keys(docs: DataFrame) -> DataFrame:
    """The key of every anchor's surroundings in every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in _pieces(*text_bytes(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array(anchored(data, bounds, whole=False)[0], pa.int64())], names=["key"])

    return docs.select("text").mapInArrow(work, "key long")


_AT = "key long, context long, doc_id long, th long, at long"


def _occurrences(docs: DataFrame) -> DataFrame:
    """key, context, doc_id, th, at: start << 16 | left << 8 | width of every anchor's surroundings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, data, bounds in _pieces(*text_bytes(batch.column("text"))):
                key, context, text, start, left, width = anchored(data, bounds)
                rows = pa.array(text + row)
                doc = [batch.column(c).take(rows) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(context, pa.int64()), *doc, pa.array(start + place << 16 | left << 8 | width, pa.int64())], names=["key", "context", "doc_id", "th", "at"])

    return docs.select("doc_id", "th", "text").mapInArrow(work, _AT)


class Scratch:
    """Intermediate tables in the checkpoint folder, far smaller there than as checkpoints, dropped when done with."""

    def __init__(self, spark: SparkSession):
        self.spark, sc = spark, spark.sparkContext
        durable(spark.range(1))
        self.base, self.names = f"{sc.getCheckpointDir()}/scratch-{uuid.uuid4().hex}", set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables, and has Spark's cleaner delete the shuffle files of finished steps."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.names.discard(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def _surroundings(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """key, kinds, doc_id, th, at and bytes (the surroundings themselves) of the wanted occurrences."""
    by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "at", "kinds")).alias("list"))
    joined = docs.join(checked_broadcast(by_doc, rows, BROADCAST_ROWS), ["doc_id", "th"]).select("doc_id", "th", "text", "list")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            listed = batch.column("list")
            values = listed.flatten()
            row = np.repeat(np.arange(len(batch)), np.asarray(listed.value_lengths().fill_null(0)))
            at = np.asarray(values.field("at"))
            for low in range(0, len(at), 50_000):
                part, cut = slice(low, low + 50_000), at[low : low + 50_000]
                sizes = (cut & 255) + LENGTH
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                bytes_ = data[spread(bounds[row[part]] + (cut >> 16), sizes)]
                doc = [batch.column(c).take(pa.array(row[part])) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays(
                    [*(values.field(c)[low : low + 50_000] for c in ("key", "kinds")), *doc, pa.array(cut), pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])],
                    names=["key", "kinds", "doc_id", "th", "at", "bytes"],
                )

    return joined.mapInArrow(work, "key long, kinds long, doc_id long, th long, at long, bytes binary")


def _common(data: np.ndarray, anchor: np.ndarray, room: np.ndarray, heads: np.ndarray, group: np.ndarray, step: int) -> np.ndarray:
    """How many bytes all members of a group share from their anchors on (step 1) or before them (-1)."""
    out = np.zeros(len(heads), np.int64)
    alive, member = np.arange(len(heads)), np.arange(len(group))
    distance = 0
    while len(alive):
        first = heads[group[member]]
        at = distance if step > 0 else -distance - 1
        within = (room[member] > distance) & (room[first] > distance)
        size = len(data) - 1
        same = within & (data[np.clip(anchor[member] + at, 0, size)] == data[np.clip(anchor[first] + at, 0, size)])
        differ = np.zeros(len(heads), bool)
        differ[group[member[~same]]] = True
        alive = alive[~differ[alive]]
        out[alive] += 1
        member = member[~differ[group[member]]]
        distance += 1
    return out


def shared_spans(data: np.ndarray, bounds: np.ndarray, left: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, start, end): of each member of a group what it shares with earlier ones, LENGTH bytes or more.

    Members are laid end to end; each holds its group's anchor after `left` bytes. What all members
    of a group share around it becomes one symbol that counts for its bytes; the rest of the members, in
    order and apart by separators, is one string whose suffixes are sorted. All spans of a member
    hold that symbol, so their union is one span.
    """
    n = len(left)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    sizes, anchor = np.diff(bounds), bounds[:-1] + left
    before = _common(data, anchor, left, heads, group, -1)[group]
    after = _common(data, anchor, sizes - left, heads, group, 1)[group]
    head, rest = left - before, sizes - left - after
    members = np.diff(np.append(heads, n))
    tail = np.zeros(n, np.int64)
    tail[heads + members - 1] = 1  # a group's string ends in its least symbol
    ends = np.cumsum(head + rest + 2 + tail)
    first = ends - (head + rest + 2 + tail)
    low = int(members.max()) + 1  # separators are below all others
    symbols = np.zeros(int(ends[-1]), np.int64)
    symbols[spread(first, head)] = data[spread(bounds[:-1], head)].astype(np.int64) + low
    symbols[first + head] = low + 256
    symbols[spread(first + head + 1, rest)] = data[spread(anchor + after, rest)].astype(np.int64) + low
    symbols[first + head + 1 + rest] = np.arange(n) - heads[group] + 1
    factors = previous_factors(symbols, np.append(first[heads], ends[-1]))
    at = spread(first, head + 1)
    owner = np.repeat(np.arange(n), head + 1)
    place = at - first[owner]
    # a prefix that holds the core counts for core - 1 bytes more
    full = np.where(place + factors[at] > head[owner], factors[at] + (before + after)[owner] - 1, 0)
    good = full >= LENGTH
    owner, start, end = owner[good], place[good], (place + full)[good]
    if not len(owner):
        return owner, start, end
    run = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[run], start[run], np.maximum.reduceat(end, run)


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """doc_id, th, start, end of the spans that groups (key, of TOGETHER rows at most) share."""
    names = ("doc_id", "th", "start", "end")

    def flush(table: pa.Table) -> pa.RecordBatch:
        key, doc, th, at = (table[c].to_numpy() for c in ("key", "doc_id", "th", "at"))
        new = np.ones(len(key), bool)  # of a repeated row one counts
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (at[1:] != at[:-1])
        keep = np.flatnonzero(new)
        data, bounds = text_bytes(table["bytes"].combine_chunks().take(pa.array(keep)))
        member, start, end = shared_spans(data, bounds, (at >> 8 & 255)[keep], key[keep])
        member = keep[member]
        first = at[member] >> 16
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[member], th[member], first + start, first + end)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = pa.Table.from_batches([batch.slice(low, 2000)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows * LENGTH > SYMBOLS:
                    key = held["key"].to_numpy()
                    cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                    if cut:
                        yield flush(held.slice(0, cut))
                        held = held.slice(cut)
        if held is not None and held.num_rows:
            yield flush(held)

    # groups of like size together: they take about as many steps
    order = (F.ceil(F.log2("kinds")), "key", "doc_id", "th", "at")
    ordered = rows.repartition("key").sortWithinPartitions(*order).select("key", "doc_id", "th", "at", "bytes")
    return ordered.mapInArrow(work, "doc_id long, th long, start long, end long")


_START, _LEFT, _WIDTH = "shiftright(at, 16)", "cast(shiftright(at, 8) & 255 as int)", "cast(at & 255 as int)"
_ENDS = f"{_START} as start", f"{_START} + {_WIDTH} + {LENGTH} as end"


def _parted(rows: DataFrame, width: int) -> DataFrame:
    """Rows of too large groups, once for each `width` offsets that their strings have.

    Those strings hold LENGTH - width + 1 bytes in common, which with the old key name the new one.
    """
    first, last = f"{_LEFT} - {_WIDTH}", _LEFT
    each = rows.select("*", F.explode(F.expr(f"sequence(({first}) div {width}, {last} div {width})")).alias("q"))
    each = each.withColumns({"low": F.expr(f"cast(greatest({first}, q * {width}) as int)"), "high": F.expr(f"cast(least({last}, q * {width} + {width - 1}) as int)")})
    core = F.expr(f"substring(bytes, cast({_LEFT} - q * {width} + 1 as int), {LENGTH - width + 1})")
    return each.select(
        F.xxhash64("key", "q", core).alias("key"),
        "doc_id",
        "th",
        F.expr(f"shiftleft({_START} + {_LEFT} - high, 16) + shiftleft(high, 8) + high - low").cast("long").alias("at"),
        F.expr(f"substring(bytes, {_LEFT} - high + 1, high - low + {LENGTH})").alias("bytes"),
    )


def _repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, th, start, end: spans whose every string of LENGTH bytes starts earlier too."""
    keys = _keys(docs).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    keys = scratch.keep(keys, "keys")
    found = scratch.keep(_occurrences(docs).join(checked_broadcast(keys, keys.count(), BROADCAST_ROWS), "key", "left_semi"), "found")
    scratch.drop("keys")
    place = F.struct("doc_id", "th", "at")
    kinds = scratch.keep(found.groupBy("key", "context").agg(F.min(place).alias("first"), F.count("*").alias("n")), "kinds")
    repeats = skew_join(found, kinds.where(F.col("n") > 1), ["key", "context"], "n", found.count()).where(place != F.col("first"))
    spans = [scratch.keep(repeats.selectExpr("doc_id", "th", *_ENDS), "spans")]
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1)
    wanted = skew_join(kinds, mixed, ["key"], "kinds", kinds.count()).select("key", "first.doc_id", "first.th", "first.at", "kinds")
    wanted = scratch.keep(wanted, "wanted")
    scratch.drop("found", "kinds")
    step = "rows"
    rows = scratch.keep(_surroundings(docs, wanted, wanted.count()), step)
    scratch.drop("wanted")
    for width in WIDTHS:
        spans.append(scratch.keep(_sorted_groups(rows.where(F.col("kinds") <= TOGETHER)), f"spans-over-{width}"))
        large = rows.where(F.col("kinds") > TOGETHER)
        if large.isEmpty():
            break
        parted = scratch.keep(_parted(large, width), f"parted-{width}")
        same = ["key", "bytes"]
        heads = scratch.keep(parted.groupBy(*same).agg(F.min(place).alias("first"), F.count("*").alias("n")), f"heads-{width}")
        repeats = skew_join(parted, heads.where(F.col("n") > 1), same, "n", parted.count()).where(place != F.col("first"))
        spans.append(scratch.keep(repeats.selectExpr("doc_id", "th", *_ENDS), f"spans-{width}"))
        mixed = heads.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1)
        rows = skew_join(heads, mixed, ["key"], "kinds", heads.count()).select("key", "kinds", "first.doc_id", "first.th", "first.at", "bytes")
        rows = scratch.keep(rows, f"rows-{width}")
        scratch.drop(step, f"parted-{width}", f"heads-{width}")
        step = f"rows-{width}"
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _lists(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"]))


def _merged(spans: DataFrame) -> DataFrame:
    """s_id, s_th, runs: a document's spans as maximal runs, in order."""
    by_doc = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            row = np.repeat(np.arange(len(batch)), np.asarray(found.value_lengths()))
            start, end = (np.asarray(found.flatten().field(c)) for c in ("start", "end"))
            by = np.lexsort((start, row))
            row, start, end = row[by], start[by], end[by]
            base = row * (int(end.max()) + 1 if len(end) else 1)
            reach = np.maximum.accumulate(end + base) - base
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])])[: len(row)])
            tail = np.append(head[1:], len(row)) - 1
            runs = _lists(start[head], reach[tail], np.bincount(row[head], minlength=len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), runs], names=["s_id", "s_th", "runs"])

    return by_doc.mapInArrow(work, "s_id long, s_th long, runs array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs plus n_bytes, spans (array of start, end: the removed runs) and kept (binary).

    Texts are UTF-8 bytes. A byte is removed if it lies in a string of LENGTH bytes that also starts
    earlier: in a smaller doc_id, or earlier in the same document. Strings overlap, never cross
    documents, and are judged on the input. Null text counts as empty. Rows with a null doc_id keep
    their text and count for nothing. Repeated rows are one document; rows that share a doc_id
    but not a text follow each other by a hash of the text. Empty tables give empty results.
    Columns of docs with the results' names are replaced.

    Cores that occur once are dropped before anything else is kept of them. Occurrences of a
    core with equal surroundings (128 bits of hash) need no sorting: all but the first repeat.
    Where surroundings differ, one row of each kind goes on to a suffix array, in groups of bounded
    size: larger ones are parted by longer cores. Keys that hold more than a small share of the rows
    are joined by a broadcast of bounded size. Cores that recur, and the runs to remove, are
    broadcast up to BROADCAST_ROWS and shuffled beyond; then the texts are shuffled too.
    """
    names = ("n_bytes", "spans", "kept")
    others = [c for c in docs.columns if c != "text"]
    row = packed(docs.select(*[f"`{c}`" for c in others])) if others else F.struct(F.lit(0).alias("none"))
    base = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    usable = base.select("doc_id", "th", "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    scratch = Scratch(docs.sparkSession)
    runs = scratch.keep(_merged(_repeated(usable, scratch)), "runs")
    scratch.drop(*scratch.names - {"runs"})
    size = runs.agg(F.coalesce(F.sum(F.size("runs") + 4), F.lit(0))).first()[0]
    runs = checked_broadcast(runs, size, BROADCAST_ROWS)
    joined = base.join(runs, (F.col("doc_id") == F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("row", "text", "runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            listed = batch.column("runs")
            counts = np.asarray(listed.value_lengths().fill_null(0))
            starts, ends = (np.asarray(listed.flatten().field(c)) for c in ("start", "end"))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            low = 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + BATCH_BYTES, "right")) - 1)
                a, b = starts[cuts[low] : cuts[high]], ends[cuts[low] : cuts[high]]
                text = np.repeat(np.arange(low, high), counts[low:high])
                gone = np.zeros(int(bounds[high] - bounds[low]) + 1, np.int32)
                np.add.at(gone, a + bounds[text] - bounds[low], 1)
                np.add.at(gone, b + bounds[text] - bounds[low], -1)
                stays = np.cumsum(gone[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stays)])[bounds[low : high + 1] - bounds[low]].astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(left), pa.py_buffer(data[bounds[low] : bounds[high]][stays])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(low, high - low), batch.column("text").slice(low, high - low), pa.array(np.diff(bounds[low : high + 1]), pa.int64()), _lists(a, b, counts[low:high]), kept],
                    names=["row", "text", *names],
                )
                low = high

    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(work, f"row {kind}, text string, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in names], *names)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
