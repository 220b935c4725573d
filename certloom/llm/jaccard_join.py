"""N-gram Jaccard join: a chosen-path join over sets of five-word shingles."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm.common import checked_broadcast, durable, packed, table, text_hash

SHINGLE, SIMILARITY = 5, 0.8
#: A path has at most LEVELS sampled tokens; runs are repeated until a pair at the threshold shares
#: a bucket of that depth with probability RECALL. Closer pairs and shallower buckets do better.
LEVELS, RECALL = 3, 0.9999
#: Buckets of more sets are split on; those of the last level that are still larger than a tile are
#: compared tile by tile. A task holds two tiles at most, each of about so many sets and shingles.
SMALL, TILE, TILE_SHINGLES = 256, 1024, 600_000
#: Representatives whose keys are broadcast at most; beyond it their texts are found by a shuffle.
BROADCAST_ROWS = 500_000
#: Buckets with two sets or more that are broadcast at most; beyond it only those with over 1 / MOST_HOT of all places are.
BROADCAST_BUCKETS, MOST_HOT = 200_000, 2000
WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def runs_needed(similarity: float = SIMILARITY, levels: int = LEVELS, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**levels))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each text's different shingles, sorted, one text after another.

    Words are runs of letters and digits in lower case. A text of fewer than k words, but not
    none, is one shingle of all its words.
    """
    lists = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([w for x in lists for w in x], object)
    codes = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(codes), np.uint64)
        for i in range(k):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + np.roll(codes, -i) + np.uint64(i + 1))
        keep = np.ones(len(codes), bool)
        owner = np.repeat(np.arange(len(texts)), sizes)
        left = first[owner + 1] - np.arange(len(codes))
        keep &= left >= k
        for d in np.flatnonzero((sizes > 0) & (sizes < k)):
            value = np.uint64(sizes[d])
            for c in codes[first[d] : first[d + 1]]:
                value = mix(np.array([value * np.uint64(0x9E3779B97F4A7C15) + c], np.uint64))[0]
            rolled[first[d]], keep[first[d]] = value, True
    owner, rolled = owner[keep], rolled[keep]
    by = np.lexsort((rolled, owner))
    owner, rolled = owner[by], rolled[by]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (rolled[1:] != rolled[:-1])]) if len(owner) else np.zeros(0, bool)
    owner, rolled = owner[new], rolled[new]
    return rolled, np.searchsorted(owner, np.arange(len(texts)), "right")


def paths(hashes: np.ndarray, ends: np.ndarray, runs: int, levels: int) -> np.ndarray:
    """For each set, run and level the key of its bucket: sets x runs x levels.

    At every node a set samples one token, the least under a hash seeded by the run and the
    path so far; the token extends the path. Two sets in one bucket choose the same child with a
    probability of exactly their Jaccard similarity.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    solid = starts < ends
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    out = np.zeros((len(ends), runs, levels), np.int64)
    with np.errstate(over="ignore"):
        for run in range(runs):
            path = mix(np.full(len(ends), (run + 1) * 0x9E3779B97F4A7C15 & _MASK, np.uint64))
            for level in range(levels):
                draws = mix(hashes ^ path[owner])
                least = np.zeros(len(ends), np.uint64)
                if solid.any():
                    least[solid] = np.minimum.reduceat(draws, starts[solid])
                path = mix(path * np.uint64(0x9E3779B97F4A7C15) + least)
                out[:, run, level] = path.view(np.int64)
    return out


def _pieces(batch: pa.RecordBatch, column: int, most: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    low = 0
    while low < len(batch):
        texts, size = [], 0
        while low + len(texts) < len(batch) and size < most:
            texts.append(batch.column(column)[low + len(texts)].as_py() or "")
            size += len(texts[-1])
        yield batch.slice(low, len(texts)), texts
        low += len(texts)


def _signatures(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, th, n_shingles, the set's 128-bit identity s1, s2 and its path keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _pieces(batch, 2):
                hashes, ends = shingle_sets(texts)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mix(hashes), mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)))]
                    s1, s2 = ((s[ends] - s[starts]).view(np.int64) for s in sums)
                keys = paths(hashes, ends, runs, LEVELS).reshape(-1)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (runs * LEVELS))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(ends - starts, pa.int64()), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(offsets, pa.array(keys))],
                    names=["doc_id", "th", "n_shingles", "s1", "s2", "keys"],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(work, "doc_id long, th long, n_shingles long, s1 long, s2 long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """rep, its shingle hashes as bytes (sorted 64-bit values)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _pieces(batch, 1):
                hashes, ends = shingle_sets(texts)
                parts = np.split(hashes, ends[:-1]) if len(texts) else []
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], names=["rep", "tokens"])

    return docs.select("rep", "text").mapInArrow(work, "rep long, tokens binary")


def compare(sets: list[np.ndarray], keys: np.ndarray, run: int, tile: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one bucket with the similarity that no earlier run brought together.

    keys: each set's bucket in every run, 0 for none. tile: 0 or 1 for each set of two tiles, whose inner pairs belong to other
    tasks; None for one tile.
    Intersections are counted through the sets' shared tokens: a product of incidence rows, in
    blocks of tokens.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[codes] > 1
    owner, codes = owner[shared], (np.cumsum(counts > 1) - 1)[codes[shared]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(codes, kind="stable")
    owner, codes = owner[by], codes[by]
    width = 4096
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        a, b = np.searchsorted(codes, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], codes[a:b] - low] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.triu(common >= similarity * union - 1e-6, 1)
    if tile is not None:
        linked &= tile[:, None] != tile[None, :]
    i, j = np.nonzero(linked)
    for r in range(run):
        new = (keys[i, r] != keys[j, r]) | (keys[i, r] == 0)
        i, j = i[new], j[new]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _in_buckets(rows: DataFrame, buckets: DataFrame, weight: str, total: int) -> DataFrame:
    """rows joined with buckets (checkpointed, one row for each run and key), of which each row is in one at most.

    weight: buckets' column with the number of their rows; total: that of all rows. Few buckets are broadcast, so
    that no row moves. Of many, those that would fill a task are, told from the others by a hash that sorts rows
    and buckets alike, so a collision only puts a bucket with the larger ones.
    """
    on, mark = ["run", "key"], F.xxhash64("run", "key")
    if buckets.count() <= BROADCAST_BUCKETS:
        return rows.join(F.broadcast(buckets), on)
    hot = [r[0] for r in buckets.where(F.col(weight) > max(1, total // MOST_HOT)).select(mark).collect()]  # MOST_HOT at most
    if not hot:
        return rows.join(buckets, on)
    large = mark.isin(hot)
    return rows.where(large).join(F.broadcast(buckets.where(large)), on).unionByName(rows.where(~large).join(buckets.where(~large), on))


def _buckets(keyed: DataFrame, runs: int) -> DataFrame:
    """(run, key, rep, n, shingles, m1, m2) of the buckets with two sets or more, each as deep as its size asks.

    A bucket of very many sets is met by its rows in a broadcast, not in one task.
    """
    path = F.slice("keys", F.col("run") * LEVELS + 1, F.lit(LEVELS))
    left = keyed.select("rep", "n_shingles", "keys", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("rep", "n_shingles", "run", path.alias("path"))
    total, done = keyed.count() * runs, None
    for level in range(LEVELS):
        left = left.withColumn("key", F.col("path")[level])
        # one row a bucket from partial sums; buckets with equal members have equal sums
        sums = [F.sum(F.xxhash64(F.lit(i), "rep").cast("decimal(20,0)")).alias(f"m{i}") for i in (1, 2)]
        sizes = left.groupBy("run", "key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), *sums).where(F.col("n") > 1)
        joined = durable(_in_buckets(left, durable(sizes), "n", total))
        last = level == LEVELS - 1
        part = (joined if last else joined.where(F.col("n") <= SMALL)).select("run", "key", "rep", "n", "shingles", "m1", "m2")
        done = part if done is None else done.unionByName(part)
        left = joined.where(F.col("n") > SMALL).select("rep", "n_shingles", "run", "path")
        total = left.count()
    return done


def _links(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """From every bucket's comparison the links of each of its sets (b null), and a spanning forest."""
    tiles = F.least(F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)), F.col("n")).cast("int")
    other = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, F.col("own")).alias("t1"), F.greatest(t, F.col("own")).alias("t2")),
    )
    tasks = (
        buckets.withColumn("tiles", tiles)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .select("run", "key", "rep", "own", F.explode(other).alias("t"))
        .select("run", "key", "rep", F.when(F.col("t.t1") == F.col("own"), 0).otherwise(1).alias("side"), "t.t1", "t.t2")
    )

    def work(group: pa.Table) -> pa.Table:
        data = group.sort_by("rep")
        reps, run = data["rep"].to_numpy(), data["run"][0].as_py()
        weights = data["weight"].to_numpy()
        sets_ = [np.frombuffer(x.as_py(), np.uint64) for x in data["tokens"]]
        keys = np.array(data["places"].combine_chunks().flatten()).reshape(len(reps), -1)
        two = data["t1"][0] != data["t2"][0]
        i, j = compare(sets_, keys, run, data["side"].to_numpy() if two else None, similarity)
        copies = np.bincount(i, weights[j], len(reps)) + np.bincount(j, weights[i], len(reps))
        texts = np.bincount(i, minlength=len(reps)) + np.bincount(j, minlength=len(reps))
        hit = np.flatnonzero(texts)
        edges = forest(len(reps), i, j)
        a = np.concatenate([reps[hit], reps[[x for x, _ in edges]] if edges else reps[:0]])
        b = pa.array([None] * len(hit) + [int(reps[y]) for _, y in edges], pa.int64())
        zeros = np.zeros(len(edges), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "links": pa.array(np.concatenate([copies[hit].astype(np.int64), zeros])), "texts": pa.array(np.concatenate([texts[hit].astype(np.int64), zeros]))})

    full = tasks.join(sets, "rep")
    return full.groupBy("run", "key", "t1", "t2").applyInArrow(work, "a long, b long, links long, texts long")


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """node, root (the least node of its component) for all nodes of the edges (a, b).

    Alternating large and small stars: each round connects nodes to smaller neighbours; a
    checkpoint cuts the lineage. The number of rounds grows with the logarithm of the longest path.
    """
    now = durable(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    for _ in range(most):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v").where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where(F.col("u") != F.col("v")).distinct()
        new = durable(small)
        same = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() == now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        now = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def _judged(docs: DataFrame, similarity: float) -> DataFrame:
    """row, doc_id, th and, of rows with shingles, class_id, is_first, n_links, n_link_texts."""
    runs = runs_needed(similarity)
    base = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("th"))
    readable = base.select("doc_id", "th", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    same = ["n_shingles", "s1", "s2"]
    signs = durable(_signatures(readable, runs).where(F.col("n_shingles") > 0).withColumn("at", F.struct("doc_id", "th")))
    members = signs.select(*same, "at").distinct()
    reps = signs.groupBy(*same).agg(F.min("at").alias("first")).withColumn("rep", F.monotonically_increasing_id())
    weights = members.groupBy(*same).agg(F.count("*").alias("weight"))
    reps = durable(reps.join(weights, same))
    keyed = reps.join(signs.groupBy("at").agg(F.first("keys").alias("keys")), F.col("first") == F.col("at")).select("rep", "n_shingles", "keys")
    placed = durable(_buckets(keyed, runs))
    firsts = placed.groupBy("n", "m1", "m2").agg(F.min(F.struct("run", "key")).alias("f")).select("f.run", "f.key", F.col("n").alias("members"))
    buckets = _in_buckets(placed, durable(firsts), "members", placed.count()).select("run", "key", "rep", "n", "shingles")
    by_run = F.map_from_entries(F.collect_set(F.struct("run", "key")))
    places = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0).cast("long")))
    busy = placed.groupBy("rep").agg(by_run.alias("m")).select("rep", places.alias("places"))
    busy = durable(busy.join(reps.select("rep", "weight", "first"), "rep"))
    wanted = checked_broadcast(busy.select("rep", "first"), busy.count(), BROADCAST_ROWS)
    texts = readable.join(wanted, (F.col("doc_id") == F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))).select("rep", "text")
    sets = _sets(texts).groupBy("rep").agg(F.first("tokens").alias("tokens")).join(busy.drop("first"), "rep")
    links = durable(_links(buckets, sets, similarity))
    roots = components(links.where(F.col("b").isNotNull()).select("a", "b"))
    degrees = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = (
        reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degrees, "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    classes = known.groupBy("root").agg(F.min("first").alias("head"))
    verdicts = known.join(classes, "root").select(
        *same,
        "head",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_link_texts"),
    )
    by_doc = members.join(verdicts, same).select(
        F.col("at.doc_id").alias("k_id"),
        F.col("at.th").alias("k_th"),
        F.col("head.doc_id").alias("class_id"),
        (F.col("head") == F.col("at")).alias("is_first"),
        "n_links",
        "n_link_texts",
    )
    return base.drop("text").join(by_doc, (F.col("doc_id") == F.col("k_id")) & (F.col("th") == F.col("k_th")), "left")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: its columns, class_id, n_links, n_link_texts.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is
    at least `similarity` (words: runs of letters and digits, in lower case). class_id is the
    least doc_id of the connected documents, n_links the number of other documents linked to this
    one, n_link_texts the number of other shingle sets among them.

    Null, empty and wordless texts have no shingles: no links, a class of their own. A text of
    fewer than five words is one shingle. Documents with equal sets are one vertex, so copies cost
    one row each, however many. Rows with a null doc_id are left alone: their class_id is null.
    Rows that share a doc_id and a text are one document; with different texts the row's class is
    that of its own text. Columns of docs with the results' names are replaced.

    Paths of sampled tokens are computed with the set, so splitting a bucket moves only keys; sets
    travel once for each bucket that has other members than an earlier one. Buckets that the paths
    do not split (copies with small edits) are compared in tiles, so no task holds a whole group,
    and give sums and a spanning forest, never their pairs.
    """
    names = ("class_id", "n_links", "n_link_texts")
    return _judged(docs, similarity).select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in names],
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_link_texts", F.lit(0)).cast("long").alias("n_link_texts"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near_duplicates(): of the least doc_id, one of its copies.

    Rows without shingles stay, one for each different doc_id and text, as do rows with a null doc_id.
    """
    first = _judged(docs, similarity).where(F.coalesce("is_first", F.lit(True)))
    rows = first.groupBy("doc_id", "th").agg(F.first("row").alias("row"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
