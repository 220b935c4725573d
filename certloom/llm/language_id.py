"""Language ID: prediction by partial matching over byte context trees with frozen statistics."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import durable, table

#: Longest context in bytes; contexts of two or more bytes seen fewer times are left out of the tree.
ORDER, LEAST_SEEN = 3, 2
#: Bounds of the training sample of one language: documents, and bytes of their whole texts.
SAMPLE_DOCS, SAMPLE_BYTES = 240, 2_000_000
#: Languages, and bytes of their tables, in memory at once; more are learned and scored block by block.
BLOCK_LANGS, BLOCK_BYTES = 16, 256_000_000
#: Bytes of the tables from codes to states that a model may keep.
STATES_BYTES = 256_000_000
#: Bytes scored at once.
PIECE = 2_000_000


class PPM:
    """One language's context tree as a table of code lengths.

    Every node has a probability for each symbol: count / (total + distinct) for those seen in its
    context (escape method C), and for the others the escape probability times the parent's
    probability, renormalised over what the node has not seen (full exclusion). States are the
    nodes; the state before a byte is the longest context in the tree.
    """

    def __init__(self, texts: list[bytes], classes: np.ndarray, size: int):
        pad = np.full(ORDER, classes[10], np.int64)
        stream = np.concatenate([x for t in texts for x in (pad, classes[np.frombuffer(t, np.uint8)].astype(np.int64))] or [pad])
        fresh = np.concatenate([x for t in texts for x in (np.zeros(ORDER, bool), np.ones(len(t), bool))] or [pad < 0])
        at = np.flatnonzero(fresh)
        prob = np.full((1, size), 1.0 / size)
        rows, self.contexts, parents = [], [], np.zeros(1, np.int64)
        known = np.zeros(1, np.int64)  # contexts of the order before, sorted
        for order in range(ORDER + 1):
            code = np.zeros(len(at), np.int64)
            for back in range(order, 0, -1):
                code = code * size + stream[at - back]
            contexts, where, totals = np.unique(code, return_inverse=True, return_counts=True)
            keep = np.ones(len(contexts), bool) if order < 2 else totals >= LEAST_SEEN
            if order == 0 and not len(contexts):
                contexts, totals, keep = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool)
            counts = np.zeros((len(contexts), size))
            np.add.at(counts, (where, stream[at]), 1)
            contexts, counts = contexts[keep], counts[keep]
            if order:
                parents = np.searchsorted(known, contexts % size ** (order - 1))
            total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            base = prob[parents]
            rest = np.where(counts > 0, 0, base)
            mass = np.maximum(rest.sum(1, keepdims=True), 1e-300)
            escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
            # a node that has seen every symbol never escapes
            escape = np.where(distinct >= size, 0.0, escape)
            prob = np.where(counts > 0, counts / np.maximum(total + np.where(distinct >= size, 0, distinct), 1), escape * rest / mass)
            rows.append(prob)
            self.contexts.append(contexts)
            known = contexts
        self.size = size
        self.bits = -np.log2(np.maximum(np.concatenate(rows), 1e-300)).astype(np.float32)

    def states(self) -> np.ndarray:
        """The state for each code of ORDER symbols."""
        n, first = self.size, 0
        out = np.zeros(n**ORDER, np.int32)
        for order, contexts in enumerate(self.contexts):
            out.reshape(-1, n**order)[:, contexts] = first + np.arange(len(contexts), dtype=np.int32)
            first += len(contexts)
        return out

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The states for some codes of ORDER symbols, without a table of all codes."""
        out, first = np.zeros(len(codes), np.int32), 0
        for order, contexts in enumerate(self.contexts):
            if len(contexts):
                key = codes % self.size**order
                at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
                out = np.where(contexts[at] == key, first + at, out).astype(np.int32)
            first += len(contexts)
        return out


class Model:
    """The languages' trees over one alphabet: the bytes seen in training, and one symbol for the rest.

    seen: the alphabet, if it is more than that of the samples.
    """

    def __init__(self, samples: dict[str, list[bytes]], seen: np.ndarray | None = None):
        seen = np.zeros(256, bool) if seen is None else seen.copy()
        seen[10] = True
        for texts in samples.values():
            for t in texts:
                seen[np.unique(np.frombuffer(t, np.uint8))] = True
        self.classes = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int32)
        self.size = int(seen.sum()) + 1
        self.langs = sorted(samples)
        self.trees = [PPM(samples[x], self.classes, self.size) for x in self.langs]
        self._states: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_states": None}

    def parts(self, most_bytes: int) -> list[Model]:
        """Models of these languages in order, with tables of most_bytes or of one language each."""
        out: list[Model] = []
        size = 0
        for lang, tree in zip(self.langs, self.trees, strict=True):
            if not out or size + tree.bits.nbytes > most_bytes:
                size = 0
                part = copy.copy(self)
                part.langs, part.trees, part._states = [], [], None
                out.append(part)
            out[-1].langs.append(lang)
            out[-1].trees.append(tree)
            size += tree.bits.nbytes
        return out

    def code_lengths(self, data: np.ndarray, ends: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Bits of each text under each language: texts x languages.

        data: the texts' bytes one after another; ends: their ends. Works in pieces of a fixed
        length, so that memory does not grow with a text's length.
        """
        n_codes = self.size**ORDER
        if self._states is None and 4 * n_codes * len(self.trees) <= STATES_BYTES:
            self._states = [t.states() for t in self.trees]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out = np.zeros((len(ends), len(self.langs)))
        for low in range(0, int(ends[-1]) if len(ends) else 0, piece):
            high = min(low + piece, int(ends[-1]))
            symbols = self.classes[data[max(0, low - ORDER) : high]]
            symbols = np.concatenate([np.full(ORDER - (low - max(0, low - ORDER)), self.classes[10], np.int32), symbols])
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            cuts = np.maximum(starts[first:last], low) - low
            solid = starts[first:last] < ends[first:last]
            state = np.zeros(high - low, np.int32)
            near = np.full(high - low, ORDER, np.int32)  # bytes of its own text before each byte, up to ORDER
            for k in range(ORDER):
                at = starts[first:last][solid] + k
                at = at[(at >= low) & (at < np.minimum(ends[first:last][solid], high))] - low
                near[at] = k
            for back in range(ORDER, 0, -1):
                context = symbols[ORDER - back : ORDER - back + high - low]
                state = state * self.size + np.where(near >= back, context, self.classes[10])
            now = symbols[ORDER:]
            if self._states is None:  # each code that occurs is looked up once a tree
                present = np.zeros(n_codes, bool)
                present[state] = True
                codes, place = np.flatnonzero(present), np.zeros(n_codes, np.int32)
                place[codes] = np.arange(len(codes), dtype=np.int32)
                state = place[state]
            for x, tree in enumerate(self.trees):
                states = tree.find(codes) if self._states is None else self._states[x]
                bits = tree.bits.reshape(-1)[states[state] * self.size + now]
                sums = np.add.reduceat(bits, cuts[solid], dtype=np.float64) if solid.any() else np.zeros(0)
                out[np.arange(first, last)[solid], x] += sums
        return out


class Blocks:
    """Models of some languages each over one alphabet, in order of the names, as broadcasts."""

    def __init__(self, langs: list[str], parts: list[Broadcast]):
        self.langs, self.parts = langs, parts


def _bytes_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(256, bool)
    for batch in batches:
        for text in batch.column(0):
            seen[np.frombuffer(text.as_py(), np.uint8)] = True
    yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["seen"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, block_langs: int = BLOCK_LANGS, block_bytes: int = BLOCK_BYTES) -> Model | Blocks:
    """A model from a bounded sample of labelled documents (doc_id, text, lang).

    For every language: whole texts in the order of a hash of doc_id, up to sample_docs documents
    and sample_bytes bytes, without those that no longer fit; if all its texts are longer than that, the first one's first
    sample_bytes bytes. Rows with null text or lang do not count. Ties in the hash fall to the
    smaller text hash.

    The driver holds the keys of all samples, and the texts and trees of block_langs languages. An
    executor's Python worker holds tables of block_bytes at once, or of one language.
    """
    size = F.octet_length("text").cast("long")
    good = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (size > 0))
    order = Window.partitionBy("lang").orderBy("long", "draw", "th")
    drawn = (
        good.select("lang", size.alias("size"), (size > sample_bytes).alias("long"), F.xxhash64("doc_id").alias("draw"), F.xxhash64("text").alias("th"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= sample_docs)
        .collect()
    )
    room, chosen = dict.fromkeys((r["lang"] for r in drawn), sample_bytes), set()
    for r in sorted(drawn, key=lambda r: (r["lang"], r["nth"])):
        size = min(r["size"], sample_bytes) if r["nth"] == 1 else r["size"]
        if size <= room[r["lang"]]:
            room[r["lang"]] -= size
            chosen.add((r["lang"], r["draw"], r["th"]))
    spark = docs.sparkSession
    langs = sorted({lang for lang, *_ in chosen})
    keys = spark.createDataFrame(list(chosen) or [("", 0, 0)], "lang string, draw bigint, th bigint")
    found = good.select("lang", F.xxhash64("doc_id").alias("draw"), F.xxhash64("text").alias("th"), F.substring(F.encode("text", "UTF-8"), 1, sample_bytes).alias("text"))

    def texts(sample: DataFrame) -> dict[str, list[bytes]]:
        samples: dict[str, list[bytes]] = {}
        for r in sample.collect():
            samples.setdefault(r["lang"], []).append(bytes(r["text"]))
        return {k: sorted(v) for k, v in samples.items()}

    if len(langs) <= block_langs:
        whole = Model(texts(found.join(F.broadcast(keys), ["lang", "draw", "th"]).dropDuplicates(["lang", "draw", "th"])))
        parts = whole.parts(block_bytes)
        return whole if len(parts) < 2 else Blocks(langs, [spark.sparkContext.broadcast(m) for m in parts])
    sample = durable(found.join(keys, ["lang", "draw", "th"]).dropDuplicates(["lang", "draw", "th"]).select("lang", "text"))
    seen = np.zeros(256, bool)
    for r in sample.select("text").mapInArrow(_bytes_seen, "seen binary").collect():
        seen |= np.frombuffer(bytes(r["seen"]), bool)
    blocks = [langs[i : i + block_langs] for i in range(0, len(langs), block_langs)]
    return Blocks(langs, [spark.sparkContext.broadcast(m) for b in blocks for m in Model(texts(sample.where(F.col("lang").isin(b))), seen).parts(block_bytes)])


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _has_letter(raw: np.ndarray) -> bool:
    if _ASCII_LETTER[raw].any():
        return True
    return bool((raw >= 128).any()) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))


def identify(docs: DataFrame, model: Model | Blocks) -> DataFrame:
    """docs plus lang_pred, score and bits (a byte, under the predicted language).

    lang_pred is the language whose tree gives the whole text the shortest code, the first by
    name in a tie; score is its share of the languages' probabilities, 0 to 1. Null texts and
    texts without a letter get 'und', score 0 and null bits, as do all texts if nothing was
    learned. Repeated rows keep their rows. Columns of docs with the results' names are replaced.

    Batches of rows are scored byte-parallel, in pieces of a fixed size; there is no shuffle. Of
    Blocks one is in memory at a time, and each batch of rows meets all of them.
    """
    names = ("lang_pred", "score", "bits")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    parts = model.parts if isinstance(model, Blocks) else [docs.sparkSession.sparkContext.broadcast(model)]
    learned = bool(model.langs)
    column = kept.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(column).cast(pa.large_binary()).fill_null(b"")
            if not len(raw):
                continue
            bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            usable = np.array([_has_letter(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) & learned
            names_, least, share = np.full(len(raw), "und", object), np.zeros(len(raw)), np.zeros(len(raw))
            for k, part in enumerate(parts if learned else []):
                m = part.value
                if len(parts) > 1:
                    part.__dict__.pop("_value", None)  # else the worker keeps every block
                lengths = m.code_lengths(data, bounds[1:])
                best = lengths.argmin(1)
                low = lengths[np.arange(len(best)), best]
                mass = np.exp2(-np.minimum(lengths - low[:, None], 1000)).sum(1)
                if k:  # probabilities are sums over the blocks so far, relative to the best of them
                    under = np.minimum(least, low)
                    mass = mass * np.exp2(-np.minimum(low - under, 1000)) + np.exp2(-np.minimum(least - under, 1000)) / share
                better = (low < least) | (k == 0)
                names_ = np.where(better, np.array(m.langs, object)[best], names_)
                least, share = np.where(better, low, least), 1 / mass
            rate = least / np.maximum(np.diff(bounds), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x if u else "und" for x, u in zip(names_, usable, strict=True)], pa.string()),
                    pa.array(np.where(usable, share, 0.0), pa.float64()),
                    pa.array(rate, pa.float64(), mask=~usable),
                ],
                names=[*batch.schema.names, *names],
            )

    return kept.mapInArrow(score, schema)


def held_out() -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def op10_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits")
