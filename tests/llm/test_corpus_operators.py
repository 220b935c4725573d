"""Operators across documents against brute force: sharding, substrings, decontamination, joins, URL lists, pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest

from certloom.llm import decontaminate, jaccard_join, registry, sharding, substring_dedup, suffix_groups, url_filter


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- sharding ---


def test_shards_are_exact_and_gapless(docs, no_docs):
    out = sharding.shuffle_to_shards(docs, shards=5, partitions=8)
    rows = out.select("doc_id", "text", "shard", "slot").collect()
    assert rows_of(out.select("doc_id", "text", "n_words")) == rows_of(docs.select("doc_id", "text", "n_words"))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shuffle_to_shards(no_docs).count() == 0


def test_shuffle_is_uniform(spark):
    """Each row reaches each shard about equally often over seeds."""
    df = spark.range(12).repartition(3)
    hits = Counter()
    for seed in range(12):
        hits.update((r["id"], r["shard"]) for r in sharding.shuffle_to_shards(df, shards=3, seed=seed, partitions=4).collect())
    assert sum(hits.values()) == 144 and max(hits.values()) <= 10 and len(hits) >= 30


def test_matrix_sums_and_distribution():
    rows, shards = {0: 10, 1: 0, 2: 25, 3: 7}, [14, 14, 14]
    for seed in range(50):
        matrix = sharding.communication_matrix(rows, shards, seed)
        counts = [[b - a for a, b in zip([0, *ends], ends, strict=False)] for _, ends in matrix]
        assert [sum(c) for c in counts] == [rows[p] for p, _ in matrix] and [sum(c) for c in zip(*counts, strict=True)] == shards
    rng, n = random.Random(1), 20_000
    drawn = Counter(sharding.hypergeometric(rng, 6, 10, 5) for _ in range(n))
    for k in range(6):
        assert drawn[k] / n == pytest.approx(math.comb(6, k) * math.comb(10, 5 - k) / math.comb(16, 5), abs=0.015)


# --- substring dedup ---


def expected_removals(corpus, n=100):
    """By doc_id and text: bytes, removed, runs, hash. Rows with an id, in the operator's order of texts."""
    seen, out = set(), {}
    for doc, text in sorted({r for r in corpus if r[0] is not None and r[1] is not None}, key=lambda r: r[0]):
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - n + 1):
            if (s := raw[i : i + n]) in seen:
                gone[i : i + n] = [True] * n
            seen.add(s)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc, text] = len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize(("together", "rows"), [(64, 4_000_000), (2, 0)])
def test_substrings_equal_brute_force(docs, no_docs, corpus, monkeypatch, together, rows):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", rows)
    want = expected_removals(corpus)
    out = substring_dedup.remove_repeats(docs)
    assert out.count() == docs.count()
    for r in out.select("doc_id", "text", "n_bytes", "spans", "kept").collect():
        expected = want.get((r["doc_id"], r["text"]), (len((r["text"] or "").encode()), 0, 0, (r["text"] or "").encode()))
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) == expected
    if together == 64:
        assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_grouped_suffix_arrays():
    import numpy as np

    rng = random.Random(3)
    strings = []
    for _ in range(400):
        k, n = rng.choice([1, 2, 3, 20]), rng.randint(0, 40)
        unit = [rng.randint(1, k) for _ in range(rng.randint(1, 5))]
        strings.append(((unit * 40)[:n] if rng.random() < 0.3 else [rng.randint(1, k) for _ in range(n)]) + [0])
    flat, starts = np.array([x for s in strings for x in s]), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    sa, factors = suffix_groups.suffix_arrays(flat, starts), suffix_groups.previous_factors(flat, starts)
    for i, s in enumerate(strings):
        assert (sa[starts[i] : starts[i + 1]] - starts[i]).tolist() == sorted(range(len(s)), key=lambda j: s[j:])
        common = lambda a, b: next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b)
        assert factors[starts[i] : starts[i + 1]].tolist() == [max((common(a, b) for a in range(b)), default=0) for b in range(len(s))]


def test_every_string_has_one_anchor():
    import numpy as np

    rng = random.Random(1)
    texts = [rng.randbytes(3000), b"", b"ab" * 150, rng.randbytes(99), b"z" * 100, rng.randbytes(100)]
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    key, context, text, start, left, width = substring_dedup.anchored(data, bounds)
    starts = sorted((t, i) for t, a, w in zip(text.tolist(), start.tolist(), width.tolist(), strict=True) for i in range(a, a + w + 1))
    assert starts == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 99)]
    alone = substring_dedup.anchored(np.frombuffer(texts[0], np.uint8), np.array([0, 3000]))
    assert alone[0].tolist() == key[text == 0].tolist() and alone[1].tolist() == context[text == 0].tolist()
    cores = defaultdict(set)
    for k, t, a, l in zip(key.tolist(), text.tolist(), start.tolist(), left.tolist(), strict=True):  # noqa: E741
        low, high = next(p for p in substring_dedup.PARTS if l <= p[1])
        cores[k].add((low, texts[t][a + l - low : a + l + 100 - high]))
    assert all(len(c) == 1 for c in cores.values()) and len(cores) == len(set.union(*cores.values()))


# --- decontamination ---


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(10, len(v))
        for k in range(len(v) - size + 1) if v else ():
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[k : k + size]:
                    hit |= set(range(i, i + size))
                    found |= {item} - {None}
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark, docs, no_docs, corpus, monkeypatch):
    base = next(t for i, t in corpus if i == 200)
    long = base.split(" ")
    items = [(1, " ".join(long[5:40]).upper()), (2, "shared BY many"), (3, "ÉCOLE, ssß"), (4, ""), (5, None), (6, "é"), (7, "twice the same row"), (1, "another text"), (None, "same id"), (8, " ".join(long[20:29]) + " other words here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 7):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", block if block > 7 else 0)
        out = decontaminate.contaminated_words(docs, benchmark, block_rows=block)
        got = rows_of(out.select("doc_id", "text", "n_words", "n_hit", "n_items", "items"))
        assert got == sorted(((i, t, n, h, len(f), f) for i, t in corpus for n, h, f in [expected_hits(t, items)]), key=repr)
    assert {r["n_hit"] for r in decontaminate.contaminated_words(docs, benchmark.limit(0)).collect()} == {0}
    assert decontaminate.contaminated_words(no_docs, benchmark).count() == 0


# --- near duplicates ---


def expected_classes(corpus):
    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))

    vertices = sorted({(i, t) for i, t in corpus if i is not None and shingles(t)}, key=repr)
    sets = {v: shingles(v[1]) for v in vertices}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = {v: {u for u in vertices if u != v and similar(u, v)} for v in vertices}
    out = {}
    for v in vertices:
        group, todo = {v}, [v]
        while todo:
            for u in near[todo.pop()] - group:
                group.add(u)
                todo.append(u)
        out[v] = min(i for i, _ in group), len(near[v]), len({sets[u] for u in near[v] if sets[u] != sets[v]})
    return out


@pytest.mark.parametrize("small", [256, 2])
def test_near_duplicates_equal_brute_force(docs, no_docs, corpus, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "TILE", small)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 500_000 if small > 2 else 0)
    want = expected_classes(corpus)
    out = jaccard_join.near_duplicates(docs)
    assert out.count() == docs.count()
    for r in out.select("doc_id", "text", "class_id", "n_links", "n_link_texts").collect():
        assert tuple(r)[2:] == want.get((r["doc_id"], r["text"]), (r["doc_id"], 0, 0)), r
    if small == 256:
        assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(docs, corpus):
    want = expected_classes(corpus)
    kept = {(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {v for v in corpus if v not in want or want[v][0] == v[0]}
    assert jaccard_join.one_of_each(docs).count() == len(kept)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 301), (301, 302), (302, 300)]
    found = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[200] == 100 and found[301] == found[302] == 300


def test_runs_reach_the_recall():
    runs = jaccard_join.runs_needed()
    assert 1 - (1 - 0.8**jaccard_join.LEVELS) ** runs >= jaccard_join.RECALL > 1 - (1 - 0.8**jaccard_join.LEVELS) ** (runs - 1)


# --- URL lists ---


def expected_verdict(url, at, entries):
    if url is None or at is None:
        return False, None, 0
    host = (re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url.strip()) or [None, ""])[1].lower()
    labels = host.split(".")
    plain = re.sub("/$", "", re.sub("#.*$", "", url.strip()))
    names = [f"url:{plain}", f"host:{host}", *(f"domain:{'.'.join(labels[i:])}" for i in range(len(labels)))]
    active = []
    for name in names:
        past = sorted((t, a) for p, a, t in entries if p == name and a in ("add", "remove") and t is not None and t <= at)
        if past and past[-1][1] == "add":
            active.append(name)
    return bool(active), active[0] if active else None, len(active)


def test_url_lists_equal_brute_force(spark):
    day, rng = date(2024, 1, 1), random.Random(4)
    urls = ["http://a.b.test/x#f", "https://user@B.test:80/", "ftp://c.test", "no url", "", None, "http://a.b.test/x", "http://a.b.test/x"]
    patterns = ["url:http://a.b.test/x", "host:a.b.test", "domain:b.test", "domain:test", "host:c.test", "host:", None]
    entries = [(rng.choice(patterns), rng.choice(["add", "remove", "note", None]), day + timedelta(days=rng.randint(0, 9))) for _ in range(60)] + [("domain:test", "add", None)]
    captures = [(i, u, None if i == 3 else day + timedelta(days=rng.randint(0, 9)), "x") for i, u in enumerate(urls * 4)]
    listed = spark.createDataFrame(entries, "pattern string, action string, at date")
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at date, pattern string")
    for most in (1000, 0):
        out = {r["page_id"]: r for r in url_filter.active_entries(df, listed, most).collect()}
        assert len(out) == len(captures)
        for i, u, at, _ in captures:
            assert (out[i]["blocked"], out[i]["matched"], out[i]["n_active"]) == expected_verdict(u, at, entries), (u, at)
    assert {r["blocked"] for r in url_filter.active_entries(df, listed.limit(0)).collect()} == {False}
    assert url_filter.active_entries(df.limit(0), listed).count() == 0


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, tables), duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_pipeline_stages(spark, tables):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "byte_bpe"]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert not {300, 301, 302, 303, 204, 201, 202} & set(out) and {200, 304, 305, 400, 501} <= set(out)
    assert all(len(r["ids"]) == r["n_tokens"] and re.fullmatch("[0-9a-f]{64}", r["ids_sha256"]) for r in out.values())
    assert out[304]["decoded_sha256"] == hashlib.sha256("é".encode()).hexdigest()


def test_pipeline_equals_brute_force(spark, tables):
    import public_tokenizers
    import tiktoken
    from test_text_operators import base64, expected_lines

    import corpus_pipeline

    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if any(map(str.isalpha, t or ""))]
    rows = [(i, t) for i, t, _, _ in expected_lines(rows)]
    classes = expected_classes(rows)
    rows = [v for v in rows if v not in classes or classes[v][0] == v[0]]
    rows = [(i, t) for i, t in rows if not expected_hits(t, items)[1]]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (reference.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, tables).collect()}
    assert got == want
