"""Operators on single texts against brute force: pseudonyms, quality, line dedup, BPE, language."""

import base64
import hashlib
import random
import re

import pytest

from certloom.llm import byte_bpe, language_id, line_dedup, pii, quality

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df):
    """Rows in an order that repeats and nulls cannot upset."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- pseudonyms ---

VALUES = {
    "4929348385146306": True, "4929 3483-8514 6306": True, "9807915762804490": False, "+1 (017) 555-7713": True, "97.51.17.173": True, "256.1.1.1": False,
    "und.34@mail7.example.com": True, "2024-02-29": True, "2023-02-29": False, "31.12.1999": True, "12/25/2020": True, "25/12/2020": True,
    "123-45-6789": True, "000-45-6789": False, "666-45-6789": False, "DE89370400440532013000": True, "DE88370400440532013000": False, "GB82WEST12345698765432": True, "4.0.": False,
}


@pytest.fixture(scope="module")
def pseudonyms(spark):
    rows = [(i, f"see {v}, or {v}.") for i, v in enumerate(VALUES)]
    df = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").cache()
    back = pii.pseudonymise(df.select("doc_id", "text"), "key", back=True)
    return {r["doc_id"]: r for r in df.collect()}, {r["doc_id"]: r["text"] for r in back.collect()}


@pytest.mark.parametrize("at", range(len(VALUES)))
def test_pseudonym_keeps_format_and_inverts(pseudonyms, at):
    (value, private), (new, back) = list(VALUES.items())[at], pseudonyms
    text = new[at]["text"]
    first, second = re.fullmatch(r"see (.*), or (.*)\.", text).groups()
    assert first == second and back[at] == f"see {value}, or {value}."
    assert (first != value) == private and (new[at]["n_replaced"] == 2) == private
    assert re.sub(r"\d", "9", first) == re.sub(r"\d", "9", value) or "@" in value or re.fullmatch(r"[\d.]+", value)
    if private and len(value) >= 16 and value[0] == "4":
        digits = [int(c) for c in re.sub(r"\D", "", first)][::-1]
        assert sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) == sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
        assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


#: Texts with values side by side, and the values in them that must go.
BESIDE = {
    "+1 (826) 555-4081 190.137.223.204": ["+1 (826) 555-4081", "190.137.223.204"],
    "+1 (843) 555-7672 170.106.47.218": ["+1 (843) 555-7672", "170.106.47.218"],
    "+1 826-555-4081 826-555-4082": ["+1 826-555-4081", "826-555-4082"],
    "+1 826 555-4081 99.john@example.com": ["+1 826 555-4081", "99.john"],
    "+1 826 5554081 4111 1111 1111 1111": ["+1 826 5554081", "4111 1111 1111 1111"],
    "+1 826 555 4081 4111 1111 1111 1111": ["+1 826 555 4081", "4111 1111 1111 1111"],
    "+1 (826) 555-4081 4111 1111 1111 1111 190.137.223.204": ["+1 (826) 555-4081", "4111 1111 1111 1111", "190.137.223.204"],
    "+49 30 123-45-6789": ["+49 30 123-45-6789"],
    "4111 1111 1111 1111 123": ["4111 1111 1111 1111"],
    "12 4111 1111 1111 1111": ["4111 1111 1111 1111"],
    "4111 1111 1111 1111 190.137.223.204": ["4111 1111 1111 1111", "190.137.223.204"],
    "4111-1111-1111-1111 123-45-6789": ["4111-1111-1111-1111", "123-45-6789"],
    "3782 822463 10005 3714 496353 98431": ["3782 822463 10005", "3714 496353 98431"],
    "BE68 5390 0754 7034 USD 100": ["BE68 5390 0754 7034"],
    "BE68 5390 0754 7034 4111 1111 1111 1111": ["BE68 5390 0754 7034", "4111 1111 1111 1111"],
    "BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00": ["BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"],
    "1234 5678 9012 3456": [],
    "7 " * 3000 + "\n4111 1111 1111 1111": ["4111 1111 1111 1111"],
}


def test_values_side_by_side(spark):
    df = spark.createDataFrame(list(enumerate(BESIDE)), "doc_id long, text string")
    alone = sorted({v for values in BESIDE.values() for v in values} - {"99.john"})
    one = {r["value"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame([(v, v) for v in alone], "value string, text string"), "key").collect()}
    rows = {r["doc_id"]: r for r in pii.pseudonymise(df, "key").collect()}
    for at, (text, values) in enumerate(BESIDE.items()):
        assert rows[at]["n_replaced"] == len(values), text[-60:]
        for v in values:
            text = text.replace(v, one.get(v, v))
        if "99.john" not in values:
            assert rows[at]["text"] == text and not any(v in text for v in values)
        else:
            assert "99.john" not in rows[at]["text"]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    key, mods = F.lit("k"), [F.lit(7).cast("long"), F.lit(11).cast("long")]
    df = spark.range(77).select("id", pii.feistel(F.col("id") % 7, (F.col("id") / 7).cast("long"), *mods, key, F.lit("t")).alias("p"))
    out = df.select("id", "p", pii.feistel(F.col("p.a"), F.col("p.b"), *mods, key, F.lit("t"), back=True).alias("q")).collect()
    assert len({tuple(r["p"]) for r in out}) == 77 and all(r["q"]["a"] + 7 * r["q"]["b"] == r["id"] for r in out)


def test_pseudonyms_leave_other_texts_alone(docs, no_docs):
    out = pii.pseudonymise(docs, "key")
    assert out.columns == [*[c for c in docs.columns if c != "text"], "text", "n_found", "n_replaced"]
    assert by_row(out.select("doc_id", "text")) == by_row(docs.select("doc_id", "text")) and out.count() == docs.count()
    assert pii.pseudonymise(no_docs, "key").count() == 0


# --- quality ---


def repeats(words, least):
    """Words covered by repeats of `least` words, and the longest repeat."""
    seen, hit, longest = {}, set(), 0
    for i in range(len(words) - least + 1):
        seen.setdefault(tuple(words[i : i + least]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                hit |= set(range(i, i + least))
            for a in places:
                for b in places:
                    k = 0
                    while a < b and b + k < len(words) and words[a + k] == words[b + k]:
                        k += 1
                    longest = max(longest, k)
    return hit, longest


def expected_quality(text):
    words = BLANK.findall(text or "")
    five, _ = repeats(words, 5)
    eight, longest = repeats(words, 8)
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    failed = len(words) < 10 or 100 * len(five) > 20 * len(words)
    chars, part = sum(map(len, words)), sum(len(words[i]) for i in eight)
    kept = not failed and part <= 0.2 * chars and longest <= 40
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(five), part, longest, failed, kept


def test_quality_equals_brute_force(docs, no_docs):
    out = quality.repetition(docs)
    assert out.count() == docs.count() and quality.repetition(no_docs).count() == 0
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat", "base_failed", "kept"]
    for r in out.select("text", *names).distinct().collect():
        if r["text"] is None or len(r["text"]) < 6000:
            assert tuple(r)[1:] == expected_quality(r["text"]), r["text"]


def test_suffix_array_of_random_words():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        lists = [[rng.randint(0, rng.choice([0, 1, 5])) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        flat = [w for x in lists for w in x]
        owner = [d for d, x in enumerate(lists) for _ in x]
        sa, lcp = quality.suffix_array(np.array(flat, np.int64), np.array(owner, np.int64))
        suffix = lambda i: (owner[i], [flat[j] for j in range(i, len(flat)) if owner[j] == owner[i]])
        assert list(sa) == sorted(range(len(flat)), key=suffix)
        for a, b, k in zip(sa, sa[1:], lcp[1:], strict=False):
            x, y = suffix(a), suffix(b)
            n = 0
            while x[0] == y[0] and n < min(len(x[1]), len(y[1])) and x[1][n] == y[1][n]:
                n += 1
            assert n == k


# --- line dedup ---


def expected_lines(corpus, min_docs=3):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(line_dedup.BLANKS))
    holders = {}
    for doc, text in corpus:
        for line in (text or "").split("\n") if doc is not None else []:
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in corpus:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(key(x)) >= 20 and len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)]) for x in lines]
        out.append((doc, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_line_dedup_equals_brute_force(docs, no_docs, corpus, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    out = line_dedup.dedup_lines(docs)
    assert by_row(out.select("doc_id", "text", "n_lines", "n_dropped")) == expected_lines(corpus)
    assert set(docs.columns) <= set(out.columns) and line_dedup.dedup_lines(no_docs).count() == 0


def test_line_keys_fold_ascii_only(spark):
    lines = ["ÉCOLE PRIMAIRE SUPÉRIEURE", "École Primaire supÉrieure", "école primaire supérieure", "ÉCOLE primaire SUPÉRIEURE", "École PRIMAIRE SUPÉRIEURE"]
    rows = [(i, x) for i, x in enumerate(lines)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(out.select("doc_id", "text", "n_lines", "n_dropped")) == expected_lines(rows)


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.public_encoder()


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(encoder, reference):
    assert sorted(encoder.hash.order) == list(range(encoder.hash.n))
    assert all(encoder.rank(k) == i for k, i in list(reference._mergeable_ranks.items())[::7])
    assert encoder.rank(b"\x00\xff not in it") == -1


def test_bpe_equals_the_library(docs, no_docs, encoder, reference):
    out = byte_bpe.encode_documents(docs, encoder)
    rows = out.select("text", "ids", "decoded").collect()
    assert len(rows) == docs.count() and byte_bpe.encode_documents(no_docs, encoder).count() == 0
    for text, ids, decoded in rows:
        assert list(ids) == reference.encode_ordinary(text or "") and bytes(decoded) == (text or "").encode()
    n, ids_hash, decoded_hash = out.where("doc_id = 305").select(*byte_bpe.digests()).first()
    text = next(t for t, *_ in rows if t and t.startswith("Ün"))
    want = reference.encode_ordinary(text)
    assert (n, ids_hash) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert decoded_hash == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_texts(encoder, reference):
    rng, cache = random.Random(5), byte_bpe._Cache(encoder)
    letters = "ab AB\t\n\r\x0b\x1c\x1f\x85\xa0 ​'stmreld09½²٣éßЖ中🙂👍🏽﻿<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert list(encoder.encode(text, cache)) == reference.encode_ordinary(text), repr(text)
    long = "ab" * 5000 + " é" * 150_000
    assert list(encoder.encode(long, cache)) == reference.encode_ordinary(long)


# --- language ---


def slow_bits(model, text, at):
    """The code length of a text by walking the tree's tables symbol by symbol."""
    tree = model.trees[at]
    states, pad, out = tree.states(), int(model.classes[10]), 0.0
    symbols = [int(model.classes[b]) for b in text]
    for i, s in enumerate(symbols):
        code = 0
        for back in range(language_id.ORDER, 0, -1):
            code = code * tree.size + (symbols[i - back] if i >= back else pad)
        out += float(tree.bits[states[code], s])
    return out


def test_ppm_codes_are_exact():
    import numpy as np

    model = language_id.Model({"a": [b"abracadabra abracadabra", b"banana"], "b": [b"zyx zyxw zyx", "é".encode()]})
    for tree in model.trees:
        assert np.allclose(np.exp2(-tree.bits.astype(float)).sum(1), 1, atol=1e-3)
    texts = [b"", b"banana abra", b"zyx", "é!".encode(), b"abra" * 50]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for piece in (3, 7, 10_000):
        got = model.code_lengths(data, ends, piece)
        assert np.allclose(got, [[slow_bits(model, t, k) for k in range(2)] for t in texts], rtol=1e-4)


def test_language_of_documents(spark, docs, no_docs):
    samples = {"en": "the cat sat on the mat with the hat", "de": "der hund und die katze sind nicht schön", "fr": "le chat est sur la table avec l'été"}
    rng = random.Random(1)
    rows = []
    for lang, words in samples.items():
        for i in range(60):
            rows.append((len(rows), " ".join(rng.choice(words.split()) for _ in range(30)), lang))
    rows += [(900, "unlabelled text", None), (901, None, "en"), (902, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out()))
    assert model.langs == ["de", "en", "fr"]
    found = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, t, lang in rows if lang and t)
    assert found[901]["lang_pred"] == found[902]["lang_pred"] == "und" and found[901]["score"] == 0
    out = language_id.identify(docs, model)
    und = {r["doc_id"] for r in out.where("lang_pred = 'und'").collect()}
    assert {300, 301, 302, 303} <= und and not {304, 305, 501} & und and out.count() == docs.count()
    assert all(0 <= r["score"] <= 1 for r in out.select("score").collect())
    empty = language_id.train(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(df, empty).collect()} == {"und"} and language_id.identify(no_docs, model).count() == 0


def test_every_label_is_learned(spark):
    import numpy as np

    rng = random.Random(8)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(k, lang) for k, lang in enumerate(words) for _ in range(5 if k < 64 else 3)]
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, (_, lang) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    blocks, whole = language_id.train(df, block_langs=16), language_id.train(df, block_langs=100)
    assert len(blocks.parts) == 5 and blocks.langs == whole.langs == sorted(words)
    found = {r["doc_id"]: r for r in language_id.identify(df, blocks).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows)
    for r in language_id.identify(df, whole).collect():
        got = found[r["doc_id"]]
        assert got["lang_pred"] == r["lang_pred"] and got["score"] == pytest.approx(r["score"]) and got["bits"] == pytest.approx(r["bits"])
    small = language_id.train(df.where("lang < 'l06'"), block_bytes=1)
    assert len(small.parts) == 6
    few = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df.where("lang < 'l06'"), small).collect()}
    assert all(few[i] == lang for i, _, lang in rows if lang < "l06")
    for tree in whole.trees[:3]:
        assert (tree.find(np.arange(tree.size**3)) == tree.states()).all()


def test_codes_are_the_same_without_tables(monkeypatch):
    import numpy as np

    model = language_id.Model({"a": [b"abracadabra abracadabra"], "b": [b"zyx zyxw zyx"]})
    data, ends = np.frombuffer(b"banana abrazyx", np.uint8), np.array([6, 6, 14])
    with_tables = model.code_lengths(data, ends, 5)
    model._states = None
    monkeypatch.setattr(language_id, "STATES_BYTES", 0)
    assert np.array_equal(model.code_lengths(data, ends, 5), with_tables)


def test_language_of_long_texts_only(spark):
    rows = [(1, "the cat sat on the mat " * 50, "en"), (2, "der hund und die katze", "de")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=200)
    assert model.langs == ["de", "en"]


def test_a_text_that_does_not_fit_is_passed_over(spark):
    from pyspark.sql import functions as F

    ids = [r["id"] for r in spark.range(20).orderBy(F.xxhash64("id")).collect()]
    texts = ["a" * 150, "b" * 60, *["c" * 10] * 5]  # in the order of the draw
    rows = [(i, f"{t}{k}", "en") for k, (i, t) in enumerate(zip(ids, texts, strict=False))]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=200)
    assert all(model.classes[ord(c)] < model.size - 1 for c in "ac") and model.classes[ord("b")] == model.size - 1
