"""Every opN_ query, with its production parameters and columns, against brute force of its contract."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from test_corpus_operators import expected_classes, expected_removals
from test_text_operators import BLANK, expected_quality, reference  # noqa: F401

from certloom.llm import language_id, pii, quality, registry


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, tables):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def results(spark, tables):
    """name -> {doc_id: row} of the queries over documents, each run once."""
    held = {}

    def get(name):
        if name not in held:
            rows = registry.QUERIES[name](spark, tables).collect()
            held[name] = {r["doc_id"]: r for r in rows}
            assert len(held[name]) == len(rows)
        return held[name]

    return get


# --- op1: an independent Feistel network ---


def feistel(a, b, mod_a, mod_b, key, tweak):
    def draw(turn, value):
        return int(sha(f"{key}|{tweak}|{turn}|{value}")[:15], 16)

    for turn in range(10):
        if turn % 2 == 0:
            a = (a + draw(turn, b)) % mod_a
        else:
            b = (b + draw(turn, a)) % mod_b
    return a, b


def chars(text, alphabet, key, tweak):
    half, base, out = 13 if len(alphabet) > 10 else 18, len(alphabet), ""
    for i in range((max(len(text), 1) - 1) // (2 * half) + 1):
        part = text[2 * half * i : 2 * half * (i + 1)]
        n_a = len(part) // 2
        value = lambda x: sum(alphabet.index(c) * base**k for k, c in enumerate(reversed(x)))
        write = lambda v, n: "".join(alphabet[v // base**k % base] for k in reversed(range(n)))
        a, b = feistel(value(part[:n_a]), value(part[n_a:]), base**n_a, base ** (len(part) - n_a), key, f"{tweak}#{i}#{len(text)}")
        out += write(a, n_a) + write(b, len(part) - n_a)
    return out


def refill(value, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in value)


def luhn_check(body):
    total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(reversed(body)))
    return str(-total % 10)


def day_pseudonym(day, key):
    from datetime import date, timedelta

    start = date(1800, 1, 1)
    late = lambda n: (start + timedelta(n)).day > 12
    n = (day - start).days

    def step(x):
        a, b = feistel(x // 773, x % 773, 189, 773, key, "date")
        return a * 773 + b

    to = step(n)
    while late(to) != late(n):
        to = step(to)
    return start + timedelta(to)


def pseudonym(kind, value, key):
    from datetime import datetime

    digits = re.sub(r"\D", "", value)
    if kind == "card":
        body = chars(digits[:-1], "0123456789", key, "card")
        return refill(value, body + luhn_check(body))
    if kind == "ip":
        o = [int(x) for x in value.split(".")]
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ssn":
        area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
        a, b = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "phone":
        return refill(value, digits[0] + chars(digits[1:], "0123456789", key, "phone" + digits[0]))
    if kind == "iban":
        plain = value.replace(" ", "")
        account = refill(plain[4:], chars(re.sub(r"\D", "", plain[4:]), "0123456789", key, "iban" + plain[:2]))
        number = int("".join(str(int(c, 36)) for c in account + plain[:2] + "00"))
        return f"{plain[:2]}{98 - number % 97:02d}{account}"
    if kind == "email":
        local, domain = value.split("@")
        letters = iter(chars(re.sub("[^a-z]", "", local), "abcdefghijklmnopqrstuvwxyz", key, "email" + domain))
        local = "".join(next(letters) if c.isalpha() else c for c in local)
        number = re.sub(r"\D", "", local)
        return (refill(local, chars(number, "0123456789", key, "email" + domain)) if number else local) + "@" + domain
    form = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y", "eu": "%d/%m/%Y"}[kind]
    return day_pseudonym(datetime.strptime(value, form).date(), key).strftime(form)


VALUES = [
    ("card", "4929348385146306"), ("card", "4929 3483-8514 6306"), ("card", "378282246310005"), ("ip", "97.51.17.173"), ("ip", "0.0.0.0"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"),
    ("phone", "+1 (017) 555-7713"), ("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432"), ("email", "und.34@mail7.example.com"), ("email", "abcdefghijklmnopqrstuvwxyzabcdefg@x.example"),
    ("-", "2024-02-29"), (".", "29.02.2024"), ("/", "02/29/2024"), ("eu", "29/02/2024"), ("-", "1800-01-01"), ("/", "01/01/1800"), ("-", "2199-12-31"), ("eu", "31/12/2199"),
]


def test_op1_equals_an_independent_network(spark, tmp_path):
    rows = [(i, f"see {v}, or {v}.") for i, (_, v) in enumerate(VALUES)] + [(100, None), (101, ""), (102, "no values é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["op1_feistel_pseudonyms"](spark, str(tmp_path))
    assert sorted(out.columns) == ["doc_id", "n_found", "n_replaced", "text"]
    found = {r["doc_id"]: r for r in out.collect()}
    for i, (kind, value) in enumerate(VALUES):
        new = pseudonym(kind, value, pii.DEMO_KEY)
        assert (found[i]["text"], found[i]["n_found"], found[i]["n_replaced"]) == (f"see {new}, or {new}.", 2, 2), value
    assert [(found[i]["text"], found[i]["n_found"]) for i in (100, 101, 102)] == [(None, 0), ("", 0), ("no values é", 0)]
    iso, dot, us, eu = (found[i]["text"].split(",")[0][4:] for i in range(12, 16))
    assert len({(iso[:4], iso[5:7], iso[8:]), (dot[6:], dot[3:5], dot[:2]), (us[6:], us[:2], us[3:5]), (eu[6:], eu[3:5], eu[:2])}) == 1


def test_op1_keeps_all_columns(spark):
    names = ["old", "new", "row", "_found_values", "_found_values_new", "n_found"]
    df = spark.createDataFrame([("4929348385146306", *names)], ", ".join(f"{c} string" for c in ("text", *names)))
    out = pii.pseudonymise(df, "k")
    r = out.first()
    assert out.columns == [*names[:-1], "text", "n_found", "n_replaced"] and all(r[c] == c for c in names[:-1]) and r["n_replaced"] == 1
    assert pii.pseudonymise(df.select("text"), "k").columns == ["text", "n_found", "n_replaced"]


# --- op2 ---


def maximal_repeats(words, least):
    """Strings of words that occur twice or more and cannot grow on either side in all their places."""
    n, found = 0, defaultdict(list)
    for size in range(least, len(words)):
        found.clear()
        for i in range(len(words) - size + 1):
            found[tuple(words[i : i + size])].append(i)
        for places in found.values():
            if len(places) > 1:
                left = {words[i - 1] if i else (i,) for i in places}
                right = {words[i + size] if i + size < len(words) else (i,) for i in places}
                n += (len(left) > 1 or () in left or any(isinstance(x, tuple) for x in left)) and (len(right) > 1 or any(isinstance(x, tuple) for x in right))
    return n


def test_op2(results, texts):
    got = results("op2_suffix_array_quality")
    assert set(got) == set(texts)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat", "base_failed", "kept"]
    for doc, text in texts.items():
        words = BLANK.findall(text or "")
        if len(words) < 700:
            assert tuple(got[doc][c] for c in names) == expected_quality(text), doc
            assert got[doc]["n_repeats"] == maximal_repeats(words, quality.MIN_REPEAT), doc
    assert max(len(t or "") for t in texts.values()) > 6000


def test_repeats_of_random_words():
    import numpy as np

    rng = random.Random(6)
    for _ in range(300):
        words = [rng.randint(0, rng.choice([0, 1, 2])) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            words = (words[:5] * 12)[: rng.randint(0, 45)]
        docs = np.zeros(len(words), np.int64)
        sa, lcp = quality.suffix_array(np.array(words, np.int64), docs)
        assert len(quality.maximal_repeats(sa, lcp, np.array(words, np.int64), docs, 2)) == maximal_repeats(words, 2), words


def test_periodic_text_takes_linear_time():
    quality.measure(["word " * 1000])
    began = time.process_time()
    found = quality.measure(["word " * 64_000])
    assert time.process_time() - began < 2 and found["longest_repeat"][0] == 63_999 and found["n_repeats"][0] == 63_999 - 7


# --- op3 ---


def test_op3(results, texts):
    got = results("op3_hypergeometric_shuffle")
    assert set(got) == set(texts)
    slots = defaultdict(list)
    for doc, r in got.items():
        raw = (texts[doc] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert sum(sizes) == len(got) and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shuffle_of_many_rows_is_uniform(spark):
    from certloom.llm import sharding

    n = 8000
    rows = [tuple(r) for r in sharding.shuffle_to_shards(spark.range(n).repartition(5), partitions=64, window_rows=1).select("id", "shard", "slot").collect()]
    cells = Counter((i * 16 // n, shard) for i, shard, _ in rows)
    chi = sum((cells[a, b] - n / 256) ** 2 / (n / 256) for a in range(16) for b in range(16))
    assert 130 < chi < 340  # 225 degrees of freedom, about five deviations
    mean = (n / 16 - 1) / 2
    inside = sum((i - (n - 1) / 2) * (slot - mean) for i, _, slot in rows) / (n * (n / math.sqrt(12)) * (n / 16 / math.sqrt(12)))
    assert abs(inside) < 0.06 and len({(shard, slot) for _, shard, slot in rows}) == n


def test_shards_are_written_in_order(spark, docs, tmp_path):
    from certloom.llm import sharding

    placed = sharding.shuffle_to_shards(docs.select("doc_id", "text"), shards=4, partitions=8)
    want = sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in placed.collect() if r["doc_id"] is not None)
    sharding.write_shards(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in back.collect() if r["doc_id"] is not None) == want


# --- op5, op6, op8 ---


def test_op5(results, texts, reference):  # noqa: F811
    got = results("op5_byte_bpe")
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = reference.encode_ordinary(text or "")
        assert tuple(got[doc][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == (len(ids), sha(",".join(map(str, ids))), sha(text or "")), doc


def test_op6(results, texts):
    got, want = results("op6_substring_dedup"), expected_removals(list(texts.items()))
    assert set(got) == set(texts)
    for doc, text in texts.items():
        size, gone, runs, kept = want.get((doc, text), (0, 0, 0, b""))
        assert tuple(got[doc][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (size, gone, runs, sha(kept)), doc
    assert sum(r["n_removed"] for r in got.values()) > 1000


def test_op8(results, texts):
    got, want = results("op8_jaccard_join"), expected_classes(list(texts.items()))
    assert set(got) == set(texts)
    for doc, text in texts.items():
        assert (got[doc]["class_id"], got[doc]["n_links"], got[doc]["n_link_texts"]) == want.get((doc, text), (doc, 0, 0)), doc


def test_near_copies_are_found(spark):
    """The share of pairs at 0.8 or a little above that the sampled paths bring together."""
    from certloom.llm import jaccard_join

    rng, rows = random.Random(12), []
    for i in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        rows.append((2 * i, " ".join(words)))
        shingles = len(words) - 4
        for _ in range(int(0.11 * shingles / 5)):  # each change costs five shingles of both
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(words)))
    want = expected_classes(rows)
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for (i, _), (_, n, _) in want.items() if n]
    found = sum(got[i]["n_links"] >= 1 for i in linked) / len(linked)
    print(f"recall {found:.4f} of {len(linked)} documents")
    assert len(linked) > 100 and found >= 0.99 and all(got[i]["n_links"] <= want[i, t][1] for i, t in rows)


# --- op10: code lengths by counting ---


def code_lengths(samples, alphabet, text):
    """Bits of a text by PPM with escape method C and exclusion, counted from the samples themselves."""
    size, counts = len(alphabet) + 1, defaultdict(Counter)
    symbols = lambda raw: [b if b in alphabet else -1 for b in raw]
    for raw in samples:
        stream = [10] * 3 + symbols(raw)
        for i in range(3, len(stream)):
            for order in range(4):
                counts[tuple(stream[i - order : i])][stream[i]] += 1
    everything = [*sorted(alphabet), -1]
    known = {}

    def table(context):
        if context not in known:
            parent = table(context[1:]) if context else dict.fromkeys(everything, 1 / size)
            seen = counts[context]
            total, distinct = sum(seen.values()), len(seen)
            whole = total + (distinct if distinct < size else 0)
            rest = sum(p for s, p in parent.items() if s not in seen)
            escape = (distinct / (total + distinct) if distinct < size else 0) if total else 1
            known[context] = {s: seen[s] / whole if s in seen else escape * p / rest for s, p in parent.items()}
        return known[context]

    stream, bits = [10] * 3 + symbols(text), 0.0
    for i in range(3, len(stream)):
        order = next(k for k in (3, 2, 1, 0) if k < 2 or sum(counts[tuple(stream[i - k : i])].values()) >= 2)
        order = next(k for k in range(order, -1, -1) if k == 0 or counts[tuple(stream[i - k : i])])
        bits -= math.log2(table(tuple(stream[i - order : i]))[stream[i]])
    return bits


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = random.Random(7)
    words = {"aa": "the cat sat on mat with hat", "bb": "der hund und die katze schön nicht", "cc": "le chat est sur la table été"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(150))]
    rows = [(i, t, None if i % 17 == 0 else lang) for i, t, lang in rows] + [(500, None, "aa"), (501, "", "bb"), (502, "12 !", "cc"), (503, "日本 🙂 kat", None)]
    at = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_op10(spark, labelled):
    at, rows = labelled
    out = registry.QUERIES["op10_ppm_language_id"](spark, at)
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(out.columns) and not {"lang", "text"} & set(out.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    samples = defaultdict(list)
    for i, text, lang in rows:
        if text and lang and not held[i]:
            samples[lang].append(text.encode())
    alphabet = {10} | {b for x in samples.values() for t in x for b in t}
    assert set(got) == set(held)
    for i, text, _ in rows:
        r = got[i]
        assert r["held_out"] == held[i]
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        bits = {lang: code_lengths(samples[lang], alphabet, text.encode()) for lang in sorted(samples)}
        best = min(bits, key=bits.get)
        share = 1 / sum(2.0 ** max(-1000, bits[best] - b) for b in bits.values())
        assert r["lang_pred"] == best and r["score"] == pytest.approx(share, rel=1e-2)
        assert r["bits"] * len(text.encode()) == pytest.approx(bits[best], rel=1e-3)


def test_sampled_model_equals_counting():
    import numpy as np

    samples = {"a": [b"abracadabra abracadabra", b"banana"], "b": [b"zyx zyxw zyx", "é".encode()]}
    model = language_id.Model(samples)
    alphabet = {10} | {b for x in samples.values() for t in x for b in t}
    texts = [b"banana abra", b"zyx", "é!".encode(), b"abra" * 50]
    got = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    assert np.allclose(got, [[code_lengths(samples[x], alphabet, t) for x in "ab"] for t in texts], rtol=1e-4)
