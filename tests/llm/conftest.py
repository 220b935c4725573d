import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "sta", "tri", "ver") for b in ("", "n", "ra", "sel", "tok", "wim")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, empties, blanks, copies, near copies, repeated rows, shared lines, long texts."""
    rng = random.Random(11)
    shared = "  This Line is shared by many documents  "
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(i, prose(rng, rng.randint(1, 90)) + ".\n" + prose(rng, 20)) for i in range(30)]
    rows += [(100 + i, f"{prose(rng, 12)}\n{shared if i % 2 else shared.strip().lower()}\nend {i}\n") for i in range(6)]
    rows += [(200, base), (201, base), (202, " ".join(near)), (203, base + " " + prose(rng, 4)), (204, prose(rng, 40) + "\n" + base[:300] + "\n" + prose(rng, 40))]
    rows += [(300, None), (301, ""), (302, " \t\n\x0b "), (303, "1234 !!"), (304, "é"), (305, "Ünïcode ÉCOLE\r\nßtraße 日本語 🙂🙂"), (None, "no id " + shared), (None, None)]
    rows += [(400, "twice the same row"), (400, "twice the same row"), (401, "same id"), (401, "another text with the same id")]
    rows += [(500, (prose(rng, 9) + " ") * 400), (501, "x" * 5000), (502, "word " * 30)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with more columns, some named like results and working columns of the operators."""
    extra = "row string, th long, line string, shard string, n_words string, kept string, lang_pred string, ids string, class_id string, runs string"
    rows = [(i, t, "en", "s", len(t or ""), "r", 7, "l", "s", "w", "k", "p", "i", "c", "u") for i, t in corpus]
    return spark.createDataFrame(rows, f"{SCHEMA}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, docs, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(f"{at}/documents.parquet")
    base = next(t for i, t in corpus if i == 204)
    spark.createDataFrame([(1, " ".join(base.split()[2:14]))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h{i % 5}.d{i % 3}.test/p{i}") for i in range(40)], "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    return at
