import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, rank int, shard int, kept string, rep long, part int"


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near and exact copies, shared passages, personal data."""
    rng = random.Random(4)
    syll = {"en": ["th", "er", "on", "an", "re", "ed", "ing"], "de": ["sch", "ung", "ein", "ich", "keit"], "fr": ["eau", "oi", "ment", "que", "eux"]}
    word = lambda lang: "".join(rng.choice(syll[lang]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word("en") for _ in range(60))
    out = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        words = [word(lang) for _ in range(rng.choice([1, 2, 3, 12, 13, 40, 90]))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        out.append([i, " ".join(words), lang, f"src{i % 4}", None])
    base = [word("en") for _ in range(150)]
    for i in range(120, 150):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word("en")
        out.append([i, " ".join(w), "en", "src0", 7])
    out += [[150, None, None, None, None], [151, "", "en", "src1", 0], [152, " \t\n ", None, "src1", 3], [153, "a", "en", None, 1], [154, "The the", "en", "src2", 7]]
    out += [[155, out[3][1], "en", "src9", 1], [155, out[3][1], "en", "src9", 1], [156, "word " * 3000, "en", "src3", 15000], [157, "x" * 5000, "en", "src3", 5000]]
    out += [[158, "mail jo.e@ex-ample.co.uk ip 1.22.255.4 256.1.1.1 call +1 (974) 555-3436 card 4539 1488 0343 6467 token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\"", "en", "src1", 9]]
    out += [[159, "é́ 漢字\x0b a\x1cb <|endoftext|> nb sp's 12ab!! " + passage, "fr", "src2", 9], [None, "no id " + passage, "en", "src0", 1], [None, None, None, None, None]]
    return [(*r, 1, 0.5, 2, 3, "k", 4, 5) for r in out]


@pytest.fixture(scope="session")
def edge_rows():
    return rows()


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, edge, tmp_path_factory):
    """A folder of tables, as the queries take it."""
    d = tmp_path_factory.mktemp("sf")
    edge.write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 4 > 0), int(i % 7 == 0)) for i in range(150)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_tables(spark, empty, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf0")
    empty.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)
