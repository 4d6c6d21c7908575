import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, uid long, score double, label int, "
          "kept boolean, n_shingles long, bucket int, size long, place long, shard int, key long, word long")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, "THE quick\tbrown fox\njumps over the lazy dog again and again"),
    (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"), (9, "two words"), (10, LONG), (11, LONG + " tail"),
    (12, "übergröße straße élan vital ñandú"), (13, "password = 'hunter2hunter2' and token:abc"),
    (14, "12345 !!! ###"), (15, "中文 \U0001f600 ١٢"), (None, "no id here at all but five"), (None, None),
    (1, "the quick brown fox jumps over the lazy dog again and again"), (16, "x" * 5000), (17, "a <|endoftext|> b\x1cc d"),
]


def make(spark, texts):
    """Documents with nulls in all other columns of some rows, and columns named like those that operators make."""
    rows = [(i, t, *(("en", "src", 1, 7, 0.5, 1, True, 3, 2, 9, 4, 6, 8, 5) if k % 2 else (None,) * 14)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, TEXTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r[0]: r[1] for r in documents.select("doc_id", "text").collect()}
