import pytest

AWKWARD = [(0, None, "en"), (1, "", "en"), (2, "   \n\t ", None), (3, "one", "en"), (4, "one two three", None),
           (5, "Hello, World! It's 12 o'clock\n\nHello, World! It's 12 o'clock", "en"), (6, "ＡＢＣ ﬁ 🙂 é  x\x85y\x1cz", "fr"),
           (7, "a  b   c\t\td \n e", "en"), (8, "<|endoftext|> x<|startoftext|><s></s>▁y", "en"), (9, "1234567890 !!! ###", "de"),
           (10, "word " * 30000, "en"), (11, "x" * 20000, "en"), (12, "same text of some words here " * 20, "en"),
           (13, "same text of some words here " * 20, "en"), (13, "same text of some words here " * 20, "en"), (None, "no id", "en")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows with nulls, empty, blank, odd and long texts, repeated rows, and columns named like results."""
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(AWKWARD, schema).repartition(3)
    for name in ("n_tokens", "shard", "slot", "score", "kept", "words", "row_number", "o", "sig", "component_id", "gone"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
