import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long, repeated and tied texts, and columns whose names clash with the operators' own."""
    texts = [None, "", " \t\n", "one", "two words", "Two\twords", "two words", "x" * 5000, "word " * 3000, "naïve café 𐍈 ▁ ﬁ\nline", "a b c d e f g h", "a b c d e f g i", "<|endoftext|> it's 3.5%"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "Two\twords"), (None, "two words"), (None, None), (90, "A b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "data", "key", "kept", "score", "group", "_id", "_prefix", "fp", "payload", "digest", "length", "n_chars", "source")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
