import pytest
from pyspark.sql import functions as F

#: Extra columns have the names that operators use inside, and odd ones; the text's own name is in capitals.
EXTRA = ["h", "fp", "gone", "__th", "__did", "__gone", "named", "did", "TH", "every", "parts", "keep", "first", "node", "bands", "key", "root", "n", "a.b", "sp ace"]
SCHEMA = "doc_id long, TEXT string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in EXTRA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, repeated, very long and odd texts, null ids, and columns whose names clash with internal ones."""
    long = "\n".join(f"line {i} of a very long text with words enough to matter" for i in range(4000))
    texts = [None, "", " \n\t ", "one", "one", "two words", long, "a b c d e f g h i j " * 30, "naïve café 日本語 😀 token = 'abc123XYZ'", "x" * 5000, "<|endoftext|> <|startoftext|>"]
    extra = tuple(range(1, len(EXTRA) + 1))
    rows = [(i, t, "en", "s", 0, *extra) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, None, *[None] * len(EXTRA)), (3, "one", "en", "s", 0, *extra)]
    return spark.createDataFrame(rows, SCHEMA)


def extras_kept(out):
    """Whether the extra columns of ``out``'s rows hold what ``odd_docs`` put there."""
    return all(list(r)[5:] == (list(range(1, len(EXTRA) + 1)) if r["doc_id"] is not None else [None] * len(EXTRA)) for r in out.collect())


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
