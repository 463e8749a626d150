import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for folder in (ROOT, os.path.join(ROOT, "tests"), os.path.join(ROOT, "tools")):
    sys.path.insert(0, folder)
# executors import the package too
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.01"

LINE = "this line is long enough to be compared with others."
WORDS = " ".join(f"word{i}" for i in range(300))
# nulls in every column, empty and long texts, ties, repeated rows
EDGE_ROWS = [
    (1, "The quick brown fox\n" + LINE + "\nend", "en", "a", 10),
    (1, "The quick brown fox\n" + LINE + "\nend", "en", "a", 10),
    (2, "  " + LINE.upper() + " \nother", "en", "a", None),
    (3, LINE, None, "b", 3),
    (4, LINE + "\n" + LINE, "en", None, 3),
    (5, "x\n" + LINE + "\t", "en", "b", 3),
    (6, LINE + "\n", "en", "b", 3),
    (7, None, None, None, None),
    (8, "", "en", "a", 0),
    (9, "   \n\t", "en", "a", 5),
    (10, "ONE two", "en", "a", 7),
    (11, "one TWO", "en", "c", 7),
    (12, "<|endoftext|> special 中文 😀 é\u00a0b \x1c c", "de", "c", 7),
    (13, "y" * 200_000, "en", "c", 200_000),
    (14, WORDS, "en", "c", 5),
    (15, WORDS.replace("word7 ", "word8 "), "en", "a", 5),
    (None, WORDS, "en", "a", 5),
    (None, None, None, None, None),
    (16, (WORDS + "\n") * 40, "fr", "a", 5),
    (14, "another text under a known id", "en", "c", 5),
]
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ("id", "fp", "row_hash", "root", "component_id", "tokens", "n_tokens", "key", "copies", "block", "lines", "deduped",
            "toxicity", "lost_id", "kept_id", "kept_rank", "mix_source", "sample_id", "h1", "pos", "h", "label_id", "ids")


@pytest.fixture(scope="session")
def edge(spark):
    """The edge-case documents, with columns named like the operators' own."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(EDGE_ROWS, DOCUMENTS)
    return df.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING)).coalesce(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
