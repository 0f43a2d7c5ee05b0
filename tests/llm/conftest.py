"""A fixture table with what operators must survive, and plain versions of their rules."""
import re

import pytest
from pyspark.sql import types as T

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use themselves
                       T.StructField("row", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("fp", T.StringType()),
                       T.StructField("bucket", T.StringType()), T.StructField("__found", T.StringType())])
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_rows():
    base = " ".join(f"word{i} and thing{i * 7 % 50}" for i in range(120))
    near = base.replace("word60 ", "other ")
    texts = [None, "", " \n\t", "x", "0", base, base, near, base.upper(), f"start {PASSAGE} end", f"{PASSAGE}\n{PASSAGE}",
             "Released under the MIT License. Licensed under CC BY-NC 4.0", "été ÇA à l'école, über straße ñandú", "日本語 テスト 😀 <|endoftext|> don't",
             "ab" * 30_000, " ".join(f"long{i % 977}" for i in range(20_000)), base + " tail " + PASSAGE, "a" * 49, "a" * 50, "a" * 51]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, base), (5, "same id, other text"), (None, base), (None, "no id"), (None, None), (400, "no id")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return plain_rows()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    data = [(i, t, "en" if t and len(t) % 2 else None, "s", len(t or ""), "r", "w", "f", "b", "x") for i, t in plain_rows()]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark):
    half = " ".join(PASSAGE.split()[:12])
    rows = [(7, PASSAGE), (70, half.upper()), (70, "thing7 word2"), (8, "x"), (9, None), (10, ""), (None, "über straße"), (11, PASSAGE)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_id long, text string, n_words string")
