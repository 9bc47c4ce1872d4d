import random

import pytest

WORDS = "the of and stone river light house under garden winter paper silver open morning quiet field".split()
#: Names that operators use inside; tables carry them as extra columns.
CLASHING = ("part", "own", "fp", "first", "size", "shard", "slot", "rank", "n", "ids", "score", "kept", "component", "segment", "lo", "hi", "row", "weight", "mix_copies", "text_hash", "leftover", "__id", "__src", "base", "at")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "s"]) for _ in range(n))


def make_docs():
    """(doc_id, text, lang, source, n_chars): nulls everywhere, empty and long texts, ties, repeats."""
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(60, 300)), rng.choice(["en", "fr"]), f"src{i % 3}") for i in range(60)]
    docs += [(100, None, "en", "src0"), (101, "", "en", None), (102, "   \n\t", None, "src1"), (103, "é " * 40 + "日本", "fr", "src1"), (104, prose(rng, 20_000), "en", "src0"), (105, "12 34 !!", "fr", None)]
    docs += [(110, docs[3][1], "en", "src0"), (111, docs[3][1] + " end", "en", "src0"), (112, docs[3][1].upper(), "fr", "src2")]
    docs += [docs[5], docs[5], (None, "no id here", None, "src0"), (None, None, None, None)]
    docs += [(120, "a  b", "en", "src1"), (121, " lead and trail ", "en", "src1"), (122, "<|endoftext|> x </s>[INST]", "en", "src2"), (123, "z" * 3000, "en", "src2")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in docs]


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, doc_rows, tmp_path_factory):
    """The fixture as a table of several files, with clashing extra columns."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("docs") / "d")
    df = spark.createDataFrame(doc_rows, SCHEMA).withColumns({c: F.lit("extra") for c in CLASHING})
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
