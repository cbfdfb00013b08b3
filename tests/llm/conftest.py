from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside or for their results, as extra columns of the input.
CLASHING = (
    "_row _g _rank _cell _own _gone _did _dtext _kept _measures _fails _found0 _host _low _text _id node bucket quality kept "
    "shard slot contamination main_text score predicted secrets n_lines n_dropped doc size taken"
).split()


def clash(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHING)])


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdefgiklmnoprstuvz") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls in every column, empty, blank, long and repeated texts, repeated rows, odd white space."""
    same = sentence(1, 60)
    near = same.split()
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "b", None), (3, " ".join(near[:30] + ["other"] + near[31:]), None, "a", 3),
        (4, None, "en", "a", 0), (5, "", "en", None, 0), (6, " \t\n\r\x0b\x0c ", "en", "a", 7), (None, sentence(2, 40), "en", "a", 5),
        (None, None, None, None, None), (7, sentence(3, 30), "en", "b", 3), (7, sentence(3, 30), "en", "b", 3), (7, sentence(4, 30), "en", "c", 3),
        (8, "word", "en", "c", 4), (9, "Word", "en", "c", 4), (10, "two words", "en", None, 9), (11, sentence(5, 40_000), "en", "long", 1),
        (12, "\n".join([sentence(6, 12)] * 9), "en", "a", 1), (13, "É é ü a\x00b c 漢字 🙂🙂", "fr", "ü", 2),
        (14, "x" * 3_000_000, "en", "long", 1), (15, "a\nb\n\na", "en", "a", 1), (16, sentence(7, 25) + " " + sentence(7, 25), "en", "b", 1),
    ]
    common = "A line that several documents hold, long enough to be counted as one"
    rows += [(20 + i, f"{sentence(30 + i, 15)}\n  {common.upper() if i % 2 else common}\t\n{sentence(60 + i, 9)}", "en", "d", 1) for i in range(7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
