import random
import re

import pytest

from askloom.llm import common

WORD = re.compile("[^\x20\x09-\x0D]+")
CLASH = ("lang", "size", "score", "key", "node", "kept", "text_", "id")


@pytest.fixture(autouse=True)
def ready(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    common.prepare(spark)


@pytest.fixture
def frame(spark):
    """Documents with extra columns whose names operators might use themselves."""
    def make(rows):
        docs = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows],
                                     "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))
        return docs
    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, repeated ids."""
    rnd = random.Random(4)
    words = "the of and naïve idiot mit license apache version 2 cc by nc ### 日本 a".split()
    some = " ".join(rnd.choices(words, k=400))
    return [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (None, some, "b"), (None, None, None), (4, some, "b"),
            (4, some, "b"), (4, "under the MIT License. You idiot!", "a"), (5, some + " tail", "a"), (6, "x" * 5000, "a"),
            (7, " ".join(rnd.choices(words, k=60_000)), "b"), (8, "one two", "a"), (9, "one two", None), (-3, "\x00 \x85 �", "c")]
