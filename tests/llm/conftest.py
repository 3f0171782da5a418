import random
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, copies, repeated rows, other white space, clashing column names."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdeäöü", k=draw.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    passage = prose(60)
    long = prose(12_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "de", "a"), (4, "x", None, "b"), (5, long, "en", "b"),
        (6, prose(40) + "\n" + passage + "\n" + prose(40), "en", "a"), (7, passage, "en", None), (8, passage, "en", "c"),
        (9, passage + " tail", "en", "c"), (10, long[: len(long) // 2] + " " + prose(30), "de", "c"),
        (11, "same line\n" * 50, "fr", "a"), (12, "ab" * 400, "fr", "a"), (13, "line\x0bwith\x0cother\rblanks and more 🙂", "es", "b"),
        (14, "Große ÄPFEL Straße 日本語 <|endoftext|> it's 12,5%", "de", "b"), (15, prose(30), "en", "c"), (15, prose(30), "en", "c"),
        (None, prose(30), "en", "c"), (None, passage + " end", "en", "c"), (16, "tick tock " * 200, "en", "a"), (17, prose(3), "en", "a"),
        (18, "1234 5678 !!!", "en", "b")]
    rows.append(rows[6])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("doc", "start", "n", "fp", "component_id", "host_rate", "key", "found", "u", "held_out", "score", "kept"):
        df = df.withColumn(name, F.lit("extra"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
