"""Dictionaries of phrases against regular expressions."""

import random
import re

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.phrases import PhraseDictionary, found_labels

SHAPES = {"anywhere": "{}", "word": r"(?a:\b){}(?a:\b)", "token": r"(?<![^ \t\n\x0b\f\r]){}(?![^ \t\n\x0b\f\r])"}


def plain(text, phrases):
    return sorted({label for phrase, label, edge in phrases if phrase and re.search(SHAPES[edge].format(re.escape(phrase)), text)})


def test_edges_on_random_texts():
    rng = random.Random(2)
    alphabet = "ab_1 -ñ\n."
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(300):
        phrases = [(make(rng.randrange(0, 4)), rng.randrange(6), rng.choice(list(SHAPES))) for _ in range(rng.randrange(8))]
        d = PhraseDictionary(phrases)
        for _ in range(10):
            text = make(rng.randrange(0, 40))
            assert d.labels(text) == plain(text, phrases), (text, phrases)


def test_ten_thousand_phrases(spark):
    """Overlapping phrases of one to four words, a label each, in whole texts, in Spark."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    phrases = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(14_000)})[:10_000]
    assert len(phrases) == 10_000
    where = {p: i for i, p in enumerate(phrases)}
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 200))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r.id: r.found for r in df.select("id", found_labels(F.col("text"), PhraseDictionary((p, i, "word") for p, i in where.items())).alias("found")).collect()}
    for i, text in enumerate(texts):
        tokens = (text or "").split()
        spans = {" ".join(tokens[a : a + k]) for a in range(len(tokens)) for k in range(1, 5)}
        assert got[i] == (None if text is None else sorted(where[s] for s in spans if s in where))


def test_severity(spark):
    rows = [("a hell of a DAY", 1), ("begun", 2), ("shit.", 0), ("shit\thell", 2), ("Fuck", 3), ("class", 0), ("", 0), (None, 0), ("oral  sex", 2), ("blow job", 2)]
    df = spark.createDataFrame(rows, "text string, want int").withColumn("got", T.severity_rank(F.col("text")))
    assert all(r.got == r.want for r in df.collect())
