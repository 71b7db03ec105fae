"""WAND against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from quern.llm import wand

from .conftest import ODD, SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the contract, every document against every item."""
    counted = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc_id, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(wand.op13_wand_search(spark, SF)) == plain(documents, items)


def test_ties_shards_and_blocks(spark, monkeypatch):
    """Many equal documents in no order, shards of a few documents, items in several blocks."""
    monkeypatch.setattr(wand, "SHARD_DOCS", 40)
    monkeypatch.setattr(wand, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(wand, "BLOCK_TERMS", 60)
    monkeypatch.setattr(wand, "MERGE_GROUPS", 2)
    rng = random.Random(4)
    words = [f"w{int(30 * rng.random() ** 3)}" for _ in range(500)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(600)]
    docs += [(i, "W1, w2 w3-w3") for i in range(1000, 1900)] + [(None, "w1 w2 w3 w3"), (5, "w1 w2 w3 w3"), (5, "w1 w2 w3 w3")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(20)] + [(20, "w1 w2 w3"), (21, None), (22, "nowhere"), (20, "w4"), (None, "w29 w3")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert rows(wand.search(table, bench)) == plain(docs, items)
    assert rows(wand.search(table, bench, 3)) == plain(docs, items, 3)


def test_odd_rows(spark, odd, empty):
    items = [("a", "one ROW without licence"), ("b", "ärger ÄRGER"), ("c", "word"), ("d", None)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    got = rows(wand.search(odd.withColumn("item_id", odd["key"]), bench))
    assert got == plain(ODD, items) and {r[0] for r in got} == {"a", "b", "c"}
    assert rows(wand.search(empty, bench)) == [] and rows(wand.search(odd, bench.limit(0))) == []


def test_documents_are_skipped():
    """With a full heap, documents whose terms cannot beat it are passed over unscored."""
    rng = np.random.default_rng(3)
    n = 4000
    terms_, places = [], []
    for t, share in enumerate((0.9, 0.5, 0.01, 0.002)):
        own = np.flatnonzero(rng.random(n) < share)
        places.append(own)
        terms_.append(np.full(len(own), t))
    places, terms_ = np.concatenate(places), np.concatenate(terms_)
    values = np.array([100, 900, 9000, 20000])[terms_] * rng.integers(50, 100, len(terms_))
    lists = wand.posting_lists(terms_, places, values)
    heap = []
    scored = wand.wand([lists[t] for t in range(4)], [-i for i in range(n)], heap, 10)
    total = np.bincount(places, values, n).astype(int)
    assert sorted(heap, reverse=True) == sorted(((s, -i) for i, s in enumerate(total.tolist())), reverse=True)[:10]
    assert scored < n / 4


def test_long_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr(wand, "PIECE", 7)
    text = "Ab, cde-FGH ÄÖ x1 " * 5 + "a" * 50 + " end"
    assert [w.decode() for part in wand.term_lists(text.encode()) for w in part] == terms(text)
