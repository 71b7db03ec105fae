"""Toxicity and quality: hashing against plain Python, held-out accuracy, odd rows."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quern.llm import labelled, quality, textvec, toxicity

from . import brute
from .brute import words
from .conftest import ODD

LARGER = "/root/testdata/sf0.01"


def test_hashes_follow_the_words():
    texts = ["", "A b, a B ä", None, "x", "  lead and trail  ", "ünï cödé Ü", "a" * 1000, "the end"] * 3
    seen = {}
    for data, offsets in textvec.chunks(pa.array(texts, pa.string()).slice(1)):
        ((h, text, _),) = textvec.word_hashes(data, offsets, textvec.byte_values("lower"))
        want = [(i, w) for i, t in enumerate(texts[1:]) for w in words(t)]
        assert text.tolist() == [i for i, _ in want]
        for (_, w), x in zip(want, h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_chunks_cover_every_text():
    texts = ["ab" * n for n in (1, 200_000, 3, 0, 140_000, 5)]
    got = [b"" if b == a else data[a:b].tobytes() for data, at in textvec.chunks(pa.array(texts)) for a, b in zip(at, at[1:])]
    assert got == [t.encode() for t in texts]


def test_ngrams_stay_inside_texts():
    values = textvec.mix(np.arange(1, 257, dtype=np.uint64))
    data, at = next(textvec.chunks(pa.array(["abcd", "ab", "", "bcd"])))
    ((h, text),) = textvec.ngram_hashes(data, at, 3, values)
    assert text.tolist() == [0, 0, 3] and h[1] == h[2] != h[0]


TEXTS = ["the end the end end end", "A b, a B ä A b", "x", "", "  lead and trail  ", "a" * 300 + " tail", "ünï cödé Ü " * 40, "one two three " + "q" * 129 + " " * 130 + "one two three"]


def found(parts):
    """What is found in each text, in order."""
    by_text = {}
    for text, at in parts:
        for t, x in zip(text.tolist(), at.tolist()):
            by_text.setdefault(t, []).append(x)
    return by_text


def test_features_follow_plain_versions(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 60)
    (chunk,) = textvec.chunks(pa.array(TEXTS))
    for got, plain in ((found(toxicity.features(*chunk, bits=60)), brute.toxic_features), (found(quality.slots(*chunk)), brute.quality_tokens)):
        seen = {}
        for i, text in enumerate(TEXTS):
            want = plain(text)
            assert len(got.get(i, [])) == len(want)
            assert all(seen.setdefault(token, x) == x for token, x in zip(want, got.get(i, [])))
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 128, 129])
def test_long_texts_in_blocks(monkeypatch, size):
    def all_of(text):
        (chunk,) = textvec.chunks(pa.array([text]))
        return set(found(toxicity.features(*chunk)).get(0, [])), Counter(found(quality.slots(*chunk)).get(0, []))

    whole = [all_of(t) for t in TEXTS]
    monkeypatch.setattr(textvec, "CHUNK", size)
    assert [all_of(t) for t in TEXTS] == whole


def test_very_long_text_in_little_memory():
    text = pa.array(["word after word " * 600_000 + "x" * 8_000_000 + " end"])
    model = np.zeros(1 << quality.BITS, np.float32), 0.5
    tracemalloc.start()
    assert quality._log_odds(text, model).tolist() == [0.5]
    assert len(toxicity._once(toxicity.features(*next(textvec.chunks(text))))) == 14
    assert tracemalloc.get_traced_memory()[1] < 90e6  # 18 MB of text: the copy with long offsets and the blocks
    tracemalloc.stop()


def test_ftrl_against_plain_version(spark):
    """The weights that learn() returns, from its own sample, as an FTRL-proximal coordinate by coordinate finds them."""
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = toxicity.learn(docs, labels, 300)
    rows = labelled.sample(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, 300).selectExpr("*", "xxhash64(id) AS h").orderBy("h", "id").collect()
    examples = [(set(found(toxicity.features(*next(textvec.chunks(pa.array([r.text]))))).get(0, [])), r.label) for r in rows]
    want = brute.ftrl(examples, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    want = {1 << toxicity.BITS if i is None else i: w for i, w in want.items() if w or i is None}
    got = dict(zip(model["feature"].tolist(), model["weight"].tolist()))
    assert len(got) > 1 and got.keys() == want.keys() and all(abs(got[i] - w) < 1e-6 for i, w in want.items())


def test_subword_sgd_against_plain_version():
    texts = [f"{a} {b} {a}" for a in ("good", "clean", "fine", "poor", "bad") for b in ("prose", "text", "words")] + [""]
    labels = [int(t[:1] in "gcf" and t != "") for t in texts]
    slot, bias = quality._train(iter([pd.DataFrame({"text": texts, "label": labels})])).iloc[0]
    examples = []
    for t, y in zip(texts, labels):
        n = Counter(found(quality.slots(*next(textvec.chunks(pa.array([t]))))).get(0, []))
        examples.append(({k: v / n.total() for k, v in n.items()}, y))
    rng = np.random.default_rng(11)
    start = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM))
    vectors = {k: start[k].tolist() for share, _ in examples for k in share}
    out, b = brute.subword_sgd(examples, vectors, [rng.permutation(len(texts)).tolist() for _ in range(quality.EPOCHS)], quality.RATE)
    got = np.frombuffer(slot, "<f4")
    want = {k: sum(v * (o1 - o0) for v, o0, o1 in zip(vec, *out)) for k, vec in vectors.items()}
    assert max(abs(got[k] - w) for k, w in want.items()) < 1e-3 * max(map(abs, want.values())) + 1e-4
    assert abs(bias - (b[1] - b[0])) < 1e-3


def test_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "good text", "a", 2.0), (2, "bad", "b", None)], f"doc_id long, text string, `odd ``na.me` string, {quality.SCORE} double")
    model = np.zeros(1 << quality.BITS, np.float32), 0.0
    assert quality.accepted(docs, model).collect() == docs.collect()
    assert quality.accepted(docs, model, 0.6).collect() == []


@pytest.mark.parametrize("module, label, folds, out, most_wrong", [(toxicity, "toxic", 4, 2, 0.15), (quality, "quality", 5, 0, 0.05)])
def test_held_out(spark, module, label, folds, out, most_wrong):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    got = {r.doc_id: r for r in module.score(docs, module.learn(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id], r[label]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(r.predicted != y for r, y in held) <= most_wrong * len(held)
    used = labelled.sample(docs, labels, label, folds, out, 100)
    assert used.count() == 100 and not any(got[r.id].held_out for r in used.collect())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, odd, empty, module):
    labels = spark.createDataFrame([(900004, 1, 1), (900006, 0, 0), (None, 1, 1), (900008, None, None), (900004, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.learn(odd, labels)
    got = module.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    by_id = {}
    for r in got:
        assert r.doc_id is None or by_id.setdefault(r.doc_id, r) == r
    assert by_id[900001].score == by_id[900002].score
    assert module.score(empty, model).count() == 0
    nothing = module.learn(odd, labels.limit(0))
    assert {r.score for r in module.score(odd, nothing).collect()} == {0.5}
