"""Exact dedup, decontamination, licences and SimHash against their plain Python versions."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import common, components, decontaminate, exact_dedup, licenses, simhash
from quern.llm.common import shared_path

from . import brute
from .conftest import ODD, SF


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def items(spark):
    real = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return [*real, (7001, None), (7002, ""), (7003, "one"), (7004, "cc by nc"), (7004, "cc by nc"), (7005, "word " * 12), (7006, "ärger")]


DEDUP = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
LEAKS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
LICENCE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
NEAR = ("doc_id", "fingerprint", "component_id")


def test_exact_dedup(spark, documents, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(rows(exact_dedup.op10_digest_dedup(spark, SF), *DEDUP), brute.exact(documents))
    same(rows(exact_dedup.dedup(odd, exact_dedup.DigestIndex(spark, shared_path(spark, "t"))), *DEDUP), brute.exact(ODD))
    assert docs.count() == len(documents)


def test_index_persists(spark, odd, empty):
    path = shared_path(spark, "t")
    exact_dedup.dedup(odd.where("doc_id < 900005"), exact_dedup.DigestIndex(spark, path, 4)).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert exact_dedup.dedup(empty, again).count() == 0
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(odd.where("doc_id < 900008"), again).collect()}
    assert got[900001] == (900002, False) and got[900002] == (900002, True) and got[900006] == (900007, False)
    twins = exact_dedup.dedup(odd.where("doc_id = 900005"), again)  # known by now
    assert sorted(r.kept for r in twins.collect()) == [False, True]
    assert not exact_dedup.dedup(odd.where("doc_id IS NULL AND text = 'one'"), again).where("kept").count()
    once = exact_dedup.DigestIndex(spark, path, 4).table()
    assert once.count() == once.select("digest").distinct().count()
    assert exact_dedup.DigestIndex(spark, path, 4).compact().table().count() == once.count()


def test_anti_join_leaves_the_index_in_place(spark):
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "t"), 4)
    plan = index.unseen(index.table())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") <= 1


def test_buckets_follow_the_first_batch(spark, monkeypatch):
    """As many buckets as the first batch needs, noted beside the files and kept by whoever opens the index again."""
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 50)
    docs = spark.range(330).selectExpr("id AS doc_id", "concat('t', id) AS text")
    path = shared_path(spark, "t")
    assert exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, path)).where("kept").count() == 330
    again = exact_dedup.DigestIndex(spark, path, 3)
    assert again.buckets == 7 and again.table().count() == 330
    assert exact_dedup.dedup(docs.limit(5).unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "concat(text, 'u') AS text")), again).where("kept").count() == 335
    plan = again.unseen(docs.select("text").selectExpr("unhex(sha2(text, 256)) AS digest", "1 AS x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the index stays where it is
    compacted = again.compact()
    assert compacted.buckets == 14 and compacted.table().count() == 660


@pytest.mark.parametrize("limit, is_small", [(10_000, True), (40, False)])
def test_broadcasts_by_bytes(spark, monkeypatch, limit, is_small):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([("x" * 30,), ("y" * 30,)], "word string")
    joined = spark.createDataFrame([("a",)] * 3, "word string").join(common.small_side(df, 10, F.octet_length("word")), "word")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert ("Broadcast" in joined._jdf.queryExecution().executedPlan().toString()) == is_small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("broadcast" in joined._jdf.queryExecution().logical().toString()) == is_small


def test_contamination(spark, documents, odd, empty):
    bench = spark.createDataFrame(items(spark), "item_id long, text string")
    docs = spark.createDataFrame(documents + ODD, "doc_id long, text string")
    same(rows(decontaminate.contamination(docs, bench), *LEAKS), brute.contamination(documents + ODD, items(spark)))
    same(rows(decontaminate.contamination(odd, bench), *LEAKS), brute.contamination(ODD, items(spark)))
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count()


def test_proximity(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, text), (2, text.replace("gamma ", "gamma x y ")), (3, text.replace("gamma ", "gamma " + "x " * 30)), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    near = {r.doc_id for r in decontaminate.proximity_matches(docs, bench, slop=3, probes=10).collect()}
    assert near == {1, 2}


def test_licences(spark, documents, odd, empty):
    docs = spark.createDataFrame(documents + ODD, "doc_id long, text string")
    same(rows(licenses.scan(docs), *LICENCE), brute.licences(documents + ODD))
    got = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert got[900010].labels == "cc-by,cc-by-nc" and 0 < got[900010].score <= 1
    assert got[900001].n_words == 0 and got[900001].score == 0 and got[900001].first_word is None
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.values())
    assert licenses.scan(empty).count() == 0


def test_licence_texts(spark, monkeypatch):
    """Whole texts among other words: each template's own label, the full score, also with one word looked up only."""
    rows = [(t, f"preamble {label} of the file {text.upper()}, and more of it") for t, (label, text, _) in enumerate(licenses.TEMPLATES)]
    rows.append((100, " ".join(text for _, text, _ in licenses.TEMPLATES)))
    rows.append((101, "permission is hereby granted but not free of charge; the software is provided as is"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for t, (label, *_) in enumerate(licenses.TEMPLATES):
        assert label in got[t].labels.split(",") and got[t].score == 1
    assert set(got[100].labels.split(",")) >= {label for label, *_ in licenses.TEMPLATES} and got[101].labels == "" and got[101].score == 0
    monkeypatch.setattr(licenses, "LOOKED_UP", 1)
    assert {r.doc_id: r for r in licenses.scan(docs).collect()} == got


def test_near_duplicates(spark, documents, odd, empty):
    same(rows(simhash.op8_simhash_variants(spark, SF), *NEAR), brute.near_duplicates(documents))
    same(rows(simhash.near_duplicates(odd), *NEAR), brute.near_duplicates(ODD))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("few", [simhash.FEW, 3])
def test_links_of_dense_clouds(spark, monkeypatch, few):
    """Two clouds of fingerprints around centres, and lone ones: components as by comparing all pairs."""
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(300)}
    for centre in (r.getrandbits(64), (1 << 63) | 5):
        for _ in range(500):
            fps.add(centre ^ sum(1 << b for b in {r.randrange(64) for _ in range(r.randrange(8))}))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {x.node: x.root for x in simhash.linked(table).collect()}
    if few > 3:
        assert {x.node: x.root for x in simhash.linked(table, parts=5).collect()} == got
    parent = {f: f for f in signed}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = {}
    for f in signed:
        groups.setdefault(find(f), []).append(f)
    want = {f: min(g) for g in groups.values() for f in g}
    assert {f: got.get(f, f) for f in signed} == want


def test_filters_keep_clashing_columns(spark):
    rows = [(1, "one two three", "d", "k", 1, 2), (2, "ONE two three", "d", "k", 1, 2), (3, None, None, None, None, None), (4, "four five six", "d", "k", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, key string, gone int, head int")
    bench = spark.createDataFrame([(9, "four five")], "item_id long, text string")
    ids = lambda df: sorted(r.doc_id for r in df.select(*docs.columns).collect())
    assert ids(exact_dedup.deduplicated(docs, exact_dedup.DigestIndex(spark, shared_path(spark, "t")))) == [2, 3, 4]
    assert ids(simhash.representatives(docs)) == [1, 3, 4]
    assert ids(decontaminate.decontaminated(docs, bench)) == [1, 2, 3]


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_row_of_each_group_stays(spark, monkeypatch, broadcast):
    """Null and repeated ids, repeated rows: one row a text, one row a component, whichever way the joins go."""
    if not broadcast:
        for module in (exact_dedup, simhash, decontaminate):
            for name in [n for n in vars(module) if n.startswith("BROADCAST_")]:
                monkeypatch.setattr(module, name, 0)
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(licenses, "BROADCAST_KEYS", 0)
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(None, "b"), (None, "B"), (7, "c c"), (7, "c c"), (7, "C c"), (3, "c C"), (None, "c c"), (8, "d"), (8, "e"), (None, None), (None, ""), (1, long), (1, long), (1, long + " x"), (None, long), (2, long.replace("w299", "z"))]
    docs = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    kept = exact_dedup.deduplicated(docs, exact_dedup.DigestIndex(spark, shared_path(spark, "t")))
    assert kept.columns == docs.columns
    lower = lambda t: (t or "").lower()
    assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in rows})
    assert {r.doc_id for r in kept.collect() if lower(r.text) == "c c"} == {7}
    near = simhash.representatives(docs)
    fp = {lower(t): brute.fingerprint(t) for _, t in rows}
    component = {(i, f): c for i, f, c in brute.near_duplicates(rows)}
    assert near.columns == docs.columns and sorted({lower(r.text)[:3] for r in near.collect()}) == ["", "b", "c c", "d", "e", "w0 "] and near.count() == 6
    assert all(r.doc_id == component[r.doc_id, f"{fp[lower(r.text)]:016x}"] for r in near.collect())
    bench = spark.createDataFrame([(9, "c c"), (10, "w3 w4 w5")], "item_id long, text string")
    assert sorted(r.source for r in decontaminate.decontaminated(docs, bench).collect()) == sorted(f"s{i}" for i, r in enumerate(rows) if lower(r[1]) != "c c" and not lower(r[1]).startswith("w0"))
    same(((r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, bench).collect()), [(i, n) for i, _, n, *_ in brute.contamination(rows, [(9, "c c"), (10, "w3 w4 w5")])])
    same(((r.doc_id, r.n_words) for r in licenses.scan(docs).collect()), [(i, n) for i, n, *_ in brute.licences(rows)])


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
