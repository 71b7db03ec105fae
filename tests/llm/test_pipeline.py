"""Each stage of the pipeline against its plain version, on what the stage before kept."""

import os

import corpus_pipeline
from quern.llm import common, quality

from . import brute
from .conftest import ODD, SF
from .test_packing import check

#: Large enough to learn from.
LARGER = "/root/testdata/sf0.01"


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark):
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    def step(name, docs, want):
        out = stages[name](spark, docs, SF)
        assert out.columns == columns
        assert kept(out) == sorted(want, key=repr)
        return spark.createDataFrame(out.collect(), out.schema)

    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    docs = step("quality classifier", docs, [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good])
    docs = docs.unionByName(odd)
    rows = kept(docs)
    keep = {(i, sha) for i, _, _, stays, sha in brute.exact(rows) if stays}
    docs = step("exact dedup", docs, {(i, t) for i, t in rows if (i, brute.exact([(i, t)])[0][4]) in keep})  # a set: of repeated rows one stays
    rows = kept(docs)
    first = {(a, c) for a, _, c in brute.near_duplicates(rows)}
    docs = step("SimHash near-dedup", docs, [(i, t) for i, t in rows if (i, i) in first])
    rows = kept(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = step("benchmark decontamination", docs, [(i, t) for i, t in rows if not brute.contamination([(i, t)], items)[0][5]])
    assert check(stages["packing"](spark, docs, SF).collect(), kept(docs)) == 0


def test_stages_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    at = f"{common.shared_dir(spark)}/quern"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    tables = len(spark.catalog.listTables())
    pieces = corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(at)) - before) == 1 and len(spark.catalog.listTables()) == tables  # nothing but the result is left
    assert 0 < pieces.select("doc_id").distinct().count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_holds_out(spark):
    """On held-out labels of the small tables: junk is found, good documents are kept."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [r for r in quality.op2_subword_quality(spark, LARGER).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held) > 0
