"""Benchmark decontamination by a distributed positional inverted index.

The index holds postings (word, document, position) of the training texts for
the words that are probed. A benchmark window (10 consecutive words; a shorter
item is one window) is probed by its rarest words by corpus count. A posting at
position p of a word that stands at place q of an item votes for the alignment
p - q; intersecting these offset-adjusted lists leaves alignments on which all
probes of some window agree, and only these are compared word by word.

Defined results: a null text has no words; a benchmark row without words (or
null) matches nothing; rows that repeat an item_id count as one item; rows
that repeat a document get the same result each. Empty tables give no hits.
Columns other than doc_id, text, item_id are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, small_side, stored, word_array

WINDOW = 10
PROBES = 3
#: Words of an item, about: only how many tasks write small tables depends on it.
PLACES = 50
#: Bytes of an array's element beside its content, about.
ELEMENT = 24
#: Most rows of a table of benchmark words, or of document keys, that is sent to every executor; beyond it, or beyond BROADCAST_BYTES, the join shuffles.
BROADCAST_WORDS = 200_000
BROADCAST_KEYS = 500_000


def _words_width() -> Column:
    """About the bytes of item_words."""
    return F.octet_length(F.array_join("item_words", "")) + ELEMENT * F.size("item_words")


def _windows_width() -> Column:
    """About the bytes of windows."""
    return ELEMENT * F.size("windows") + 4 * F.size(F.flatten("windows"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def _tokens(keyed: DataFrame) -> DataFrame:
    return keyed.select("doc", "key", F.posexplode(word_array(F.col("text"))).alias("pos", "word"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (a key of the row), item_id, q, word, n (words of the item)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("words")).distinct()
    return items.select(row_key(F.col("item_id"), F.col("words")).alias("item"), "item_id", F.size("words").alias("n"), F.posexplode("words").alias("q", "word"))


def word_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences in all documents of each word that some item has."""
    vocabulary = stored(items.select("word").distinct(), "vocabulary", items.count())
    seen = _tokens(_keyed(docs)).select("word").join(small_side(vocabulary, BROADCAST_WORDS, F.octet_length("word")), "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
    return vocabulary.join(seen, "word", "left").select("word", F.coalesce("seen", F.lit(0)).alias("seen"))


def window_probes(items: DataFrame, counts: DataFrame, window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """A row per item: its words in order, and for each window the places of its rarest words."""
    per_item = (
        items.join(counts, "word")
        .groupBy("item", "item_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("q", "seen", "word"))).alias("at"))
        .withColumn("width", F.least(F.lit(window), F.col("n")))
    )
    rarest = (
        f"transform(sequence(0, n - width), s -> transform(slice(array_sort(transform(slice(at, s + 1, width), x -> "
        f"struct(x.seen AS seen, x.q AS q))), 1, {int(probes)}), x -> x.q))"
    )
    return per_item.select("item", "item_id", "n", "width", F.col("at.word").alias("item_words"), F.expr(rarest).alias("windows"))


def postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The positional index over ``words``: doc, key, pos, word."""
    return _tokens(_keyed(docs)).join(words, "word", "left_semi")


def alignments(index: DataFrame, probed: DataFrame) -> DataFrame:
    """doc, key, item, delta on which all probes of some window of the item agree."""
    places = probed.select("item", F.explode(F.array_distinct(F.flatten("windows"))).alias("q"), "item_words").select(
        "item", "q", F.element_at("item_words", F.col("q") + 1).alias("word")
    )
    voted = (
        index.join(small_side(stored(places, "places", probed.count() * PLACES), BROADCAST_WORDS, ELEMENT + F.octet_length("word")), "word")
        .groupBy("doc", "key", "item", (F.col("pos") - F.col("q")).alias("delta"))
        .agg(F.collect_set("q").alias("agreed"))
    )
    with_windows = voted.join(small_side(probed.select("item", "windows"), BROADCAST_WORDS, _windows_width()), "item")
    return with_windows.where("exists(windows, w -> forall(w, q -> array_contains(agreed, q)))").select("doc", "key", "item", "delta")


def _probes(docs: DataFrame, benchmark: DataFrame, window: int, probes: int) -> tuple[DataFrame, DataFrame]:
    """item_words and window_probes of a benchmark, stored."""
    items = stored(item_words(benchmark), "items", benchmark.count() * PLACES)
    n = items.count()
    return items, stored(window_probes(items, stored(word_counts(docs, items), "counts", n), window, probes), "probes", n)


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """doc, key, n_hit, items (sorted distinct ids as strings) for documents in which a window occurs exactly."""
    items, probed = _probes(docs, benchmark, window, probes)
    probe_words = probed.select(F.explode("windows").alias("w"), "item_words").select(F.explode(F.expr("transform(w, q -> item_words[q])")).alias("word")).distinct()
    index = stored(postings(docs, small_side(stored(probe_words, "probe-words", items.count()), BROADCAST_WORDS, F.octet_length("word"))), "postings")
    found = (
        alignments(index, probed)
        .groupBy("doc", "key", "item")
        .agg(F.collect_list("delta").alias("deltas"))  # numbers only: an item of one frequent word has one for each place
        .join(small_side(probed.select("item", "item_id", "n", "width", "item_words"), BROADCAST_WORDS, _words_width()), "item")
        .groupBy("doc", "key")
        .agg(F.collect_list(F.struct("item_id", "n", "width", "item_words", "deltas")).alias("found"))
    )
    found = stored(found, "alignments", index.count())
    texts = _keyed(docs).alias("d").join(small_side(found.select("doc", "key"), BROADCAST_KEYS).alias("f"), _same_row("d", "f"), "left_semi")
    texts = texts.dropDuplicates(["doc", "key"])
    checked = texts.alias("d").join(found.alias("f"), _same_row("d", "f")).select("d.doc", "d.key", "found", word_array(F.col("text")).alias("words"))
    checked = stored(checked, "candidates", 20 * found.count())  # whole texts
    same = "transform(sequence(0, c.n - 1), q -> d + q >= 0 AND d + q < size(words) AND get(words, d + q) = c.item_words[q])"
    starts = "filter(transform(sequence(0, c.n - c.width), s -> IF(forall(slice(a.same, s + 1, c.width), x -> x), a.delta + s, NULL)), x -> x IS NOT NULL)"
    verified = f"transform(found, c -> struct(c.item_id AS item_id, c.width AS width, flatten(transform(transform(c.deltas, d -> struct(d AS delta, {same} AS same)), a -> {starts})) AS starts))"
    return checked.withColumn("hits", F.expr(f"filter({verified}, c -> size(c.starts) > 0)")).select(
        "doc",
        "key",
        F.expr("size(array_distinct(flatten(transform(hits, c -> flatten(transform(c.starts, s -> sequence(s, s + c.width - 1)))))))").cast("long").alias("n_hit"),
        F.expr("array_sort(array_distinct(hits.item_id))").alias("items"),
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3, probes: int = PROBES, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, lowest and highest alignment: documents where all probes of some window stand near their places.

    Near: the alignments of the probes differ by at most ``slop``. Alignments are
    cut into blocks of slop + 1, and a vote counts in its block and the next, so
    that any two alignments within ``slop`` meet in a block.
    """
    items, probed = _probes(docs, benchmark, window, probes)
    places = probed.select("item", F.explode(F.array_distinct(F.flatten("windows"))).alias("q"), "item_words").select("item", "q", F.element_at("item_words", F.col("q") + 1).alias("word"))
    places = stored(places, "places", items.count())
    votes = postings(docs, small_side(places.select("word").distinct(), BROADCAST_WORDS, F.octet_length("word"))).join(small_side(places, BROADCAST_WORDS, ELEMENT + F.octet_length("word")), "word").withColumn("delta", F.col("pos") - F.col("q"))
    near = (
        votes.withColumn("block", F.explode(F.array(F.floor(F.col("delta") / (slop + 1)), F.floor(F.col("delta") / (slop + 1)) + 1)))
        .groupBy("doc", "key", "item", "block")
        .agg(F.collect_set(F.struct("delta", "q")).alias("votes"))
        .join(small_side(probed.select("item", "item_id", "windows"), BROADCAST_WORDS, _windows_width()), "item")
    )
    within = f"filter(array_distinct(votes.delta), d -> exists(windows, w -> forall(w, q -> exists(votes, v -> v.q = q AND v.delta >= d AND v.delta <= d + {int(slop)}))))"
    return (
        near.withColumn("from", F.expr(within))
        .where(F.size("from") > 0)
        .groupBy(F.col("doc").alias("doc_id"), "item_id")
        .agg(F.min(F.array_min("from")).alias("first_alignment"), F.max(F.array_max("from")).alias("last_alignment"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = stored(phrase_hits(docs, benchmark, window, probes), "hits")
    lengths = _keyed(docs).select("doc", "key", F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    return (
        lengths.alias("d")
        .join(small_side(hits, BROADCAST_KEYS).alias("h"), _same_row("d", "h"), "left")
        .select(
            F.col("d.doc").alias("doc_id"),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    hit = stored(phrase_hits(docs, benchmark).where("n_hit > 0").select(F.col("doc").alias("_quern_doc"), F.col("key").alias("_quern_key")), "hits")
    key = row_key(docs["doc_id"], docs["text"])
    return docs.join(small_side(hit, BROADCAST_KEYS), docs["doc_id"].eqNullSafe(F.col("_quern_doc")) & (key == F.col("_quern_key")), "left_anti")


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op6_positional_index": op6_positional_index}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op6_positional_index": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, CAST(least({WINDOW}, len(w)) AS BIGINT) AS width FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, width, array_to_string(w[s + 1 : s + width], ' ') AS shingle FROM (SELECT *, unnest(range(len(w) - width + 1)) AS s FROM i)),
dw AS (SELECT doc_id, width, s, array_to_string(w[s + 1 : s + width], ' ') AS shingle FROM (SELECT doc_id, w, width, unnest(range(greatest(len(w) - width + 1, 0))) AS s FROM d, (SELECT DISTINCT width FROM i))),
h AS (SELECT doc_id, s, width, item_id FROM dw JOIN iw USING (width, shingle)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
