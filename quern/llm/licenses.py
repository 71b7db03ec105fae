"""Licence scan by a positional rare-token index.

Licence texts and notices are templates with a mandatory key phrase each. The
corpus gives each template word its document frequency. A file looks up its
LOOKED_UP licence words of highest IDF in the postings of the key phrases; further
words count where they are the highest-IDF word of a phrase, so that no phrase is
missed however many a file holds. A template found is a candidate if the file holds
all words of its key phrase. For candidates, the positions of template words in the
file minus their places in the template are intersected, and an alignment counts if
the whole key phrase stands on it. Its score is the share of the template's IDF
weight on the alignment.

Base phrases are templates that are all key phrase, so every place where one
stands is found exactly. Defined results: a null text is empty; a file without
licence words has null first_word and last_word, empty labels and score 0; rows
that repeat a file get the same result each; an empty table gives none. Columns
other than doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, small_side, stored, word_array

#: Label and phrase of the base scan.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Parts that several licences share, in words.
_MERCHANTABLE = "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} for more details"
_GNU_NOTICE = "{} is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "this work is licensed under a creative commons {} license to view a copy of this license visit"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
#: Label, text or notice in words, and the key phrase in it that must stand whole.
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-notice", _GNU_NOTICE.format("this program", "gnu general public license", "3") + " this program is distributed in the hope that it will be useful but without any warranty " + _MERCHANTABLE.format("general public license"), "terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("lgpl-notice", _GNU_NOTICE.format("this library", "gnu lesser general public license", "2 1") + " this library is distributed in the hope that it will be useful but without any warranty " + _MERCHANTABLE.format("lesser general public license"), "terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2 0",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", _CC.format("attribution 4 0 international"), "creative commons attribution 4 0 international license"),
    ("cc-by-sa", _CC.format("attribution sharealike 4 0 international"), "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", _CC.format("attribution noncommercial 4 0 international"), "creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "copy modify and or distribute this software",
    ),
    ("bsd", _BSD, "redistribution and use in source and binary forms"),
    ("bsd-3-clause", _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "the origin of this software must not be misrepresented",
    ),
    ("bsl-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost software license version 1 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
)
#: Licence words of highest IDF that a file looks up in all postings of key phrases.
LOOKED_UP = 8
#: Most document keys that are sent to every executor; beyond it the join shuffles.
BROADCAST_KEYS = 500_000


def _template_rows() -> list[tuple]:
    rows = []
    for t, (label, phrase) in enumerate(BASE):
        rows += [(t, label, True, i, w, True) for i, w in enumerate(phrase.split())]
    for t, (label, sentence, key) in enumerate(TEMPLATES, len(BASE)):
        words, must = sentence.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        rows += [(t, label, False, i, w, at <= i < at + len(must)) for i, w in enumerate(words)]
    return rows


def template_words(spark: SparkSession) -> DataFrame:
    """template, label, base, place, word, is_key: the templates' own postings, a few hundred rows."""
    return spark.createDataFrame(_template_rows(), "template int, label string, base boolean, place int, word string, is_key boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def held_words(docs: DataFrame) -> DataFrame:
    """doc, key, n_words, held: the distinct template words of each whole text."""
    vocabulary = sorted({w for _, phrase in BASE for w in phrase.split()} | {w for _, sentence, _ in TEMPLATES for w in sentence.split()})
    keyed = _keyed(docs).select("doc", "key", word_array(F.col("text")).alias("words"))
    return keyed.select("doc", "key", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("held"))


def weighted_templates(templates: DataFrame, held: DataFrame) -> DataFrame:
    """Template postings with each word's inverse document frequency over all documents."""
    frequency = held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    size = held.agg(F.count("*").alias("n_docs"))
    return (
        templates.join(F.broadcast(frequency), "word", "left")  # a row for each template word at most
        .join(F.broadcast(size))  # one row
        .withColumn("idf", F.log((F.col("n_docs") + 1.0) / (F.coalesce("df", F.lit(0)) + 0.5)))
        .drop("df", "n_docs")
    )


def candidates(held: DataFrame, weighted: DataFrame) -> DataFrame:
    """doc, key, templates: those that the file's highest-IDF licence words lead to and whose key words it all holds."""
    phrases = weighted.where("is_key").groupBy("template").agg(F.max_by("word", F.struct("idf", "word")).alias("rarest"), F.collect_set("word").alias("key_words"))
    index = weighted.where("is_key").select("word", "template").distinct().join(phrases, "template")
    ranks = weighted.where("is_key").select("word", "idf").distinct().agg(F.map_from_entries(F.collect_list(F.struct("word", "idf"))).alias("idf_of"))
    by_idf = F.expr("array_sort(filter(held, w -> map_contains_key(idf_of, w)), (a, b) -> CASE WHEN idf_of[a] <> idf_of[b] THEN IF(idf_of[a] > idf_of[b], -1, 1) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)")
    looked_up = held.where(F.size("held") > 0).join(F.broadcast(ranks)).select("doc", "key", "held", F.posexplode(by_idf).alias("place", "word"))  # one row of key words is broadcast
    found = looked_up.join(F.broadcast(index), "word").where((F.col("place") < LOOKED_UP) | (F.col("word") == F.col("rarest")))  # a row a template and key word
    return found.where(F.size(F.array_except("key_words", "held")) == 0).groupBy("doc", "key").agg(F.collect_set("template").alias("templates"))


def placements(docs: DataFrame, found: DataFrame, weighted: DataFrame) -> DataFrame:
    """doc, key, label, base, start, score: alignments on which the whole key phrase stands; start is its first word."""
    texts = _keyed(docs).alias("d").join(small_side(found, BROADCAST_KEYS).alias("f"), _same_row("d", "f")).select("d.doc", "d.key", "templates", word_array(F.col("text")).alias("words"))
    texts = texts.dropDuplicates(["doc", "key"])
    words = texts.select("doc", "key", "words", F.explode("templates").alias("template")).select("doc", "key", "template", F.posexplode("words").alias("pos", "word"))
    whole = F.broadcast(weighted.groupBy("template").agg(F.sum("idf").alias("full"), F.count_if("is_key").alias("n_key"), F.min(F.when(F.col("is_key"), F.col("place"))).alias("key_at")))
    aligned = (
        words.join(F.broadcast(weighted), ["template", "word"])
        .groupBy("doc", "key", "template", "label", "base", (F.col("pos") - F.col("place")).alias("delta"))
        .agg(F.count_if("is_key").alias("n_here"), F.sum("idf").alias("weight"))
        .join(whole, "template")
        .where("n_here = n_key")
    )
    score = F.when(F.col("full") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("full"))).otherwise(1.0)
    return aligned.select("doc", "key", "label", "base", (F.col("delta") + F.col("key_at")).cast("long").alias("start"), F.round(score, 6).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    held = stored(held_words(docs), "licence-words")
    n = held.count()
    weighted = stored(weighted_templates(template_words(docs.sparkSession), held), "licence-templates", 8)
    found = stored(candidates(held, weighted), "licence-candidates", n)
    base = F.when(F.col("base"), F.col("start"))
    labels = (
        placements(docs, found, weighted)
        .groupBy("doc", "key")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(base).alias("first_word"),
            F.max(base).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("score").alias("score"),
        )
    )
    labels = stored(labels, "licence-labels", n)
    return (
        held.alias("h")
        .join(small_side(labels, BROADCAST_KEYS).alias("l"), _same_row("h", "l"), "left")
        .select(
            F.col("h.doc").alias("doc_id"),
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def op7_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_licence_index": op7_licence_index}
ORACLE_SQL = {
    "op7_licence_index": rf"""
WITH t(template, label, base, place, word, is_key) AS (VALUES {", ".join(f"({t}, '{label}', {base}, {place}, '{word}', {key})" for t, label, base, place, word, key in _template_rows())}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
f AS (SELECT word, count(DISTINCT doc_id) AS df FROM p WHERE word IN (SELECT word FROM t) GROUP BY 1),
i AS (SELECT t.*, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM t LEFT JOIN f USING (word)),
k AS (SELECT template, sum(idf) AS whole, count(*) FILTER (WHERE is_key) AS n_key, min(place) FILTER (WHERE is_key) AS key_at FROM i GROUP BY 1),
a AS (SELECT doc_id, template, label, base, pos - place AS delta, count(*) FILTER (WHERE is_key) AS n_here, sum(idf) AS weight FROM p JOIN i USING (word) GROUP BY ALL),
h AS (SELECT doc_id, label, base, CAST(delta + key_at AS BIGINT) AS start, round(CASE WHEN whole > 0 THEN least(1.0::DOUBLE, weight / whole) ELSE 1 END, 6) AS score FROM a JOIN k USING (template) WHERE n_here = n_key),
l AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN l USING (doc_id)
"""
}
