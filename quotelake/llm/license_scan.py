"""Operator 4: license scan by an exact set-similarity join with license templates. DataFrame functions only.

Two things are found in one pass over the words. Base phrases: every place where a phrase's words stand consecutively. Templates
(short notices and whole license texts): every text block whose word set holds at least THRESHOLD of a template's words. A
block is a window of consecutive words, across line breaks as notices are wrapped: twice the template's length, and one from every
multiple of that length on, so that each run of as many words as the template has lies in one.

The words of all templates are ordered by their document frequency over the whole corpus, rare first. A
template is indexed by its prefix of |T| - o + 1 words, where o is the overlap that the threshold asks
for: a block that meets it holds one of them. Each word of a text is looked up in that index; a hit names the two blocks that hold it.
Length filter: the block needs o words. Positional filter: the template's words from the matching place on must
allow o. What is left is verified exactly. A phrase is indexed by its rarest word in the same way.
The index has at most a few thousand rows, fixed by the templates and phrases, and is broadcast.

Null and empty texts have no words, no labels and score 0. Rows that repeat an id and text have equal
results; rows that share only an id are kept apart. Empty tables give empty results. Other columns play
no part. Texts and lines of any length are read whole.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import row_key, table
from quotelake.llm.words import SQL_WORDS, once, words

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as license texts ask for them, and license texts without their headings, in words; label -> text.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "under the mit license",  # four words: all of them are needed
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
    "out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8


def needed(text: str, threshold: float) -> int:
    """The overlap with a template's word set that the threshold asks for."""
    return ceil(threshold * len(set(text.split(" "))) - 1e-9)


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """In how many documents each word of `vocabulary` stands; words that none has are absent."""
    known = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string").withColumn("hash", F.xxhash64("word"))
    every = docs.select(F.explode_outer(F.array_distinct(words(F.col(text_col)))).alias("w"))
    seen = every.withColumn("hash", F.xxhash64("w")).join(F.broadcast(known), "hash").filter("w = word")
    return {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each template word


def index(docs: DataFrame, phrases: dict[str, str], templates: dict[str, str], threshold: float, text_col: str) -> DataFrame:
    """word, hash, label, phrase (its number; null for templates), parts array<string> (the phrase's, or the template's distinct words), at (the word's place in parts), need, length.

    One row with the empty word and no label stands for every document."""
    vocabulary = sorted({x for t in [*templates.values(), *phrases] for x in t.split(" ")})
    frequency = frequencies(docs, vocabulary, text_col)
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (frequency.get(x, 0), x)))}
    rows = [("", None, None, [], 0, 0, 1)]
    for i, (phrase, label) in enumerate(phrases.items()):
        parts = phrase.split(" ")
        at = min(range(len(parts)), key=lambda k: rank[parts[k]])
        rows.append((parts[at], label, i, parts, at, len(parts), len(parts)))
    for label, text in templates.items():
        own, need = sorted(set(text.split(" ")), key=rank.__getitem__), needed(text, threshold)
        rows += [(w, label, None, own, p, need, len(text.split(" "))) for p, w in enumerate(own[: len(own) - need + 1])]
    out = docs.sparkSession.createDataFrame(rows, "word string, label string, phrase int, parts array<string>, at int, need int, length int")
    return out.withColumn("hash", F.xxhash64("word"))


def found(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row_key, label, phrase, place (a phrase's first word or a block's number, from 0), share (of a template's words), n_words: a row for each
    place of a phrase and each block and prefix word that meets a template, and one without a label for each document.

    Generator, look-up and check run in one generated loop that copies hits only."""
    # an empty word in front stands for the document, so places in w are those in Spark's slices less one
    w = docs.select(F.col(id_col), row_key(F.col(text_col)).alias("row_key"), once(F.concat(F.array(F.lit("")), words(F.col(text_col)))).alias("w"))
    each = w.select("*", F.posexplode_outer("w").alias("p", "x")).withColumn("hash", F.xxhash64("x")).join(F.broadcast(known), "hash").filter("x = word")
    start = F.col("p") - F.col("at")  # of a phrase, from 1
    block = F.floor((F.col("p") - 1) / F.col("length")).cast("int")
    is_phrase, is_document = F.col("phrase").isNotNull(), F.col("label").isNull()
    at = each.withColumn("place", F.explode(F.when(is_document, F.array(F.lit(0))).when(is_phrase, F.array(start - 1)).otherwise(F.array(block, block - 1)))).filter("place >= 0")
    here = F.slice("w", F.col("place") + 2, F.col("length"))
    window = F.slice("w", F.col("place") * F.col("length") + 2, 2 * F.col("length"))
    allowed = F.size("parts") - F.col("at") >= F.col("need")
    long_enough = F.size("w") - 1 - F.col("place") * F.col("length") >= F.col("need")
    common = F.when(~is_document & ~is_phrase & allowed & long_enough, F.size(F.array_intersect("parts", window))).otherwise(0)
    met = at.filter(is_document | F.when(is_phrase, here == F.col("parts")).otherwise(allowed & long_enough & (F.size(F.array_intersect("parts", window)) >= F.col("need"))))
    return met.select(id_col, "row_key", "label", "phrase", "place", (common / F.nullif(F.size("parts"), F.lit(0))).alias("share"), (F.size("w") - 1).cast("long").alias("n_words"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: base places and labels, blocks array<struct<label, block, share>>, labels (both), score (1 with a base phrase, else the best share)."""
    hits = found(docs, index(docs, phrases, templates, threshold, text_col), id_col, text_col)
    is_phrase, is_block = F.col("phrase").isNotNull(), F.col("phrase").isNull() & F.col("label").isNotNull()
    each = hits.groupBy(id_col, "row_key").agg(
        F.first("n_words").alias("n_words"), F.count(F.when(F.col("label").isNull(), 1)).alias("copies"),
        F.collect_set(F.when(is_phrase, F.struct("label", "phrase", "place"))).alias("places"),
        F.array_sort(F.collect_set(F.when(is_block, F.struct("label", F.col("place").alias("block"), "share")))).alias("blocks"),
    )
    out = each.select(
        id_col, "row_key", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.place").cast("long").alias("first_word"), F.array_max("places.place").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("places.label")).alias("base_labels"), "blocks", "copies",
    )
    return out.select(
        id_col, "row_key", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.col("blocks.label"))).alias("labels"), "blocks",
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0))).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    ).drop("_copy")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def _place_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT r, i - 1 AS i, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()}"
        for p, label in PHRASES.items()
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS.format("text")} AS w FROM documents),
p AS ({_place_sql()}),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY r),
t AS (SELECT label, len(string_split(notice, ' ')) AS s, list_distinct(string_split(notice, ' ')) AS t FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())}) AS x(label, notice)),
m AS (SELECT r, label, len(list_intersect(w[i:i + 2 * s - 1], t)) AS common, len(t) AS n FROM (SELECT r, label, s, t, w, unnest(range(1, len(w) + 1, s)) AS i FROM d, t WHERE len(w) > 0)),
f AS (SELECT r, list(DISTINCT label) AS labels, max(common / CAST(n AS DOUBLE)) AS best FROM m WHERE common >= ceil({THRESHOLD} * n - 1e-9) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""
