"""Licence scan by diagonal voting (operator 9), with DataFrame functions only.

Every pair of neighbouring words of every text is hashed and joined to the pairs of the templates. A joined pair votes for
a diagonal: its place in the text less its place in the template. Votes are counted by (text, template, diagonal),
neighbouring diagonals (a word more or less in between) are merged to bands, and a band that covers enough of its template
is a finding. Joined pairs are compared word by word, so hashes only select.

The templates are constants of this module or of the caller: their table is broadcast if it has at most ``BROADCAST_PAIRS``
rows and joined by a shuffle beyond that.

Edge cases: a null or empty text has 0 words, no labels and score 0; an empty table has no rows; very long texts are taken whole;
of templates that tie all labels are given, once and sorted; rows are kept apart by a row number and not by their key, so
repeated rows and null keys give one row each; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: The phrases whose every place counts, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Wordings of notices, and the labels that the method finds by them.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu general public license version": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc",
    "licensed under a creative commons attribution license": "cc",
    "all rights reserved": "reserved",
}

#: Words of a text: digits, a to z, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals that are at most so far apart belong to one band.
GAP = 2
#: A band is a finding when its votes cover so much of the template.
COVERAGE = 0.75
BROADCAST_PAIRS = 100_000

_NO_PAIR = 0


def template_pairs(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row for each pair of words of each template; and one with template -1 that every text meets once."""
    rows = [(-1, "", False, 0, 0, "", "")]
    for t, (wording, label, base) in enumerate([*((p, x, True) for p, x in phrases.items()), *((p, x, False) for p, x in notices.items())]):
        words = wording.split()
        rows += [(t, label, base, len(words) - 1, i, *words[i : i + 2]) for i in range(len(words) - 1)]
    pairs = spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, at int, first string, second string")
    pairs = pairs.withColumn("pair", F.when(F.col("template") < 0, F.lit(_NO_PAIR).cast("long")).otherwise(F.xxhash64("first", "second")))
    return F.broadcast(pairs) if len(rows) <= BROADCAST_PAIRS else pairs


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """Per row of ``docs``: words, base phrases' places, labels and the best coverage of a template."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(key).alias("key"), words.alias("words"))

    def hashed(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get("words", i + 1))

    # The row number beside the pairs keeps the optimizer from testing their number, which would make them twice.
    rows = rows.select("key", F.monotonically_increasing_id().alias("row"), "words", F.concat(F.array(F.lit(_NO_PAIR).cast("long")), F.transform("words", hashed)).alias("all_pairs"))
    places = rows.select("key", "row", "words", F.posexplode("all_pairs").alias("place", "pair"))
    votes = (
        places.join(template_pairs(docs.sparkSession, phrases, notices), "pair")
        .where((F.col("template") < 0) | ((F.get("words", F.col("place") - 1) == F.col("first")) & (F.get("words", F.col("place")) == F.col("second"))))
        .where((F.col("template") >= 0) | (F.col("place") == 0))
        .select("key", "row", F.size("words").cast("long").alias("n_words"), "template", "label", "base", "pairs", (F.col("place") - 1 - F.col("at")).cast("long").alias("diagonal"))
    )
    # One shuffle: all that follows groups by the row and something else.
    diagonals = votes.repartition("row").groupBy("row", "template", "label", "base", "pairs", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.first("key").alias("key"), F.first("n_words").alias("n_words"))
    in_order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(in_order)
    banded = diagonals.withColumn("breaks", F.when(apart > (F.when(F.col("base"), 0).otherwise(gap)), 1).otherwise(0)).withColumn("band", F.sum("breaks").over(in_order))
    whole = F.col("base") & (F.col("votes") == F.col("pairs"))
    bands = banded.groupBy("row", "template", "label", "base", "pairs", "band").agg(
        F.first("key").alias("key"),
        F.first("n_words").alias("n_words"),
        F.least(F.sum("votes"), F.first("pairs")).alias("votes"),
        F.sum(F.when(whole, 1).otherwise(0)).alias("wholes"),
        F.min(F.when(whole, F.col("diagonal"))).alias("low"),
        F.max(F.when(whole, F.col("diagonal"))).alias("high"),
    )
    covered = F.when(F.col("template") >= 0, F.col("votes").cast("double") / F.col("pairs")).otherwise(F.lit(0.0))
    found = F.when(F.col("template") < 0, F.lit(False)).when(F.col("base"), F.col("wholes") > 0).otherwise(covered >= coverage)
    return (
        bands.groupBy("row")
        .agg(
            F.first("key").alias(key),
            F.max("n_words").alias("n_words"),
            F.sum("wholes").cast("long").alias("n_base"),
            F.min("low").alias("first_word"),
            F.max("high").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") & found, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
            F.max(F.when(found | ~F.col("base"), covered).otherwise(F.lit(0.0))).alias("score"),
        )
        .drop("row")
    )


def oracle(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, gap: int = GAP, coverage: float = COVERAGE) -> str:
    """DuckDB SQL for the same rows."""
    rows = []
    for t, (wording, label, base) in enumerate([*((p, x, True) for p, x in phrases.items()), *((p, x, False) for p, x in notices.items())]):
        words = wording.split()
        rows += [f"({t}, '{label}', {base}, {len(words) - 1}, {i}, '{words[i]}', '{words[i + 1]}')" for i in range(len(words) - 1)]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH t(template, label, base, pairs, pos, a, b) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS w FROM documents),
p AS (SELECT r, i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS i FROM d)),
v AS (SELECT r, template, label, base, pairs, i - pos AS diagonal, count(*) AS votes FROM p JOIN t USING (a, b) GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN diagonal - before > CASE WHEN base THEN 0 ELSE {gap} END THEN 1 ELSE 0 END) OVER (PARTITION BY r, template ORDER BY diagonal) AS band FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) AS before FROM v)),
s AS (SELECT r, template, label, base, least(sum(votes), pairs) / pairs AS covered, count(*) FILTER (base AND votes = pairs) AS wholes, min(diagonal) FILTER (base AND votes = pairs) AS low, max(diagonal) FILTER (base AND votes = pairs) AS high FROM g GROUP BY r, template, label, base, pairs, band),
f AS (SELECT *, CASE WHEN base THEN wholes > 0 ELSE covered >= {coverage} END AS found FROM s)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, CAST(coalesce(sum(wholes), 0) AS BIGINT) AS n_base, min(low) AS first_word, max(high) AS last_word,
 coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base AND found))), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (found))), ','), '') AS labels,
 coalesce(max(CASE WHEN found OR NOT base THEN CAST(covered AS DOUBLE) ELSE 0 END), 0.0::DOUBLE) AS score FROM d LEFT JOIN f USING (r) GROUP BY d.r, d.doc_id
"""
