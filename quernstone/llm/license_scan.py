"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are lowered, stripped of punctuation and cut into words; shingles are five words. For a template of T
words a text is cut into windows of T + T/2 words, one every T/2 words, so that any run of T words lies whole in a window.
Window and template are compared by ``BANDS`` min-hashes, one to a band, and a template is retrieved where one band
agrees. A window that holds the share ``CONTAINMENT`` of a template's shingles has a Jaccard similarity of at least about
0.3 with it, so that all bands miss with a probability of at most 0.7 ** 32, one in ninety thousand. Retrieved pairs are
verified by counting the template's shingles in the window. Texts that hold no shingle of any template cannot match and
get no windows. Everything runs in built-in expressions.

Defined results: a null or empty text matches nothing; a template shorter than five words is one shingle of all its words
and needs at least that; repeated rows with one id give one row per license; an empty table gives an empty result; columns
besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.quality_rules import words
from quernstone.session import cut

SHINGLE = 5
BANDS = 32
CONTAINMENT = 80
PUNCTUATION = ".,;:()\"'!?#*$%&|"
#: Notices by which texts state their license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def _words(text: Column) -> Column:
    """Hashes of a text's words, so that a shingle hashes five numbers instead of five texts."""
    return F.transform(words(F.lower(F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, ""))), lambda word: F.xxhash64(word))


def _shingles(found: str) -> Column:
    """Hashes of an array's five-word shingles; a shorter array is one shingle."""
    count = F.greatest(F.size(found) - (SHINGLE - 1), F.lit(1))
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(found, i, SHINGLE))))


def _bands(found: str) -> Column:
    """One min-hash of an array of shingle hashes for each band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda seed: F.array_min(F.transform(found, lambda h: F.xxhash64(h, seed))))


def templates(spark: SparkSession, notices: Sequence[tuple[str, str]]) -> DataFrame:
    """(license, length, needed, shingles): as many rows as notices."""
    rows = spark.createDataFrame(list(notices), "license string, notice string").select("license", _words(F.col("notice")).alias("_w"))
    hashed = rows.where(F.size("_w") > 0).select("license", F.size("_w").alias("length"), F.array_distinct(_shingles("_w")).alias("shingles"))
    return cut(hashed.withColumn("needed", F.ceil(F.size("shingles") * CONTAINMENT / 100).cast("int")))


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, license, n_shingles of the notice, the most of them in one window, and that number of windows that match.

    The notices are a parameter, not data, so their few rows are broadcast.
    """
    spark = docs.sparkSession
    known = templates(spark, notices)
    every = [row["h"] for row in known.select(F.explode("shingles").alias("h")).distinct().collect()]
    hashed = docs.select(F.col(id_column).alias("doc_id"), _words(F.col(text_column)).alias("_w")).select("doc_id", _shingles("_w").alias("_h"))
    # as a generator the test stays above the hashes; a filter would be pushed below and hash the text anew for each
    overlaps = F.arrays_overlap("_h", F.array(*map(F.lit, every)) if every else F.array().cast("array<bigint>"))
    held = hashed.withColumn("_hit", F.explode(F.when(overlaps, F.array(F.lit(1))))).drop("_hit")

    sizes = F.broadcast(known.select("length").distinct().withColumn("_all", F.lit(1)))
    reach = F.greatest(F.col("length") - (SHINGLE - 1), F.lit(1))
    stride = F.greatest((F.col("length") / 2).cast("int"), F.lit(1))
    spread = held.withColumn("_all", F.lit(1)).join(sizes, "_all").withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_h"), stride)))
    windows = spread.select("doc_id", "length", "_at", F.array_distinct(F.slice("_h", F.col("_at"), reach + stride)).alias("_window"))
    banded = windows.select("*", F.posexplode(_bands("_window")).alias("band", "value"))
    wanted = F.broadcast(known.select("license", "length", "needed", "shingles", F.posexplode(_bands("shingles")).alias("band", "value")))
    retrieved = banded.join(wanted, ["length", "band", "value"]).dropDuplicates(["doc_id", "license", "_at", "_window"])
    counted = retrieved.select("doc_id", "license", "_at", "needed", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("shingles", "_window")).alias("_in"))
    found = counted.where("_in >= needed").groupBy("doc_id", "license")
    return found.agg(F.max("n_shingles").cast("long").alias("n_shingles"), F.max("_in").cast("long").alias("most_shingles"), F.countDistinct("_at").cast("long").alias("n_windows"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: DuckDB, over documents: every window of every notice's size, without retrieval.
ORACLE = rf"""
WITH notices(license, notice) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in TEMPLATES)}),
cut AS (
  SELECT license, regexp_extract_all(lower(translate(notice, {_quoted(PUNCTUATION)}, '')), '[^\x20\x09-\x0D]+') AS w FROM notices
), known AS (
  SELECT license, len(w) AS length, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM cut
), texts AS (
  SELECT doc_id, regexp_extract_all(lower(translate(text, {_quoted(PUNCTUATION)}, '')), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), held AS (
  SELECT DISTINCT t.doc_id, t.w FROM texts t JOIN (SELECT DISTINCT unnest(s) AS x FROM known) k ON contains(' ' || array_to_string(t.w, ' ') || ' ', ' ' || k.x || ' ')
), hashed AS (
  SELECT doc_id, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM held
), windows AS (
  SELECT doc_id, license, s, pos, list_slice(h, pos, pos + greatest(length - 4, 1) + length // 2 - 1) AS v
  FROM (SELECT h.doc_id, h.h, k.license, k.s, k.length, unnest(range(1, len(h.h) + 1, greatest(k.length // 2, 1))) AS pos FROM hashed h, known k)
), counted AS (
  SELECT doc_id, license, pos, len(s) AS n, len(list_intersect(s, v)) AS held FROM windows
)
SELECT doc_id, license, CAST(max(n) AS BIGINT) AS n_shingles, CAST(max(held) AS BIGINT) AS most_shingles, CAST(count(DISTINCT pos) AS BIGINT) AS n_windows
FROM counted WHERE held >= ceil(n * 0.8) GROUP BY doc_id, license
"""
