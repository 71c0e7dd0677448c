"""License notices by diagonal voting.

Every rolling k-gram of a document's words is joined to its positions in the templates. A hit
at document position p and template position q votes for the diagonal p - q, the place where
the template would begin. Diagonals of one template at most ``SLACK`` apart are merged, so
that a word put in or left out does not break a notice. The span of a merged diagonal is
verified on its words: at least ``COVERED_PERCENT`` of the template's distinct k-grams must
stand in it.

The base phrases are templates too; each place where all their words stand consecutively
counts. Words are runs of digits, letters a-z and characters beyond ASCII after lowering A-Z.
NULL and empty texts have no words, no labels and score 0. Every row of the input gives one
row, repeated rows as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatsheet.llm import common

SLACK = 2
COVERED_PERCENT = 80

#: Base phrases and their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

#: Sentences of public license notices and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("no rights reserved this work is in the public domain", "public-domain"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
]

NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[tuple[int, str, bool, int, list[str]]]:
    """Number, label, whether it is a base phrase, k, words."""
    listed = [(t, label, True) for t, label in BASE] + [(t, label, False) for t, label in NOTICES]
    return [
        (n, label, base, min(3, len(t.split())), t.split())
        for n, (t, label, base) in enumerate(listed)
    ]


def _grams(spark: SparkSession, of: list) -> DataFrame:
    """Positions of the k-grams of all templates; they are as many as the words above."""
    rows = [
        (n, k, q, " ".join(w[q : q + k])) for n, _, _, k, w in of for q in range(len(w) - k + 1)
    ]
    hashed = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    grams = spark.createDataFrame(rows, "template int, k int, q int, gram string")
    gram = F.when(F.col("k") == 2, F.xxhash64("k", F.get("v", F.lit(0)), F.get("v", F.lit(1))))
    return grams.withColumn("v", hashed).select(
        "template", "k", "q",
        gram.otherwise(F.xxhash64("k", *[F.get("v", F.lit(j)) for j in range(3)])).alias("hash"),
    )


def _names(spark: SparkSession, of: list) -> DataFrame:
    rows = [
        (n, label, base, k, len(w), sorted({" ".join(w[q : q + k]) for q in range(len(w) - k + 1)}))
        for n, label, base, k, w in of
    ]
    return spark.createDataFrame(
        rows, "template int, label string, base boolean, k int, m int, grams array<string>"
    )


def words(text) -> F.Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NO_WORD), lambda w: w != "")


def _rolling(k: int, wanted: list[int]) -> F.Column:
    """Hash and position of every k consecutive words, of which ``v`` has the hashes. Those
    that no template has are left out here already, so that the join gets only rows it keeps."""

    def gram(p):
        return F.xxhash64(F.lit(k), *[F.get("v", p + j) for j in range(k)])

    places = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("v") - k, F.lit(0))), lambda p: gram(p).isin(wanted)
    )
    return F.transform(places, lambda p: F.struct(gram(p).alias("hash"), p.alias("p")))


def _spans(diagonals: DataFrame) -> DataFrame:
    """Places of base phrases, each by itself, and merged diagonals of the notices."""
    enough = F.col("votes") * 100 >= (F.col("m") - F.col("k") + 1) * COVERED_PERCENT
    places = diagonals.filter(F.col("base") & (F.col("votes") == F.col("m") - F.col("k") + 1))
    ordered = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(ordered) > SLACK
    merged = (
        diagonals.filter(~F.col("base"))
        .withColumn("first", F.when(apart, 1).otherwise(0))
        .withColumn("cluster", F.sum("first").over(ordered))
        .groupBy("doc_id", "row", "template", "m", "k", "cluster")
        .agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter(enough)
    )
    columns = ["doc_id", "row", "template", "low", "high"]
    return places.select(*columns).unionByName(merged.select(*columns))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    spark, of = docs.sparkSession, templates()
    plain = common.texts(docs)
    rows = plain.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
    kinds = sorted({k for _, _, _, k, _ in of})
    template_grams = _grams(spark, of)
    wanted = template_grams.select("k", "hash").distinct().collect()
    grams = (
        rows.select("doc_id", "row", F.transform("w", lambda w: F.xxhash64(w)).alias("v"))
        .select(
            "doc_id", "row",
            # The outer form, lest an inferred filter takes the words apart anew for every k-gram.
            F.explode_outer(
                F.concat(*[_rolling(k, [r["hash"] for r in wanted if r["k"] == k]) for k in kinds])
            ).alias("g"),
        )
        .select("doc_id", "row", "g.hash", "g.p")
    )
    # The templates are a constant of this module: some two hundred rows.
    hits = (
        grams.join(F.broadcast(template_grams.select("template", "q", "hash")), "hash")
        .select("doc_id", "row", "template", "p", "q", (F.col("p") - F.col("q")).alias("diagonal"))
        .distinct()
    )
    names = F.broadcast(_names(spark, of))
    diagonals = hits.groupBy("doc_id", "row", "template", "diagonal").agg(
        F.count("*").alias("votes"),
        F.min("p").alias("low"),
        F.max("p").alias("high"),
    )
    spans = common.written(_spans(diagonals.join(names, "template")), "spans")
    text = plain.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("row_"), F.col("text")
    )
    found = (
        text.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("row_") == F.col("row")))
        .join(names.select("template", "label", "base", "k", "grams"), "template")
        .withColumn(
            "span",
            F.slice(words(F.col("text")), F.col("low") + 1, F.col("high") - F.col("low") + F.col("k")),
        )
    )
    ours = F.transform(
        F.sequence(F.lit(1), F.size("span") - F.col("k") + 1),
        lambda p: F.array_join(F.slice(F.col("span"), p, F.col("k")), " "),
    )
    cover = F.size(F.array_intersect("grams", ours)) / F.size("grams")
    key = ["doc_id", "row", "template", "label", "base", "low", "high"]
    checked = (
        found.select(*key, cover.alias("cover"))
        .groupBy(*key)
        .agg(F.max("cover").alias("cover"))
        .filter((F.col("cover") >= COVERED_PERCENT / 100) & (~F.col("base") | (F.col("cover") == 1)))
    )
    per_row = checked.groupBy("doc_id", "row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("low"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    found = per_row.withColumnRenamed("doc_id", "id").withColumnRenamed("row", "row_")
    return (
        rows.select("doc_id", "row", F.size("w").cast("long").alias("n_words"))
        .join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("row_") == F.col("row")), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            F.col("first_word").cast("long").alias("first_word"),
            F.col("last_word").cast("long").alias("last_word"),
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
