"""License scan by diagonal voting, in DataFrame operations only.

All two-word grams of every text join the grams of the templates; each hit votes for the diagonal (document position minus template
position). Neighbouring diagonals merge, and a template's coverage on merged diagonals decides its label. A gram joins on its 64-bit
hash and on its words, so that a run of votes on one diagonal is a verified span: a phrase stands wherever one diagonal holds all its
grams.

Nulls: a null text counts as empty. Each row of the table gives one row, repeated rows and null ids too; an empty table gives none.
Other columns are ignored. A text of fewer than two words has no grams and no labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings of well-known notices, in words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution": "cc-by",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: At most so many template words are broadcast.
MOST_TEMPLATE_WORDS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), 0)


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(tgram, template, label, base, grams, at, th): a row per gram of each template."""
    rows = []
    for i, (text, label, base) in enumerate([*((t, x, True) for t, x in phrases.items()), *((t, x, False) for t, x in notices.items())]):
        parts = text.split()
        rows += [(f"{a} {b}", i, label, base, len(parts) - 1, at) for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
    if len(rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"{len(rows)} template grams; {MOST_TEMPLATE_WORDS} can be broadcast")
    names = ("tgram", "template", "label", "base", "grams", "at")
    literals = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))
    return spark.range(1).select(F.inline(literals)).withColumn("th", F.xxhash64("tgram"))


def labelled(documents: DataFrame, least: float = 0.6, drift: int = 2, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    base_*: places where a phrase's words stand consecutively. labels adds those of templates of which `least` of the grams is found on
    diagonals at most `drift` from the next; score is the best coverage, 1 for a phrase in full.
    """
    spark = documents.sparkSession
    known = F.broadcast(templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices))
    texts = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    n = F.size("w")
    pairs = F.when(n > 1, F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    # the last entry, null, keeps documents without hits and carries the number of words
    grams = texts.select("doc_id", "row", n.alias("n_words"), F.posexplode(F.concat(pairs, F.array(F.lit(None).cast("string")))).alias("pos", "gram"))
    hits = grams.withColumn("h", F.xxhash64("gram")).join(known, (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")), "left").where("template IS NOT NULL OR gram IS NULL")
    votes = (
        hits.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("_d"), F.when(F.col("template").isNotNull(), F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), F.countDistinct("at").alias("votes"), F.collect_set("at").alias("ats"))
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= drift, 0).otherwise(1)
    merged = votes.withColumn("cut", apart).withColumn("band", F.sum("cut").over(along))
    found = merged.groupBy("row", "template", "band").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.sum(F.when(F.col("base") & (F.col("votes") == F.col("grams")), 1).otherwise(0)).alias("places"),
        F.min(F.when(F.col("base") & (F.col("votes") == F.col("grams")), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("base") & (F.col("votes") == F.col("grams")), F.col("diagonal"))).alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.first("grams")).alias("coverage"),
    )
    whole = F.col("places") > 0
    cover = F.when(F.col("base"), F.when(whole, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.coalesce("coverage", F.lit(0.0)))
    listed = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return found.withColumn("cover", cover).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), F.sum("places").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        listed(whole).alias("base_labels"), listed(whole | (F.col("cover") >= least)).alias("labels"), F.max("cover").alias("score"),
    ).drop("row")
