"""License scans by diagonal voting (operator 9), in SQL functions only.

Every text gives the rolling hashes of its word k-grams. They are joined with
the places of the same k-grams in the license templates; a hit at word p of the
text and word q of a template votes for the diagonal p - q. Votes are counted by
(document, template, diagonal); neighbouring diagonals, which an inserted or
dropped word sets apart, are merged, and a merged group is cut where its
template starts again. A piece is a finding when the distinct places of the
template that its span matches cover enough of it, among them the words that set
a version or variant apart.

The templates are a fixed list of this module (a few hundred words, so their
broadcast is bounded whatever the corpus); a longer list of one's own is
broadcast only up to BROADCAST_GRAMS grams and joined by shuffle beyond.

Defined results: a null text counts as empty (no words, no labels, score 0);
repeated rows give repeated results; other columns are not returned; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

K = 3
#: Diagonals at most so far apart are merged.
NEAR = 3
#: The share of a template's grams that a finding has to have.
COVER = 0.6
BROADCAST_GRAMS = 200_000

# Fixed values of the contract: phrases and labels of the base.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short public notices by which licenses are commonly named (fixed texts), lower case without punctuation.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: The name of a gram that stands for the text itself.
EVERY = 0x5DEECE66D2B79F31

#: Words of a label's templates that a finding has to have, as they set the license apart from others of nearly the same words.
REQUIRED = {"apache-2": {"2"}, "gpl-2": {"2"}, "gpl-3": {"3"}, "mpl-2.0": {"2"}, "lgpl": {"lesser"}, "cc-by-nc": {"nc", "noncommercial"}, "cc-by-sa": {"sa", "sharealike"}}

#: A word of the contract, before lower-casing: every run of digits, letters and what lies beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    # The Kelvin sign is the one character outside ASCII whose lower case is a single ASCII letter.
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def grams(words: Column) -> Column:
    """Hashes of the word k-grams, in order; null for the last places, which have no k words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # A one-element array binds the hashes, which else were made anew for every use.
    return F.element_at(F.transform(F.array(hashed), lambda h: F.transform(h, lambda x, i: F.when(F.get(h, i + (K - 1)).isNotNull(), F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)])))), 1)


def templates(spark: SparkSession, labelled=None) -> DataFrame:
    """A row for each gram of a template or phrase: gram, template, label, base, q (place), grams (of the template), phrase (words), must (places of required words)."""
    must = lambda label, text: [k for k, w in enumerate(text.split(" ")) if w in REQUIRED.get(label, ())]
    rows = [(i, label, text, True, []) for i, (text, label) in enumerate(PHRASES.items())]
    rows += [(len(rows) + i, label, text, False, must(label, text)) for i, (label, text) in enumerate(labelled or TEMPLATES)]
    table = spark.createDataFrame(rows, "template int, label string, text string, base boolean, must array<int>").select("template", "label", "base", "must", F.split("text", " ").alias("phrase"))
    made = table.select("template", "label", "base", "must", "phrase", (F.size("phrase") - K + 1).alias("grams"), F.posexplode(grams(F.col("phrase"))).alias("q", "gram")).where("gram is not null")
    # Every text holds the gram EVERY once, so that one pass gives its words' number, too.
    every = spark.range(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.expr("cast(array() as array<int>)").alias("must"), F.expr("cast(array() as array<string>)").alias("phrase"), F.lit(1).alias("grams"), F.lit(0).alias("q"), F.lit(EVERY).alias("gram"))
    return made.union(every)


def scan_licenses(docs: DataFrame, labelled=None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), findings (array of label, start, end, cover, required, matched) and score."""
    spark = docs.sparkSession
    worded = docs.select("doc_id", common.row_key().alias("_row"), words_of(F.col("text")).alias("words"))
    all_grams = F.concat(grams(F.col("words")), F.array(F.lit(EVERY)))
    each = worded.select("doc_id", "_row", "words", all_grams.alias("grams")).select("doc_id", "_row", "words", F.posexplode_outer("grams").alias("p", "gram")).where("gram is not null")
    table = templates(spark, labelled)
    small = sum(len(t.split()) for _, t in (labelled or TEMPLATES)) <= BROADCAST_GRAMS
    hits = each.join(F.broadcast(table) if small else table, "gram")
    # The words stand beside the hit, so the base phrases are compared word by word here.
    whole = F.col("base") & (F.col("q") == 0) & (F.slice("words", F.col("p") + 1, F.size("phrase")) == F.col("phrase"))
    votes = hits.select("doc_id", "_row", "template", "label", "base", "must", F.col("grams").alias("n"), (F.col("p") - F.col("q")).alias("diagonal"), "p", "q", F.when(F.col("template") < 0, F.size("words")).cast("bigint").alias("n_words"), whole.alias("whole"))
    votes = votes.where("not base or whole").drop("whole")
    # Repeated rows vote once; how often a row stands is kept.
    votes = votes.groupBy(*votes.columns).agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("doc_id", "_row", "template").orderBy("diagonal", "p")
    far = (F.col("diagonal") - F.lag("diagonal").over(order)) > NEAR
    merged = votes.withColumn("_new", F.coalesce(far | F.col("base"), F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("doc_id", "_row", "template", "_group").orderBy("p", "q")
    cut = (F.col("q") + NEAR < F.lag("q").over(along)) | (F.col("p") - F.lag("p").over(along) > F.col("n") + K)
    pieces = merged.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("_piece", F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = pieces.groupBy("doc_id", "_row", "template", "label", "base", "must", "n", "_group", "_piece").agg(F.sort_array(F.collect_set("q")).alias("qs"), F.min("p").alias("start"), (F.max("p") + K).alias("end"), F.max("n_words").alias("n_words"), F.max("times").alias("times"))
    # Verified: distinct places of the template, as grams and as words.
    spans = spans.withColumn("places", F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + K - 1)))))
    spans = spans.withColumn("cover", F.when(F.col("base"), F.lit(1.0)).otherwise(F.size("qs") / F.col("n"))).where((F.col("cover") >= COVER) & (F.size(F.array_except("must", "places")) == 0))
    spans = spans.select("doc_id", "_row", "template", "n_words", "times", "label", "base", "start", "end", "cover", F.size("must").alias("required"), F.size("places").alias("matched"))
    found = spans.groupBy("doc_id", "_row").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template") < 0, F.col("times"))).alias("times"),
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(~F.col("base") & (F.col("template") >= 0), F.struct("label", "start", "end", "cover", "required", "matched")))).alias("findings"),
        F.max(F.when(F.col("template") >= 0, F.col("cover"))).alias("score"),
    )
    # Of findings that overlap, those stay that have the most required words, then matched ones (versions of one license share most of their words).
    rank = lambda f: F.struct(f["required"], f["matched"])
    beaten = lambda f: F.exists("findings", lambda g: (rank(g) > rank(f)) & (g["start"] < f["end"]) & (f["start"] < g["end"]))
    found = found.withColumn("findings", F.filter("findings", lambda f: ~beaten(f))).withColumn("labels", F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("findings", lambda f: f["label"])))))
    out = found.select("*", F.explode_outer(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("_again"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "findings", F.coalesce("score", F.lit(0.0)).alias("score"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_licenses(docs)
    return out.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")}).drop("findings")
