"""License scans by diagonal voting, in built-in expressions only (operator 12).

A template is a notice as a row of words. Every run of ``k`` consecutive words of every text that begins with a word with which
a run of a template begins is hashed and joined to the hashes of the templates' runs; a pair that meets is compared word by
word. If the run stands at word i of the text and at
word j of the template, it votes for the *diagonal* i - j: an unchanged copy has all its votes on one diagonal, and each
inserted or deleted word moves the rest of it to the next one. So votes are added up by text, template and diagonal,
diagonals that are at most ``shift`` apart are merged, and the merged *span* is verified: the share of the template's words
that its votes cover must reach ``least``, and the span must not be longer than ``STRETCH`` templates.

Phrases are templates with ``shift`` 0 and ``least`` 1, so their spans are the places where they stand word for word.

The templates are the broadcast side of the join, as long as they have ``BROADCAST_WORDS`` words at most; the runs of the
corpus are never shuffled, only those that met a template. Votes of a text are counted once, however many equal rows
there are.

Cases: null and empty texts have no words, no labels and score 0; rows with one id and different texts are told apart by a
64-bit hash of the text, and equal rows get equal results; rows without id are scanned like all others; overlapping
places count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRETCH = 2
BROADCAST_WORDS = 200_000
MOST_FIRST = 10_000
"""With more different first words, runs are hashed wherever they begin."""


class Template(NamedTuple):
    """``words`` are in lower case, with one space between them; there are at least ``k`` of them."""

    label: str
    words: str
    k: int = 3
    shift: int = 3
    least: float = 0.6


def phrase(label: str, words: str) -> Template:
    """A template that stands word for word or not at all."""
    return Template(label, words, 2, 0, 1.0)


# Phrases and labels that a scan always reports.
PHRASES = (
    phrase("cc-by", "cc by"),
    phrase("gpl", "general public license"),
    phrase("reserved", "all rights reserved"),
)
# Sentences of common license notices.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(text: Column) -> Column:
    """Words of a text: code points other than ASCII punctuation, blanks and controls, A-Z in lower case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower())
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _starts(words: Column, first: Sequence[str] | None) -> Column:
    """Words (from 0) at which a run may begin: those in ``first``, or all."""
    places = F.transform(words, lambda w, i: i if first is None else F.when(w.isin(*first), i))
    return F.filter(places, lambda i: i.isNotNull())


def _runs(words: Column, starts: Column, k: int) -> Column:
    """``i`` (from 0), ``k``, ``gram`` and its ``hash`` of each run of ``k`` words that begins at one of ``starts``."""
    whole = F.filter(starts, lambda i: i <= F.size(words) - k)
    grams = F.transform(whole, lambda i: F.struct(i.alias("i"), F.slice(words, i + 1, k).alias("gram")))
    return F.transform(grams, lambda g: F.struct(g["i"].alias("i"), F.lit(k).alias("k"), g["gram"].alias("gram"), F.xxhash64(F.lit(k), g["gram"]).alias("hash")))


def _template_runs(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """``hash, template, j, gram`` of each run of the templates."""
    fixed = [F.struct(F.lit(n).alias("template"), F.split(F.lit(t.words), " ").alias("words"), F.lit(t.k).alias("k")) for n, t in enumerate(templates)]
    rows = spark.range(1).select(F.inline(F.array(*fixed)))
    parts = [rows.filter(F.col("k") == k).select("template", F.inline(_runs(F.col("words"), _starts(F.col("words"), None), k)))
             for k in sorted({t.k for t in templates})]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("hash", "template", F.col("i").alias("j"), "gram")


def votes(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """``doc_id, row, template, i, j``: runs of the texts that are runs of a template, once for equal rows."""
    spark = docs.sparkSession
    fixed = _template_runs(spark, templates)
    if sum(len(t.words.split(" ")) for t in templates) <= BROADCAST_WORDS:
        fixed = F.broadcast(fixed)
    first = sorted({w for t in templates for w in t.words.split(" ")[: 1 - t.k or None]})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("starts", _starts(F.col("words"), first if len(first) <= MOST_FIRST else None))
    runs = F.concat(*[_runs(F.col("words"), F.col("starts"), k) for k in sorted({t.k for t in templates})])
    met = rows.select("doc_id", "row", F.inline(runs)).join(fixed.withColumnRenamed("gram", "words"), "hash")
    met = met.filter(F.col("gram") == F.col("words"))
    return met.select("doc_id", "row", "template", "i", "j").distinct()


def spans(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """``doc_id, row, template, label, first, end, score, verified``: each merged span of words ``first`` to ``end`` (not
    included) with the share of the template that it covers."""

    def of(field: str) -> Column:
        return F.element_at(F.array(*[F.lit(getattr(t, field)) for t in templates]), F.col("template") + 1)

    size = F.element_at(F.array(*[F.lit(len(t.words.split(" "))) for t in templates]), F.col("template") + 1)
    place = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal", "i")
    on = votes(docs, templates).withColumn("diagonal", F.col("i") - F.col("j"))
    apart = F.col("diagonal") - F.lag("diagonal").over(place) > of("shift")
    on = on.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(place))
    # A template has few places, so the set is short however many votes there are.
    out = on.groupBy("doc_id", "row", "template", "span").agg(
        F.min("i").alias("first"), F.max(F.col("i") + of("k")).alias("end"), F.collect_set("j").alias("js")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + of("k") - 1)))))
    out = out.withColumn("score", covered / size)
    good = (F.col("score") >= of("least")) & (F.col("end") - F.col("first") <= STRETCH * size)
    return out.select("doc_id", "row", "template", of("label").alias("label"), "first", "end", "score", good.alias("verified"))


def scanned(docs: DataFrame, notices: Sequence[Template] = NOTICES, phrases: Sequence[Template] = PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` tell of the phrases' places, ``labels`` of all verified spans. The score
    is the largest share of a template that the text covers.
    """
    found = spans(docs, [*phrases, *notices])
    base, verified = (F.col("template") < len(phrases)) & F.col("verified"), F.col("verified")
    first = F.when(base, F.col("first"))
    per_row = found.groupBy("doc_id", "row").agg(
        F.count_if(base).alias("n_base"), F.min(first).cast("long").alias("first_word"), F.max(first).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"), F.max("score").alias("score"),
    )
    per_row = per_row.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    n_words = F.size(words_of(F.col("text"))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), n_words.alias("n_words"))
    out = rows.join(per_row, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = [F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word"]
    none += [F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", *none, F.coalesce("score", F.lit(0.0)).alias("score"))
