"""Quality rules and robust outliers of text statistics by language and source (operator 2).

All built-in expressions. Base rules look at one text; the method looks at a document among those of its language and
source. Of the documents that pass the base rules, transformed statistics (``vector``) give each group a minimum
covariance determinant estimate: from two starts (all rows; medians and absolute deviations), concentration steps take
the ``SHARE`` of rows with the smallest distances and estimate mean and covariance anew, and the start with the smaller
determinant wins. A document is rejected if its squared Mahalanobis distance is above ``CUTOFF``.

A step is one aggregate: rows are counted and summed by group and by distance in bins of 1/16 octave, and the first bins
that together hold the share are the subset, so no group's distances are sorted or gathered. ``FLOORS`` squared is added to
the diagonal of each covariance: it keeps it regular when most rows agree in a statistic.

Cases: a null or empty text has no words and fails the base rules; null languages and sources are values of their own;
groups of fewer than ``LEAST`` rows take the estimate of their language, then of all rows, and if these are fewer as well,
the base rules alone decide; equal rows get equal verdicts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.llm import shared

SPACES = " \t\n\u000b\f\r"
P = 4
SHARE = 0.75
LEAST = 200
STEPS = 4
CUTOFF = 40.0
FLOORS = (0.3, 0.4, 0.3, 0.08)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the text, each word counted once."""

    def of(found: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(found) - 3)
        hashed = F.transform(at, lambda i: F.struct(F.xxhash64(found[i], found[i + 1], found[i + 2]).alias("h"), i.alias("i")))
        return _let(F.sort_array(hashed), covered)

    def covered(ordered: Column) -> Column:
        def twice(e: Column, k: Column) -> Column:
            near = F.when(k > 0, F.get(ordered, k - 1)["h"] == e["h"])
            return F.coalesce(near, F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == e["h"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(ordered, twice), lambda e: e["i"]))
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(of(words))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the statistics of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")).alias(c) for c in ("lang", "source")]
    figures = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *named, figures.alias("f"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select("doc_id", "lang", "source", "f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics; sizes of texts alone say nothing about quality and are not among them."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.col("word_chars") / n,
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _consistency(share: float = SHARE) -> float:
    """What the covariance of the inner share of a normal sample of four dimensions is multiplied by."""
    low, high = 0.0, 100.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < share else (low, x)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _estimate(n: Column, sums: list[Column], products: dict[tuple[int, int], Column], scale: float) -> list[Column]:
    """Mean ``m0..`` and covariance ``s00..`` from sums."""
    means = [(s / n).alias(f"m{i}") for i, s in enumerate(sums)]
    out = []
    for (i, j), product in products.items():
        value = scale * (product / n - (sums[i] / n) * (sums[j] / n))
        out.append(((F.greatest(value, F.lit(0.0)) + FLOORS[i] ** 2) if i == j else value).alias(f"s{i}{j}"))
    return means + out


def _factored(model: DataFrame) -> DataFrame:
    """The model with the Cholesky factor ``l00..`` of its covariance and the logarithm of the determinant."""
    for i, j in sorted(PAIRS):
        rest = F.col(f"s{i}{j}") - reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
        model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    logs = [F.log(F.col(f"l{i}{i}")) for i in range(P)]
    return model.withColumn("logdet", 2 * reduce(lambda a, b: a + b, logs))


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution, each step computed once."""
    zs: list[Column] = []

    def step(i: int) -> Column:
        if i == P:
            return reduce(lambda a, b: a + b, [z * z for z in zs])
        below = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * zs[k] for k in range(i)], F.lit(0.0))
        value = (x[i] - F.col(f"m{i}") - below) / F.col(f"l{i}{i}")
        zs.append(value)
        return step(i + 1)

    return step(0)


def _sums(x: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"t{i}") for i in range(P)],
            *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS]]


MODEL = [f"m{i}" for i in range(P)] + [f"s{i}{j}" for i, j in PAIRS]


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``key, size`` and the best model of each group of ``rows`` (``key, x0..x3``)."""
    x = [F.col(f"x{i}") for i in range(P)]
    from_sums = ([F.col(f"t{i}") for i in range(P)], {p: F.col("q{}{}".format(*p)) for p in PAIRS})
    every = rows.groupBy("key").agg(*_sums(x))
    classic = every.select("key", F.lit(0).alias("start"), F.col("n").alias("size"), *_estimate(F.col("n"), *from_sums, 1.0))
    middle = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(x)])
    middle = shared.checkpointed(middle)
    away = rows.join(middle, "key").groupBy("key").agg(
        F.first("size").alias("size"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[F.percentile_approx(F.abs(x[i] - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(P)],
    )
    spread = [(F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS]
    robust = away.select("key", F.lit(1).alias("start"), "size", *[f"m{i}" for i in range(P)], *spread)
    model = shared.checkpointed(_factored(classic.unionByName(robust)))
    for _ in range(steps):
        placed = rows.join(model, "key").withColumn("bin", F.floor(16 * F.log2(_distance(x) + 2.0**-20)).cast("int"))
        bins = placed.groupBy("key", "start", "size", "bin").agg(*_sums(x))
        upto = Window.partitionBy("key", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        names = ["n", *[f"t{i}" for i in range(P)], *["q{}{}".format(*p) for p in PAIRS]]
        inner = bins.select("key", "start", "size", F.col("n").alias("own"), *[F.sum(c).over(upto).alias(c) for c in names])
        need = F.ceil(SHARE * F.col("size"))
        inner = inner.filter((F.col("n") >= need) & (F.col("n") - F.col("own") < need))
        model = shared.checkpointed(_factored(inner.select("key", "start", "size", *_estimate(F.col("n"), *from_sums, _consistency()))))
    best = model.groupBy("key").agg(F.min(F.struct("logdet", "start")).alias("b")).select("key", F.col("b.start").alias("start"))
    return model.join(best, ["key", "start"]).drop("start", "logdet")


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``."""
    levels = {"group": F.array("lang", "source"), "lang": F.array("lang")}
    everything = F.array().cast("array<string>")
    rows = statistics(docs)
    rows = shared.written(rows.select("*", *[c.cast("double").alias(f"x{i}") for i, c in enumerate(vector())]))
    keys = F.explode(F.array(*levels.values(), everything)).alias("key")
    model = shared.written(estimates(rows.filter("NOT base_failed").select(keys, *[f"x{i}" for i in range(P)])))
    model = model.filter(F.col("size") >= LEAST)
    fields = [c for c in model.columns if c != "key"]
    for level, key in levels.items():
        one = model.select(F.col("key").alias(f"key_{level}"), F.struct(*fields).alias(f"model_{level}"))
        rows = rows.withColumn(f"key_{level}", key).join(one, f"key_{level}", "left")
    # The estimate of all rows is one row; as literals it needs no join.
    last = model.filter(F.size("key") == 0).select(*fields).first()
    types = {f: model.schema[f].dataType for f in fields}
    whole = F.struct(*[F.lit(None if last is None else last[f]).cast(types[f]).alias(f) for f in fields])
    whole = F.when(F.lit(last is not None), whole)
    rows = rows.withColumn("model", F.coalesce(*[f"model_{level}" for level in levels], whole)).select("*", "model.*")
    distance = _distance([F.col(f"x{i}") for i in range(P)])
    kept = ~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(*base, kept.alias("kept"), distance.alias("distance"))
