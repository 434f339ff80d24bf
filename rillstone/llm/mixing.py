"""Mixing documents to target shares of tokens by source, language and topic (operator 10).

Iterative proportional fitting: the tokens of each (source, language, topic) cell are scaled in turn so that their sums
by source, by language and by topic meet the targets, round after round. The scaled share of a cell over its own share is
the factor of its documents; a document is kept with probability ``min(1, rate * factor)`` and carries the weight
``factor / probability``, so that weighted tokens of the sample meet the targets on average. Where weights cannot be passed
on, ``bounded`` gives probabilities with which the bare tokens of the sample meet them. The draw is a hash of the
document's id, so it repeats.

Targets are shares of the observed tokens raised to a power: 1 leaves a marginal as it is, 0 makes it uniform over the
values that have tokens.

Cases: a null text has no tokens; null sources, languages and topics are each one value of their own; documents of cells
without tokens have the factor 1; rows with the same id get the same draw; an empty table gives no rows; columns of other
names are passed on only by ``sampled``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.llm import shared

POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.7}
ROUNDS = 8
TRIALS = 8
CLOSE = 0.01
SPACES = " \t\n\u000b\f\r"


def n_words(text: Column) -> Column:
    """Words between white space, in a whole text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[ \t-\r]+"))).cast("long")


def topic(text: Column) -> Column:
    """A topic from what stands in a whole text: the first that fits."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    numbers = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    legal = low.contains("licensed under") | low.contains("all rights reserved") | low.contains("copyright")
    return (
        F.when(legal, "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(symbols * 50 > F.length(text), "markup")
        .when(numbers * 50 > F.length(text), "figures")
        .otherwise("prose")
    )


TOPIC_SQL = """CASE WHEN contains(lower(t), 'licensed under') OR contains(lower(t), 'all rights reserved') OR contains(lower(t), 'copyright')
      THEN 'legal' WHEN contains(t, '@') THEN 'contact'
      WHEN (length(t) - length(translate(t, '#*$%&|<>', ''))) * 50 > length(t) THEN 'markup'
      WHEN (length(t) - length(translate(t, '0123456789', ''))) * 50 > length(t) THEN 'figures' ELSE 'prose' END"""


def _raked(cells: DataFrame, powers: dict[str, float], rounds: int) -> tuple[DataFrame, int]:
    """``cells`` with the goals of their values and ``factor``, and the tokens of all cells."""
    def summed(by: list[str]) -> Column:
        return F.sum("share").over(Window.partitionBy(*by))

    cells = cells.filter("tokens > 0").withColumn("share", F.col("tokens").cast("double"))
    cells = shared.checkpointed(cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for name, power in powers.items():
        goal = shared.checkpointed(cells.groupBy(name).agg(F.pow(F.sum("share"), F.lit(power)).alias(f"goal_{name}")))
        whole = goal.agg(F.sum(f"goal_{name}")).first()[0] or 1.0
        cells = cells.join(goal.withColumn(f"goal_{name}", F.col(f"goal_{name}") / F.lit(float(whole))), name)
    cells = shared.checkpointed(cells)
    for k in range(rounds):
        for name in powers:
            cells = cells.withColumn("share", F.col("share") * (F.col(f"goal_{name}") / summed([name])))
        if k % 4 == 3 or k == rounds - 1:
            cells = shared.checkpointed(cells)
    goals = [f"goal_{name}" for name in powers]
    return cells.select(*powers, *goals, "tokens", (F.col("share") * F.lit(total) / F.col("tokens")).alias("factor")), total


def raked(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the names in ``powers`` and ``tokens``) with ``factor``; cells without tokens are left out.

    What is summed by value are cells, at most one for each combination of values, never documents. Every few rounds
    are written to the shared folder, so plans stay short.
    """
    return _raked(cells, powers, rounds)[0].select(*powers, "tokens", "factor")


def bounded(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``probability``: the shares of a sample without weights meet the targets on average.

    A value with the share s and the target g lets no sample keep more than s / g of all tokens. ``TRIALS`` shares to keep,
    from the one at which no factor is above 1 up to the least s / g, are raked at the same time under the bound
    ``probability <= 1``: a step scales the cells of a value by the number that brings the sum of ``min(1, scaled)`` to
    the goal. Of the shares whose sums all come within ``CLOSE`` of their goals the largest is taken; if none does (targets
    that contradict each other), the one that comes closest.
    """
    cells, total = _raked(cells.withColumn("tokens", F.col("tokens").cast("long")), powers, rounds)
    cells = shared.checkpointed(cells)
    bounds = [F.sum("tokens").over(Window.partitionBy(name)) / (F.col(f"goal_{name}") * F.lit(float(total or 1))) for name in powers]
    largest, most = cells.select("factor", F.least(*bounds).alias("bound")).agg(F.max("factor"), F.min("bound")).first()
    if largest is None:
        return cells.select(*powers, F.lit(1.0).alias("probability"))
    least = min(1.0, 1 / largest)
    rates = [least * (max(least, most) / least) ** (k / (TRIALS - 1)) for k in range(TRIALS)]
    cells = cells.select("*", F.posexplode(F.array(*map(F.lit, rates))).alias("trial", "rate"))
    cells = cells.withColumn("scaled", F.col("rate") * F.col("factor"))

    def aim(name: str) -> Column:
        return F.col("rate") * F.col(f"goal_{name}") * F.lit(float(total))

    for k in range(rounds):
        for name in powers:
            value = Window.partitionBy("trial", name)
            smaller = value.orderBy("scaled", *powers).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            # With the larger cells kept whole, the others need this factor; the largest such number is the right one.
            whole = F.sum("tokens").over(value) - F.sum("tokens").over(smaller)
            scale = F.try_divide(aim(name) - whole, F.sum(F.col("tokens") * F.col("scaled")).over(smaller))
            cells = cells.withColumn("_scale", scale).withColumn("scaled", F.col("scaled") * F.max("_scale").over(value))
        if k % 2 == 1 or k == rounds - 1:
            cells = shared.checkpointed(cells.drop("_scale"))
    cells = cells.withColumn("probability", F.least(F.lit(1.0), "scaled"))
    kept = F.col("tokens") * F.col("probability")
    missed = [F.abs(F.sum(kept).over(Window.partitionBy("trial", name)) / aim(name) - 1) for name in powers]
    errors = dict(cells.select("trial", F.greatest(*missed).alias("missed")).groupBy("trial").agg(F.max("missed")).collect())
    best = max(k for k, missed_by in errors.items() if missed_by <= max(CLOSE, min(errors.values())))
    return cells.filter(F.col("trial") == best).select(*powers, "probability")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the id."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mixed(docs: DataFrame, rate: float = 1.0, seed: str = "mix", powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, weight, kept`` of each document."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")).alias(c) for c in ("source", "lang")]
    rows = docs.select("doc_id", *named, topic(F.col("text")).alias("topic"), n_words(F.col("text")).alias("n_tokens"))
    rows = shared.written(rows)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    factors = shared.written(raked(cells, powers, rounds).select("source", "lang", "topic", "factor"))
    out = rows.join(factors, ["source", "lang", "topic"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    out = out.withColumn("probability", F.least(F.lit(1.0), rate * F.col("factor")))
    back = [F.when(F.col(c) != "\u0000null", F.col(c)).alias(c) for c in ("source", "lang")]
    return out.select(
        "doc_id", *back, "topic", "n_tokens", "probability", (F.col("factor") / F.col("probability")).alias("weight"),
        (draw(F.col("doc_id"), seed) < F.col("probability")).alias("kept"),
    )


def sampled(
    docs: DataFrame, rate: float = 1.0, seed: str = "mix", powers: dict[str, float] = POWERS, rounds: int = ROUNDS, unweighted: bool = False
) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The cell of a row, not its id, decides its probability.

    The rows are those that ``mixed`` keeps, and need its weights. With ``unweighted`` the probabilities are those of
    ``bounded`` (times ``rate``, at most 1), so that the kept rows meet the targets as they are.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in ("source", "lang")]
    cell = [named[0].alias("source"), named[1].alias("lang"), topic(F.col("text")).alias("topic")]
    cells = docs.select(*cell, n_words(F.col("text")).alias("n")).groupBy("source", "lang", "topic").agg(F.sum("n").alias("tokens"))
    if unweighted:
        limits, p = bounded(cells, powers, rounds), min(1.0, rate) * F.col("probability")
    else:
        limits, p = raked(cells, powers, rounds), F.least(F.lit(1.0), rate * F.col("factor"))
    # Cells are few, but not bounded; their draw limits come back by a join on the cell, whose large values AQE splits.
    limits = limits.select(F.struct("source", "lang", "topic").alias("_cell"), p.alias("_p"))
    marked = docs.withColumn("_cell", F.struct(*cell)).join(shared.written(limits), "_cell", "left")
    return marked.filter(draw(F.col("doc_id"), seed) < F.coalesce("_p", F.lit(1.0))).select(*docs.columns)


def statement(table: str = "documents", rate: float = 1.0, seed: str = "mix", powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the rows of ``mixed``, rounded like ``digits``."""
    parts = [
        f"""d AS MATERIALIZED (SELECT doc_id, source, lang, {TOPIC_SQL} AS topic,
      CASE WHEN length(trim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) = 0 THEN 0
           ELSE len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) END AS n_tokens
      FROM (SELECT *, coalesce(text, '') AS t FROM {table}))""",
        """c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens, sum(n_tokens)::DOUBLE AS share
      FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)""",
    ]
    for name, power in powers.items():
        parts.append(
            f"g_{name} AS MATERIALIZED (SELECT {name}, g / sum(g) OVER () AS goal FROM "
            f"(SELECT {name}, pow(sum(share), {power}) AS g FROM c0 GROUP BY {name}))"
        )
    step = 0
    for _ in range(rounds):
        for name in powers:
            parts.append(
                f"c{step + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.share * (g.goal / s.s) AS share FROM c{step} c "
                f"JOIN g_{name} g ON c.{name} IS NOT DISTINCT FROM g.{name} JOIN (SELECT {name}, sum(share) AS s FROM c{step} GROUP BY {name}) s "
                f"ON c.{name} IS NOT DISTINCT FROM s.{name})"
            )
            step += 1
    return f"""WITH {', '.join(parts)},
    f AS (SELECT source, lang, topic, share * (SELECT sum(tokens) FROM c{step}) / tokens AS factor FROM c{step}),
    p AS (SELECT d.*, coalesce(f.factor, 1.0) AS factor, least(1.0, {rate} * coalesce(f.factor, 1.0)) AS p FROM d LEFT JOIN f
      ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic)
    SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, floor(p * 1e9 + 0.5) / 1e9 AS probability, floor(factor / p * 1e9 + 0.5) / 1e9 AS weight,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / 4503599627370496.0 < p AS kept FROM p"""


def digits(mixed_rows: DataFrame) -> DataFrame:
    """``mixed`` rounded to nine digits, as sums in another order differ in the last ones."""
    for name in ("probability", "weight"):
        mixed_rows = mixed_rows.withColumn(name, F.floor(F.col(name) * 1e9 + 0.5).cast("double") / 1e9)
    return mixed_rows
