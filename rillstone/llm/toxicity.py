"""Toxicity by weak supervision (operator 5).

1. *Lexicon.* Words that mark toxic texts, found in the labelled rows for learning (equal texts
   count once), beside a short list of English insults.
2. *Voters.* ``VOTERS`` voters look at a text: parts of the lexicon, insults, patterns. Each says yes or no.
3. *Label model.* An exponential family over the votes and the unknown class: a weight for each voter and class (its
   accuracy) and for pairs of voters that agree more than the class explains (their correlation). It is fitted by exact
   likelihood: all rows enter through the count of each vote pattern (at most ``2 ** VOTERS``), labelled rows with
   their label as well.
4. *Classifier.* A logistic regression on votes and single terms, trained on the posterior labels of a bounded sample of
   labelled rows. A score is one pass of built-in expressions.

Cases: a null or empty text casts no vote and gets the classifier's score of no vote; a null label is no label; without
labelled rows of both classes the lexicon is the insults and the score is the share of voters that say yes; equal texts
get equal scores; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English insults.
INSULTS = [
    "clown", "coward", "disgusting", "dumb", "fool", "garbage", "idiot", "idiotic", "idiots", "imbecile", "jerk", "liar",
    "loser", "losers", "moron", "moronic", "morons", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
]
VOTERS = 14
PARTS = 8
"""Voters that each hold a part of the learned words."""


@dataclass(frozen=True)
class Learning:
    """Bounds of what is learned: labelled rows, terms, and what makes a term a mark."""

    labelled_rows: int = 50_000
    terms: int = 600
    least_toxic: int = 4
    least_share: float = 0.85


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def words_of(text: Column) -> Column:
    """Lower-case words of letters, and perhaps an empty one at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def marks(train: DataFrame, learning: Learning) -> list[str]:
    """Words that mark toxic texts, the most frequent first; at most ``learning.terms``.

    ``train`` has ``text, toxic``. A word needs ``least_toxic`` different toxic texts, and a smoothed share of toxic texts
    of at least ``least_share``.
    """
    once = train.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest")).agg(
        F.max("toxic").alias("toxic"), F.first("text").alias("text")
    )
    words = once.select("toxic", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).filter("word <> ''")
    counted = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    share = (F.col("t") + 0.2) / (F.col("n") + 0.5)
    found = counted.filter((F.col("t") >= learning.least_toxic) & (share >= learning.least_share))
    return [r.word for r in found.orderBy(F.desc("t"), "word").limit(learning.terms).collect()]


class Voters:
    """The voters over the learned ``words``."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted({*words, *INSULTS})
        self.parts = [[w for i, w in enumerate(words) if i % PARTS == k] for k in range(PARTS)]

    def found(self, text: Column) -> list[Column]:
        """Terms in a text and the few figures that the voters need; patterns about insults look at texts with terms."""
        plain = F.coalesce(text, F.lit(""))
        hits = F.array_intersect(words_of(text), F.array(*map(F.lit, self.words)))
        aimed = plain.rlike(rf"(?i)\b(?:you|are|is)\s+(?:\w+\s+)?(?:{'|'.join(INSULTS)})\b")
        one = F.transform(F.array(hits), lambda h: F.struct(h.alias("hits"), ((F.size(h) > 0) & aimed).alias("aimed")))[0]
        shout = F.contains(plain, F.lit("!!!")) | F.contains(plain, F.lit("???"))
        return [one.alias("found"), shout.alias("shout"), ((F.upper(plain) == plain) & (plain != "")).alias("capitals")]

    def votes(self) -> list[Column]:
        """One Boolean for each voter, from the columns of ``found``."""
        hits = F.col("found.hits")

        def any_of(terms: list[str]) -> Column:
            return F.arrays_overlap(hits, F.array(*map(F.lit, terms))) if terms else F.lit(False)

        out = [any_of(part) for part in self.parts]
        out += [any_of(INSULTS), F.size(hits) >= 2, F.size(hits) >= 3, F.col("found.aimed"), F.col("shout"), F.col("capitals")]
        assert len(out) == VOTERS
        return out

    def pattern(self) -> Column:
        return sum((v.cast("int") * F.lit(1 << k) for k, v in enumerate(self.votes())), F.lit(0)).alias("pattern")


def bits(patterns: np.ndarray) -> np.ndarray:
    return (np.asarray(patterns)[:, None] >> np.arange(VOTERS) & 1).astype(float)


class LabelModel:
    """log P(votes, y) = a·votes + y (b + w·votes) + sum of c over correlated pairs that both say yes - log Z.

    ``fit`` climbs the likelihood: rows without label count by their marginal, rows with label by their joint probability.
    All ``2 ** VOTERS`` patterns are summed, so Z, the gradient and the posterior are exact.
    """

    def __init__(self, pairs: int = 12, rounds: int = 900, rate: float = 0.08, ridge: float = 2e-4) -> None:
        self.n_pairs, self.rounds, self.rate, self.ridge = pairs, rounds, rate, ridge

    def fit(self, counts: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> LabelModel:
        """The three arrays count every pattern: all rows, rows labelled 0, rows labelled 1."""
        votes = bits(np.arange(1 << VOTERS))
        self.pairs: list[tuple[int, int]] = []
        features = votes
        self._climb(features, counts, clean, toxic)
        self.pairs = self._correlated(votes, counts, clean, toxic)
        features = np.hstack([votes, *[(votes[:, i] * votes[:, j])[:, None] for i, j in self.pairs]])
        self._climb(features, counts, clean, toxic)
        return self

    def _climb(self, features: np.ndarray, counts: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
        size, m = features.shape[1], VOTERS
        theta = np.zeros(size + m + 1)
        theta[size : size + m], theta[-1] = 1.5, -2.0
        theta[:m] = -1.0
        total, labelled = max(counts.sum(), 1.0), max(clean.sum() + toxic.sum(), 1.0)
        moment, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, self.rounds + 1):
            base, lift = features @ theta[:size], features[:, :m] @ theta[size : size + m] + theta[-1]
            log = np.stack([base, base + lift], 1)
            model = np.exp(log - log.max())
            model /= model.sum()
            post = 1 / (1 + np.exp(-lift))
            seen = np.stack([counts * (1 - post), counts * post], 1) / total
            told = np.stack([clean, toxic], 1) / labelled
            away = (seen + told) / (1 + (told.sum() > 0)) - model
            gain = np.concatenate([features.T @ away.sum(1), features[:, :m].T @ away[:, 1], [away[:, 1].sum()]])
            gain -= self.ridge * theta
            moment, square = 0.9 * moment + 0.1 * gain, 0.99 * square + 0.01 * gain**2
            theta = theta + self.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.accuracy, self.bias = theta[size : size + m], theta[-1]
        self.posterior = 1 / (1 + np.exp(-(features[:, :m] @ self.accuracy + self.bias)))
        self.joint = model

    def _correlated(self, votes: np.ndarray, counts: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int]]:
        """Pairs whose joint yes is furthest above what the model without pairs expects."""
        seen = (counts / max(counts.sum(), 1.0) + (clean + toxic) / max(clean.sum() + toxic.sum(), 1.0)) / 2
        excess = votes.T @ ((seen - self.joint.sum(1))[:, None] * votes)
        above = [(excess[i, j], i, j) for i in range(VOTERS) for j in range(i) if excess[i, j] > 1e-4]
        return [(i, j) for _, i, j in sorted(above, reverse=True)[: self.n_pairs]]


def logistic(features: np.ndarray, target: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft targets, by Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) / len(x) + penalty * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass
class Model:
    """What was learned: terms, the label model, and the weights of votes, single terms and the bias."""

    voters: Voters
    labels: LabelModel | None
    votes: list[float]
    terms: dict[str, float]
    bias: float

    def score(self) -> Column:
        """The score, from the columns of ``Voters.found``."""
        total = F.lit(self.bias)
        for weight, vote in zip(self.votes, self.voters.votes()):
            total = total + F.when(vote, F.lit(weight)).otherwise(0.0)
        if self.terms:
            pairs = [x for term, weight in self.terms.items() for x in (F.lit(term), F.lit(weight))]
            weights = F.create_map(*pairs)
            total = total + F.aggregate(F.col("found.hits"), F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at(weights, t), F.lit(0.0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, learning: Learning = Learning(), single_terms: int = 40) -> Model:
    """Fit on ``docs`` (``doc_id, text``) and the rows of ``labels`` (``doc_id, toxic``) that are not held out.

    At most ``learning.labelled_rows`` labelled documents are used: those with the smallest hash of their id.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(learning.labelled_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = texts.join(F.broadcast(ids), "doc_id").select("toxic", "text")
    voters = Voters(marks(train, learning))
    found = texts.select(*voters.found(F.col("text")))
    counts = np.zeros(1 << VOTERS)
    for row in found.select(voters.pattern()).groupBy("pattern").count().collect():
        counts[row.pattern] = row["count"]
    told = train.select("toxic", *voters.found(F.col("text"))).select("toxic", voters.pattern(), "found.hits").toPandas()
    label = told["toxic"].to_numpy(int)
    if not len(label) or label.min() == label.max():
        return Model(voters, None, [2.0] * VOTERS, {}, -2.0)
    pattern = told["pattern"].to_numpy(int)
    clean, toxic = (np.bincount(pattern[label == k], minlength=1 << VOTERS).astype(float) for k in (0, 1))
    model = LabelModel().fit(counts, clean, toxic)
    terms = list(told["hits"])
    frequent: dict[str, int] = {}
    for row in terms:
        for term in row:
            frequent[term] = frequent.get(term, 0) + 1
    columns = sorted(frequent, key=lambda t: (-frequent[t], t))[:single_terms]
    at = {t: i for i, t in enumerate(columns)}
    single = np.zeros((len(terms), len(columns)))
    for i, row in enumerate(terms):
        for term in row:
            if term in at:
                single[i, at[term]] = 1
    weights = logistic(np.hstack([bits(pattern), single]), model.posterior[pattern])
    single_weights = dict(zip(columns, map(float, weights[VOTERS:-1])))
    return Model(voters, model, [float(w) for w in weights[:VOTERS]], single_weights, float(weights[-1]))


def scored(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score as ``name``; one pass without shuffle."""
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *model.voters.found(F.col("text")))
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], model.score().alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, learning: Learning = Learning(), threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels, learning), "doc_id")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
