"""Toxicity by weak supervision.

Many voters, words and word stems of a lexicon and a few patterns, each speak or stay
silent on a text. A generative model with a latent class estimates by expectation
maximisation how often each voter speaks for either class, and how far voters go
together within a class; its posteriors are the labels that a linear classifier is
trained on. Only the classifier scores texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.langid import remainder

#: Bounds of the labelled sample (rows of a class) and of the number of voters.
ROWS_PER_CLASS = 5000
VOTERS = 600
#: A voter speaks on at least so many toxic rows, and on at least this share of them.
LEAST_SUPPORT = 4
LEAST_SHARE = 0.012
LEAST_LIFT = 2.5
STEMS = (4, 5, 6, 7, 8)
#: A stem that is found twice, or three times, in a text speaks as a voter of its own.
TIMES = (2, 3)

_WORD = re.compile(r"[^\W\d_]+")
# Pattern voters, by name.
PATTERNS = {
    "!shout": re.compile(r"!{3,}"),
    "!you": re.compile(r"(?i)\byou(?:'re| are)\s+(?:a|an|such)\b"),
    "!hate": re.compile(r"(?i)\bi\s+hate\b|\bgo\s+to\s+hell\b|\bshut\s+up\b"),
    "!masked": re.compile(r"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]*\b"),
}
#: Voters for the length of a text, in words.
LENGTHS = {"!over100": 100, "!over300": 300, "!over1000": 1000, "!over3000": 3000}
_HEAD = min(STEMS)


def marks(text: str, heads: set[str] | None = None) -> set[str]:
    """What the voters look at in a whole text: its lower-cased words, their stems (`abcd*`),
    stems found more than once (`abcd*2`), patterns, and the length. With ``heads``, only words
    that begin with one of these four letters are looked at."""
    words = _WORD.findall(text.lower())
    out = {name for name, least in LENGTHS.items() if len(words) > least}
    out.update(name for name, pattern in PATTERNS.items() if pattern.search(text))
    if heads is not None:
        words = [w for w in words if w[:_HEAD] in heads]
    out.update(words)
    for n in STEMS:
        stems = Counter([w[:n] for w in words if len(w) > n])
        out.update([k + "*" for k in stems])
        out.update([f"{k}*{t}" for k, v in stems.items() if v > 1 for t in TIMES if v >= t])
    return out


@dataclass
class Model:
    """The classifier: a weight for each voter's mark, and a constant."""

    weights: dict[str, float]
    constant: float

    def __post_init__(self) -> None:
        self.heads = {k[:_HEAD].split("*")[0] for k in self.weights if k[0] != "!"}

    def score(self, text: str) -> float:
        known = self.weights
        total = self.constant + sum([known[m] for m in marks(text, self.heads) if m in known])
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, rates by class, weights) of a latent-class model of ``votes`` (rows x voters, bool).

    ``known``: 1, 0, or -1 where the label is not known; known rows stay as they are while the
    rates are estimated, and all rows get a posterior in the end. A voter's weight falls with
    the sum of squares of its correlations with the other voters, within each class by its share, so
    that a word and its own stem count about once. Known rows fix which class is which; the accuracies
    are estimated from them and from the unknown rows' votes together.
    """
    x = votes.astype(np.float64)
    n, v = x.shape
    post = np.where(known >= 0, known, 0.5 * (x.sum(axis=1) > 0)).astype(np.float64)
    weights, rates, odds = np.ones(v), np.full((2, v), 0.5), np.zeros(n)
    for step in range(rounds):
        share = np.clip(post[known >= 0].mean() if (known >= 0).any() else post.mean(), 1e-4, 1 - 1e-4)
        for y, p in ((1, post), (0, 1 - post)):
            rates[y] = (p @ x + 2.0 * x.mean(axis=0) + 1e-3) / (p.sum() + 2.0)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        if step % 8 == 0 and v > 1:
            square = np.zeros((v, v))
            for y, p in ((1, post), (0, 1 - post)):
                centred = (x - rates[y]) * np.sqrt(p)[:, None]
                cov = centred.T @ centred / max(p.sum(), 1e-9)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                square += p.mean() * (cov / sd[:, None] / sd[None, :]) ** 2
            np.fill_diagonal(square, 0)
            square[square < 0.05] = 0  # noise of a finite sample
            weights = 1 / np.sqrt(1 + square.sum(axis=1))
        # A voter that stays silent abstains: only what is said counts.
        odds = np.log(share / (1 - share)) + x @ (weights * np.log(rates[1] / rates[0]))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        fresh = np.where(known >= 0, known, fresh)
        if np.abs(fresh - post).max(initial=0) < 1e-5 and step > 8:
            break
        post = fresh
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30))), rates, weights


def linear(votes: np.ndarray, target: np.ndarray, penalty: float = 5e-5, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps with a ridge; both classes weigh the same."""
    n, v = votes.shape
    x = np.concatenate([votes, np.ones((n, 1), dtype=bool)], axis=1).astype(np.float32)
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight /= max(weight.sum(), 1e-9)
    ridge = np.full(v + 1, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(v + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        slope = x.T @ (weight * (p - target)).astype(np.float32) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6)).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(curve.astype(np.float64) + np.diag(ridge), slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of each class (text of ``docs``, toxic of ``labels``).

    A document labelled more than once counts as toxic if any label says so; labels other
    than 0 and 1 and labels of unknown documents are passed over. Of repeated rows of a document
    the least text counts, null and empty texts vote by their silence. Without rows of both classes
    every text scores 0.5 or less.
    """
    spark = docs.sparkSession
    said = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = said.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).select("doc_id", "toxic")
    few = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in few.collect()], f"doc_id {dict(labels.dtypes)['doc_id']}, toxic int")  # 2 * per_class at most
    # Repeated rows of a doc_id: one text stands for it, so the sample keeps its bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def spread(batches):
        for b in batches:
            rows = [(i, int(y), m) for i, y, t in zip(b["doc_id"], b["toxic"], b["text"], strict=True) for m in marks(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "mark"])

    counted = (
        sample.mapInPandas(spread, "doc_id long, toxic int, mark string")
        .groupBy("mark").agg(F.sum("toxic").cast("double").alias("bad"), F.sum(1 - F.col("toxic")).cast("double").alias("good"))
        .where(F.col("bad") >= LEAST_SUPPORT)
    )
    total = few.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = float(total[0] or 0), float(total[1] - (total[0] or 0))
    if not bad or not good:
        return Model({}, 0.0 if bad else -5.0)
    lift = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # Voters: the marks that tell most about the class, by lift times the share they speak on.
    chosen = counted.where(F.col("bad") >= LEAST_SHARE * bad).withColumn("lift", lift).where(F.col("lift") > LEAST_LIFT).orderBy(F.desc(F.col("lift") * F.sqrt(F.col("bad"))), "mark").limit(VOTERS)
    voters = sorted({r["mark"] for r in chosen.collect()} | set(PATTERNS) | set(LENGTHS))
    at = {m: i for i, m in enumerate(voters)}

    def vote(batches):
        for b in batches:
            rows = [sorted(at[m] for m in marks(t or "") if m in at) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "votes": rows})

    rows = sample.mapInPandas(vote, "toxic int, votes array<int>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["votes"]))
    votes = np.zeros((len(rows), len(voters)), dtype=bool)
    for i, r in enumerate(rows):
        votes[i, r["votes"]] = True
    # Every second labelled row counts as unlabelled, so the posteriors rest on the voters.
    known = np.array([r["toxic"] if i % 2 == 0 else -1 for i, r in enumerate(rows)])
    speaks = np.array([m not in LENGTHS for m in voters])  # a length is the classifier's business, not a vote
    posterior, _, _ = label_model(votes[:, speaks], known)
    w, b = linear(votes, posterior)
    return Model(dict(zip(voters, map(float, w), strict=True)), float(b))


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score, 0 to 1, of each whole text; null counts as empty."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in batches:
            yield pd.Series([own.score(t or "") for t in texts], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels of rows that are not held out."""
    from webloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(remainder(3) != 1))
    out = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), score(spark, model, F.col("text")).alias("score"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
