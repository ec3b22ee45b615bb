"""Toxic passages as maximal-scoring segments of word log-odds.

Fitting: numbers of toxic and clean labelled texts that hold a word give its log-odds with an informative
Dirichlet prior (the pooled counts). A word that leans to toxic texts by a likelihood-ratio test scores its
log-odds less a standard error, any other word a negative drift, so a random clean text drifts downwards. Scanning: one linear pass finds every maximal
segment (no longer or shorter span in it scores higher). A segment of score S in a text of n words is as
good as chance K n exp(-lambda S) times, the extreme-value law of such segments; lambda solves
E[exp(lambda s)] = 1 on clean words and K is its maximum-likelihood value on clean texts. A text's evidence is
the sum of (lambda S - ln K n) over its significant segments, which a two-parameter logistic fit on
labelled texts turns into a probability.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import durable

#: Labelled rows the model is fitted on at most (those with the smallest hash of doc_id).
SAMPLE_ROWS = 12_000
#: Weight of the pooled counts as prior, in words; least likelihood ratio of a scoring word; score of all
#: other words; expected chance segments up to which a segment counts.
PRIOR_WORDS = 20_000.0
MIN_RATIO = 12.0
DRIFT = -0.5
MAX_CHANCE = 0.05
WORD = re.compile(r"[^\W_]+")

PASSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("chance", T.DoubleType()),
        ]
    )
)


@dataclasses.dataclass
class Model:
    scores: dict[str, float]
    rate: float  # lambda
    scale: float  # K
    slope: float
    offset: float

    def chance(self, score: float, n: int) -> float:
        """Expected number of segments of this score in ``n`` clean words."""
        return self.scale * n * math.exp(-self.rate * score)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a score sequence, in one pass.

    Candidates are kept as a stack; each new positive run joins the last candidate to its left that starts
    from a lower running sum whenever that makes a larger total.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        left, right = float(sums[first]), float(sums[end])
        while True:
            k = len(stack) - 1
            # stacked sums before rise and sums after fall below what a scan has passed
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                stack.append((first, end, left, right))
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, r - lo) for a, b, lo, r in stack]


def _scored(model: Model, text: str) -> tuple[np.ndarray, int]:
    words = words_of(text)
    get = model.scores.get
    return np.fromiter((get(w, DRIFT) for w in words), np.float64, len(words)), len(words)


def evidence(model: Model, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Summed evidence and the significant segments (in words) of a text; 0 and none for clean ones."""
    if not text:
        return 0.0, []
    scores, n = _scored(model, text)
    found = [(a, b, s, model.chance(s, n)) for a, b, s in segments(scores)]
    found = [x for x in found if x[3] <= MAX_CHANCE]
    return sum(-math.log(max(x[3], 1e-300)) for x in found), found


def probability(model: Model, value):
    return 1.0 / (1.0 + np.exp(-(model.slope * np.log1p(value) + model.offset)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, in_training: Column, rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` training documents labelled 0 or 1; other labels are left out.

    The labels are cut to the bound first, so the side that meets the documents is small at any size.
    """
    picked = (
        labels.filter(in_training & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, in_training: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Model from labels whose doc_id passes ``in_training`` (a column of ``labels``).

    The sample is bounded by ``rows``; word counts are summed by Spark. With no labels of one class the
    model finds nothing and gives every text the share of toxic labels.
    """
    sample = labelled(docs, labels, "toxic", in_training, rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch["text"], batch["y"]):
                for w in set(words_of(text)):
                    seen.setdefault(w, [0, 0])[y] += 1
            pairs = list(seen.values())
            yield pd.DataFrame(
                {"word": list(seen), "clean": [p[0] for p in pairs], "toxic": [p[1] for p in pairs]}
            )

    counted = sample.mapInPandas(count, "word string, clean long, toxic long")
    pairs = counted.groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    pairs = durable(pairs)
    sizes = pairs.agg(F.sum("c").alias("c"), F.sum("t").alias("t")).first()
    n_c, n_t = float(sizes.c or 0), float(sizes.t or 0)
    if not n_c or not n_t:
        share = 1.0 if n_t else 0.0
        return Model({}, 1.0, 1.0, 0.0, 10.0 * (2 * share - 1))
    c, t, both = F.col("c"), F.col("t"), F.col("c") + F.col("t")
    prior = both * (PRIOR_WORDS / (n_c + n_t))
    expected = both * (n_t / (n_c + n_t))

    def log_odds(k, n):
        return F.log((k + prior) / (n + PRIOR_WORDS - k - prior))

    # likelihood ratio of the word's split over the classes against that of all words
    ratio = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (both - expected))).otherwise(0.0))
    scored = pairs.filter((t > 0) & (t > expected)).select(
        "word", "c", ratio.alias("ratio"), (log_odds(t, n_t) - log_odds(c, n_c) - 1 / F.sqrt(t + prior)).alias("low")
    )
    top = scored.filter((F.col("ratio") >= MIN_RATIO) & (F.col("low") > 0))
    # words of the bounded sample
    top = top.orderBy(F.desc("ratio"), "word").collect()
    scores = {r.word: float(r.low) for r in top}
    if not scores:
        return Model({}, 1.0, 1.0, 0.0, math.log(max(n_t, 1) / max(n_c, 1)))
    # half a count for every scoring word, so one that no clean text holds still has a clean frequency
    values = np.array(list(scores.values()))
    mass = (np.array([r.c for r in top]) + 0.5) / n_c
    rate = _rate(values, mass)
    model = Model(scores, rate, 1.0, 0.0, 0.0)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, size = [], []
            for text in batch["text"]:
                s, n = _scored(model, text)
                best.append(max((x[2] for x in segments(s)), default=0.0))
                size.append(n)
            yield pd.DataFrame({"y": batch["y"], "best": best, "n": size})

    clean = sample.filter("y = 0").mapInPandas(scan, "y int, best double, n long")
    fitted = clean.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.exp(-rate * F.col("best"))).alias("s"))
    row = fitted.first()
    model.scale = min(1.0, row.k / row.s) if row.s else 1.0

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [evidence(model, t)[0] for t in batch["text"]]})

    found = sample.mapInPandas(weigh, "y int, x double").toPandas()
    model.slope, model.offset = _logistic(np.log1p(found["x"].to_numpy()), found["y"].to_numpy(float))
    return model


def _rate(values: np.ndarray, mass: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 with all other words at the drift."""
    rest = max(0.0, 1.0 - mass.sum())

    def excess(x):
        return float((mass * np.exp(np.minimum(x * values, 500))).sum() + rest * math.exp(x * DRIFT)) - 1.0

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull to zero that keeps separable data finite."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    pull = np.diag([1e-2, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(
            design.T @ (design * (p * (1 - p))[:, None]) + pull, design.T @ (y - p) - pull @ beta
        )
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (probability) and ``passages`` (character spans with score and chance).

    Every row and column is kept; columns of these two names are replaced. Null and empty texts have no
    passage and get the probability of a text without evidence. Whole texts are scanned, in one pass.
    """

    @F.pandas_udf(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("s", PASSAGES)]))
    def scan(texts: pd.Series) -> pd.DataFrame:
        values, spans = [], []
        for text in texts:
            value, found = evidence(model, text)
            values.append(value)
            spans.append(_spans(text, found) if found else [])
        return pd.DataFrame({"p": probability(model, np.array(values)), "s": spans})

    return (
        docs.withColumn("_toxic", scan(F.col("text")))
        .withColumn("toxicity", F.col("_toxic.p"))
        .withColumn("passages", F.col("_toxic.s"))
        .drop("_toxic")
    )


def _spans(text: str, found) -> list[dict]:
    """Word positions as character positions of the text."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer: by the words of the text itself
        lowered = text
    at = [m.span() for m in WORD.finditer(lowered)]
    return [
        {"start": at[a][0], "end": at[min(b, len(at)) - 1][1], "score": float(s), "chance": float(c)}
        for a, b, s, c in found
        if a < len(at)
    ]
