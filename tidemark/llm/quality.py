"""Text quality by a small convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Within a chunk every byte has a learned
embedding, learned filters slide over the embedded bytes, and the largest response of each filter goes to a
hidden layer that gives the chunk one logit. The mean and the least chunk logit of a text give its one
probability. Training is plain gradient descent (Adam) on a bounded sample of labelled texts; scoring reads
every chunk of every text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk and from one chunk to the next; bytes a filter moves (it spans two moves).
CHUNK, STEP, MOVE = 512, 448, 4
EMBED, FILTERS, HIDDEN = 4, 32, 24
#: Bounds of the training sample: texts (smallest hash of doc_id first) and evenly spread chunks of each.
SAMPLE_ROWS = 4_000
SAMPLE_CHUNKS = 24
EPOCHS, BATCH, RATE = 6, 128, 4e-3
#: Chunks scored at once.
BLOCK = 1_024


@dataclasses.dataclass
class Model:
    params: dict[str, np.ndarray]
    combine: np.ndarray  # weights of mean, least and 1


def chunks(raw: bytes) -> list[bytes]:
    """Overlapping chunks that cover all bytes; one empty chunk for an empty text."""
    return [raw[k : k + CHUNK] for k in range(0, max(len(raw) - (CHUNK - STEP), 1), STEP)]


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chunks, filled up with zero, and their lengths."""
    flat = np.frombuffer(b"".join([p.ljust(CHUNK, b"\0") for p in parts]), np.uint8)
    return flat.reshape(len(parts), CHUNK), np.array([len(p) for p in parts], np.float32)


def start_params(rng: np.random.Generator) -> dict[str, np.ndarray]:
    wide = MOVE * EMBED
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": draw(256, EMBED, scale=0.5),
        "left": draw(wide, FILTERS, scale=wide**-0.5),
        "right": draw(wide, FILTERS, scale=wide**-0.5),
        "bias": np.zeros(FILTERS, np.float32),
        "w1": draw(FILTERS + 1, HIDDEN, scale=FILTERS**-0.5),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": draw(HIDDEN, scale=HIDDEN**-0.5),
        "b2": np.zeros(1, np.float32),
    }


def forward(p: dict[str, np.ndarray], x: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
    n = len(x)
    embedded = p["embed"].take(x.reshape(-1), axis=0).reshape(n * (CHUNK // MOVE), MOVE * EMBED)
    left = (embedded @ p["left"]).reshape(n, CHUNK // MOVE, FILTERS)
    right = (embedded @ p["right"]).reshape(n, CHUNK // MOVE, FILTERS)
    response = left[:, :-1] + right[:, 1:]
    response += p["bias"]
    # a filter that reaches past the end of the text counts as silent
    seen = np.maximum((length // MOVE).astype(np.int64) - 1, 0)
    if (seen < response.shape[1]).any():
        response[np.arange(response.shape[1]) >= seen[:, None]] = 0
    most = np.maximum(response.max(axis=1), 0)
    pooled = np.concatenate([most, (length / CHUNK)[:, None]], 1).astype(np.float32)
    hidden = np.maximum(pooled @ p["w1"] + p["b1"], 0)
    return {
        "embedded": embedded,
        "response": response,
        "pooled": pooled,
        "hidden": hidden,
        "logit": hidden @ p["w2"] + p["b2"][0],
    }


def backward(p, x, f, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for the slope of the loss in each chunk's logit."""
    n, slots = len(x), CHUNK // MOVE
    g = {"w2": f["hidden"].T @ slope, "b2": np.array([slope.sum()], np.float32)}
    d_hidden = slope[:, None] * p["w2"] * (f["hidden"] > 0)
    g["w1"], g["b1"] = f["pooled"].T @ d_hidden, d_hidden.sum(0)
    d_most = (d_hidden @ p["w1"].T)[:, :FILTERS] * (f["pooled"][:, :FILTERS] > 0)
    where = f["response"].argmax(axis=1)
    rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    d_left = np.zeros((n, slots, FILTERS), np.float32)
    d_right = np.zeros((n, slots, FILTERS), np.float32)
    d_left[rows, where, cols] = d_most
    d_right[rows, where + 1, cols] = d_most
    d_left, d_right = d_left.reshape(n * slots, -1), d_right.reshape(n * slots, -1)
    g["bias"] = d_most.sum(0)
    g["left"], g["right"] = f["embedded"].T @ d_left, f["embedded"].T @ d_right
    d_bytes = (d_left @ p["left"].T + d_right @ p["right"].T).reshape(-1, EMBED)
    flat = x.reshape(-1)
    g["embed"] = np.stack([np.bincount(flat, d_bytes[:, k], 256) for k in range(EMBED)], 1)
    return g


def train(parts: list[bytes], doc: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Model from chunks, the text each belongs to and the 0/1 label of its text."""
    rng = np.random.default_rng(seed)
    p = start_params(rng)
    if not len(parts) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(p, np.array([0.0, 0.0, 6 * (2 * share - 1)]))
    x, length = _matrix(parts)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    steps, total = 0, EPOCHS * (-(-len(x) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            some = order[k : k + BATCH]
            f = forward(p, x[some], length[some])
            slope = (_sigmoid(f["logit"]) - y[some]).astype(np.float32) / len(some)
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for name, grad in backward(p, x[some], f, slope).items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.99 * v[name] + 0.01 * grad * grad
                step = (m[name] / (1 - 0.9**steps)) / (np.sqrt(v[name] / (1 - 0.99**steps)) + 1e-8)
                p[name] = (p[name] - rate * step).astype(np.float32)
    logits = np.concatenate([forward(p, x[k : k + BLOCK], length[k : k + BLOCK])["logit"] for k in range(0, len(x), BLOCK)])
    _, first = np.unique(doc, return_index=True)
    order = np.argsort(doc, kind="stable")
    starts = np.searchsorted(doc[order], doc[first])
    return Model(p, _combine(*_pool(logits[order], starts), y[first]))


def _pool(logits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and least logit of each run of chunks; logits are bounded so one chunk cannot decide alone."""
    logits = np.clip(logits.astype(np.float64), -12, 12)
    sizes = np.diff(np.append(starts, len(logits)))
    return np.add.reduceat(logits, starts) / sizes, np.minimum.reduceat(logits, starts)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _combine(mean: np.ndarray, least: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of mean, least and 1 by Newton steps with a weak pull to zero."""
    design = np.stack([mean, least, np.ones_like(mean)], 1)
    beta, pull = np.zeros(3), 1e-2 * np.eye(3)
    for _ in range(50):
        p = _sigmoid(design @ beta)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + pull
        step = np.linalg.solve(hessian, design.T @ (y - p) - pull @ beta)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, in_training: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Model from labels 0 and 1 whose doc_id passes ``in_training`` (a column of ``labels``).

    At most ``rows`` labelled texts and ``SAMPLE_CHUNKS`` chunks of each reach the driver. With labels of one
    class only, every text gets that class.
    """
    picked = (
        labels.filter(in_training & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, y, text in zip(batch["doc_id"], batch["y"], batch["text"]):
                parts = chunks(text.encode())
                at = np.unique(np.linspace(0, len(parts) - 1, SAMPLE_CHUNKS).round().astype(int))
                rows += [(doc, y, int(k), parts[k]) for k in at]
            yield pd.DataFrame(rows, columns=["doc_id", "y", "at", "chunk"])

    schema = "doc_id long, y int, at int, chunk binary"
    got = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text").mapInPandas(spread, schema)
    got = got.toPandas().sort_values(["doc_id", "at", "y", "chunk"], kind="stable")
    y = got["y"].to_numpy(np.float64)
    return train([bytes(c) for c in got["chunk"]], got["doc_id"].to_numpy(), y)


def score_texts(model: Model, texts) -> np.ndarray:
    """Probability of each text (null: empty), over all of its chunks."""
    out, parts, starts = [], [], []

    def flush():
        x, length = _matrix(parts)
        pieces = [forward(model.params, x[k : k + BLOCK], length[k : k + BLOCK])["logit"] for k in range(0, len(x), BLOCK)]
        mean, least = _pool(np.concatenate(pieces), np.array(starts))
        out.append(_sigmoid(np.stack([mean, least, np.ones_like(mean)], 1) @ model.combine))
        parts.clear()
        starts.clear()

    for text in texts:
        starts.append(len(parts))
        parts.extend(chunks((text or "").encode()))
        if len(parts) >= BLOCK:
            flush()
    if parts:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score``, the probability of label 1.

    Every row and column is kept; a column of that name is replaced. Null and empty texts are scored as an
    empty chunk; whole texts of any length are read.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, texts))

    return docs.withColumn("quality_score", score(F.col("text")))
