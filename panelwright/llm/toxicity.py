"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram of a word (3 to 6 bytes, with the word's
edges as spaces, ASCII letters in lower case).  Its value is its log-count
ratio: the logarithm of its smoothed share among the n-grams of toxic texts over
that among the others.  A ridge-penalised logistic regression learns a weight
for each scaled feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import labelled
from panelwright.llm import text as tx

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Odd multipliers, one per order, whose products' top bits number a feature.
_SPREAD = {3: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 5: 0x165667B19E3779F9, 6: 0xD6E8FEB86659FD93}
#: Labelled rows of each class that one fit reads at most.
PER_CLASS = 2000

_NORMAL = tx.LOWER.copy()
_NORMAL[~tx.ALNUM & (np.arange(256) < 0x80)] = 0x20
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)


#: Bytes whose n-grams are taken at once; longer blocks and texts are walked in steps that overlap by an n-gram.
STEP = 1 << 18


def grams(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once; with ``wanted`` only features flagged there."""
    data, offsets = tx.flat(texts)
    n = len(offsets) - 1
    edge = offsets[:-1] + 2 * np.arange(n)
    total = len(data) + 2 * n
    inside = np.ones(total, bool)
    inside[edge] = inside[edge + np.diff(offsets) + 1] = False
    padded = np.full(total + max(ORDERS), 0x20, np.uint8)
    padded[:total][inside] = _NORMAL[data]
    steps = [np.unique(_step(padded[begin:], min(STEP, total - begin), begin, edge, wanted)) for begin in range(0, total, STEP)]
    pairs = steps[0] if len(steps) == 1 else np.unique(np.concatenate([np.zeros(0, np.int64), *steps]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _step(padded: np.ndarray, size: int, begin: int, edge: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Text and feature, as one number, of the n-grams that begin in the first ``size`` bytes."""
    space = padded[: size + max(ORDERS)] == 0x20
    packed = padded[:size].astype(np.uint64)
    inner = np.zeros(size, bool)  # a space strictly inside the n-gram
    out = []
    for k in range(2, max(ORDERS) + 1):
        if k > 2:
            inner |= space[k - 2 : k - 2 + size]
        packed |= padded[k - 1 : k - 1 + size].astype(np.uint64) << np.uint64(8 * (k - 1))
        if k not in ORDERS:
            continue
        feature = ((packed * np.uint64(_SPREAD[k])) >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(~inner if wanted is None else ~inner & wanted[feature])
        owner = np.searchsorted(edge, at + begin, side="right") - 1
        out.append((owner << BITS) | feature[at])
    return np.concatenate(out)


@dataclass
class Model:
    """``coefficient`` is weight times log-count ratio by feature; ``base`` the score's logit without features."""

    coefficient: np.ndarray
    base: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, feature = grams(texts, self.coefficient != 0)
        total = np.bincount(owner, self.coefficient[feature], len(texts)) + self.base
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def learn(label: np.ndarray, features: list[np.ndarray], prior: float, smoothing: float = 1.0, ridge: float = 1.0, min_texts: int = 3, min_ratio: float = 1.0, rounds: int = 100) -> Model:
    """Fits the model to the features of each text; a missing class gives the prior alone.

    Features in fewer than ``min_texts`` texts, or whose log-count ratio is
    nearer to 0 than ``min_ratio``, would enter with next to no scale and are
    left out, before anything is held for all texts together.
    """
    logit = float(np.log(prior / (1 - prior)))
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), logit)
    counts = np.zeros((2, 1 << BITS))
    for y, own in zip(label, features, strict=True):
        counts[y, own] += 1
    used = counts.sum(0) >= min_texts
    share = (counts + smoothing) / (counts + smoothing)[:, used].sum(1, keepdims=True)
    ratio = np.where(used, np.log(share[1] / share[0]), 0.0)

    strong = np.abs(ratio) >= min_ratio
    kept = [own[strong[own]] for own in features]
    column = np.concatenate(kept)
    row = np.repeat(np.arange(len(kept)), [len(own) for own in kept])
    names, column = np.unique(column, return_inverse=True)
    value = ratio[names]
    n = len(label)
    weight = np.full(len(names), 0.0)
    bias = 0.0
    target = label.astype(float)
    # full-batch gradient steps with one step size per feature (diagonal of the curvature bound)
    curvature = np.bincount(column, minlength=len(names)) * value**2
    spread = np.bincount(row, (np.abs(value))[column], n)
    bound = np.bincount(column, spread[row], len(names)) * np.abs(value) / 4 + ridge
    bound = np.maximum(bound, curvature / 4 + ridge)
    momentum, before = 1.0, weight.copy()
    look = weight.copy()
    for _ in range(rounds):
        z = np.bincount(row, (look * value)[column], n) + bias
        p = 1 / (1 + np.exp(-z))
        error = p - target
        gradient = np.bincount(column, error[row], len(names)) * value + ridge * look
        weight = look - gradient / bound
        bias -= 4 * error.mean()
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = weight + (momentum - 1) / later * (weight - before)
        before, momentum = weight, later
    coefficient = np.zeros(1 << BITS, np.float32)
    coefficient[names] = weight * value
    sampled = float(np.log(target.mean() / (1 - target.mean())))
    return Model(coefficient, bias + logit - sampled)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0) -> Model:
    """Learns from at most ``per_class`` labelled rows of each class outside the held-out fold.

    The prior of the score is the share of label 1 among all labelled rows
    outside that fold.  N-grams are taken in parallel; the fit itself is one
    task on the bounded sample.  Without labels of both kinds the model gives
    the prior (0.5 without labels) to every text.
    """
    sample = labelled.training_sample(docs, labels, label_col, per_class, id_col, text_col, held_out)
    known = labels.where((labelled.fold(id_col) != held_out) & F.col(f"`{label_col}`").cast("int").isin(0, 1))
    n = known.agg(F.count("*").alias("n"), F.sum(F.col(f"`{label_col}`").cast("int")).alias("ones")).first()
    prior = ((n.ones or 0) + 1) / (n.n + 2)

    def present(texts: pa.Array) -> dict[str, object]:
        owner, feature = grams(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return {"features": pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())}

    def fit(batches: list[pa.RecordBatch]) -> Model:
        label = np.array([x for b in batches for x in b.column("label").to_pylist()], int)
        features = [np.frombuffer(x.as_buffer(), "<i4") for b in batches for x in b.column("features")]
        return learn(label, features, prior)

    return labelled.fit(tx.map_texts(sample, "text", present, "features binary", keep=["label"]), fit)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic; null and empty texts get the model's base score.

    Rows are neither dropped nor merged; an input column named like the result
    is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    return tx.map_texts(df, text_col, lambda texts: {score_col: sent.value.scores(texts)}, f"`{score_col}` double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score stays below the threshold, with their columns unchanged.

    Without labels of both kinds nothing can be learned, and no row goes.
    """
    model = train(docs, labels, text_col=text_col)
    if not model.coefficient.any():
        return docs
    judged = score(docs, model, text_col, "_toxicity")
    return judged.where(F.col("_toxicity") < threshold).drop("_toxicity")
