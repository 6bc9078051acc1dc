"""Document quality from a linear-chain conditional random field over lines.

Every line is a variable that is good (1) or bad (0).  Its evidence is a linear
function of the line's own measurements and those of the line before and after
it; neighbouring labels are tied by a 2 x 2 table.  Forward-backward gives each
line's marginal probability of being good, and the mean of the marginals
weighted by line length is the document's quality.

Only documents are labelled.  In training a line's label is latent: a document
is good with the probability of its weighted share of good lines, and the
likelihood of the documents' labels is maximised over the chains.

Chains of a block are walked together: step t handles the t-th line of every
document that has one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.llm import labelled
from panelwright.llm import text as tx

#: Labelled rows of each class that one fit reads at most.
PER_CLASS = 2000

_NEWLINE = tx.byte_class((0x0A, 0x0A))
_UPPER = tx.byte_class((0x41, 0x5A))
_LETTER = tx.byte_class((0x41, 0x5A), (0x61, 0x7A))
_HIGH = tx.byte_class((0x80, 0xFF))
_DIGIT = tx.byte_class((0x30, 0x39))
#: Characters that count as symbols and as marks.
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>=~^_\\/@+{}[]", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?.,;:", np.uint8))

OWN = ("upper", "symbols", "marks", "digits", "high", "repeats", "second_repeats", "word_length", "log_words", "short", "same_as_before", "many_symbols", "many_marks", "many_repeats", "loud")
NEIGHBOUR = ("upper", "symbols", "marks", "repeats", "same_as_before", "many_symbols", "many_marks", "many_repeats", "loud")
_AT = [OWN.index(n) for n in NEIGHBOUR]
WIDTH = 1 + len(OWN) + 2 * len(NEIGHBOUR) + 2


@dataclass
class Lines:
    """Lines with a word: features, length in bytes, and per text the range of its lines."""

    features: np.ndarray
    length: np.ndarray
    at: np.ndarray


def _within(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return (total[end] - total[begin]).astype(float)


def lines_of(texts: pa.Array) -> Lines:
    """Measures every line with a word; blank lines are left out."""
    data, offsets = tx.flat(texts)
    runs = tx.words(data, offsets, ~_NEWLINE)
    w = tx.words(data, offsets, tx.NOT_SPACE)
    first, last = np.searchsorted(w.start, runs.start), np.searchsorted(w.start, runs.end)
    solid = last > first
    begin, end, first, last = runs.start[solid], runs.end[solid], first[solid], last[solid]
    owner = runs.text_of[solid]
    at = np.searchsorted(owner, np.arange(len(offsets)))
    n_words = (last - first).astype(float)
    letters = np.maximum(_within(_LETTER[data], begin, end), 1)
    solid_bytes = _within(tx.NOT_SPACE[data], begin, end)

    hashes = tx.word_hashes(w)
    again = np.r_[False, hashes[1:] == hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    second = np.zeros(len(hashes), bool)
    second[2:] = hashes[2:] == hashes[:-2]
    repeats = _within(again, np.minimum(first + 1, last), last) / n_words
    seconds = _within(second, np.minimum(first + 2, last), last) / n_words
    whole = tx.range_hashes(data, begin, end)
    same = np.zeros(len(whole))
    same[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])

    upper = _within(_UPPER[data], begin, end) / letters
    symbols = np.minimum(_within(_SYMBOL[data], begin, end) / n_words, 2)
    marks = np.minimum(_within(_MARK[data], begin, end) / n_words, 2)
    own = np.column_stack([
        upper, symbols, marks, _within(_DIGIT[data], begin, end) / solid_bytes, _within(_HIGH[data], begin, end) / solid_bytes,
        repeats, seconds, np.minimum(solid_bytes / n_words / 10, 4), np.log1p(n_words) / 3, n_words < 4, same,
        symbols > 0.3, marks > 0.8, (repeats > 0.2) | (seconds > 0.3), upper > 0.5,
    ])
    is_first = np.zeros(len(owner), bool)
    is_last = np.zeros(len(owner), bool)
    is_first[at[:-1][np.diff(at) > 0]] = True
    is_last[at[1:][np.diff(at) > 0] - 1] = True
    before, after = np.zeros((len(owner), len(_AT))), np.zeros((len(owner), len(_AT)))
    before[1:] = own[:-1, _AT]
    after[:-1] = own[1:, _AT]
    before[is_first] = 0
    after[is_last] = 0
    x = np.column_stack([np.ones(len(owner)), own, before, after, is_first, is_last])
    return Lines(x, (end - begin).astype(float), at)


class Chains:
    """Lines in time-major order: the t-th lines of all chains, longest chain first."""

    def __init__(self, at: np.ndarray) -> None:
        size = np.diff(at)
        self.chains = np.argsort(-size, kind="stable")
        size = size[self.chains]
        steps = int(size[0]) if len(size) else 0
        self.alive = np.searchsorted(-size, -np.arange(steps), side="left")  # chains with more than t lines
        self.begin = np.r_[0, np.cumsum(self.alive)]
        start = at[:-1][self.chains]
        self.order = np.concatenate([start[: self.alive[t]] + t for t in range(steps)]) if steps else np.zeros(0, np.int64)

    def walk(self, score: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of label 1, expected label pairs summed over all steps, and the log partition per chain.

        ``score`` is the evidence for label 1 over label 0 in time-major order.
        """
        forward, backward, norm = self._passes(score, tie)
        marginal = np.exp((forward + backward)[:, 1] - norm)
        pairs = np.zeros((2, 2))
        for _, _, joint in self._steps(score, tie, forward, backward, norm):
            pairs += joint.sum(0)
        return marginal, pairs, norm[: self.alive[0] if len(self.alive) else 0]

    def _passes(self, score: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log weights of both labels, and each line's log partition."""
        n = len(score)
        emit = np.column_stack([np.zeros(n), score])
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        steps, b = len(self.alive), self.begin
        total = np.zeros(self.alive[0] if steps else 0)
        for t in range(steps):
            now = slice(b[t], b[t + 1])
            if t == 0:
                forward[now] = emit[now]
                continue
            held = forward[b[t - 1] : b[t - 1] + self.alive[t]]
            forward[now] = emit[now] + np.logaddexp(held[:, :1] + tie[0], held[:, 1:] + tie[1])
        for t in range(steps - 2, -1, -1):
            k = self.alive[t + 1]
            later = emit[b[t + 1] : b[t + 1] + k] + backward[b[t + 1] : b[t + 1] + k]
            backward[b[t] : b[t] + k] = np.logaddexp(tie[:, 0] + later[:, :1], tie[:, 1] + later[:, 1:])
        whole = forward + backward
        return forward, backward, np.logaddexp(whole[:, 0], whole[:, 1])

    def _steps(self, score: np.ndarray, tie: np.ndarray, forward: np.ndarray, backward: np.ndarray, norm: np.ndarray):
        """(begin of a step, begin of the next, probabilities of the label pairs between them) of every step."""
        emit = np.column_stack([np.zeros(len(score)), score])
        for t in range(len(self.alive) - 1):
            now, then, k = self.begin[t], self.begin[t + 1], self.alive[t + 1]
            later = emit[then : then + k] + backward[then : then + k]
            yield now, then, np.exp(forward[now : now + k, :, None] + tie + later[:, None, :] - norm[now : now + k, None, None])

    def shares(self, score: np.ndarray, tie: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """What the documents' labels say about the lines' labels, which nobody has seen.

        A document is good with the probability of its weighted share of good
        lines.  ``weight`` is each line's part of its document (time-major),
        ``label`` the label of each chain, longest first.  Returns how far
        knowing the label moves the marginals and the expected label pairs, and
        the log likelihood of the labels.  The expected share given a line's
        label is the sum of what the lines up to it and those after it give,
        carried along both passes as means.
        """
        forward, backward, norm = self._passes(score, tie)
        emit = np.column_stack([np.zeros(len(score)), score])
        past, future = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        past[:, 1] = weight
        steps, b = len(self.alive), self.begin
        for t in range(1, steps):
            k = self.alive[t]
            held = forward[b[t - 1] : b[t - 1] + k, :, None] + tie
            from_ = np.exp(held - np.logaddexp(held[:, 0], held[:, 1])[:, None, :])
            past[b[t] : b[t] + k] += (from_ * past[b[t - 1] : b[t - 1] + k, :, None]).sum(1)
        for t in range(steps - 2, -1, -1):
            k = self.alive[t + 1]
            later = tie + (emit[b[t + 1] : b[t + 1] + k] + backward[b[t + 1] : b[t + 1] + k])[:, None, :]
            to = np.exp(later - np.logaddexp(later[:, :, 0], later[:, :, 1])[:, :, None])
            ahead = future[b[t + 1] : b[t + 1] + k].copy()
            ahead[:, 1] += weight[b[t + 1] : b[t + 1] + k]
            future[b[t] : b[t] + k] = (to * ahead[:, None, :]).sum(2)
        n = self.alive[0] if steps else 0
        good = np.exp((forward + backward)[:, 1] - norm)
        first = np.exp((forward + backward)[:n] - norm[:n, None])
        share = np.clip((first * (past[:n] + future[:n])).sum(1), 1e-9, 1 - 1e-9)
        chain = np.concatenate([np.arange(self.alive[t]) for t in range(steps)]) if steps else np.zeros(0, np.int64)
        label = label[:n].astype(float)

        def moved(expected: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.where(y == 1, expected / q - 1, (q - expected) / (1 - q))

        lines = good * moved(past[:, 1] + future[:, 1], share[chain], label[chain])
        pairs = np.zeros((2, 2))
        for now, then, joint in self._steps(score, tie, forward, backward, norm):
            k = len(joint)
            ahead = future[then : then + k].copy()
            ahead[:, 1] += weight[then : then + k]
            expected = past[now : now + k, :, None] + ahead[:, None, :]
            pairs += (joint * moved(expected, share[:k, None, None], label[:k, None, None])).sum(0)
        return lines, pairs, float(np.where(label == 1, np.log(share), np.log1p(-share)).sum())


@dataclass
class Crf:
    """``weight`` per feature (evidence for good over bad), ``tie`` per pair of neighbouring labels."""

    weight: np.ndarray
    tie: np.ndarray
    prior: float

    def marginals(self, lines: Lines) -> np.ndarray:
        """Probability of being good per line."""
        chains = Chains(lines.at)
        out = np.zeros(len(lines.length))
        out[chains.order] = chains.walk((lines.features @ self.weight)[chains.order], self.tie)[0]
        return out

    def quality(self, texts: pa.Array) -> np.ndarray:
        """Length-weighted mean of the marginals; the prior where there is no line."""
        lines = lines_of(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(lines.at))
        good = np.bincount(owner, self.marginals(lines) * lines.length, len(texts))
        size = np.bincount(owner, lines.length, len(texts))
        return np.where(size > 0, good / np.maximum(size, 1), self.prior)


def learn(features: np.ndarray, at: np.ndarray, labels: np.ndarray, length: np.ndarray, ridge: float = 1.0, tie_ridge: float = 20.0, start: int = 40, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Maximises the penalised likelihood of the documents' labels; the lines' labels are latent.

    The first ``start`` rounds give each line its document's label and leave the
    ties out, which tells apart what good and bad lines look like; from then on
    a line is only bound by the share of good lines its document should have.
    Steps follow the sign of each gradient component with step sizes of their
    own, so features on different scales need no tuning.
    """
    chains = Chains(at)
    x = features[chains.order]
    owner = np.repeat(np.arange(len(labels)), np.diff(at))
    part = (length / np.bincount(owner, length, len(labels))[owner])[chains.order]
    y, of_chain = labels[owner][chains.order].astype(float), labels[chains.chains]
    theta = np.zeros(x.shape[1] + 4)
    penalty = np.r_[np.full(x.shape[1], ridge), np.full(4, tie_ridge)]
    step = np.full(len(theta), 0.1)
    before = np.zeros(len(theta))
    for r in range(rounds):
        weight, tie = theta[:-4], theta[-4:].reshape(2, 2)
        if r < start:
            pull = np.r_[x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ weight, -500, 500)))), np.zeros(4)]
        else:
            lines, pairs, _ = chains.shares(x @ weight, tie, part, of_chain)
            pull = np.r_[x.T @ lines, pairs.ravel()]
        gradient = pull - penalty * theta
        turned = gradient * before
        step = np.clip(np.where(turned > 0, step * 1.2, np.where(turned < 0, step * 0.5, step)), 1e-6, 1.0)
        gradient = np.where(turned < 0, 0, gradient)
        theta = theta + np.sign(gradient) * step
        before = gradient
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0) -> Crf:
    """Learns from at most ``per_class`` labelled rows of each class outside the held-out fold.

    Lines are measured in parallel; the fit is one task on the bounded sample.
    Without labels of both kinds every line gets the same probability: 1, 0 or
    (without labels) 0.5 smoothed by one row of each kind.
    """
    sample = labelled.training_sample(docs, labels, label_col, per_class, id_col, text_col, held_out)

    def measured(texts: pa.Array) -> dict[str, object]:
        lines = lines_of(texts)
        both = np.column_stack([lines.features, lines.length]).astype("<f4")
        packed = [both[a:b].tobytes() for a, b in zip(lines.at[:-1], lines.at[1:], strict=True)]
        return {"lines": pa.array(packed, pa.binary())}

    def fit(batches: list[pa.RecordBatch]) -> Crf:
        label = np.array([x for b in batches for x in b.column("label").to_pylist()], int)
        rows = [np.frombuffer(x, "<f4").reshape(-1, WIDTH + 1) for b in batches for x in b.column("lines").to_pylist()]
        prior = (label.sum() + 1) / (len(label) + 2)
        if len(set(label.tolist())) < 2:
            return Crf(np.r_[np.log(prior / (1 - prior)), np.zeros(WIDTH - 1)], np.zeros((2, 2)), float(prior))
        at = np.r_[0, np.cumsum([len(r) for r in rows])]
        whole = np.concatenate(rows).astype(float)
        weight, tie = learn(whole[:, :WIDTH], at, label, whole[:, WIDTH])
        return Crf(weight, tie, float(prior))

    return labelled.fit(tx.map_texts(sample, "text", measured, "lines binary", keep=["label"]), fit)


def score(df: DataFrame, model: Crf, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the quality of every text, between 0 and 1; texts without a line with a word get the prior.

    Rows are neither dropped nor merged; an input column named like the result
    is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    return tx.map_texts(df, text_col, lambda texts: {score_col: sent.value.quality(texts)}, f"`{score_col}` double")


def line_labels(df: DataFrame, model: Crf, text_col: str = "text", out_col: str = "line_good") -> DataFrame:
    """Adds the probability of being good of every line with a word, in order, as an array."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> dict[str, object]:
        lines = lines_of(texts)
        values = sent.value.marginals(lines)
        return {out_col: pa.ListArray.from_arrays(pa.array(lines.at, pa.int32()), pa.array(values, pa.float64()))}

    return tx.map_texts(df, text_col, run, f"`{out_col}` array<double>")
