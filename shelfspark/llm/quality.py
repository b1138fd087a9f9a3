"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad. Its features are character shares, length, word length and repetition
(of its words, and of the whole line) for the line itself and the lines before and after it; neighbouring labels are tied by transition
weights. The forward-backward recursion gives each line's marginal, and the length-weighted mean of
the marginals is the document's quality, mapped to a probability by a fitted logistic curve.

Fitting: at most ``fit_rows`` labelled documents, those with the smallest hash of their id, give
line features (at most FIT_WINDOWS windows of WINDOW lines each, evenly spread over the text);
every line carries its document's label. The likelihood is climbed on the driver over these few
numbers. Scoring reads whole texts where they lie, without a shuffle.

Defined cases: null text is empty; an empty text is one empty line and gets the score the model
gives it. Without labels of both kinds the score is the share of label 1 (0.5 without any). Repeated
rows are scored each, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, slices, text_bytes, text_of, word_hashes
from shelfspark.llm.registry import query

FIT_ROWS = 3000
WINDOW = 64
FIT_WINDOWS = 32
STEPS = 120
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = 9
_OTHER, _UPPER, _LOWER, _DIGIT, _BLANK, _BAR, _SHOUT, _SYMBOL, _STOP = range(_CLASSES)


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    for chars, kind in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
        (b"abcdefghijklmnopqrstuvwxyz", _LOWER),
        (b"0123456789", _DIGIT),
        (b" \t\r\n\v\f", _BLANK),
        (b"|", _BAR),
        (b"!?", _SHOUT),
        (b"#$%&*@~^=<>{}[]\\/_+`", _SYMBOL),
        (b".,;:'\"-()", _STOP),
    ):
        table[list(chars)] = kind
    return table


_TABLE = _class_table()


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, lines per text) of the texts data[at[i]:at[i + 1]]."""
    breaks = np.flatnonzero(data == 10)
    per_text = 1 + np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1])
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    last = np.cumsum(per_text) - 1
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[last] = at[1:]
    length = ends - starts
    n = len(starts)
    line = np.repeat(np.arange(n), length)
    # the bytes of all lines, without the line ends
    inside = np.ones(len(data), bool)
    inside[breaks] = False
    counts = np.bincount(line * _CLASSES + _TABLE[data[inside]], minlength=n * _CLASSES).reshape(n, _CLASSES)
    share = counts / np.maximum(length, 1)[:, None]
    first = np.zeros(n, bool)
    first[last[:-1] + 1] = True
    first[0] = True
    alike = np.zeros(n, bool)
    alike[1:] = (counts[1:] == counts[:-1]).all(axis=1) & ~first[1:] & (length[1:] > 0)
    for i in np.flatnonzero(alike):
        alike[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[i - 1] : ends[i - 1]])
    repeated = alike.copy()
    repeated[:-1] |= alike[1:]
    words = counts[:, _BLANK] + 1
    hashes, begins, _ = word_hashes(data, at)
    of_line = np.searchsorted(starts, begins, side="right") - 1
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])) + 1
    own = np.column_stack(
        [
            share,
            np.bincount(of_line[again], minlength=n) / words,
            np.log1p(length) / 5,
            np.minimum(length / words, 40) / 10,
            repeated,
            length < 20,
            length == 0,
        ]
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[first] = 0
    after[:-1] = own[1:]
    after[last] = 0
    return np.hstack([own, before, after]), length + 1.0, per_text


def _layout(per_text: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Chains sorted by falling length, and how many reach each position."""
    order = np.argsort(-per_text, kind="stable")
    sorted_lengths = per_text[order]
    longest = int(sorted_lengths[0]) if len(order) else 0
    reach = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    return order, reach.tolist()


def _through(x: np.ndarray, gg: float, bg: float, gb: float, bb: float) -> np.ndarray:
    """Log odds after a transition: log((e^(x + gg) + e^bg) / (e^(x + gb) + e^bb))."""
    return np.logaddexp(x + gg, bg) - np.logaddexp(x + gb, bb)


def forward_backward(
    emission: np.ndarray, per_text: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good, given the lines up to each one, and given those after it.

    ``moves`` are the transition weights bad-bad, bad-good, good-bad, good-good. Chains are stepped
    through together, position by position.
    """
    bb, bg, gb, gg = moves
    start = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)[:-1]])
    order, reach = _layout(per_text)
    ahead, behind = emission.copy(), np.zeros_like(emission)
    for j in range(1, len(reach)):
        at = start[order[: reach[j]]] + j
        ahead[at] += _through(ahead[at - 1], gg, bg, gb, bb)
    for j in range(len(reach) - 1, 0, -1):
        at = start[order[: reach[j]]] + j
        behind[at - 1] = _through(emission[at] + behind[at], gg, gb, bg, bb)
    return ahead, behind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Feature scale, weights of good against bad, transitions, and the curve to a probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((features - self.mean) / self.scale) @ self.weights[1:]

    def document_quality(self, features: np.ndarray, weight: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, 0 to 1."""
        ahead, behind = forward_backward(self.emission(features), per_text, self.moves)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)[:-1]])
        good = _sigmoid(ahead + behind)
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, at = text_bytes(texts)
        slope, shift = self.curve
        if not slope:
            return np.full(len(at) - 1, _sigmoid(np.float64(shift)))
        return _sigmoid(slope * _logit(self.document_quality(*line_features(data, at))) + shift)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _constant(share: float) -> Model:
    share = float(np.clip(share, 1e-4, 1 - 1e-4))
    return Model(np.zeros(0), np.ones(0), np.zeros(1), np.zeros(4), (0.0, float(np.log(share / (1 - share)))))


def fit_chain(
    features: np.ndarray, weight: np.ndarray, per_text: np.ndarray, label: np.ndarray, steps: int = STEPS
) -> Model:
    """Climb the likelihood of the lines' labels; ``label`` is one 0 or 1 per chain."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
    line_label = np.repeat(label, per_text).astype(float)
    inner = np.ones(len(x), bool)
    inner[np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)[:-1]])] = False
    cur = np.flatnonzero(inner)
    pair = (2 * line_label[cur - 1] + line_label[cur]).astype(int)
    seen = np.bincount(pair, minlength=4)
    params = np.zeros(x.shape[1] + 4)
    slow, fast = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        weights, moves = params[:-4], params[-4:]
        emission = x @ weights
        ahead, behind = forward_backward(emission, per_text, moves)
        p = _sigmoid(ahead + behind)
        left, right = ahead[cur - 1], emission[cur] + behind[cur]
        joint = np.column_stack([np.full(len(cur), moves[0]), moves[1] + right, moves[2] + left, moves[3] + left + right])
        joint = np.exp(joint - joint.max(axis=1, keepdims=True)) if len(cur) else joint
        expected = (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) if len(cur) else np.zeros(4)
        gradient = np.concatenate([x.T @ (line_label - p), seen - expected]) / len(x) - 1e-3 * params
        slow = 0.9 * slow + 0.1 * gradient
        fast = 0.99 * fast + 0.01 * gradient**2
        params = params + 0.1 * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, params[:-4], params[-4:], (1.0, 0.0))


def _fit_curve(quality: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve from the quality's log odds to the label, by Newton steps."""
    z = np.column_stack([_logit(quality), np.ones(len(quality))])
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(z @ beta)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, z.T @ (label - p) - 1e-2 * beta)
    return float(max(beta[0], 1e-3)), float(beta[1])


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    fit_rows: int = FIT_ROWS,
    steps: int = STEPS,
) -> Model:
    """Learn from labelled documents outside the held-out fold 0."""
    known = (
        labels.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold_of(F.col("id")) != 0))
        .groupBy("id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, weight, per_text = line_features(*text_bytes(part.column(1)))
                rows = []
                start = 0
                for n in per_text.tolist():
                    windows = np.arange(0, n, WINDOW)
                    if len(windows) > FIT_WINDOWS:
                        windows = windows[np.linspace(0, len(windows) - 1, FIT_WINDOWS).astype(int)]
                    pick = np.concatenate([np.arange(start + w, start + min(w + WINDOW, n)) for w in windows])
                    rows.append(np.column_stack([weight[pick], x[pick]]).astype("<f4").tobytes())
                    start += n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["y", "x"])

    # at most fit_rows rows: of an id's rows, the text with the smallest hash
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), text_of(text).alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "y", "text")).alias("row")
    chosen = rows.join(F.broadcast(known), "id").groupBy("id").agg(least).select("row.y", "row.text")
    got = chosen.select("y", "text").mapInArrow(features, "y int, x binary").toArrow()
    label_of = np.asarray(got["y"], dtype=float)
    if len(label_of) == 0 or label_of.min() == label_of.max():
        return _constant(label_of.mean() if len(label_of) else 0.5)
    texts = [np.frombuffer(b, "<f4").astype(float).reshape(-1, _width() + 1) for b in got["x"].to_pylist()]
    lengths = np.array([len(t) for t in texts])
    whole = np.vstack(texts)
    # long texts are fitted window by window
    cuts = [min(WINDOW, n - w) for n in lengths.tolist() for w in range(0, n, WINDOW)]
    chain_label = np.repeat(label_of, -(-lengths // WINDOW))
    model = fit_chain(whole[:, 1:], whole[:, 0], np.array(cuts), chain_label, steps)
    quality = model.document_quality(whole[:, 1:], whole[:, 0], lengths)
    model.curve = _fit_curve(quality, label_of)
    return model


def _width() -> int:
    return 3 * (_CLASSES + 6)


def score_of(model: Model, text: Column) -> Column:
    """The document's score, 0 to 1, from its text alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.large_string(), from_pandas=True)], names=["text"])
            parts = [model.scores(part.column(0)) for part in slices(batch, "text")]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def classify(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), score_of(model, text_of(text)).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op5_crf_quality")
def op5_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read(spark, sf_dir, "labels")))
