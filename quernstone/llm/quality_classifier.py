"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded: the shares of its bytes in fixed
classes, the share of words that repeat their predecessor, its mean word length and size, standardised and passed through
a learned layer. Gated attention weighs the passages of a document, and the weighted mean of their codes is scored by a
logistic unit. Attention, encoder and scorer are fitted together from document labels alone.

Defined results: a null or empty text is one empty passage and is scored; repeated rows score alike; texts of any length
are read whole; without labels of both kinds every score is the share of label 1 (1 without any label); an empty table
gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.labelled import FIT_ROWS, fitted, split_of

PASSAGE_WORDS = 50
_SYMBOLS = b"#*$%&|<>!?.,;:\"'()[]{}-_/\\@=+~^`"
_CLASSES = len(_SYMBOLS) + 7


def _byte_classes() -> np.ndarray:
    table = np.full(256, len(_SYMBOLS) + 6, np.uint8)  # controls
    for ranges, at in ((((97, 123),), 0), (((65, 91),), 1), (((48, 58),), 2), (((9, 14), (32, 33)), 3), (((128, 192),), 4), (((192, 256),), 5)):
        for low, high in ranges:
            table[low:high] = len(_SYMBOLS) + at
    for i, symbol in enumerate(_SYMBOLS):
        table[symbol] = i
    return table


_TABLE = _byte_classes()
_SPACE = len(_SYMBOLS) + 3
_SALT = np.random.default_rng(7).integers(0, 2**63, 256, np.int64).astype(np.uint64) | np.uint64(1)
FEATURES = _CLASSES + 4


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts``, and the number of passages of each text (at least one)."""
    raw = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    kinds = _TABLE[data]
    space = kinds == _SPACE
    begins = ~space
    begins[1:] &= space[:-1]
    word_of = np.cumsum(begins, dtype=np.int32)
    words_to = word_of[ends - 1]  # words up to each text's end
    words_from = np.concatenate([[0], words_to[:-1]])
    counts = np.maximum(1, -(-(words_to - words_from) // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    total = int(counts.sum())

    sizes = np.diff(ends, prepend=0)
    text_of = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    place = np.maximum(word_of - 1 - words_from.astype(np.int32)[text_of], 0) // PASSAGE_WORDS + first.astype(np.int32)[text_of]
    shares = np.bincount(place.astype(np.int64) * _CLASSES + kinds, minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float64)
    size = shares.sum(axis=1)

    starts = np.flatnonzero(begins)
    repeats, words = np.zeros(total), np.zeros(total)
    if len(starts):
        inside = np.arange(len(data), dtype=np.uint64)
        values = _SALT[data] * (inside - starts.astype(np.uint64)[np.maximum(word_of - 1, 0)] + np.uint64(0x9E3779B9))
        values[space] = 0
        hashes = np.add.reduceat(values, starts)
        of = place[starts]
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (text_of[starts][1:] == text_of[starts][:-1])
        repeats = np.bincount(of, again, total)
        words = np.bincount(of, minlength=total).astype(np.float64)
    solid = size - shares[:, _SPACE]
    extra = np.stack([repeats / np.maximum(words, 1), solid / np.maximum(words, 1) / 10, np.log1p(words), np.log1p(size)], axis=1)
    return np.concatenate([np.sqrt(shares / np.maximum(size, 1)[:, None]), extra], axis=1), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class AttentionModel:
    """Weights of the encoder, the gated attention and the scorer; ``base`` alone where nothing could be fitted."""

    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        code = np.tanh(x @ w["encode"] + w["encode_bias"])
        signal, gate = np.tanh(code @ w["signal"]), _sigmoid(code @ w["gate"])
        energy = (signal * gate) @ w["attend"]
        energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), counts))
        attention = energy / np.repeat(np.add.reduceat(energy, starts), counts)
        bag = np.add.reduceat(attention[:, None] * code, starts, axis=0)
        return {"starts": starts, "code": code, "signal": signal, "gate": gate, "attention": attention, "bag": bag, "score": _sigmoid(bag @ w["score"] + w["score_bias"])}

    def gradients(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the document labels by every weight."""
        w, f = self.weights, self._forward(x, counts)
        d_out = (f["score"] - labels) / len(labels)
        d_bag = np.outer(d_out, w["score"])
        spread = np.repeat(d_bag, counts, axis=0)
        d_attention = (spread * f["code"]).sum(axis=1)
        lean = np.repeat(np.add.reduceat(d_attention * f["attention"], f["starts"]), counts)
        d_energy = f["attention"] * (d_attention - lean)
        d_signal = np.outer(d_energy, w["attend"]) * f["gate"] * (1 - f["signal"] ** 2)
        d_gate = np.outer(d_energy, w["attend"]) * f["signal"] * f["gate"] * (1 - f["gate"])
        d_code = (spread * f["attention"][:, None] + d_signal @ w["signal"].T + d_gate @ w["gate"].T) * (1 - f["code"] ** 2)
        return {
            "encode": x.T @ d_code,
            "encode_bias": d_code.sum(axis=0),
            "signal": f["code"].T @ d_signal,
            "gate": f["code"].T @ d_gate,
            "attend": (f["signal"] * f["gate"]).T @ d_energy,
            "score": f["bag"].T @ d_out,
            "score_bias": d_out.sum(),
        }

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        x, counts = passages(texts)
        return self._forward((x - self.mean) / self.scale, counts)["score"]


def fit(texts: list[str], labels: np.ndarray, width: int = 16, steps: int = 300, rate: float = 0.02, decay: float = 1e-3, seed: int = 11) -> AttentionModel:
    """Fit all weights by full-batch Adam on the cross entropy of the document labels."""
    if len(set(labels.tolist())) < 2:
        return AttentionModel(float(labels.mean()) if len(labels) else 1.0)
    parts = [passages(texts[at : at + 256]) for at in range(0, len(texts), 256)]
    x, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x -= mean
    x /= scale
    draw = np.random.default_rng(seed)
    w = {
        "encode": draw.normal(0, FEATURES**-0.5, (FEATURES, width)),
        "encode_bias": np.zeros(width),
        "signal": draw.normal(0, width**-0.5, (width, width)),
        "gate": draw.normal(0, width**-0.5, (width, width)),
        "attend": draw.normal(0, width**-0.5, width),
        "score": draw.normal(0, width**-0.5, width),
        "score_bias": np.zeros(()),
    }
    model = AttentionModel(float(labels.mean()), mean, scale, w)
    slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, steps + 1):
        gradients = model.gradients(x, counts, labels)
        for k, g in gradients.items():
            m, v = slow[k]
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            slow[k] = (m, v)
            w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9) - (rate * decay * w[k] if "bias" not in k else 0)
    return model


def add_scores(docs: DataFrame, model: AttentionModel, column: str = "score", text_column: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text; all columns stay."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = docs.drop(column)
    at_text = kept.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column(at_text).to_pylist()))], [*part.schema.names, column])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5, rows: int = FIT_ROWS) -> AttentionModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    return fitted(fit, docs, labels, "quality", split_of("doc_id", folds) != held_out_fold, rows)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = add_scores(docs.select("doc_id", "text"), train(docs, labels, 0, folds))
    return scored.select("doc_id", (split_of("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
