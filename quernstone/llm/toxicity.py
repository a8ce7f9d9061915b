"""Toxicity by a counterfactually regularised classifier.

Documents are bags of lower-case words and word beginnings. Of these, the ``most_terms`` that tell the labels apart best
become features, each as its count up to ``most_repeats``, beside the logarithm of the document's length; a logistic model
is fitted on them. In every labelled sentence that names an identity the term is swapped for each other term of its group,
and the squared change of the sentence's logit is added to the loss, so that a mention of one group scores like that of
another. Neutral sentences, each with every term, are swapped alike: they are labelled by what they say, and through them
groups that few labelled documents name, but whose terms begin like words with weight, are levelled too. ``n_swaps`` of
the model counts the swaps. Words that no labelled document holds carry no weight of their own.

Defined results: a null or empty text is scored by its length feature alone; repeated rows score alike; texts of any length
are read whole; without labels of both kinds every score is the share of label 1 (0 without any label); an empty table
gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quernstone.llm.labelled import FIT_ROWS, fitted, split_of

#: Identity terms that may stand for each other within their group, in English, German, French and Spanish; a default only.
#: No term is in two groups, so that none is swapped for one of another language.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiatische", "arabische"),
    ("schwule", "heterosexuelle", "lesbische", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "staatsbürger"),
    ("alte", "junge", "behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("vieux", "jeunes", "handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("ancianos", "jóvenes", "discapacitados", "sordos", "ciegos"),
)
#: Neutral sentences about a group, into which every identity term is put.
NEUTRAL = ("we met the {} in town", "the {} live here", "my neighbours are {}")
#: A term counts at most so often in a document, so that a single repeated word does not outweigh all others.
MOST_REPEATS = 5
BEGINNINGS = range(4, 8)
_BREAKS = bytes(b if (b >= 128 or chr(b).isalnum() or b == 39) else 32 for b in range(256))
_SENTENCE = re.compile(r"[.!?\n]+")
_CACHE = 150_000


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_BREAKS).split() if text else []


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings; a beginning ends in a hyphen and whole characters."""
    letters = word.decode(errors="ignore")
    return [word, *((letters[:n] + "-").encode() for n in BEGINNINGS if n < len(letters))]


@dataclass
class ToxicityModel:
    """Weights by term; ``base`` alone where nothing could be fitted."""

    base: float
    terms: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = 0.0
    length_weight: float = 0.0
    most_repeats: int = MOST_REPEATS
    n_swaps: int = 0
    _known: dict[bytes, tuple[int, ...] | None] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _features(self, word: bytes) -> tuple[int, ...] | None:
        found = tuple(self.terms[t] for t in terms_of(word) if t in self.terms) or None
        if len(word) <= 64:
            if len(self._known) >= _CACHE:
                self._known.clear()
            self._known[word] = found
        return found

    def counts(self, words: Sequence[bytes]) -> Counter[int]:
        known, missing = self._known, object()
        out: Counter[int] = Counter()
        get = known.get
        for found, word in zip([get(w, missing) for w in words], words, strict=True):
            if found is missing:
                found = self._features(word)
            if found:
                out.update(found)
        return out

    def logit(self, text: str | None) -> float:
        words = words_of(text)
        return self.bias + self.length_weight * math.log1p(len(words)) + sum(self.weights[i] * min(n, self.most_repeats) for i, n in self.counts(words).items())

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.logit(text)))))


def swaps(text: str, groups: Sequence[Sequence[str]]) -> Iterator[tuple[str, str]]:
    """Each sentence of ``text`` that names an identity, with each copy in which another of the group stands for it."""
    for sentence in _SENTENCE.split(text):
        present = set(words_of(sentence))
        for group in groups:
            for term in group:
                if term.encode() in present:
                    pattern = re.compile(rf"\b{re.escape(term)}\b", re.IGNORECASE)
                    for other in group:
                        if other != term:
                            yield sentence, pattern.sub(other, sentence)


def choose_terms(bags: list[list[bytes]], labels: np.ndarray, most_terms: int, least_docs: int, least_chi: float) -> list[bytes]:
    """The terms whose presence tells the labels apart best, by the chi-squared statistic, from ``least_chi`` up."""
    in_all: Counter[bytes] = Counter()
    in_toxic: Counter[bytes] = Counter()
    for words, label in zip(bags, labels.tolist(), strict=True):
        present = {t for w in set(words) for t in terms_of(w)}
        in_all.update(present)
        if label:
            in_toxic.update(present)
    n, toxic = len(bags), int(labels.sum())
    ranked = []
    for term, total in in_all.items():
        if total >= least_docs and total < n:
            a = in_toxic[term]
            gap = a * n - total * toxic
            chi = gap * gap * n / (total * (n - total) * toxic * (n - toxic))
            if chi >= least_chi:
                ranked.append((-chi, term))
    return [term for _, term in sorted(ranked)[:most_terms]]


def fit(texts: list[str], labels: np.ndarray, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, most_terms: int = 1500, least_docs: int = 3, least_chi: float = 12.0, fairness: float = 1.0, ridge: float = 2e-5, steps: int = 400, rate: float = 0.05, most_repeats: int = MOST_REPEATS) -> ToxicityModel:
    """Fit by full-batch Adam on cross entropy, ridge and the mean squared change of the logit by a swap."""
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(float(labels.mean()) if len(labels) else 0.0)
    # equal words of all documents are one object
    known: dict[bytes, bytes] = {}
    bags = [[known.setdefault(w, w) for w in words_of(t)] for t in texts]
    terms = choose_terms(bags, labels, most_terms, least_docs, least_chi)
    chosen = set(terms)
    terms += [t for t in (term.encode() for group in groups for term in group) if t in known and t not in chosen]
    model = ToxicityModel(float(labels.mean()), {t: i for i, t in enumerate(terms)}, most_repeats=most_repeats)

    def row(words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(terms) + 1, np.float32)
        for i, n in model.counts(words).items():
            out[i] = min(n, most_repeats)
        out[-1] = math.log1p(len(words))
        return out

    x = np.zeros((len(bags), len(terms) + 1), np.float32)
    for at, words in enumerate(bags):
        x[at] = row(words)
    del bags, known
    neutral = (s.format(term) for s in NEUTRAL for group in groups for term in group)
    # the penalty is a quadratic form, added up a block of swaps at a time
    change, block = np.zeros((x.shape[1], x.shape[1]), np.float32), []
    for sentence, copy in itertools.chain.from_iterable(swaps(t, groups) for t in itertools.chain(texts, neutral)):
        block.append(row(words_of(copy)) - row(words_of(sentence)))
        model.n_swaps += 1
        if len(block) == 512:
            change += np.stack(block).T @ np.stack(block)
            block = []
    if block:
        change += np.stack(block).T @ np.stack(block)
    change /= max(model.n_swaps, 1)

    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        gap = 1 / (1 + np.exp(-np.clip(x @ w + bias, -50, 50))) - labels
        g = np.append(x.T @ gap.astype(np.float32) / len(labels) + 2 * ridge * w + 2 * fairness * (change @ w), gap.mean())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = (w - move[:-1]).astype(np.float32), bias - move[-1]
    model.weights, model.length_weight, model.bias = w[:-1], float(w[-1]), float(bias)
    return model


def add_scores(docs: DataFrame, model: ToxicityModel, column: str = "score", text_column: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text; all columns stay."""
    kept = docs.drop(column)
    at_text = kept.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(at_text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3, rows: int = FIT_ROWS, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    return fitted(lambda texts, y: fit(texts, y, groups), docs, labels, "toxic", split_of("doc_id", folds) != held_out_fold, rows)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = add_scores(docs.select("doc_id", "text"), train(docs, labels, 1, folds, groups=groups))
    return scored.select("doc_id", (split_of("doc_id", folds) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
