"""Labelled documents for fitting: a bounded sample drawn by hash, and the held-out split."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are fitted on.
FIT_ROWS = 5000


def split_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def _drawn(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, id_column: str, text_column: str) -> DataFrame:
    """id, _y and _text of at most ``rows`` documents, those with the smallest hashes among ``usable`` labelled ids.

    The ids are chosen from the labels alone, so that only chosen texts are shuffled; being at most ``rows``, they may be
    broadcast. Of an id's several labels the smallest counts, and of its texts the first; both are picked by aggregation,
    so that an id is drawn once, however often it is repeated.
    """
    chosen = labels.where(usable & F.col(label).isin(0, 1)).select(id_column, F.col(label).cast("int").alias("_y")).groupBy(id_column).agg(F.min("_y").alias("_y")).orderBy(F.xxhash64(id_column), id_column).limit(rows)
    return docs.select(id_column, text_column).join(F.broadcast(chosen), id_column).groupBy(id_column, "_y").agg(F.min(text_column).alias("_text"))


def _ordered(found: pa.Table) -> tuple[list[str], np.ndarray]:
    """Texts and labels in the order of the ids, the first column."""
    found = found.sort_by(found.column_names[0])
    return [t or "" for t in found["_text"].to_pylist()], found["_y"].to_numpy().astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and labels of the drawn documents, on the driver."""
    return _ordered(_drawn(docs, labels, label, usable, rows, id_column, text_column).toArrow())


def fitted(fit: Callable[[list[str], np.ndarray], Any], docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Any:
    """What ``fit`` makes of the texts and labels of the drawn documents, by one task.

    Neither texts nor features reach the driver, only the model does. The sample is bounded, so one task holds it; should
    its executor be lost, the task runs again elsewhere and fits the same model.
    """
    drawn = _drawn(docs, labels, label, usable, rows, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.record_batch({"model": pa.array([pickle.dumps(fit(*_ordered(pa.Table.from_batches(held))))], pa.binary())})

    made = drawn.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([], np.zeros(0, np.int64))
