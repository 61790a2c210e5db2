"""A bounded sample of labelled documents, turned into sparse features on the executors, for fitting on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = "label int, indices binary, counts binary"


def labels_by_document(labels: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """(doc_id, label) with one row a document: the largest label where rows repeat, none where the label is null."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.where(where) if where is not None else rows
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, where: Column | None = None) -> DataFrame:
    """At most max_rows labelled documents, those whose ids hash lowest, so that any run takes the same ones.

    The limit is what bounds the broadcast side: max_rows pairs of a long and an int.
    """
    chosen = labels_by_document(labels, label, where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return documents.join(F.broadcast(chosen.withColumnRenamed("doc_id", "__labelled").withColumnRenamed("label", "__label")), F.col("doc_id") == F.col("__labelled")).drop("__labelled")


def collected(rows: DataFrame, columns: list[str], features: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """labels, row starts, feature indices and values of a sample; features(batch) yields (indices, values) per row."""

    def per_batch(batches):
        for batch in batches:
            label = batch.column(batch.schema.get_field_index("__label")).to_pylist()
            found = list(features(batch))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["label", "indices", "counts"])

    table = rows.select(*columns, "__label").mapInArrow(per_batch, FEATURES).toArrow()
    indices = [np.frombuffer(x, np.int32) for x in table["indices"].to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in table["counts"].to_pylist()]
    order = sorted(range(len(indices)), key=lambda i: (len(indices[i]), indices[i].tobytes(), values[i].tobytes()))  # not the order of tasks
    label = np.array(table["label"].to_pylist(), np.float64)[order] if order else np.zeros(0)
    starts = np.concatenate([[0], np.cumsum([len(indices[i]) for i in order])]).astype(np.int64)
    flat = lambda parts, kind: np.concatenate([parts[i] for i in order]) if order else np.zeros(0, kind)
    return label, starts, flat(indices, np.int32), flat(values, np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """The Adam update for one array of parameters."""

    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, 0.0, 0.0, 0

    def step(self, parameter: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        parameter -= (self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)).astype(parameter.dtype)
