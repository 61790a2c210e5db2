"""Reading tables and keeping intermediate results where driver and executors both see them."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch, so that a batch of ordinary texts takes a few MB on either side.
BATCH_ROWS = 500


def bounded(spark: SparkSession) -> None:
    """Session setting that bounds what a Python worker holds; each query and each stage of the pipeline makes it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that setCheckpointDir was given; one on this machine only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = current.get() if current.isDefined() else f"{tempfile.gettempdir()}/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: In each thread, paths of stored tables by workspace, the innermost last.
_thread = threading.local()


def _open() -> list[list[str]]:
    if not hasattr(_thread, "workspaces"):
        _thread.workspaces = []
    return _thread.workspaces


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """Within it, tables that stored() writes are scratch: they go when it ends, but for those stored with keep."""
    _open().append([])
    try:
        yield
    finally:
        for path in _open().pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        release(spark)


def stored(df: DataFrame, name: str, keep: bool = False, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends and a lost executor loses nothing.

    With keep it outlives its workspace, and belongs to the one around that, if there is one.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if len(_open()) > keep:
        _open()[-1 - keep].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps now, not at the driver's next collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that may be broadcast, and rows of keys alone: at most about 40 MB, and 130 MB, on the driver and on each executor.
BROADCAST_ROWS, KEY_ROWS = 1 << 20, 1 << 22


def near(keys: DataFrame, weight: str = "1") -> DataFrame:
    """keys, to be joined with a large table: broadcast if its rows, by weight, are no more than BROADCAST_ROWS.

    With more rows Spark shuffles both sides and splits what is skewed; results are the same. keys should be a stored table,
    as it is counted here.
    """
    size = keys.agg(F.sum(F.expr(weight))).first()[0] or 0
    return F.broadcast(keys) if size <= BROADCAST_ROWS else keys


def with_rows(documents: DataFrame, rows: DataFrame, on: list[str], weight: str | None = "1") -> DataFrame:
    """documents joined with rows, a stored table with one row for each of its keys, inner.

    Texts without a row do not move: small rows, by weight, are broadcast, and of larger ones the keys, as long as they are no
    more than KEY_ROWS. Beyond that Spark shuffles both sides. Without a weight rows are never broadcast, as they are large
    themselves.
    """
    n, size = rows.agg(F.count("*"), F.sum(F.expr(weight or "1"))).first()
    if weight and (size or 0) <= BROADCAST_ROWS:
        return documents.join(F.broadcast(rows), on)
    if n * len(on) <= KEY_ROWS:
        documents = documents.join(F.broadcast(rows.select(on)), on, "left_semi")
    return documents.join(rows if weight else rows.hint("merge"), on)


def without_rows(documents: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows of documents whose keys are not in rows, a stored table. Nulls are in none."""
    keys = rows.select(on)
    return documents.join(F.broadcast(keys) if rows.count() * len(on) <= KEY_ROWS else keys, on, "left_anti")


def without_ids(documents: DataFrame, ids: DataFrame, id_column: str = "doc_id", repeated: list[str] | None = None) -> DataFrame:
    """documents whose id is not in ids(doc_id), a stored table. Rows without an id stay.

    With `repeated`, ids has a column `gone` too: rows go where it is true, and of other rows named in ids that are equal in
    the columns of `repeated` one stays.
    """
    named = ids.select(F.col("doc_id").alias("__named"), *(["gone"] if repeated else []))
    names = named.select("__named").distinct()
    others = documents.join(F.broadcast(names) if ids.count() <= KEY_ROWS else names, F.col(id_column) == F.col("__named"), "left_anti")
    if not repeated:
        return others
    left = documents.join(near(named.where("NOT gone").select("__named").distinct()), F.col(id_column) == F.col("__named"), "left_semi")
    return others.unionByName(left.dropDuplicates(repeated))


def groups(batches, n_keys: int):
    """Column arrays of each run of rows with equal values in the first n_keys integer columns, across Arrow batches.

    Integer columns come as numpy arrays and others as lists. Only the run at hand is held.
    """
    held: list[list] = []
    key = None
    joined = lambda parts: [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for p in c for x in p] for c in zip(*parts, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else c.to_pylist() for c in batch.columns]
        change = np.zeros(batch.num_rows, bool)
        for c in columns[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            now = tuple(c[a] for c in columns[:n_keys])
            if held and now != key:
                yield joined(held)
                held = []
            key = now
            held.append([c[a:b] for c in columns])
    if held:
        yield joined(held)
