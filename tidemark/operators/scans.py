"""Recurrences over time whose series are split into blocks, so that one long series uses all tasks.

A recurrence that can be written as an associative product of its steps (affine maps, transition matrices, max-plus matrices,
Gaussian filtering elements) runs in three rounds, whatever its series' lengths:

1. each block of rows gives its element, the product of its steps: a few numbers for thousands of rows;
2. an exclusive scan over the elements gives what every block begins with. Elements are scanned WIDTH at a time, and then the
   products of those, so that no task holds more than WIDTH elements or a series' length over WIDTH * rows of a block;
3. each block, with its beginning as one more row ahead of it, is worked through on its own.

Only series of several blocks take part in the first two rounds; others go straight to the third. Rows meet their blocks by one
shuffle on (key, block), and tasks hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, elements that are scanned together, and values of a packed row (an Arrow batch has up to 10,000 rows).
BLOCK_ROWS, WIDTH, PACKED_ROWS = 1 << 14, 1 << 10, 1 << 8

Element = Callable[[pd.DataFrame], np.ndarray]
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def kind_of(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def _changes(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; not for the first."""
    change = np.zeros(len(frame), bool)
    for c in keys:
        now = frame[c]
        change |= (now.ne(now.shift()) & ~(now.isna() & now.shift().isna())).to_numpy()
    change[0] = False
    return change


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, across frames; nulls equal each other. Only the run at hand is held."""
    parts: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        bounds = [0, *np.flatnonzero(_changes(frame, keys)).tolist(), len(frame)]
        if parts and any(not (a == b or (pd.isna(a) and pd.isna(b))) for a, b in ((parts[-1][c].iloc[-1], frame[c].iloc[0]) for c in keys)):
            yield pd.concat(parts) if len(parts) > 1 else parts[0]
            parts = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if parts and low:
                yield pd.concat(parts) if len(parts) > 1 else parts[0]
                parts = []
            parts.append(frame.iloc[low:high])
    if parts:
        yield pd.concat(parts) if len(parts) > 1 else parts[0]


def by_runs(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of the rows of each combination of keys, in order. Groups are dealt to tasks by hash and read one after the other."""

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[pd.DataFrame] = []
        size = 0
        for rows in runs(frames, keys):
            done.append(f(rows))
            size += len(done[-1])
            if size >= BLOCK_ROWS:
                yield pd.concat(done)
                done, size = [], 0
        if done:
            yield pd.concat(done)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInPandas(per_task, schema)


def stacks(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole runs end to end, of some BLOCK_ROWS rows or one longer run, and where each begins."""
    held: list[pd.DataFrame] = []
    size, enough = 0, BLOCK_ROWS
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size < enough:
            continue
        rows = pd.concat(held, ignore_index=True)
        starts = np.flatnonzero(_changes(rows, keys))
        if len(starts):  # the last run may go on
            last = int(starts[-1])
            yield rows.iloc[:last], np.append(0, starts[:-1])
            rows = rows.iloc[last:]
        held, size = [rows], len(rows)
        enough = max(BLOCK_ROWS, 2 * size)
    if size:
        rows = pd.concat(held, ignore_index=True)
        yield rows, np.append(0, np.flatnonzero(_changes(rows, keys)))


def by_stacks(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """As by_runs, for an f that works through many groups at once: it takes their rows end to end and where each group begins."""

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in stacks(frames, keys):
            yield f(rows, starts)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInPandas(per_task, schema)


def blocked(df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """df with __block, the number of the block of time that its seq lies in."""
    return df.withColumn("__block", F.floor(F.col("seq") / rows))


def packed(df: DataFrame, value: str, key: str, rows: int = PACKED_ROWS) -> DataFrame:
    """(key, __block, obs): a row for each block with its values in order of seq, so that a series goes to many tasks as few rows and
    can be read a piece at a time.

    Blocks are dealt to all tasks first: in the task that made df by windows over a series, their sorts would share its memory.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col("seq"), F.col(value).cast("double").alias("value"))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocked(df.select(key, "seq", value), rows).repartition(tasks, key, "__block")
    return dealt.groupBy(key, "__block").agg(pairs.alias("__pairs")).select(key, "__block", F.col("__pairs.value").alias("obs"))


def pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[np.ndarray]]]:
    """For each run of equal keys, the first `keys` columns, their values and the arrays of the last column one after the other, nulls
    as NaN. A batch is held at a time; arrays may be kept only as copies."""

    def rows() -> Iterator[tuple[tuple, np.ndarray]]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            yield from zip(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True), map(values.__getitem__, map(slice, bounds[:-1], bounds[1:])), strict=True)

    for name, run in groupby(rows(), lambda x: x[0]):
        yield name, (x for _, x in run)


def places(df: DataFrame, key: str, most: int) -> tuple[Column, int]:
    """A number for each key, and how many there are: up to `most` keys have one each, more are dealt by hash. Runs a job on df."""
    found = [r[0] for r in df.select(key).distinct().limit(most + 1).collect()]
    if len(found) > most:
        return F.pmod(F.hash(key), F.lit(most)), most
    place = F.lit(0)
    for k, name in enumerate(found):
        place = F.when(F.col(key).eqNullSafe(F.lit(name)), k).otherwise(place)
    return place, max(1, len(found))


def several(df: DataFrame, key: str) -> DataFrame:
    """The rows of a blocked df whose series has several blocks."""
    long = df.groupBy(F.col(key).alias("__of")).agg(F.min("__block").alias("__low"), F.max("__block").alias("__high")).where("__low < __high").select("__of")
    return df.join(long, F.col(key).eqNullSafe(F.col("__of")), "left_semi")


def _fold(rows: pd.DataFrame, combine: Combine) -> np.ndarray:
    total = None
    for x in rows["__element"]:
        total = np.asarray(x) if total is None else combine(total, np.asarray(x))
    return total


def _exclusive(rows: pd.DataFrame, combine: Combine, start: np.ndarray | None) -> list[np.ndarray | None]:
    out = []
    for x in rows["__element"]:
        out.append(start)
        start = np.asarray(x) if start is None else combine(start, np.asarray(x))
    return out


def prefixes(elements: DataFrame, combine: Combine, key: str, reverse: bool = False) -> DataFrame:
    """(key, __block, __carry) for elements(key, __block, __element): the product of all elements before a block in time.

    With `reverse`, of all elements after it. combine(earlier, later) is in the order of time in both cases. Blocks that have none
    before them give no row.
    """
    joined = (lambda a, b: combine(b, a)) if reverse else combine
    kind = kind_of(elements, key)
    ranked = elements.withColumn("__at", F.col("__block") * (-1 if reverse else 1)).withColumn("__group", F.floor(F.col("__at") / WIDTH))
    one = lambda rows: pd.DataFrame({key: rows[key].iloc[:1], "__group": rows["__group"].iloc[:1], "__element": [_fold(rows, joined)]})
    tops = by_runs(ranked, [key, "__group"], ["__at"], one, f"{kind}, __group long, __element array<double>")
    ahead = lambda rows: rows[[key, "__group"]].assign(__element=_exclusive(rows, joined, None)).iloc[1:]
    starts = by_runs(tops, [key], ["__group"], ahead, f"{kind}, __group long, __element array<double>")
    met = ranked.select(key, "__group", "__block", "__at", "__element", F.lit(1).alias("__kind")).unionByName(starts.select(key, "__group", F.lit(None).cast("long").alias("__block"), F.lit(None).cast("long").alias("__at"), "__element", F.lit(0).alias("__kind")))

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["__kind"].iloc[0] == 0
        start, rows = (np.asarray(rows["__element"].iloc[0]), rows.iloc[1:]) if first else (None, rows)
        out = pd.DataFrame({key: rows[key], "__block": rows["__block"].astype("int64"), "__carry": _exclusive(rows, joined, start)})
        return out if first else out.iloc[1:]

    return by_runs(met, [key, "__group"], ["__kind", "__at"], inside, f"{kind}, __block long, __carry array<double>")


def elements(df: DataFrame, element: Element, key: str, carries: list[DataFrame] | None = None) -> DataFrame:
    """(key, __block, __element) of a blocked df; with carries, element takes what a block begins with too."""
    one = lambda rows, *begins: pd.DataFrame({key: rows[key].iloc[:1], "__block": rows["__block"].iloc[:1], "__element": [element(rows, *begins)]})
    return applied(df, one, key, f"{kind_of(df, key)}, __block long, __element array<double>", carries or [])


def scanned(df: DataFrame, element: Element, combine: Combine, key: str, reverse: bool = False, carries: list[DataFrame] | None = None) -> DataFrame:
    """prefixes() of a blocked df's elements, for series of several blocks."""
    return prefixes(elements(several(df, key), element, key, carries), combine, key, reverse)


def applied(df: DataFrame, f: Callable[..., pd.DataFrame], key: str, schema: str, carries: list[DataFrame]) -> DataFrame:
    """f(rows of a block in time order, a carry or None for each of carries(key, __block, __carry)) of every block of df."""
    if not carries:
        return by_runs(df, [key, "__block"], ["seq"], f, schema)
    names, count = df.columns, len(carries)
    met = df.withColumn("__carry", F.lit(None).cast("array<double>")).withColumn("__kind", F.lit(count))
    for k, carry in enumerate(carries):
        empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names if c not in (key, "__block")]
        met = met.unionByName(carry.select(key, "__block", *empty, "__carry", F.lit(k).alias("__kind")))
    integers = {x.name: t for x in df.schema.fields if (t := {"bigint": "int64", "int": "int32"}.get(x.dataType.simpleString()))}

    def per_block(rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["__kind"].to_numpy()
        begins: list[np.ndarray | None] = [None] * count
        n = int((kind < count).sum())
        for k, carry in zip(kind[:n].tolist(), rows["__carry"].iloc[:n], strict=True):
            begins[k] = np.asarray(carry)
        rows = rows.iloc[n:].drop(columns=["__carry", "__kind"])
        # a carry's nulls make pandas read integers as doubles
        whole = {c: t for c, t in integers.items() if rows[c].dtype.kind == "f" and not rows[c].isna().any()} if n else {}
        return f(rows.astype(whole) if whole else rows, *begins)

    return by_runs(met, [key, "__block"], ["__kind", "seq"], per_block, schema)


def applied_together(df: DataFrame, f: Callable[..., pd.DataFrame], key: str, schema: str, carries: list[DataFrame]) -> DataFrame:
    """As applied, for an f that works through many blocks at once: f(rows of blocks end to end, where each begins, and for each of
    carries a pair: which blocks have one, and an array with a row for each block, of zeros where it has none)."""
    if not carries:
        return by_stacks(df, [key, "__block"], ["seq"], f, schema)
    names, count = df.columns, len(carries)
    met = df.withColumn("__carry", F.lit(None).cast("array<double>")).withColumn("__kind", F.lit(count))
    for k, carry in enumerate(carries):
        empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names if c not in (key, "__block")]
        met = met.unionByName(carry.select(key, "__block", *empty, "__carry", F.lit(k).alias("__kind")))
    integers = {x.name: t for x in df.schema.fields if (t := {"bigint": "int64", "int": "int32"}.get(x.dataType.simpleString()))}

    def per_stack(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        kind, begins = rows["__kind"].to_numpy(), []
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        for k in range(count):
            at = np.flatnonzero(kind == k)
            given = np.zeros(len(starts), bool)
            given[block[at]] = True
            values = np.stack(rows["__carry"].iloc[at].tolist()) if len(at) else np.zeros((0, 0))
            whole = np.zeros((len(starts), values.shape[1]))
            whole[block[at]] = values
            begins.append((given, whole))
        own = np.flatnonzero(kind == count)
        rows = rows.iloc[own].drop(columns=["__carry", "__kind"]).reset_index(drop=True)
        # a carry's nulls make pandas read integers as doubles
        whole = {c: t for c, t in integers.items() if rows[c].dtype.kind == "f" and not rows[c].isna().any()}
        return f(rows.astype(whole) if whole else rows, np.searchsorted(block[own], np.arange(len(starts))), *begins)

    return by_stacks(met, [key, "__block"], ["__kind", "seq"], per_stack, schema)


def with_columns(df: DataFrame, columns: str, f: Callable[..., pd.DataFrame], key: str, carries: list[DataFrame], apply: Callable[..., DataFrame] = applied) -> DataFrame:
    """df, a blocked one, with more columns: f(rows, carries) gives the rows with them. apply: applied or applied_together."""
    kept = [x for x in df.schema.fields if x.name != "__block"]
    made = {c.split()[0] for c in columns.split(", ")}
    kept = [x for x in kept if x.name not in made]
    names = [x.name for x in kept] + [c.split()[0] for c in columns.split(", ")]
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in kept), columns])
    return apply(df, lambda *a: f(*a)[names], key, schema, carries)
