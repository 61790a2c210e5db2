"""Vendor files of one-minute bars as a Spark data source: spark.read.format("vendor_bars") and, for new files, spark.readStream.

A folder holds a file `{contract}_ohlcv-1m_{anything}.parquet` for each contract, or several; each may be a folder of Parquet parts.
A batch reads the first of a contract's files by name, as later ones repeat it; a stream reads all of them, in the order of
their names. A file or part is a partition.

Options: `path`; `symbols`, comma-separated (`ES` and `ES.c.0` name one contract), all by default; `start` (kept) and `end` (not kept).
register(spark) makes the format known. Filters on ts and symbol that Spark pushes down prune contracts and row groups too, and
a schema given to the reader prunes columns: the files' other columns are never read. Times without a zone are UTC. A column
that a file lacks is null. Folders can be in any store that pyarrow opens by its address.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from tidemark.sources.market import contract_name

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"
KIND = "_ohlcv-1m_"
KINDS = {"symbol": pa.string(), "ts": pa.timestamp("us", "UTC"), "volume": pa.int64()}


@dataclass
class Part(InputPartition):
    symbol: str
    file: str


def listed(path: str) -> list[tuple[str, str, list[str]]]:
    """(contract, name, files) of a folder's vendor files, in the order of their names."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    out = []
    for entry in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda e: e.base_name):
        contract, kind, _ = entry.base_name.partition(KIND)
        if kind and entry.base_name.endswith(".parquet"):
            parts = [entry] if entry.type == fs.FileType.File else store.get_file_info(fs.FileSelector(entry.path, recursive=True))
            files = sorted(p.path for p in parts if p.type == fs.FileType.File and p.extension == "parquet" and p.base_name[0] not in "._")
            out.append((contract, entry.base_name, files))
    return out


def _moment(value) -> datetime.datetime:
    moment = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))
    return moment if moment.tzinfo else moment.replace(tzinfo=datetime.timezone.utc)


class _Files:
    """What a batch and a stream share: options, limits, and reading a part."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path = schema.names, options.get("path", "")
        if not self.path:
            raise ValueError("vendor_bars needs a path")
        asked = [s for s in options.get("symbols", "").split(",") if s.strip()]
        self.symbols = {contract_name(s) for s in asked} or None
        self.limits = [(sign, _moment(options[name])) for name, sign in (("start", ">="), ("end", "<")) if options.get(name)]

    def wanted(self, symbol: str) -> bool:
        return self.symbols is None or symbol in self.symbols

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        data = dataset.dataset(part.file, filesystem=store, format="parquet")
        ts = "ts_event" if "ts_event" in data.schema.names else "ts"
        keep = None
        for sign, moment in self.limits:
            kind = data.schema.field(ts).type
            limit = pa.scalar(moment if kind.tz else moment.astimezone(datetime.timezone.utc).replace(tzinfo=None), kind)
            field = pc.field(ts)
            test = {">=": field >= limit, ">": field > limit, "<": field < limit, "<=": field <= limit}[sign]
            keep = test if keep is None else keep & test
        source = {n: ts if n == "ts" else n for n in self.names if n != "symbol"}
        for batch in data.to_batches(columns=[c for c in source.values() if c in data.schema.names], filter=keep):
            if batch.num_rows:
                kind = lambda n: KINDS.get(n, pa.float64())
                columns = [pa.array([part.symbol] * batch.num_rows) if n == "symbol" else batch.column(source[n]).cast(kind(n)) if source[n] in batch.schema.names else pa.nulls(batch.num_rows, kind(n)) for n in self.names]
                yield pa.RecordBatch.from_arrays(columns, self.names)


class BatchReader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes note of limits on ts and of symbols; Spark applies all filters to the rows that are left."""
        signs = {GreaterThanOrEqual: ">=", GreaterThan: ">", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if f.attribute == ("ts",) and type(f) in signs:
                self.limits.append((signs[type(f)], _moment(f.value)))
            elif f.attribute == ("symbol",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = named if self.symbols is None else self.symbols & named
            yield f

    def partitions(self) -> list[Part]:
        first: dict[str, list[str]] = {}
        for symbol, _, files in listed(self.path):
            if self.wanted(symbol):
                first.setdefault(symbol, files)
        if self.symbols and not first:
            raise ValueError(f"no file for {', '.join(sorted(self.symbols))} in {self.path}")
        return [Part(s, f) for s, files in first.items() for f in files]


class StreamReader(_Files, DataSourceStreamReader):
    """An offset is the name of the last file read; a file whose name sorts before it is not read any more."""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max((n for s, n, _ in listed(self.path) if self.wanted(s)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(s, f) for s, n, files in listed(self.path) if start["last"] < n <= end["last"] and self.wanted(s) for f in files]

    def commit(self, end: dict) -> None:
        pass


class VendorBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, dict(self.options))


def register(spark) -> None:
    """Makes the format known to the session, and lets Spark push filters down to it, which a reader that takes them needs."""
    spark.dataSource.register(VendorBars)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
