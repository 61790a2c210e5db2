"""Rows of many numpy columns packed into one binary value for each part, so that millions of small rows move as few large ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PACKED = "part int, packed binary"


def batch_of(part: np.ndarray, columns: list[np.ndarray], kinds: np.dtype) -> pa.RecordBatch:
    """PACKED: rows of columns, of the kinds in order, dealt by the part of each."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [np.asarray(c)[order].astype(kinds[k]) for k, c in enumerate(columns)]
    bounds = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)] if len(part) else [0]
    blobs = [b"".join([np.uint32(b - a).tobytes(), *(c[a:b].tobytes() for c in columns)]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "packed"])


def columns_of(blobs: list[bytes], kinds: np.dtype) -> list[np.ndarray]:
    """The columns of all blobs of a part."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds.names]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        for k in range(len(kinds)):
            parts[k].append(np.frombuffer(blob, kinds[k], n, at))
            at += n * kinds[k].itemsize
    return [np.concatenate(c) for c in parts]
