"""What the operators share: column handling, work tables, grouped streaming.

Conventions that hold for every operator here unless its docstring says more:

* Only the named columns of an input are read, and they are renamed at once, so
  extra columns, whatever their names, can't clash.
* A null text counts as an empty one.
* A null ``doc_id`` can't be referred to: searches over documents leave such
  rows out, and row-wise operators return them with their null id.
* Work tables go to the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import discard, ship, stash

__all__ = ["batches", "binary", "buffer", "by_group", "discard", "prepare", "stash", "texts", "unbinary", "unused"]

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the bytes of Arrow batches, unless they are bound."""
    ship(spark)
    bound = spark.conf.get(ARROW_BYTES)
    if not bound.isdigit() or int(bound) > 1 << 26:
        spark.conf.set(ARROW_BYTES, str(1 << 24))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (never null), and ``more`` columns, of a table of documents."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *(docs[c].alias(c) for c in more),
    )


def batches(it: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, or one row."""
    for b in it:
        if not b.num_rows:
            continue
        _, off = buffer(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
            to = max(at + 1, min(to, b.num_rows))
            yield b.slice(at, to - at)
            at = to


def buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the rows' offsets."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type) and not pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) else pa.large_string())
    _, o, d = arr.buffers()
    off = np.frombuffer(o, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(d, np.uint8)[off[0] : off[-1]] if d is not None and d.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def binary(parts: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array whose rows are ``parts[off[i]:off[i+1]]`` as raw bytes."""
    parts = np.ascontiguousarray(parts)
    if len(off) and int(off[-1]) * parts.itemsize > 2**31 - 1:
        raise ValueError("more than 2 GiB in one batch")
    o = (off * parts.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(o), pa.py_buffer(parts)])


def unbinary(arr: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Undo :func:`binary`."""
    data, off = buffer(arr.cast(pa.large_binary()))
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), off // size


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, most: int = 1, order: list[str] | None = None) -> DataFrame:
    """Call ``fn`` with whole groups of ``keys``, several at once up to ``most`` rows.

    The groups come sorted by ``keys`` then ``order``; a group is never split.
    """
    df = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in it:
            if not b.num_rows:
                continue
            cuts = np.ones(b.num_rows, bool)
            first = held[-1].slice(held[-1].num_rows - 1, 1) if held else None
            same = np.ones(b.num_rows, bool)
            for k in keys:
                col = b.column(b.schema.get_field_index(k))
                prev = pa.concat_arrays([(first.column(b.schema.get_field_index(k)) if first is not None else col.slice(0, 1)), col.slice(0, b.num_rows - 1)])
                v, p = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in (col, prev))
                same &= v == p
            cuts = ~same
            if first is None:
                cuts[0] = False
            at = 0
            for c in np.flatnonzero(cuts):
                if rows + (c - at) >= most:
                    if c > at:
                        held.append(b.slice(at, c - at))
                    if held:
                        yield from fn(pa.Table.from_batches(held))
                    held, rows, at = [], 0, int(c)
            held.append(b.slice(at))
            rows += b.num_rows - at
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.mapInArrow(run, schema)
