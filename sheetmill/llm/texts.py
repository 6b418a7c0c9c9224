"""Streaming whole texts through numpy kernels: batches of bounded size in, Arrow record batches out."""

from __future__ import annotations

import sys
import types
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Output rows gathered before a record batch is passed on.
FLUSH_ROWS = 200_000


def map_texts(df: DataFrame, kernel: Callable[..., Iterator[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``kernel(rows)`` over the partition's rows (dicts, one text at a time in memory besides the Arrow batch) yields
    dicts of equally long columns; they are passed on in record batches of about FLUSH_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    yield from batch.slice(lo, 256).to_pylist()

        held: list[dict] = []
        n = 0
        for part in kernel(rows()):
            k = len(part[arrow.names[0]])
            if not k:
                continue
            held.append(part)
            n += k
            if n >= FLUSH_ROWS:
                yield _joined(held, arrow)
                held, n = [], 0
        if held:
            yield _joined(held, arrow)

    return df.mapInArrow(run, schema)


def _joined(parts: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in arrow:
        chunks = [pa.array(p[f.name], type=f.type) for p in parts]
        arrays.append(chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks))
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def kept(key: str, make: Callable[[], object], most: int) -> object:
    """What ``make`` returns, kept by the Python worker from task to task; of more than ``most`` things the one used
    longest ago is given up. It is held outside of this package, whose functions may reach a worker by value."""
    held: OrderedDict = sys.modules.setdefault("_sheetmill_kept", types.ModuleType("_sheetmill_kept")).__dict__.setdefault("held", OrderedDict())
    if key not in held:
        while len(held) >= most:
            held.popitem(last=False)
        held[key] = make()
    held.move_to_end(key)
    return held[key]
