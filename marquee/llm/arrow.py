"""Small helpers for functions that work on Arrow batches inside tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes worked on at once; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20

_SHIPPED: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after its application's Python workers were given this package.

    Functions that run in tasks import it there; Spark hands the file to each worker, as
    ``--py-files`` would. Imported from an archive, it is there already.
    """
    context = df.sparkSession.sparkContext
    package = Path(__file__).parent.parent
    if context.applicationId not in _SHIPPED and package.is_dir():
        archive = os.path.join(tempfile.mkdtemp(prefix="marquee-"), "marquee-package.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return df


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_binary())
        offsets = np.frombuffer(sizes.buffers()[1], np.int64)[
            sizes.offset : sizes.offset + len(sizes) + 1
        ]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column, null as empty."""
    return [value or "" for value in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a column, null as empty."""
    return [value or b"" for value in batch.column(column).cast(pa.large_binary()).to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            column if isinstance(column, pa.Array) else pa.array(column, field.type)
            for column, field in zip(columns, schema, strict=True)
        ],
        schema=schema,
    )
