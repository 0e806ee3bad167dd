"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_AT_ONCE = 1 << 22  # bytes of text that one task handles at a time
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound the batches that go to Python by bytes, and send this package to the executors, once per application.

    Functions on executors import the package by name. A smaller limit that the session already sets stays.
    """
    limit = spark.conf.get(_BATCH_CONF, "64m").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    held = int(limit[:-1]) * units[limit[-1]] if limit[-1] in units else int(limit)
    if not 0 < held <= ROWS_AT_ONCE:
        spark.conf.set(_BATCH_CONF, str(ROWS_AT_ONCE))
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="briefloom-"))  # on the driver, which serves the file
    with zipfile.ZipFile(folder / "briefloom_package.zip", "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(folder / "briefloom_package.zip"))
    _SHIPPED.add(application)




def id_type(docs: DataFrame, id_col: str) -> T.DataType:
    return docs.schema[id_col].dataType


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under internal names: extra columns cannot clash."""
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def byte_cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least: memory follows bytes, not rows."""
    ends = np.cumsum(sizes)
    start, done = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def slices(batches: Iterator[pa.RecordBatch], limit: int = ROWS_AT_ONCE, column: str = "__text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``limit`` bytes of text."""
    for batch in batches:
        sizes = text_sizes(batch.column(batch.schema.get_field_index(column)))
        for start, stop in byte_cuts(sizes, limit):
            yield batch.slice(start, stop - start)


def text_sizes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the offsets of the texts in it. Null counts as empty."""
    import pyarrow.compute as pc

    filled = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = filled.buffers()
    offsets = np.frombuffer(places, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_batches(
    docs: DataFrame, id_col: str, text_col: str, schema: str, rows: Callable[[list[str]], dict[str, list]]
) -> DataFrame:
    """Run ``rows`` on lists of texts (null: empty) and put the id in front of what it returns.

    ``rows`` gives one list per column of ``schema``. Only ids and the returned columns leave the task.
    """
    source = ids_and_texts(docs, id_col, text_col)
    key = T.StructField(id_col, id_type(docs, id_col))
    out = T.StructType([key, *T._parse_datatype_string(schema).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            got = rows(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), *[pa.array(got[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow
            )

    return source.mapInArrow(run, out)
