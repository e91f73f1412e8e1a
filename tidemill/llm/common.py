"""What the text operators share: reading tables, stored intermediates, text passes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.sources.tables import shared_dir, stored  # noqa: F401  the operators take them from here

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows of an Arrow batch at most: whole texts are long, and Spark's own ten times as
#: many cost each worker about 110 MB more. A session that sets fewer keeps them.
BATCH_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _row(carry: list[str]) -> Column:
    """A struct of the carried columns; of a null where there are none, as no struct is empty."""
    return F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(None).cast("boolean").alias("none")])).alias("row")


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches of BATCH_ROWS; a task gives free memory back as it ends, as
    its process waits beside others for the next one."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_ROWS)) <= BATCH_ROWS:
        conf.set(_BATCH_ROWS, str(BATCH_ROWS))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return df.mapInArrow(task, schema)


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], list[list]]],
    result: T.StructType,
    carry: list[str],
    text_col: str = "text",
) -> DataFrame:
    """One Arrow pass over text_col.

    ``make()`` runs once in a task and returns a function from a list of texts
    to one list for each field of ``result``. The columns ``carry`` go along
    unread inside the struct column ``row``; the fields come in the struct
    column ``out``, so no name can clash.
    """
    inner = df.select(_row(carry), F.col(f"`{text_col}`").alias("text"))
    types = [to_arrow_type(f.dataType) for f in result.fields]
    names = [f.name for f in result.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = step(part.column(1).to_pylist())
                out = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(got, types, strict=True)], names=names)
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["row", "out"])

    schema = T.StructType([inner.schema["row"], T.StructField("out", result)])
    return map_arrow(inner, run, schema)
