"""Shared text and storage helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of result that a worker gathers before it hands an Arrow batch to the JVM.
FLUSH_BYTES = 8 << 20


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow column; None for nulls."""
    if pa.types.is_string(column.type):
        return column.cast(pa.binary()).to_pylist()
    return column.cast(pa.large_binary()).to_pylist()


def ascii_words(text: bytes) -> list[bytes]:
    """Maximal runs outside [\\x20\\x09-\\x0D]: what bytes.split() splits at."""
    return text.split()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever columns came along."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Where the setting is absent, a session on one machine (tests) uses a temporary folder
    that is removed when the driver ends; on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="strandline-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        root = f"file://{_LOCAL[0]}"
    return f"{root.rstrip('/')}/strandline-{uuid.uuid4().hex}"


def stored(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and
    survives the loss of any executor."""
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a stored() frame that nothing will read again."""
    path = getattr(df, "_strandline_path", None)
    if path:
        remove(df.sparkSession, path)


def scalar_struct(fn: Callable[[list[bytes | None]], list[list]], ddl: str) -> Callable[..., Column]:
    """An Arrow scalar function: the bytes of a text column in, one struct a row out.

    fn gets the texts of one Arrow batch and returns a list of columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _parse_datatype_string(ddl)
    names = [f.name for f in schema.fields]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(texts: pa.Array) -> pa.Array:
        columns = fn(as_bytes(texts))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # nondeterministic: a filter on the result must not make Spark evaluate it twice
    return F.arrow_udf(run, schema).asNondeterministic()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, cost: Callable[[tuple], int] = lambda r: 64) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += cost(row)
        if size >= FLUSH_BYTES or len(held) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
