"""Helpers shared by the corpus operators: reading, Arrow mapping and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: bytes.split() separates at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return f"file://{tempfile.gettempdir()}/checkpoints"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


#: Shuffle files of a query go when it ends, so that a job of many steps needs the disk of its largest step and not of all.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch for Python at most: rows are whole texts.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back, which cuts its lineage and survives lost executors.

    What isn't discarded before goes when the application ends. by: a last column by whose values the files lie in
    folders, so that reading one value reads only it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    _files(out, lambda fs, at: fs.deleteOnExit(at))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read any more."""
    for table in tables:
        _files(table, lambda fs, at: fs.delete(at, True))


def _files(table: DataFrame, act: Callable) -> None:
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
    act(path.getFileSystem(context._jsc.hadoopConfiguration()), path)


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose batches for Python have at most ROWS rows from now on."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= ROWS:
        conf.set(BATCH, str(ROWS))
    return df


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable], columns: list[str]) -> DataFrame:
    """mapInArrow over the named columns (strings arrive as UTF-8 bytes).

    make() runs once for each task and returns a function from one row's values to an iterable of output tuples;
    output goes out in batches of bounded size, so a task holds one input batch and one output batch.
    """
    kinds = dict(df.dtypes)
    source = df.select(*[F.col(c).cast("binary").alias(c) if kinds[c] == "string" else F.col(c) for c in columns])
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        rows: list[tuple] = []
        weight = 0
        for batch in batches:
            for values in zip(*[col if isinstance(col, list) else lazy(col) for col in batch.columns], strict=True):
                for row in each(*values):
                    rows.append(row)
                    weight += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
                    if weight > 4_000_000:
                        yield pack(rows, arrow)
                        rows, weight = [], 0
        if rows:
            yield pack(rows, arrow)
        pa.default_memory_pool().release_unused()

    return small_batches(source).mapInArrow(run, schema)


def lazy(column: pa.Array) -> Iterator:
    """A column's values one by one; short ones at once, arrays of integers as they lie."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return (x.as_py() for x in column)
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type):
        return (None if x.values is None else x.values.to_numpy() for x in column)
    return iter(column.to_pylist())


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
