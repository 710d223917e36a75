"""Running Arrow functions inside Spark tasks, and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evq.llm.words import BLOCK_BYTES, release_memory, text_blocks
from evq.plans.session import drop_folder, ensure_checkpoint_dir


#: Rows sent to a Python worker at once. Rows hold whole documents: Spark's default of 10,000 is made for narrow ones.
BATCH_ROWS = 2000
_made: list[list[str]] = []  # folders of ``written``, a list per open ``scratch``


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself, with the session's Arrow batches limited to ``BATCH_ROWS`` rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def map_text(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """Apply a function to blocks of rows whose texts hold about ``block`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch, column, block):
                yield function(part)
            release_memory()

    return small_batches(df).mapInArrow(run, schema)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder, as URI, in the folder shared by driver and executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    folder = new_folder(df.sparkSession, name)
    if _made:
        _made[-1].append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables that ``written`` makes inside are deleted at the end: what follows from them is written before, elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for folder in _made.pop():
            drop_folder(spark, folder)


def finished(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """The result of ``make`` as a table of its own; the tables made on the way are deleted."""
    folder = new_folder(spark, name)
    with scratch(spark):
        result = make()
        result.write.parquet(folder)
        schema = result.schema
    if _made:
        _made[-1].append(folder)
    return spark.read.schema(schema).parquet(folder)
