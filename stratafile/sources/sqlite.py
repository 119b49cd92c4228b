"""Reading a catalog that lies in an SQLite database."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FILES, SCANS, migrated
from ..session import arrow_map
from .catalog import Catalog


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _ranges(path: str, table: str, columns: list[str], schema: pa.Schema, page: int):
    """Rows of ranges of rowids, a page at a time, so that a task never holds more than one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _open(path)
        wanted = ", ".join(f'"{c}"' for c in columns)
        kinds = [bool if pa.types.is_boolean(f.type) else int if pa.types.is_integer(f.type) else str for f in schema]
        for batch in batches:
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()):
                cursor = con.execute(f'SELECT {wanted} FROM "{table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (low, high))
                while rows := cursor.fetchmany(page):
                    columns_ = [pa.array([None if v is None else k(v) for v in own], f.type) for own, k, f in zip(zip(*rows), kinds, schema)]
                    yield pa.RecordBatch.from_arrays(columns_, schema=schema)
        con.close()

    return run


def read_sqlite(spark: SparkSession, path: str, table: str, schema: T.StructType, rows_per_task: int = 500_000, page: int = 10_000) -> DataFrame:
    """A table of an SQLite database, by ranges of its rowids, read by the executors; the file must be where they all see it.

    Columns of the schema that the table lacks are NULL. A missing file raises FileNotFoundError; an empty table gives no rows.
    """
    try:
        con = _open(path)
        low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        have = {r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
        con.close()
    except sqlite3.OperationalError as e:
        raise FileNotFoundError(f"{path}: {e}") from e
    own = T.StructType([f for f in schema if f.name in have])
    if low is None:
        return spark.createDataFrame([], schema)
    starts = spark.range(low, high + 1, rows_per_task, numPartitions=max(1, -(-(high + 1 - low) // rows_per_task)))
    ranges = starts.select(F.col("id").alias("low"), F.least(F.col("id") + rows_per_task, F.lit(high + 1)).alias("high"))
    arrow = pa.schema([(f.name, pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in own])
    return migrated(arrow_map(ranges, _ranges(path, table, own.names, arrow, page), own), schema)


def import_sqlite(catalog: Catalog, path: str) -> None:
    """Takes over both tables of an SQLite catalog as new snapshots."""
    catalog.write(files=read_sqlite(catalog.spark, path, "files", FILES), scans=read_sqlite(catalog.spark, path, "scans", SCANS))
