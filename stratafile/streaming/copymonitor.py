"""Following the copy tool's logs as they grow."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators import copylog
from ..session import ship

#: Bytes that one task reads at most, and that are looked at for the last line end at once.
TASK_BYTES, TAIL_BYTES = 64 * 1024 * 1024, 65_536


@dataclass
class _Range(InputPartition):
    """Bytes of a log; first and last are where the lines to read begin and end, start and end what is this task's share."""

    log: str
    first: int
    start: int
    end: int
    last: int


def _whole_lines(path: str) -> int:
    """Where the last whole line of a file ends; what follows is still being written. A line of any length is looked for from the end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            start = max(0, at - TAIL_BYTES)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


class _LogReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names)
        return sorted(p for p in glob.glob(self.path) if os.path.isfile(p))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        ends = {}
        for path in self._files():
            try:
                ends[path] = _whole_lines(path)
            except OSError:
                continue  # gone or locked for now
        return ends

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for log, last in end.items():
            # a log that is shorter than before has been begun anew
            first = start.get(log, 0) if start.get(log, 0) <= last else 0
            out += [_Range(log, first, at, min(at + TASK_BYTES, last), last) for at in range(first, last, TASK_BYTES)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.log, "rb") as f:
            at = partition.start
            if at > partition.first:  # the line that goes on here belongs to the share before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                yield partition.log, at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class CopyLogs(DataSource):
    """log, position (in bytes) and line of every whole line of a file, of the files of a folder or of a pattern; offsets are bytes, so what is appended to a file is read as it comes."""

    @classmethod
    def name(cls) -> str:
        return "copylogs"

    def schema(self) -> str:
        return "log string, position long, line string"

    def streamReader(self, schema) -> _LogReader:
        return _LogReader(self.options["path"].removeprefix("file://"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of growing logs as a stream: log, position and line. The folder must be seen by the driver and the executors alike."""
    ship(spark)
    spark.dataSource.register(CopyLogs)
    return spark.readStream.format("copylogs").load(path)


def running_totals(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The batch summary over all lines so far: sums, first and last start, last file and last status, in the order of logs and of the positions in them. The state is one row, or one a log with keys."""
    at = F.struct("log", "position").alias("at")
    return copylog.summary(lines.select("log", at, "line"), keys, "at")


def monitor(spark: SparkSession, path: str, name: str, checkpoint: str, seconds: int | None = 5, keys: list[str] | None = None) -> StreamingQuery:
    """Keeps the totals of the logs in the table `name`, updated as they grow; seconds None reads what is there and stops. keys: ["log"] for a row a log."""
    writer = running_totals(read_log(spark, path), keys).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
