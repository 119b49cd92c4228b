"""Sessions and the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import io
import json
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Folders of the workspaces that are open, the innermost last.
_workspaces: list[str] = []


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratafile")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster must name one."""
    found = spark.sparkContext.getCheckpointDir()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if not found:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="stratafile-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stratafile/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path of this application below the shared folder."""
    return f"{_workspaces[-1] if _workspaces else _home(spark)}/{kind}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Everything that is settled inside goes to a folder of its own, whose path is given, and is deleted at the end. Results must be consumed, or written elsewhere, before."""
    path = f"{_home(spark)}/work-{uuid.uuid4().hex}"
    _workspaces.append(path)
    try:
        yield path
    finally:
        _workspaces.remove(path)
        delete_path(spark, path)


def settled(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared folder and read from there, so that later plans start from it and no lost executor repeats the work."""
    path = shared_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; only when none of its results are needed any more."""
    delete_path(spark, _home(spark))
    _shipped.discard(spark.sparkContext.applicationId)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the shared storage, if it is there."""
    fs, p = _file(spark, path)
    fs.delete(p, True)


def _rename(fs, old, new) -> bool:
    return not fs.exists(new) and fs.rename(old, new)


def _versions(fs, folder) -> list[int]:
    """Numbers of the whole versions of a state, rising."""
    if not fs.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())


def write_json(spark: SparkSession, path: str, value) -> None:
    """A new version of a small state on the shared storage: a folder holds each version under its number, written beside and then renamed.

    No version is touched before a later one is whole, so a job that stops anywhere leaves the old state or the new one; older ones than the last
    two are deleted afterwards. If another job has taken the number meanwhile, this one fails (FileExistsError) and its own state is not written.
    """
    fs, folder = _file(spark, path)
    before = _versions(fs, folder)
    number = before[-1] + 1 if before else 1
    _, beside = _file(spark, f"{path}/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(json.dumps(value).encode())
    out.close()
    if not _rename(fs, beside, _file(spark, f"{path}/{number:012d}")[1]):
        fs.delete(beside, False)
        raise FileExistsError(f"another job has changed {path}")
    for old in before[:-1]:
        fs.delete(_file(spark, f"{path}/{old:012d}")[1], False)


def read_json(spark: SparkSession, path: str, default=None):
    """The last whole version of a state; default if there is none."""
    fs, folder = _file(spark, path)
    found = _versions(fs, folder)
    if not found:
        return default
    data = fs.open(_file(spark, f"{path}/{found[-1]:012d}")[1])
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
    finally:
        data.close()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once an application, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    fs, path = _file(spark, f"{_home(spark)}/code-{uuid.uuid4().hex}/{home.name}.zip")
    out = fs.create(path)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)


def arrow_map(df: DataFrame, f: Callable, schema) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
