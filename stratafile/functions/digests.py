"""Digests of contents, in a column or on disk."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_map
from .text import as_column

try:
    import blake3 as _blake3
except ModuleNotFoundError:
    _blake3 = None

OUTCOME = "file_id long, quick_hash string, sha256 string, blake3 string, h1 string, h2 string, outcome string, message string"


def sha256_hex(content: Column | str) -> Column:
    return F.sha2(as_column(content), 256)


def head_digest(content: Column | str, sample: int) -> Column:
    """Digest of the first `sample` bytes (of text: characters), for grouping."""
    return F.md5(F.left(as_column(content), F.lit(sample)))


def tail_digest(content: Column | str, sample: int) -> Column:
    """Digest of the last `sample` bytes (of text: characters); the empty string for an empty content."""
    x = as_column(content)
    return F.when(F.length(x) == 0, F.lit("")).otherwise(F.md5(F.right(x, F.lit(sample))))


def sampled_digest(content: Column | str, size: Column | str, sample: int) -> Column:
    """Digest for grouping over size, head, and tail if the content is longer than the sample."""
    x, n = as_column(content), as_column(size)
    tail = F.when(n > sample, F.right(x, F.lit(sample))).otherwise(F.lit(""))
    return F.md5(F.concat(n.cast("string"), F.left(x, F.lit(sample)), tail))


def quick_digest(size: int, head: bytes, tail: bytes) -> str:
    """The catalog's quick hash: xxh64 of seed 0 over the decimal size, the head, and the tail (empty unless the file is longer than the head)."""
    return xxhash.xxh64(str(size).encode() + head + tail).hexdigest()


@F.pandas_udf(T.StringType())
def quick_hash_of(content: pd.Series, sample: pd.Series) -> pd.Series:
    """Quick hash of binary contents, equal to that of the same bytes on disk. Arrow batches."""
    out = [None if c is None else quick_digest(len(c), c[:n], c[-n:] if len(c) > n else b"") for c, n in zip(content, sample)]
    return pd.Series(out, dtype="object")


def blake3_available() -> bool:
    return _blake3 is not None


def _hash_file(path: str, wanted: frozenset[str], sample: int, chunk: int) -> dict[str, str]:
    import os

    size = os.stat(path).st_size
    out: dict[str, str] = {}
    with open(path, "rb") as f:
        if wanted & {"quick_hash", "h1", "h2"}:
            head = f.read(sample)
            tail = b""
            if size > sample or "h2" in wanted:
                f.seek(max(0, size - sample))
                tail = f.read(sample)
            if "quick_hash" in wanted:
                out["quick_hash"] = quick_digest(size, head, tail if size > sample else b"")
            if "h1" in wanted:
                out["h1"] = xxhash.xxh64(head).hexdigest()
            if "h2" in wanted:
                out["h2"] = xxhash.xxh64(tail).hexdigest() if size else ""
            f.seek(0)
        whole = {k: make() for k, make in (("sha256", hashlib.sha256), ("blake3", _blake3 and _blake3.blake3)) if k in wanted and make}
        if whole:
            while block := f.read(chunk):
                for h in whole.values():
                    h.update(block)
            out |= {k: h.hexdigest() for k, h in whole.items()}
    return out


def _hash_batches(wanted: frozenset[str], sample: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["quick_hash", "sha256", "blake3", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, path in zip(batch.column("file_id").to_pylist(), batch.column("path_abs").to_pylist()):
                try:
                    rows.append({"file_id": file_id, "outcome": "success", "message": None, **_hash_file(path, wanted, sample, chunk)})
                except (FileNotFoundError, NotADirectoryError):
                    rows.append({"file_id": file_id, "outcome": "missing", "message": f"there is no file at {path}"})
                except (OSError, TypeError, ValueError) as e:
                    rows.append({"file_id": file_id, "outcome": "error", "message": str(e)})
            schema = pa.schema([("file_id", pa.int64()), *((n, pa.string()) for n in [*names, "outcome", "message"])])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def hash_files(candidates: DataFrame, digests: set[str], sample: int = 262_144, chunk: int = 2 * 1024 * 1024, tasks: int | None = None) -> DataFrame:
    """Reads the candidates' files where they lie and gives each one's digests and outcome: success, missing or error, with a message.

    digests: any of quick_hash, sha256, blake3, h1 and h2, all from one pass over a file; contents are read in chunks, so a file of any size
    takes constant memory. Candidates (file_id, path_abs, size_bytes) are put into ranges of their size, and each range is dealt to all tasks in turn,
    so that the largest files lie apart. tasks: a few files each are best for large ones. blake3 needs its library on every executor.
    """
    if "blake3" in digests and not blake3_available():
        raise ModuleNotFoundError("blake3 digests need the blake3 library")
    spark = candidates.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.repartitionByRange(tasks, F.desc("size_bytes"), "file_id").select("file_id", "path_abs").repartition(tasks)
    return arrow_map(dealt, _hash_batches(frozenset(digests), sample, chunk), OUTCOME)
