"""Searching, sorting and paging the catalog."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, like

COLUMNS = ["file_id", "path_abs", "dir", "name", "ext", "size_bytes", "mtime_utc", "ctime_utc", "state", "error_msg"]
SORTABLE = ["path_abs", "name", "ext", "size_bytes", "mtime_utc", "ctime_utc", "state", "error_msg", "file_id", "dir"]
SEARCHED = ["path_abs", "name", "ext", "state", "error_msg"]


def search(text: str = "", state: str = "All") -> Column:
    """Rows of a state (All: any) with a text in any searched column; % and _ in it are wildcards, A to Z without case."""
    keep = F.lit(True)
    if state and state != "All":
        keep = keep & (F.col("state") == state)
    if text:
        found = F.lit(False)
        for c in SEARCHED:
            found = found | F.coalesce(like(c, f"%{text}%"), F.lit(False))
        keep = keep & found
    return keep


def haystack(text: str = "", state: str = "All") -> Column:
    """Rows whose searched columns, those that aren't empty joined by blanks, hold a text literally, without case; it may reach over columns."""
    keep = F.lit(True) if not state or state == "All" else F.coalesce(F.col("state"), F.lit("")) == state
    if text:
        joined = F.lower(F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in SEARCHED)))
        keep = keep & F.contains(joined, F.lit(text.lower()))
    return keep


def page(files: DataFrame, number: int = 1, size: int = 100, text: str = "", state: str = "All", sort: str = "path_abs", ascending: bool = True) -> DataFrame:
    """One page (from 1) of the rows found, in the order of a column, ties by file_id; NULL comes first in rising order. Spark keeps only the rows up to the page's end of each task."""
    if sort not in SORTABLE:
        raise ValueError(f"can't sort by {sort}; by {', '.join(SORTABLE)}")
    order = F.asc_nulls_first(sort) if ascending else F.desc_nulls_last(sort)
    rows = files.where(search(text, state)).select(*COLUMNS)
    return rows.orderBy(order, F.asc("file_id")).offset((max(1, number) - 1) * size).limit(size)


def page_after(files: DataFrame, last: tuple | None, size: int = 100, text: str = "", state: str = "All", sort: str = "path_abs") -> DataFrame:
    """The page that follows a row, in rising order: last is that row's value of the sorted column and its file_id (None for the first page).

    However deep the page lies, each task keeps one page of rows, and what comes before isn't sorted; pages by number (page) carry all rows up to theirs.
    """
    if sort not in SORTABLE:
        raise ValueError(f"can't sort by {sort}; by {', '.join(SORTABLE)}")
    rows = files.where(search(text, state)).select(*COLUMNS)
    if last is not None:
        value, at = last
        later = F.col("file_id") > at
        if value is None:
            rows = rows.where((F.col(sort).isNull() & later) | F.col(sort).isNotNull())
        else:
            rows = rows.where((F.col(sort) > F.lit(value)) | ((F.col(sort) == F.lit(value)) & later))
    return rows.orderBy(F.asc_nulls_first(sort), F.asc("file_id")).limit(size)


def count(files: DataFrame, text: str = "", state: str = "All") -> DataFrame:
    return files.where(search(text, state)).agg(F.count(F.lit(1)).alias("n"))


def pages(total: int, size: int, number: int) -> tuple[int, int, int]:
    """Number of pages (1 at least), and the first and last row (from 1) of a page; 0 and 0 if there are none."""
    n = max(1, math.ceil(total / size))
    if not total:
        return n, 0, 0
    first = (min(max(1, number), n) - 1) * size + 1
    return n, first, min(first + size - 1, total)


def tree(files: DataFrame, limit: int | None = None, text: str = "", state: str = "All") -> DataFrame:
    """path, depth and files of every directory that holds a found file or leads to one; files counts those at or below it.

    limit: only the first so many files by path, as the explorer shows. Each directory is counted before its ancestors are made, so rows
    aren't multiplied by their depth.
    """
    rows = files.where(search(text, state))
    if limit:
        rows = rows.orderBy("path_abs", "file_id").limit(limit)
    dirs = rows.where(F.col("dir").isNotNull()).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    steps = dirs.select("n", F.explode(ancestors("dir")).alias("a"))
    return steps.groupBy(F.col("a.path").alias("path"), F.col("a.depth").alias("depth")).agg(F.sum("n").alias("files"))


def leaves(files: DataFrame, limit: int | None = None, text: str = "", state: str = "All") -> DataFrame:
    """path, parent, name and depth of every found file, to hang below tree()'s directories; separators are /, as there. limit: as in tree. Rows without a path have no place."""
    rows = files.where(search(text, state) & F.col("path_abs").isNotNull())
    if limit:
        rows = rows.orderBy("path_abs", "file_id").limit(limit)
    way = F.filter(F.split(F.regexp_replace("path_abs", r"\\", "/"), "/"), lambda p: p != "")
    rows = rows.select("file_id", "path_abs", way.alias("way"), F.size(way).alias("depth"))
    return rows.select("file_id", F.array_join("way", "/").alias("path"), F.array_join(F.slice("way", 1, F.greatest(F.col("depth") - 1, F.lit(0))), "/").alias("parent"), F.coalesce(F.get("way", F.col("depth") - 1), F.lit("")).alias("name"), "depth")
