"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_map, settled

#: How a state is made from rows and from other states, by the end of its name.
_ROWS = {"sum": "sum", "min": "min", "max": "max"}


def _partial_states(keys: list[str], measures: list[str], names: list[str]):
    """Reads one partition in key order; gives a state for each key in it. edge: the key is the partition's first or last, so its state may go on in a neighbour."""

    rows = [([], "count_all"), *((m, how) for m in measures for how in _ROWS)]
    merge = [("n", "sum"), *((f"{m}_{how}", how) for m in measures for how in _ROWS)]

    def grouped(t: pa.Table, what: list) -> pa.Table:
        """States in the order in which their keys come; group_by alone doesn't keep it."""
        t = t.append_column("_at", pa.array(np.arange(t.num_rows)))
        out = t.group_by(keys, use_threads=False).aggregate([*what, ("_at", "min")]).sort_by("_at_min")
        return out.select([*keys, *("count_all" if how == "count_all" else f"{m}_{how}" for m, how in what)]).rename_columns(names)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None  # the state of the key that the last batch ended with
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            t = grouped(pa.Table.from_batches([batch]), rows)
            if open_ is not None:
                t = grouped(pa.concat_tables([open_, t]), merge)
            open_ = t.slice(t.num_rows - 1)
            done = t.slice(0, t.num_rows - 1)
            if done.num_rows:
                edge = np.zeros(done.num_rows, bool)
                edge[0], first = first, False
                yield from done.append_column("edge", pa.array(edge)).combine_chunks().to_batches()
        if open_ is not None:
            yield from open_.append_column("edge", pa.array([True])).combine_chunks().to_batches()

    return states


def balanced_aggregate(df: DataFrame, keys: list[str], order: list[str], measures: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Count of rows (n), and sum, min and max of each measure, for every key, with even tasks however the keys are skewed.

    Rows are range partitioned on the keys and the secondary order, at quantiles that Spark samples, so a
    heavy key is split over neighbouring partitions; every partition makes the states of its keys in one
    pass over its sorted rows; only the first and last key of a partition can go on next door, and
    those states, two a partition at most, are stitched by a small aggregation. All others are whole
    as they are, and aren't shuffled again.

    order should tell rows of a key apart (an id); rows equal in all of it stay in one partition. NULL is a
    key like any other; NULL measures don't count in sum, min and max (all NULL gives NULL). An empty input
    gives no rows. Sums of integers are long. measures must be numeric.
    """
    measures = measures or []
    long = df.select(*dict.fromkeys([*keys, *order, *measures]))
    kinds = {f.name: T.LongType() if isinstance(f.dataType, T.IntegralType) else T.DoubleType() if f.name in measures else f.dataType for f in long.schema}
    long = long.select(*(F.col(c).cast(kinds[c]).alias(c) if c in measures else F.col(c) for c in long.columns))
    names = [*keys, "n", *(f"{m}_{how}" for m in measures for how in _ROWS)]
    schema = T.StructType(
        [T.StructField(k, long.schema[k].dataType) for k in keys]
        + [T.StructField("n", T.LongType())]
        + [T.StructField(f"{m}_{how}", kinds[m]) for m in measures for how in _ROWS]
        + [T.StructField("edge", T.BooleanType())]
    )
    by = [*keys, *(c for c in order if c not in keys)]
    ranged = long.repartitionByRange(partitions, *by) if partitions else long.repartitionByRange(*by)
    # the order within a key has done its part; partitions only need their keys together
    states = arrow_map(ranged.select(*dict.fromkeys([*keys, *measures])).sortWithinPartitions(*keys), _partial_states(keys, measures, names), schema)
    # both parts must see the same partitions: a second run of the range exchange could cut elsewhere
    states = settled(states)
    whole = states.where(~F.col("edge")).drop("edge")
    merge = [F.sum("n").alias("n"), *(getattr(F, how)(f"{m}_{how}").alias(f"{m}_{how}") for m in measures for how in _ROWS)]
    stitched = states.where(F.col("edge")).groupBy(*keys).agg(*merge)
    return whole.unionByName(stitched)


def heavy_keys(df: DataFrame, keys: list[str], order: list[str], percent: int = 1) -> DataFrame:
    """The keys that hold at least so many percent of all rows, with their n, through balanced_aggregate. No rows for an empty input."""
    counts = balanced_aggregate(df, keys, order)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.where(F.col("n") * 100 >= total.scalar() * percent)


def _number_rows(keys: list[str]):
    """Adds to sorted rows their place in the partition and their rank within the key, both from where the partition starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rank, last = 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = pa.Table.from_batches([batch.select(keys)])
            seen = pa.concat_tables([last, own]) if last is not None else own
            new = np.zeros(seen.num_rows - 1, bool)
            for c in seen.columns:
                c = c.combine_chunks()
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                new |= differ | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            if last is None:
                new = np.concatenate([[True], new])
            where = np.arange(n)
            start = np.maximum.accumulate(np.where(new, where, -1))
            ranks = np.where(start >= 0, where - start, where + rank) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where + at), pa.array(ranks)], names=[*batch.schema.names, "_at", "_rank"])
            at, rank, last = at + n, int(ranks[-1]), own.slice(n - 1)

    return run


def balanced_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds each row's number within its key (from 1) in a total order, with even tasks however the keys are skewed.

    As balanced_aggregate, rows are range partitioned on keys and order, so that a heavy key lies in several partitions in turn; rows are
    numbered within their partition, and a partition that goes on with a key adds what the partitions before hold of it: one offset
    a partition, computed from its first and last key. order must be total within a key. NULL is a key like others.
    """
    by = [*(F.col(k) for k in keys), *order]
    ranged = (df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_rank", T.LongType())])
    local = settled(arrow_map(ranged, _number_rows(keys), schema))
    ends = local.groupBy("_part").agg(
        F.min_by(F.struct(*keys), "_at").alias("head"), F.max_by(F.struct(*keys, "_rank"), "_at").alias("tail"), F.max("_at").alias("rows")
    )
    # what a partition leaves of its last key, and where the next ones take up the same key as their first
    tails = ends.select("_part", *(F.col(f"tail.{k}").alias(k) for k in keys), F.col("tail._rank").alias("n"))
    heads = ends.select("_part", *(F.col(f"head.{k}").alias(k) for k in keys), F.lit(0).cast("long").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("first", F.lit(True)).unionByName(tails.withColumn("first", F.lit(False))).withColumn("_offset", F.sum("n").over(earlier))
    offsets = carried.where(F.col("first") & F.col("_offset").isNotNull()).select("_part", F.struct(*keys).alias("_head"), "_offset")
    mine = F.lit(True)
    for k in keys:
        mine = mine & F.col(k).eqNullSafe(F.col(f"_head.{k}"))
    # at most one offset a partition
    joined = local.join(F.broadcast(offsets), "_part", "left")
    rank = F.col("_rank") + F.when(F.col("_offset").isNotNull() & mine, F.col("_offset")).otherwise(0)
    return joined.select(*df.columns, rank.alias(name))
