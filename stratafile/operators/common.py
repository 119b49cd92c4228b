"""What several operators need: picking columns, and joins that stand a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lookup of at most so many rows and bytes of values is broadcast, after counting both; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only. An exact name wins, so that extra columns whose names differ in case, or repeat, don't clash."""
    have = df.columns
    if len({c.lower() for c in have}) < len(have):
        df = df.toDF(*(f"_{i}" for i in range(len(have))))
    picked = []
    for name in names:
        at = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"there is no column {name}; there are {', '.join(have)}")
        picked.append(df[df.columns[at[0]]].alias(name))
    return df.select(*picked)


def hot_keys(rows: DataFrame, on: list[str], share: int | None = None) -> DataFrame:
    """Keys that hold at least one in `share` rows, hence at most `share` keys. share: four times the shuffle's partitions, unless given."""
    share = share or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    return counts.where(F.col("_n") * share >= F.greatest(total.scalar(), F.lit(share * 1000))).select(*on)


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Adds to each row the values of a table with unique keys.

    Rows of hot keys stay where they are and meet a broadcast of their few table rows (at most one for
    each hot key, whose number hot_keys bounds); all others meet the table by shuffle. how: inner or left.
    NULL keys match nothing.
    """
    hot = hot_keys(rows, on)
    values = [c for c in table.columns if c not in on]
    heavy = F.broadcast(table.join(F.broadcast(hot), on, "left_semi"))
    most = rows.join(F.broadcast(hot), on, "left_anti").join(table, on, how)
    few = rows.join(F.broadcast(hot), on, "left_semi").join(heavy, on, how)
    columns = [*rows.columns, *values]
    return most.select(*columns).unionByName(few.select(*columns))


def is_small(table: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes of values, counted in one pass over it. It should be cheap to read."""
    fixed, size = 0, F.lit(0)
    for f in table.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        fixed += 8
    n, total = table.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return n <= most and n * fixed + (total or 0) <= most_bytes


def small_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Joins a table with unique keys that is expected to be small: rows and bytes are counted first; broadcast within both limits, else joined by lookup_join. table should be cheap to read."""
    if is_small(table, most, most_bytes):
        return rows.join(F.broadcast(table), on, how)
    return lookup_join(rows, table, on, how)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of tables whose keys may repeat on both sides; NULL keys match nothing.

    A table within both limits is broadcast. Beyond them both sides are shuffled, and rows of a hot key (hot_keys) are dealt by a hash of the whole
    row over as many partitions as a shuffle has, each of which gets the table's rows of that key: no task gets all rows of a key, and no pair is lost.
    rows and table are read more than once and should be settled.
    """
    if is_small(table, most, most_bytes):
        return rows.join(F.broadcast(table), on)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(rows, on).withColumn("_hot", F.lit(True)))
    deal = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(parts)).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), deal).otherwise(0))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(copies, [*on, "_salt"]).select(*rows.columns, *(c for c in table.columns if c not in on))
