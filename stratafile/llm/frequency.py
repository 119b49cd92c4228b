"""Frequency of every distinct value or term."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code
from ..operators.common import take
from ..session import delete_path, read_json, shared_path, write_json

#: The field under which the store counts records themselves.
ALL = "*"
#: Segments of one tier that are merged, and the growth of a tier; counts of the smallest tier.
MERGED, LEAST_ROWS = 4, 100_000

_COUNTS = "val string, occ long, recs long, field string"


_TERM = "array<struct<field:string,val:string,occ:bigint>>"


def _one(field: str, value: Column) -> Column:
    """Array of (field, val, occ) of a value that is a term itself; empty for NULL and for nothing."""
    term = F.struct(F.lit(field).alias("field"), value.alias("val"), F.lit(1).cast("long").alias("occ"))
    return F.when(value != "", F.array(term)).otherwise(F.array().cast(_TERM))


def _with_terms(rows: DataFrame, field: str) -> DataFrame:
    """Replaces a text of terms by the array of (field, val, occ) of its distinct terms.

    Sorted, a term's occurrences lie together: where one starts and the next starts gives their number. Each step is a column of its own, so a
    text of very many terms is split once.
    """
    rows = rows.withColumn("_words", F.array_sort(F.regexp_extract_all(F.lower(field), F.lit("[a-z0-9_]+"), 0)))
    first = F.transform("_words", lambda w, i: F.when((i == 0) | (F.get("_words", i - 1) != w), i))
    rows = rows.withColumn("_starts", F.filter(first, lambda i: i.isNotNull()))
    terms = F.transform(
        "_starts",
        lambda i, k: F.struct(
            F.lit(field).alias("field"), F.get("_words", i).alias("val"), (F.coalesce(F.get("_starts", k + 1), F.size("_words")) - i).cast("long").alias("occ")
        ),
    )
    return rows.withColumn(field, F.coalesce(terms, F.array().cast(_TERM))).drop("_words", "_starts")


def term_deltas(added: DataFrame | None, removed: DataFrame | None, values: list[str], term_lists: list[str]) -> DataFrame:
    """Signed changes by field and val: occ in occurrences, recs in records; changes that cancel out give no row.

    A changed record is removed in its old form and added in its new one. values: fields compared trimmed
    and in lower case; term_lists: fields whose terms are the maximal runs of a-z, 0-9 and _ in lower
    case. NULL, empty and blank values have no terms. The records themselves count under the field *.

    Records are first counted by their raw combination of values, combined before the shuffle, so
    terms are taken apart once for each combination and a term that all rows hold is never gathered.
    """
    fields = [*values, *term_lists]
    signed = [take(df, *fields).withColumn("_sign", F.lit(s).cast("long")) for df, s in ((added, 1), (removed, -1)) if df is not None]
    rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    raw = rows.groupBy(*fields).agg(F.sum("_sign").alias("_sign")).where(F.col("_sign") != 0)
    for f in term_lists:
        raw = _with_terms(raw, f)
    own = F.array(F.struct(F.lit(ALL).alias("field"), F.lit("").alias("val"), F.lit(1).cast("long").alias("occ")))
    parts = [own, *(_one(f, code(f)) for f in values), *(F.col(f) for f in term_lists)]
    terms = raw.select("_sign", F.explode(F.concat(*parts)).alias("t"))
    out = terms.groupBy("t.field", "t.val").agg(F.sum(F.col("t.occ") * F.col("_sign")).alias("occ"), F.sum("_sign").alias("recs"))
    return out.where((F.col("occ") != 0) | (F.col("recs") != 0))


class TermCounts:
    """Counts that persist between deliveries: segments of field, val, occ, recs below a shared folder, partitioned by field.

    apply() writes the signed changes of a delivery as a segment and then switches to it; segments of one tier of size are merged as soon as there are
    MERGED of them, so what a delivery writes follows its own size, and a count is written anew a logarithmic number of times. The counts
    are the sums over the few segments. A lost executor or a stopped job leaves the last state whole. With the path of counts that are there
    already, it goes on from them. Read what counts() and marked() give before the next apply(): merged segments are deleted.
    """

    def __init__(self, spark: SparkSession, values: list[str], term_lists: list[str], path: str | None = None, least_rows: int = LEAST_ROWS):
        self.spark, self.values, self.term_lists, self.least_rows = spark, values, term_lists, least_rows
        self.path = (path or shared_path(spark, "terms")).rstrip("/")
        self.state = read_json(spark, f"{self.path}/COUNTS.json") or {"segments": [], "deliveries": []}

    def _sum(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], _COUNTS)
        rows = self.spark.read.schema(_COUNTS).parquet(f"{self.path}/{segments[0]['name']}")
        for s in segments[1:]:
            rows = rows.unionByName(self.spark.read.schema(_COUNTS).parquet(f"{self.path}/{s['name']}"))
        if len(segments) == 1:
            return rows
        return rows.groupBy("field", "val").agg(F.sum("occ").alias("occ"), F.sum("recs").alias("recs")).where((F.col("occ") != 0) | (F.col("recs") != 0))

    def counts(self) -> DataFrame:
        return self._sum(self.state["segments"])

    def _write(self, rows: DataFrame) -> dict:
        name = f"s-{uuid.uuid4().hex}"
        rows.select("val", "occ", "recs", "field").write.partitionBy("field").parquet(f"{self.path}/{name}")
        return {"name": name, "rows": self.spark.read.schema(_COUNTS).parquet(f"{self.path}/{name}").count()}

    def _switch(self, segments: list[dict], deliveries: list[str]) -> None:
        new = {"segments": segments, "deliveries": deliveries}
        write_json(self.spark, f"{self.path}/COUNTS.json", new)
        old, self.state = self.state, new
        for s in old["segments"]:
            if s not in segments:
                delete_path(self.spark, f"{self.path}/{s['name']}")

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, delivery: str | None = None) -> bool:
        """Merges the signed changes into the counts. delivery: a name; one that has been applied already changes nothing, and False is given. Names are kept, some bytes each."""
        if delivery is not None and delivery in self.state["deliveries"]:
            return False
        one = self._write(term_deltas(added, removed, self.values, self.term_lists))
        self._switch([*self.state["segments"], *([one] if one["rows"] else [])], [*self.state["deliveries"], *([delivery] if delivery is not None else [])])
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in self.state["segments"]:
                tiers.setdefault(int(math.log(max(s["rows"], self.least_rows) / self.least_rows, MERGED)), []).append(s)
            full = next((t for t in tiers.values() if len(t) >= MERGED), None)
            if full is None:
                return True
            one = self._write(self._sum(full))
            self._switch([*(s for s in self.state["segments"] if s not in full), *([one] if one["rows"] else [])], self.state["deliveries"])

    def drop(self) -> None:
        """Deletes the counts."""
        delete_path(self.spark, self.path)
        self.state = {"segments": [], "deliveries": []}

    def marked(self, rare_under: int = 6, common_over_percent: int = 10) -> DataFrame:
        """field, val, occ, recs and mark: rare (fewer occurrences than rare_under), else common (in more than so many percent of all records), else mid."""
        counts = self.counts()
        total = F.coalesce(counts.where(F.col("field") == ALL).agg(F.sum("recs").alias("n")).scalar(), F.lit(0))
        mark = F.when(F.col("occ") < rare_under, "rare").when(F.col("recs") * 100 > total * common_over_percent, "common").otherwise("mid")
        return counts.where(F.col("field") != ALL).select("field", "val", "occ", "recs", mark.alias("mark"))
