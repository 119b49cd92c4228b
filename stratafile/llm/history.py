"""Deduplicating new batches against all history."""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ext_key, is_active, valid_quick_hash, valid_sha256
from ..operators.common import lookup_join, take
from ..session import delete_path, read_json, settled, shared_path, write_json

#: What a posting is of: the record's digest (s or q before it), length and extension.
RECORD = ["digest", "length", "ext"]
#: What a posting is found by, token and length, and what it is verified with.
FOUND_BY, KEY = ["token", "length"], ["token", "length", "digest", "ext"]
NO_LENGTH = -1
#: A token is common if at least one in so many records has it; segments of one tier that are merged; growth of a tier, and after which rarity is taken anew.
COMMON, MERGED, GROWTH = 1000, 4, 4
#: Postings of the smallest tier; postings of a bucket.
LEAST_ROWS, BUCKET_ROWS = 10_000, 2_000_000


def _records(rows: DataFrame) -> DataFrame:
    """file_id and RECORD of what takes part, up to two records a row.

    A record is the set of its tokens. For exact these are its sha256 alone, of which one must be shared; for near its quick_hash, its size and its
    extension, of which all three must be.
    """
    taking = is_active("state") & (F.col("size_bytes") > 0)
    exact = F.struct(F.concat(F.lit("s"), valid_sha256("sha256")).alias("digest"), F.lit(NO_LENGTH).cast("long").alias("length"), F.lit("").alias("ext"))
    near = F.struct(F.concat(F.lit("q"), valid_quick_hash("quick_hash")).alias("digest"), F.col("size_bytes").alias("length"), ext_key("ext").alias("ext"))
    rows = take(rows, "file_id", "sha256", "quick_hash", "size_bytes", "ext", "state").where(taking & F.col("file_id").isNotNull())
    return rows.select("file_id", F.explode(F.array(exact, near)).alias("t")).select("file_id", "t.*").where(F.col("digest").isNotNull())


def _first(rows: DataFrame, keys: list[str], c: str = "file_id") -> DataFrame:
    """The lowest id of each key, which is all that any later batch can ask for. Combined before the shuffle, so a hot key costs one row a task."""
    return rows.groupBy(*keys).agg(F.min(c).alias("first_id"))


def _near_tokens() -> list[Column]:
    return [F.col("digest"), F.concat(F.lit("z"), F.col("length").cast("string")), F.concat(F.lit("e"), F.col("ext"))]


def common_tokens(records: DataFrame) -> DataFrame:
    """token and df of the tokens that at least one in COMMON of the distinct near records has: at most 3 x COMMON, whatever there is."""
    near = records.where(F.col("length") != NO_LENGTH)
    counts = near.select(F.explode(F.array(*_near_tokens())).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = near.agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("df") * COMMON >= total.scalar())


def with_prefix(records: DataFrame, common: DataFrame | None) -> DataFrame:
    """Adds the prefix of each record, in the order of rarity.

    Sorted from rare to common, two sets of n tokens that share at least m have a token in common among their first n - m + 1. Here m = n, for exact
    and near alike, so the prefix is the one rarest token. Tokens that aren't common tie, then come digest, size, extension in turn; the order
    is the same for all records as long as `common` is.
    """
    none, near = F.lit(0).cast("long"), F.col("length") != NO_LENGTH
    dfs = [none] * 3
    if common is not None:
        for k, token in enumerate(_near_tokens()):
            own = F.broadcast(common.select(F.col("token").alias(f"_t{k}"), F.col("df").alias(f"_df{k}")))
            records = records.withColumn(f"_t{k}", F.when(near, token)).join(own, f"_t{k}", "left").drop(f"_t{k}")
        dfs = [F.coalesce(f"_df{k}", none) for k in range(3)]
    ranked = F.array_min(F.array(*(F.struct(df.alias("df"), F.lit(k).alias("k"), t.alias("t")) for k, (df, t) in enumerate(zip(dfs, _near_tokens())))))
    return records.withColumn("token", F.when(near, ranked["t"]).otherwise(F.col("digest"))).drop("_df0", "_df1", "_df2")


class HistoryIndex:
    """Inverted index of rare-token prefixes over everything accepted, in segments below a shared folder.

    Every segment is bucketed by token and length and sorted in its buckets, so a probe shuffles the batch's keys alone and reads the index where it
    lies; it has more buckets the more postings it has. An append writes one segment; as soon as MERGED segments are of one tier of size, they are merged into
    one, so a posting is written anew a logarithmic number of times and there are few segments. Which tokens are common is
    counted at the first append, and anew when there are GROWTH times as many postings; then all segments are
    written in the new order at once. With the path of an index that is there already, it goes on from its segments.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, merged: int = MERGED, least_rows: int = LEAST_ROWS):
        self.spark, self.merged, self.least_rows = spark, merged, least_rows
        self.path = (path or shared_path(spark, "history")).rstrip("/")
        self.state = read_json(spark, f"{self.path}/INDEX.json") or {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "common": None, "ordered_at": 0, "segments": [], "gone": []}
        for s in self.state["segments"]:
            if not spark.catalog.tableExists(s["name"]):
                by = ", ".join(FOUND_BY)
                spark.sql(
                    f"CREATE TABLE {s['name']} (token STRING, length BIGINT, digest STRING, ext STRING, first_id BIGINT) USING parquet "
                    f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {s['buckets']} BUCKETS LOCATION '{self.path}/{s['name']}'"
                )

    @property
    def segments(self) -> list[dict]:
        return self.state["segments"]

    def _common(self, path: str | None = None) -> DataFrame | None:
        path = path or self.state["common"]
        return path and self.spark.read.schema("token string, df long").parquet(path)

    def _turn(self) -> int:
        return max([0, *(s["turn"] for s in self.segments), *(g["turn"] for g in self.state["gone"])]) + 1

    def _write(self, postings: DataFrame, turn: int) -> dict:
        """A segment of postings with unique keys; each bucket is one file."""
        name = f"history_{uuid.uuid4().hex}"
        postings = settled(postings)
        rows = postings.count()
        buckets = max(self.state["buckets"], math.ceil(rows / BUCKET_ROWS))
        dealt = postings.select("token", "length", "digest", "ext", "first_id").repartition(buckets, *FOUND_BY)
        dealt.write.format("parquet").bucketBy(buckets, *FOUND_BY).sortBy(*FOUND_BY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return {"name": name, "rows": rows, "buckets": buckets, "turn": turn}

    def _read(self, segment: dict) -> DataFrame:
        """A segment's postings without those that a later retraction has replaced."""
        out = self.spark.table(segment["name"])
        for g in self.state["gone"]:
            if g["turn"] > segment["turn"]:
                out = out.join(self.spark.read.schema("token string, length long, digest string, ext string").parquet(g["path"]), KEY, "left_anti")
        return out

    def _switch(self, **changes) -> None:
        """From here on the index is in this state; a job that stops before leaves it as it was. Afterwards what no state needs is deleted."""
        new = self.state | changes
        write_json(self.spark, f"{self.path}/INDEX.json", new)
        old, self.state = self.state, new
        for s in old["segments"]:
            if s not in new["segments"]:
                self._delete(s)
        for g in old["gone"]:
            if g not in new["gone"]:
                delete_path(self.spark, g["path"])

    def _delete(self, segment: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {segment['name']}")
        delete_path(self.spark, f"{self.path}/{segment['name']}")

    def _merge(self) -> None:
        """Merges tiers that are full; counts rarity anew if the index has grown that far."""
        total = sum(s["rows"] for s in self.segments)
        if self.state["ordered_at"] and total >= GROWTH * max(self.state["ordered_at"], self.least_rows):
            return self._order()
        while True:
            tiers = defaultdict(list)
            for s in self.segments:
                tiers[int(math.log(max(s["rows"], self.least_rows) / self.least_rows, GROWTH))].append(s)
            full = next((t for t in tiers.values() if len(t) >= self.merged), None)
            if full is None:
                return None
            rest = [s for s in self.segments if s not in full]
            # replaced postings are gone from the merged segment; the rest may still have some
            one = self._write(_first(self._union(full), KEY, "first_id"), max(s["turn"] for s in full))
            self._switch(segments=[*rest, one], gone=[g for g in self.state["gone"] if any(s["turn"] < g["turn"] for s in rest)])

    def _union(self, segments: list[dict]) -> DataFrame:
        out = self._read(segments[0])
        for s in segments[1:]:
            out = out.unionByName(self._read(s))
        return out

    def _order(self) -> None:
        """All postings in one segment, under an order of rarity counted over them."""
        records = settled(_first(self._union(self.segments), RECORD, "first_id"))
        path = f"{self.path}/common-{uuid.uuid4().hex}"
        common_tokens(records).write.parquet(path)
        one = self._write(with_prefix(records, self._common(path)), self._turn())
        old = self.state["common"]
        self._switch(segments=[one], gone=[], common=path, ordered_at=max(1, one["rows"]))
        if old:
            delete_path(self.spark, old)

    def append(self, rows: DataFrame) -> None:
        """Adds the postings of accepted rows."""
        records, turn = settled(_first(_records(rows), RECORD)), self._turn()
        common, changes = self.state["common"], {}
        if common is None:
            common = f"{self.path}/common-{uuid.uuid4().hex}"
            common_tokens(records).write.parquet(common)
        one = self._write(with_prefix(records, self._common(common)), turn)
        if not self.state["ordered_at"]:
            changes = {"ordered_at": one["rows"]}
        self._switch(segments=[*self.segments, one], common=common if one["rows"] else self.state["common"], **changes)
        self._merge()

    def retract(self, rows: DataFrame, accepted: DataFrame) -> None:
        """Takes rows out again. accepted: what is left, at least all of it with a content of theirs.

        Only postings with a content of the rows are touched: older segments no longer give them, and the lowest id left of each, if there is one, is posted
        in a segment of its own. The rows must have been appended.
        """
        turn = self._turn()
        touched = settled(with_prefix(_records(rows).select(*RECORD).distinct(), self._common()))
        left = lookup_join(settled(_records(accepted)), touched, RECORD)
        one = self._write(_first(left, KEY), turn)
        path = f"{self.path}/gone-{uuid.uuid4().hex}"
        touched.select(*KEY).write.parquet(path)
        self._switch(segments=[*self.segments, one], gone=[*self.state["gone"], {"path": path, "turn": turn}])
        self._merge()

    def probe(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose content is already in the index or in an earlier row of the batch.

        Gives match_id, file_id, kind: exact if an earlier row has the same valid sha256, else near if one
        has the same valid quick_hash, size_bytes and ext; match_id is the lowest such file_id. Only active
        rows of size over 0 with an id take part. Everything in the index counts as earlier, rows of the batch
        by their file_id; the batch may hold several deliveries at once. An empty batch gives no rows.

        The prefixes of the batch's distinct records meet each segment's postings by token, those of another length being left out in the same
        join; what is met is verified by the number of tokens in common. Going back to rows, hot records are broadcast.
        """
        records = settled(with_prefix(_records(batch), self._common()))
        own = settled(_first(records, KEY))
        found = own
        near = F.col("length") != NO_LENGTH
        shared = (F.col("digest") == F.col("_digest")).cast("int") + F.when(near, 1 + (F.col("ext") == F.col("_ext")).cast("int")).otherwise(0)
        for s in self.segments:
            posted = self._read(s).select(*FOUND_BY, F.col("digest").alias("_digest"), F.col("ext").alias("_ext"), F.col("first_id").alias("_seen"))
            met = own.select(*KEY).join(posted, FOUND_BY).where(shared >= F.when(near, 3).otherwise(1))
            found = found.unionByName(met.select(*KEY, F.col("_seen").alias("first_id")))
        hits = lookup_join(records, settled(_first(found, KEY, "first_id")), KEY).where(F.col("first_id") < F.col("file_id"))
        best = hits.groupBy("file_id").agg(
            F.min(F.when(~near, F.col("first_id"))).alias("exact_id"), F.min(F.when(near, F.col("first_id"))).alias("near_id")
        )
        kind = F.when(F.col("exact_id").isNotNull(), "exact").otherwise("near")
        return best.select(F.coalesce("exact_id", "near_id").alias("match_id"), "file_id", kind.alias("kind"))

    def deliver(self, batch: DataFrame) -> DataFrame:
        """Probes a batch, then appends it."""
        found = settled(self.probe(batch))
        self.append(batch)
        return found

    def drop(self) -> None:
        """Deletes the index, its tables and files."""
        for s in self.segments:
            self._delete(s)
        delete_path(self.spark, self.path)
        self.state = self.state | {"segments": [], "gone": [], "common": None, "ordered_at": 0}
