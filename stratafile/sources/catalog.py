"""The catalog on storage: parts of files and scans, and changes of files, which a small state lists."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.transitions import overlay
from ..schema import FILES, SCANS, migrated
from ..session import delete_path, read_json, settled, write_json

#: Changes are merged into the parts when there are more folders of them than this, or more changed rows than one in so many.
MOST_CHANGES, CHANGED_SHARE = 16, 4
_SCHEMAS = {"files": FILES, "scans": SCANS}
_ID = {"files": "file_id", "scans": "scan_run_id"}


class Catalog:
    """A folder of parts and changes, and a state that names those that count.

    A scan appends a part; digests, states and removals are written as changed rows, by file_id, of which the last counts; neither touches what is
    there, so what they write doesn't grow with the catalog. Readers lay the changes over the parts; when there are too many, they are merged. A job
    that stops leaves the state it began with. What a switch leaves unused is deleted at the next one, so a reader has until then.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> dict:
        return read_json(self.spark, f"{self.path}/CURRENT.json", {})

    def exists(self) -> bool:
        return bool(self._state())

    def _read(self, name: str, places: list[str], extra: str = "", schema: T.StructType | None = None) -> DataFrame:
        kinds = T.StructType([*(schema or _SCHEMAS[name]), *(T.StructType.fromDDL(extra) if extra else [])])
        return self.spark.read.schema(kinds).parquet(*(f"{self.path}/{p}" for p in places))

    def _table(self, name: str) -> DataFrame:
        own = self._state().get(name)
        if not own:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        schema = T.StructType.fromJson(json.loads(own["schema"]))
        rows = self._read(name, own["parts"], schema=schema)
        if not own["changes"]:
            return rows
        changed = self._read(name, [c["place"] for c in own["changes"]], "_gone boolean, _turn long", schema)
        key = _ID[name]
        last = changed.groupBy(key).agg(F.max_by(F.struct(*(c for c in changed.columns if c != key)), "_turn").alias("r"))
        last = last.select(*(F.col(key) if c == key else F.col(f"r.`{c}`").alias(c) for c in rows.columns), F.col("r._gone").alias("_gone"))
        return overlay(rows, last.where(~F.col("_gone")).drop("_gone"), changed.select(key).distinct(), key)

    def files(self) -> DataFrame:
        return self._table("files")

    def scans(self) -> DataFrame:
        return self._table("scans")

    def _put(self, df: DataFrame, kind: str) -> str:
        place = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{place}")
        return place

    def _switch(self, state: dict, unused: list[str]) -> None:
        earlier = state.get("unused", [])
        write_json(self.spark, f"{self.path}/CURRENT.json", state | {"unused": unused})
        for place in earlier:
            delete_path(self.spark, f"{self.path}/{place}")

    def write(self, **tables: DataFrame) -> None:
        """Writes the given tables anew, as one part each, then switches to them together."""
        state, unused = self._state(), []
        for name, df in tables.items():
            df = migrated(df, _SCHEMAS[name])
            old = state.get(name, {"parts": [], "changes": []})
            unused += [*old["parts"], *(c["place"] for c in old["changes"])]
            place = self._put(df, name)
            rows = self.spark.read.parquet(f"{self.path}/{place}").agg(F.count(F.lit(1)), F.max(_ID[name])).first()
            state |= {name: {"schema": df.schema.json(), "parts": [place], "changes": [], "rows": rows[0], "last": max(rows[1] or 0, old.get("last", 0))}}
        self._switch(state, unused)

    def append(self, **tables: DataFrame) -> None:
        """Adds rows with new ids as parts of their own, then switches to them together."""
        state = self._state()
        for name, df in tables.items():
            own = state.get(name) or {"schema": _SCHEMAS[name].json(), "parts": [], "changes": [], "rows": 0, "last": 0}
            place = self._put(migrated(df, _SCHEMAS[name]), name)
            rows = self._read(name, [place]).agg(F.count(F.lit(1)), F.max(_ID[name])).first()
            state |= {name: own | {"parts": [*own["parts"], place], "rows": own["rows"] + rows[0], "last": max(own["last"], rows[1] or 0)}}
        self._switch(state, [])

    def change(self, rows: DataFrame, gone: bool = False) -> None:
        """Replaces files by the given rows with the same file_id, or with gone removes the files with these ids. Each file_id once."""
        state = self._state()
        own = state["files"]
        turn = max([0, *(c["turn"] for c in own["changes"])]) + 1
        schema = T.StructType.fromJson(json.loads(own["schema"]))
        rows = migrated(rows.select("file_id") if gone else rows, schema).select(*schema.names, F.lit(gone).alias("_gone"), F.lit(turn).cast("long").alias("_turn"))
        place = self._put(rows, "changes")
        n = self._read("files", [place]).count()
        state |= {"files": own | {"changes": [*own["changes"], {"place": place, "turn": turn, "rows": n}]}}
        self._switch(state, [])
        changes = state["files"]["changes"]
        if len(changes) > MOST_CHANGES or sum(c["rows"] for c in changes) * CHANGED_SHARE > own["rows"]:
            self.write(files=self.files())

    def remove(self, ids: DataFrame) -> None:
        """Removes the files with these ids."""
        self.change(settled(ids.select("file_id").distinct()), gone=True)

    def next_ids(self) -> tuple[int, int]:
        """The next scan_run_id and file_id, from the state alone; ids of removed files aren't given again."""
        state = self._state()
        return tuple(state.get(name, {}).get("last", 0) + 1 for name in ("scans", "files"))


def export_parquet(catalog: Catalog, out: str) -> None:
    """Writes both tables as files.parquet and scans.parquet below a folder, replacing what is there. Without a catalog: FileNotFoundError."""
    if not catalog.exists():
        raise FileNotFoundError(f"there is no catalog at {catalog.path}")
    catalog.files().write.mode("overwrite").parquet(f"{out.rstrip('/')}/files.parquet")
    catalog.scans().write.mode("overwrite").parquet(f"{out.rstrip('/')}/scans.parquet")
