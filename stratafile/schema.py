"""Schemas of the catalog and its settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCANS = T.StructType(
    [
        T.StructField("scan_run_id", T.LongType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("root_path", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("user", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("scan_run_id", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("path_abs", "dir", "name", "ext")),
        T.StructField("size_bytes", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("mtime_utc", "ctime_utc", "owner", "flags", "mime_hint", "quick_hash", "sha256")),
        T.StructField("is_pdf_born_digital", T.BooleanType()),
        *(T.StructField(c, T.StringType()) for c in ("state", "error_code", "error_msg", "last_seen_at", "h1", "h2", "blake3")),
    ]
)


def migrated(df: DataFrame, schema: T.StructType = FILES) -> DataFrame:
    """A snapshot of an older layout in the current one: missing columns are added as NULL, types are cast, extra columns kept at the end."""
    have = {c.lower(): c for c in df.columns}
    known = [(F.col(f"`{have[f.name]}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    extra = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {f.name for f in schema}]
    return df.select(*known, *extra)


@dataclass
class ScannerConfig:
    max_workers: int = 8
    io_chunk_bytes: int = 65_536


@dataclass
class DedupeConfig:
    enabled: bool = True
    max_workers: int = 8
    small_file_threshold: int = 131_072
    min_file_size: int = 262_144
    min_duplicate_count: int = 5
    quick_hash_bytes: int = 262_144
    sha_chunk_bytes: int = 2_097_152


@dataclass
class DBConfig:
    path: str = "data/catalog"
    journal_mode: str = "WAL"
    synchronous: str = "NORMAL"


@dataclass
class ExportConfig:
    parquet_dir: str = "data/parquet"
    schedule: str = "manual"


@dataclass
class CatalogConfig:
    """Settings; only roots is required. db.journal_mode, db.synchronous, dedupe.enabled and export.* are accepted and have no effect."""

    roots: list[str]
    include_ext: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    scanner: ScannerConfig = field(default_factory=ScannerConfig)
    dedupe: DedupeConfig = field(default_factory=DedupeConfig)
    db: DBConfig = field(default_factory=DBConfig)
    export: ExportConfig = field(default_factory=ExportConfig)

    @classmethod
    def of(cls, data: dict[str, Any]) -> CatalogConfig:
        if not isinstance(data, dict) or "roots" not in data:
            raise ValueError("the configuration needs roots")
        parts = {"scanner": ScannerConfig, "dedupe": DedupeConfig, "db": DBConfig, "export": ExportConfig}
        known = {f.name for f in fields(cls)}
        values = {}
        for key, value in data.items():
            if key in parts:
                names = {f.name for f in fields(parts[key])}
                values[key] = parts[key](**{k: v for k, v in (value or {}).items() if k in names})
            elif key in known:
                values[key] = value
        return cls(**values)

    def network_friendly(self, sample: int | None = None) -> tuple[int, int, int]:
        """Sizes of the quick hash, the read chunk and the sample under the profile for slow networks: at most 64, 256 and 64 KiB."""
        d = self.dedupe
        return min(d.quick_hash_bytes, 65_536), min(d.sha_chunk_bytes, 262_144), min(sample or 65_536, 65_536)

    def default_sample(self) -> int:
        return min(self.dedupe.quick_hash_bytes, 65_536)


def load_config(path: str) -> CatalogConfig:
    """Reads settings from a YAML file, or from JSON where no YAML library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ModuleNotFoundError:
        import json

        return CatalogConfig.of(json.loads(text))
    return CatalogConfig.of(yaml.safe_load(text))
