"""Commands: scan, hash, dedupe, export and explore."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cascade, explorer, groups, keepers, status, transitions
from .schema import CatalogConfig, load_config
from .session import local_session, settled, workspace
from .sources.catalog import Catalog, export_parquet
from .sources.tree import scan_row, scan_tree


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or local_session("*")


def _catalog(config: CatalogConfig) -> Catalog:
    return Catalog(_session(), config.db.path)


def _needed(config: CatalogConfig) -> Catalog:
    catalog = _catalog(config)
    if not catalog.exists():
        raise SystemExit(f"there is no catalog at {catalog.path}; run a scan first")
    return catalog


def run_scan(args: argparse.Namespace) -> int:
    """Scans the configured roots, then those given, one run each; rows are appended and the run's rows become done."""
    config = load_config(args.config)
    catalog = _catalog(config)
    for root in [*config.roots, *(args.root or [])]:
        run, first = catalog.next_ids()
        found = transitions.finish_scan(scan_tree(catalog.spark, root, run, config.include_ext, config.exclude_paths, first), run)
        catalog.append(files=found, scans=scan_row(catalog.spark, root, run))
        print(f"{root}: {catalog.files().where(F.col('scan_run_id') == run).count():,} files in run {run}")
    return 0


def run_hash(args: argparse.Namespace) -> int:
    """Whole digests of every active file that has none."""
    config = load_config(args.config)
    if args.chunk_bytes:
        config.dedupe.sha_chunk_bytes = args.chunk_bytes
    catalog = _needed(config)
    changed, summary = cascade.hash_changes(catalog.files(), config, include=args.include_prefix or [], exclude=args.exclude_prefix or [], force=args.force, mirror=args.mirror_to_sha256)
    catalog.change(changed)
    print(summary.first().asDict())
    return 0


def _prune_metadata(catalog: Catalog, config: CatalogConfig, args: argparse.Namespace) -> None:
    d = config.dedupe
    gone = settled(keepers.metadata_prune(catalog.files(), catalog.scans(), d.min_file_size, d.min_duplicate_count, args.include_prefix or [], args.exclude_prefix or []))
    n = gone.count()
    if not n:
        print("No metadata duplicates; nothing to prune.")
        return
    catalog.remove(gone)
    print(f"Removed {n:,} catalog rows (kept the oldest of each group).")


def _delete(catalog: Catalog, args: argparse.Namespace) -> None:
    plan = settled(keepers.prune_plan(catalog.files(), catalog.scans(), "newest" if args.keep_newest else "oldest", args.include_prefix or [], args.exclude_prefix or []))
    stats = keepers.prune_stats(plan).first()
    print(f"Groups: {stats.hash_groups:,}; to remove: {stats.files_considered:,} files, {stats.potential_bytes / 1024**3:.2f} GB")
    if not stats.files_considered:
        print("Every group is down to one file already.")
        return
    if args.dry_run:
        print("Dry run; nothing was removed.")
        return
    if not args.no_confirm and input(f"Delete {stats.files_considered:,} files? [y/N]: ").strip().lower() != "y":
        print("Cancelled.")
        return
    done = settled(keepers.execute_plan(plan, dry_run=False))
    # what is gone from disk, before or now, leaves the catalog; what couldn't be removed stays
    catalog.remove(done.where(F.col("outcome").isin("removed", "missing")))
    print({r.outcome: r.n for r in done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()})


def run_dedupe(args: argparse.Namespace) -> int:
    config = load_config(args.config)
    catalog = _needed(config)
    include, exclude = args.include_prefix or [], args.exclude_prefix or []
    if args.metadata_prune:
        args.metadata_only = True
    if args.metadata_only and args.report_only:
        print("--metadata-only overrides --report-only; detecting.")
    detected = False
    if args.metadata_only:
        d = config.dedupe
        found = groups.metadata_groups(catalog.files(), d.min_file_size, d.min_duplicate_count, include, exclude)
        n = found.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("files")).first()
        print(f"Metadata groups: {n.groups:,} with {n.files:,} files")
        for r in found.orderBy(F.desc("cnt"), "size_bytes", "name_key").limit(10).collect():
            print(f"  {r.name_key} ({r.ext_key}): {r.cnt} copies of {r.size_bytes:,} bytes")
    elif not args.report_only:
        changed, summary = cascade.detect_changes(
            catalog.files(),
            config,
            quick_hash=not args.skip_quick_hash,
            sha256=not args.skip_sha256,
            network_friendly=args.network_friendly,
            progressive=args.progressive,
            sample_bytes=args.sample_bytes,
            use_blake3=args.blake3,
            include=include,
            exclude=exclude,
            progress=lambda *x: print(x[-1]),
        )
        catalog.change(changed)
        detected = True
        for key, value in summary.first().asDict().items():
            print(f"{key}: {value:,}")
    if args.metadata_prune:
        _prune_metadata(catalog, config, args)
    if args.delete_duplicates:
        if args.metadata_only:
            print("Nothing is deleted in metadata-only mode.")
            return 0
        if not detected:
            raise SystemExit("duplicates must be detected before --delete-duplicates")
        _delete(catalog, args)
    if (args.report or args.report_only) and not args.metadata_only:
        report = groups.duplicate_report(catalog.files(), args.report_limit, include, exclude).orderBy("rank", "mtime_utc", "path_abs")
        last = None
        for r in report.toLocalIterator():
            if r["rank"] != last:
                last = r["rank"]
                print(f"#{last}: {r.cnt} copies of {r.size_bytes:,} bytes, {r.total_wasted:,} wasted, {(r.sha256 or r.blake3)[:16]}")
            print(f"    {r.path_abs}  {r.mtime_utc}")
    return 0


def run_export(args: argparse.Namespace) -> int:
    config = load_config(args.config)
    export_parquet(Catalog(_session(), args.db or config.db.path), args.out)
    return 0


def run_explore(args: argparse.Namespace) -> int:
    """One page of the catalog, and its counts by state."""
    catalog = _needed(load_config(args.config))
    status.status_counts(catalog.files()).show()
    explorer.page(catalog.files(), args.page, args.page_size, args.search, args.state, args.sort, not args.descending).show(args.page_size, truncate=False)
    return 0


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stratafile", description=__doc__)
    commands = parser.add_subparsers(dest="command")

    def command(name: str, handler) -> argparse.ArgumentParser:
        p = commands.add_parser(name, description=handler.__doc__)
        p.add_argument("--config", default="config/catalog.yaml")
        p.set_defaults(handler=handler)
        return p

    def prefixes(p: argparse.ArgumentParser) -> None:
        p.add_argument("--include-prefix", action="append")
        p.add_argument("--exclude-prefix", action="append")
        p.add_argument("--max-workers", type=int, help="accepted; Spark decides on parallelism")
        p.add_argument("--io-bytes-per-sec", type=int, help="accepted; bound the number of tasks instead")

    p = command("scan", run_scan)
    p.add_argument("--max-workers", type=int, help="accepted; Spark decides on parallelism")
    p.add_argument("--root", action="append")
    p = command("hash", run_hash)
    prefixes(p)
    p.add_argument("--force", action="store_true")
    p.add_argument("--chunk-bytes", type=int)
    p.add_argument("--mirror-to-sha256", action="store_true")
    p = command("dedupe", run_dedupe)
    prefixes(p)
    for flag in ("network-friendly", "progressive", "blake3", "skip-quick-hash", "skip-sha256", "metadata-only", "metadata-prune", "report", "report-only", "delete-duplicates", "dry-run", "keep-newest", "no-confirm"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--sample-bytes", type=int)
    p.add_argument("--report-limit", type=int, default=100)
    p = command("export", run_export)
    p.add_argument("--db")
    p.add_argument("--out", default="data/parquet")
    p = command("gui", run_explore)
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--page-size", type=int, default=100)
    p.add_argument("--search", default="")
    p.add_argument("--state", default="All")
    p.add_argument("--sort", default="path_abs")
    p.add_argument("--descending", action="store_true")
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if not getattr(args, "handler", None):
        parser.print_help(sys.stderr)
        return 1
    with workspace(_session()):
        return args.handler(args)


if __name__ == "__main__":
    sys.exit(main())
