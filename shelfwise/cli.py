"""Command line: `python -m shelfwise.cli 1g1r CATALOG... [options]`."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import FileOutput, Filter, InvalidCatalog, PostFilter, Preference, allowed
from .functions.files import ByteSize, output_types
from .functions.tables import materialize, release, scratch
from .operators.derive import derive, divergence
from .operators.filters import built_in_excludes, patterns_of
from .operators.headers import load_detector
from .operators.matching import choose, rom_rows
from .plans.execute import run_plan
from .plans.files import plan_files
from .plans.progress import Progress
from .plans.render import MODES, rebuilt, rebuilt_header
from .plans.selection import ordered, select_best
from .plans.sink import show_file, write_catalog, write_names
from .sources.archives import Tools
from .sources.catalog import load_catalogs
from .sources.config import load_app_config, load_patterns, load_regions
from .sources.files import also_scanned, list_files, scan, schedule, size_bounds
from .sources.storage import PIECE
from .workers import ship

CLASSES = ("bad", "proto", "beta", "demo", "sample", "bios", "program", "chip", "pirate", "promo", "unlicensed", "dlc", "update")


def _words(upper: bool):
    return lambda text: tuple(w for x in text.split(",") if (w := x.strip().upper() if upper else x.strip().lower()))


def _archive(text: str) -> str:
    kind = text.lstrip(".")
    if kind not in output_types():
        raise argparse.ArgumentTypeError(f"{text!r} cannot be written; one of {', '.join(output_types())}")
    return kind


def _folder(text: str) -> str:
    if not Path(text).is_dir():
        raise argparse.ArgumentTypeError(f"{text!r} is no folder")
    return text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shelfwise")
    top.add_argument("--version", action="version", version=__version__)
    p = top.add_subparsers(dest="command", required=True).add_parser("1g1r", help="one entry of each family")
    p.add_argument("catalogs", nargs="+", help="a catalog that cannot be read whole is an error")
    p.add_argument("--in-dir", action="append", type=_folder, default=[])
    p.add_argument("--out-file")
    p.add_argument("--out-mode", type=str.lower, choices=MODES)
    p.add_argument("--out-dir")
    p.add_argument("--alphabetic", action="store_true")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--archive", type=_archive)
    one.add_argument("--force-subfolder", action="store_true")
    for k in ("include", "exclude", "sort"):
        p.add_argument(f"--{k}-regions", type=_words(True), default=())
        p.add_argument(f"--{k}-languages", type=_words(False), default=())
    for k in ("include", "exclude", "post-exclude", "prefer", "avoid"):
        p.add_argument(f"--{k}", action="append", default=[])
        p.add_argument(f"--{k}-regex", action="append", default=[])
        p.add_argument(f"--{k}s-file", action="append", default=[])
    for k in CLASSES:
        p.add_argument(f"--{k}", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--no-all", action="store_true")
    for k in ("prioritize-languages", "early-versions", "early-revisions", "early-prereleases", "prefer-prereleases", "prefer-parents", "copy-raw-zip", "debug"):
        p.add_argument(f"--{k}", action="store_true")
    for k in ("scan-threads", "copy-threads"):
        p.add_argument(f"--{k}", type=int, help="tasks; by default as Spark deals the files")
    for k in ("scan-buffer", "scan-max-buffer"):
        p.add_argument(f"--{k}", type=ByteSize.parse, help="content held at a time by a task (scan-max-buffer before scan-buffer)")
    p.add_argument("--copy-buffer", type=ByteSize.parse, help="accepted; copies go in fixed pieces")
    p.add_argument("--unrar-exec")
    p.add_argument("--7z-exec", dest="seven_zip_exec")
    force = p.add_mutually_exclusive_group()
    force.add_argument("--force-unrar", action="store_true")
    force.add_argument("--force-7z", dest="force_seven_zip", action="store_true")
    p.add_argument("--region-data")
    p.add_argument("--detectors")
    p.add_argument("--config")
    return top


#: Overrides of a user: region-data.yaml, config.yaml and a folder of detectors.
BASE = Path.home() / ".shelfwise"


def _own(given: str | None, name: str) -> str | None:
    """What was given on the command line, else the user's own file or folder if there is one."""
    return given or (str(BASE / name) if (BASE / name).exists() else None)


def report(parsed: DataFrame) -> DataFrame:
    """name, what, detected, provided: entries whose releases leave out regions or languages that their names have."""
    rows = [
        parsed.where(divergence(F.col(f"{kind}_detected"), F.col(f"{kind}_provided"))).select("name", F.lit(kind).alias("what"), F.col(f"{kind}_detected").alias("detected"), F.col(f"{kind}_provided").alias("provided"))
        for kind in ("regions", "languages")
    ]
    return rows[0].unionByName(rows[1])


def _patterns(a: argparse.Namespace, kind: str) -> tuple[str, ...]:
    files = (x for f in getattr(a, f"{kind}s_file") for x in load_patterns(f))
    return (*patterns_of(getattr(a, kind), getattr(a, f"{kind}_regex")), *files)


def options(a: argparse.Namespace) -> tuple[Filter, PostFilter, Preference]:
    may = {k: allowed(getattr(a, k), a.no_all) for k in CLASSES}
    f = Filter(
        a.include_regions, a.exclude_regions, a.include_languages, a.exclude_languages, may["bios"], may["proto"], may["beta"], may["demo"], may["sample"],
        (*_patterns(a, "exclude"), *built_in_excludes(may)), _patterns(a, "include"),
    )
    p = Preference(
        a.sort_regions, a.sort_languages, _patterns(a, "prefer"), _patterns(a, "avoid"), a.prioritize_languages, a.early_versions, a.early_revisions, a.early_prereleases, a.prefer_parents, a.prefer_prereleases,
    )
    return f, PostFilter(_patterns(a, "post_exclude")), p


def run(spark: SparkSession, a: argparse.Namespace, show=print) -> int:
    """0 if the selection was made, even if single files failed; InvalidCatalog for what the user must mend."""
    if a.out_dir and not a.in_dir:
        raise InvalidCatalog("an output folder needs an input folder")
    if a.out_dir and (a.out_file or a.out_mode):
        raise InvalidCatalog("choose either an output folder or text output")
    app = load_app_config(_own(a.config, "config.yaml"))
    raw_zip = a.copy_raw_zip or app.copier.allow_raw_zip_copy
    tools = Tools(a.unrar_exec or app.scanner.custom_unrar_path, a.seven_zip_exec or app.scanner.custom_seven_zip_path, a.force_unrar or app.scanner.force_unrar, a.force_seven_zip or app.scanner.force_seven_zip)
    docs, catalog = load_catalogs(spark, a.catalogs)
    f, post, p = options(a)
    regions = load_regions(_own(a.region_data, "region-data.yaml"))
    if a.debug:
        for r in report(derive(catalog, regions)).toLocalIterator():
            print(f"{r['name']}: {r['what']} {r['detected']} are not all among the provided {r['provided']}", file=sys.stderr)
    scanned = None
    if a.in_dir:
        names = [r[0] for r in catalog.select("detector").where("detector is not null").distinct().collect()]
        detectors = [load_detector(n, _own(a.detectors, "detectors")) for n in sorted(names)]
        roms = rom_rows(catalog)
        bounds = size_bounds(roms, detectors)
        threads, buffer = a.scan_threads or app.scanner.threads, a.scan_max_buffer or a.scan_buffer
        with Progress(spark, "scan").shown(_status) as seen:
            files = schedule(list_files(spark, a.in_dir, bounds), threads or 4 * spark.sparkContext.defaultParallelism)
            scanned = scan(files, bounds, detectors, also_scanned(roms), tools, int(buffer.in_bytes()) if buffer else PIECE, progress=seen)
            scanned = materialize(seen.observed(scanned, "size"), "scan")  # hashed once, though matching reads it several times
    text_catalog = a.out_mode is not None
    best = materialize(select_best(catalog, f, p, post, scanned, regions, text_catalog), "best")  # used more than once below
    if a.out_dir:
        out = FileOutput(a.out_dir, a.archive, a.alphabetic, a.force_subfolder)
        chosen = materialize(choose(rom_rows(best), scanned, out.archive_type is not None), "chosen")
        plan, threads = plan_files(best, chosen, out), a.copy_threads or app.copier.threads
        plan = plan.repartition(threads, "to_path") if threads else plan
        with Progress(spark, "copy").shown(_status) as copied:
            done = materialize(copied.observed(run_plan(plan, raw_zip, tools, copied)), "copied")  # once: reading the rows again must not copy again
        for r in done.where("status <> 'OK'").toLocalIterator():
            print(f"{r['from_path']} -> {r['to_path']}: {r['message']}", file=sys.stderr)
        return 0
    target = _absolute(a.out_file) if a.out_file else scratch(spark, "output")
    if text_catalog:
        first = docs.where("dat_ord = 0").select("header").first()
        write_catalog(rebuilt(best), target, a.out_mode, rebuilt_header(first["header"] if first else None))
    else:
        write_names(ordered(best), target)
    if not a.out_file:
        show_file(target, show)
    return 0


def _absolute(path: str) -> str:
    return path if "://" in path else str(Path(path).absolute())


def _status(line: str) -> None:
    """Progress goes to a terminal only."""
    if sys.stderr.isatty():
        print(f"\r{line}", end="", file=sys.stderr, flush=True)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("shelfwise").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    try:
        return run(spark, a)
    except InvalidCatalog as e:
        top.error(str(e))
    except Exception as e:
        if a.debug:
            raise
        print(f"failed: {e}", file=sys.stderr)
        return 1
    finally:
        release(spark)


if __name__ == "__main__":
    sys.exit(main())
