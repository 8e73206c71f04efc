"""Continuous scan of file collections: new files become scan rows, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.headers import EOF, Detector
from ..sources.files import scan
from ..sources.listing import arriving_files


def scan_stream(spark: SparkSession, folder: str, bounds: tuple[int, int] = (0, EOF), detectors: list[Detector] = ()) -> DataFrame:
    """A streaming DataFrame of the scan rows of all files below a folder, whatever their names and age, and of no links. A file
    counts once for each time of modification; what cannot be looked at is one FAILED row (see `arriving_files`)."""
    return scan(arriving_files(spark, [folder], bounds), bounds, detectors)
