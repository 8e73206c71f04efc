"""Execution of file plans: one status row per spec; failures become rows and stop nothing."""

from __future__ import annotations

import os
import shutil
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import spread
from ..sources.archives import Entry, Tools, raw_zip_copy, read_archive, write_entries
from ..sources.storage import PIECE, local, modified, open_input, write_file
from .progress import Progress

RESULT = "kind string, from_path string, to_path string, status string, message string"


def _copy(spec: dict) -> None:
    when = modified(spec["from_path"])
    with open_input(spec["from_path"]) as f:
        write_file(spec["to_path"], lambda out: shutil.copyfileobj(f, out, PIECE), (when, when) if when else None)
    here, there = local(spec["from_path"]), local(spec["to_path"])
    if here and there:
        shutil.copystat(here, there)


def _extract(specs: list[dict], tools: Tools) -> list[str | None]:
    """The specs of one source archive, which is read once; per spec its error or None. An entry that several specs (or one
    of them twice) ask for is written to each target."""
    left, errors = [defaultdict(list) for _ in specs], [None] * len(specs)
    for want, s in zip(left, specs):
        for x in s["entries"]:
            want[x["from_name"].replace("\\", "/")].append(x["to_name"])
    first = specs[0]
    with open_input(first["from_path"]) as source:
        for e in read_archive(first["from_type"], source, None, tools):
            times, done, begun = ((e.atime or e.mtime, e.mtime) if e.mtime else None), None, []

            def write(out, e=e, begun=begun) -> None:
                if begun:
                    raise ValueError(f"{e.name} could not be read whole")  # an earlier target has used up the stream
                begun.append(True)
                out.writelines(e.pieces())

            for k, want in enumerate(left):
                for target in want.pop(e.name, ()):
                    try:
                        if done is None:
                            write_file(target, write, times)
                            done = target
                        else:
                            with open_input(done) as f:
                                write_file(target, lambda out, f=f: shutil.copyfileobj(f, out, PIECE), times)
                    except Exception as err:  # the other targets go on
                        errors[k] = f"{type(err).__name__}: {err}"
            if not any(left):
                break
    return [err or (f"KeyError: no such entries: {', '.join(sorted(want))}" if want else None) for err, want in zip(errors, left)]


def _entries(spec: dict, tools: Tools) -> Iterator[Entry]:
    if spec["kind"] == "compress":
        for x in spec["entries"]:
            with open_input(x["from_name"]) as f:
                size = f.seek(0, os.SEEK_END)
                f.seek(0)
                yield Entry(x["to_name"], None, modified(x["from_name"]), stream=f, size=size)
        return
    names = {x["from_name"].replace("\\", "/"): x["to_name"] for x in spec["entries"]}
    with open_input(spec["from_path"]) as source:
        for e in read_archive(spec["from_type"], source, list(names), tools):
            yield e.renamed(names[e.name])


def _pack(specs: list[dict], raw_zip: bool, tools: Tools) -> None:
    """All specs that write into one archive; of equal entry names the first counts. The archive appears whole or not at all."""
    first = specs[0]
    unchanged = all(x["from_name"] == x["to_name"] for s in specs for x in s["entries"])
    if raw_zip and len(specs) == 1 and (first["from_type"], first["to_type"]) == ("zip", "zip") and unchanged:
        with open_input(first["from_path"]) as f:
            return write_file(first["to_path"], lambda out: raw_zip_copy(f, [x["from_name"] for x in first["entries"]], out))

    def once() -> Iterator[Entry]:
        seen = set()
        for s in specs:
            for e in _entries(s, tools):
                if e.name not in seen:
                    seen.add(e.name)
                    yield e

    write_file(first["to_path"], lambda out: write_entries(first["to_type"], once(), out))


def perform(specs: list[dict], raw_zip: bool = False, tools: Tools = Tools()) -> list[str | None]:
    """Specs of one kind that share a source archive (extract) or a target (the other kinds); per spec its error or None."""
    try:
        if specs[0]["kind"] == "extract":
            return _extract(specs, tools)
        if specs[0]["kind"] == "copy":
            return [_copy(s) for s in specs]
        _pack(specs, raw_zip, tools)
        return [None] * len(specs)
    except Exception as e:  # reported, so that the other specs go on
        return [f"{type(e).__name__}: {e}"] * len(specs)


def _contested(specs: DataFrame) -> DataFrame:
    """_spec, _lost: the targets of a spec that another one writes. Of copies from different files to one target the first counts
    (by owner, then by source), and of the owners of a target the first; one owner may write a target from several archives, as
    these hold the same file."""
    targets = F.when(F.col("kind") == "extract", F.transform("entries", lambda x: x["to_name"])).otherwise(F.array("to_path"))
    rows = specs.select("_spec", "owner", "from_path", (F.col("kind") == "copy").alias("copy"), F.explode(targets).alias("target"))
    first = rows.groupBy("target").agg(F.min("owner").alias("_owner"), F.min(F.when(F.col("copy"), F.struct("owner", "from_path"))).alias("_copy"), F.min("owner").alias("lo"), F.max("owner").alias("hi"),
                                       F.min(F.when(F.col("copy"), F.col("from_path"))).alias("a"), F.max(F.when(F.col("copy"), F.col("from_path"))).alias("b"))
    first = first.where("lo <> hi or a <> b")
    lost = rows.join(first, "target").where((F.col("owner") != F.col("_owner")) | F.col("copy") & (F.struct("owner", "from_path") != F.col("_copy")))
    return lost.groupBy("_spec").agg(F.collect_set("target").alias("_lost"))  # no more than the spec's own targets


def run_plan(plan: DataFrame, raw_zip: bool = False, tools: Tools = Tools(), progress: Progress | None = None) -> DataFrame:
    """A status row for every distinct spec. Specs that write one archive meet in one task, as do those that read one, which
    is read once for all; every other spec is a task of its own.

    A target is written for one game only: specs of later games (column owner), and copies of other files to it, are FAILED and
    leave it alone; an extraction goes on with its other entries. Specs with a reason in column `refused` are FAILED and not
    run. Plans may lack both columns.
    """
    for c, kind in (("owner", "struct<dat_ord:int,game_ord:long>"), ("refused", "string")):
        plan = plan if c in plan.columns else plan.withColumn(c, F.lit(None).cast(kind))
    unique = plan.dropDuplicates(["kind", "from_path", "to_path", "to_type", "entries"])
    unique = unique.withColumn("_spec", F.xxhash64("kind", "from_path", "to_path", "to_type", "entries"))
    unique = unique.withColumn("owner", F.coalesce("owner", F.struct(*(F.lit(-1).cast(f.dataType).alias(f.name) for f in plan.schema["owner"].dataType))))
    unique = unique.join(_contested(unique.where("refused is null")), "_spec", "left").drop("_spec", "owner")
    key = F.when(F.col("to_type").isNotNull(), F.concat(F.lit("to|"), "to_path")).when(F.col("kind") == "extract", F.concat(F.lit("from|"), "from_path")).otherwise(F.concat_ws("|", "kind", "from_path", "to_path"))

    def statuses(specs: list[dict]) -> list[dict]:
        specs = [s | {"entries": list(s["entries"])} for s in specs]
        specs = [{k: None if isinstance(v, float) else v for k, v in s.items()} for s in specs]
        errors, able = [], []
        for s in specs:
            lost = set(s["_lost"]) if s["_lost"] is not None else set()
            errors.append(s["refused"] or (f"FileExistsError: written for another file: {', '.join(sorted(lost))}" if lost else None))
            if s["kind"] == "extract" and not s["refused"]:
                s["entries"] = [x for x in s["entries"] if x["to_name"] not in lost]
                able.append(bool(s["entries"]) or not lost)
            else:
                able.append(errors[-1] is None)
        todo = [s for s, ok in zip(specs, able) if ok]
        done = iter(perform(todo, raw_zip, tools) if todo else [])
        errors = ["; ".join(filter(None, (e, next(done) if ok else None))) or None for e, ok in zip(errors, able)]
        if progress:
            progress.add(len(specs), 0, sum(e is not None for e in errors))
        return [{"kind": s["kind"], "from_path": s["from_path"], "to_path": s["to_path"], "status": "OK" if e is None else "FAILED", "message": e} for s, e in zip(specs, errors)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for _, specs in groupby((s for pdf in frames for s in pdf.to_dict("records")), lambda s: s["_key"]):
            out += statuses(list(specs))
            if len(out) >= 1000:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)

    # specs of one key meet in one task, next to each other
    return spread(unique.withColumn("_key", key), "_key").sortWithinPartitions("_key").mapInPandas(run, RESULT)
