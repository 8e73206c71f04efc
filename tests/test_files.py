"""Detectors, archives, scans, matching, plans, execution, command line, streaming."""

import hashlib
import os
import shutil
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise import cli
from shelfwise.config import FileOutput
from shelfwise.operators import headers as H
from shelfwise.operators import matching as M
from shelfwise.operators.filters import patterns_of
from shelfwise.plans.execute import run_plan
from shelfwise.plans.files import plan_files
from shelfwise.sources import archives as A
from shelfwise.sources.config import load_app_config, load_patterns, load_regions
from shelfwise.sources.files import list_files, scan, schedule
from shelfwise.streaming.completeness import complete_as_seen
from shelfwise.streaming.files import scan_stream

KINDS = ["zip", "tar", "tar.bz2", "tar.gz", "tar.xz", "tar.lzma", *["tar.lz4"] * bool(shutil.which("lz4")), *["7z"] * bool(shutil.which("bsdtar"))]


def payload(n: int, seed: int = 0) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def test_detectors():
    body = payload(64)
    nes = b"NES\x1a" + bytes(12) + body
    assert H.strip_header(nes, [H.load_detector("nes.xml")]) == (body, None)
    assert H.strip_header(body, [H.load_detector("nes.xml")]) == (body, None)
    z64 = bytes.fromhex("37804012") + body
    assert H.strip_header(z64, [H.load_detector("n64.xml")])[0][:4] == bytes.fromhex("80371240")
    rule = H.parse_detector(b'\xef\xbb\xbf<detector><name>x</name><rule start_offset="-4" end_offset="EOF" operation="bitswap"><file size="PO2"/><and offset="0" mask="0F" value="01"/></rule></detector>').rules[0]
    data = bytes([0xF1]) + bytes(11) + bytes([1, 2, 4, 128])
    assert rule.holds(data) and rule.apply(data) == bytes([128, 64, 32, 1]) and not rule.holds(data + b"x")
    assert H.Rule(operation="wordbyteswap").apply(bytes([1, 2, 3, 4])) == bytes([3, 4, 1, 2])
    assert not H.DataTest(100, b"x", False).holds(b"abc", 3)
    with pytest.raises(H.RuleError):
        H.Rule(operation="wordswap").apply(b"abc")
    with pytest.raises(H.RuleError):
        H.DataTest(0, b"ab", kind="xor", mask=b"a").holds(b"abc", 3)


@pytest.mark.parametrize("rules,want", [
    ([], (8192, 8192, False)), ([H.Rule()], (8192, 8192, True)), ([H.Rule(128)], (8192, 8320, True)),
    ([H.Rule(128, tests=(H.DataTest(32768 - 4, b"abcd"),))], (8192, 8320, True)), ([H.Rule(128, tests=(H.DataTest(32768, b"abcd"),))], (8192, 8320, False)),
    ([H.Rule(128, operation="byteswap")], (8192, 8320, False)), ([H.Rule(256, -512)], (8192, 8960, True)),
])
def test_scan_bounds(rules, want):
    assert H.scan_bounds((8192, 8192), [H.Detector("d", tuple(rules))] if rules else []) == want


@pytest.mark.parametrize("kind", KINDS)
def test_archives(kind):
    items = [A.Entry("d/a.bin", payload(1000, 1), 1.5e9), A.Entry("c\\d.bin", payload(70000, 2), 1.5e9), A.Entry("z.txt", b"", 1.5e9)]
    data = A.write_archive(kind, items)
    got = list(A.read_archive(kind, data))
    assert [(e.name, e.data) for e in got] == [("d/a.bin", items[0].data), ("c/d.bin", items[1].data), ("z.txt", b"")]
    assert [e.name for e in A.read_archive(kind, data, ["c\\d.bin", "d/a.bin"])] == ["d/a.bin", "c/d.bin"]
    with pytest.raises(KeyError):
        list(A.read_archive(kind, data, ["none"]))
    with pytest.raises(A.Unsupported):
        A.write_archive("rar", items)


def test_zip_times():
    items = [A.Entry("a", b"1", 1.6e9, 1.7e9), A.Entry("b", b"2", 5e9, None, 1.5e9), A.Entry("c", b"3", 1.6e9 + 0.25), A.Entry("d", b"4")]
    got = list(A.entries("zip", A.write_archive("zip", items)))
    assert [(e.mtime, e.atime, e.ctime) for e in got[:3]] == [(1.6e9, 1.7e9, None), (5e9, None, 1.5e9), (1.6e9 + 0.25, None, None)]
    assert A.unix_time(A.windows_time(0)) == 0 and A.windows_time(0) == 116444736000000000


def test_tools():
    t = A.Tools("/x/unrar", "/x/7z")
    assert t.command("rar", "a", "d")[0] == "/x/unrar" and t.command("7z", "a", "d")[0] == "/x/7z"
    assert A.Tools("/x/unrar", "/x/7z", force_seven_zip=True).command("rar", "a", "d")[0] == "/x/7z"
    assert A.Tools("/x/unrar", "/x/7z", True, True).command("rar", "a", "d") is None


def test_raw_zip():
    data = A.write_archive("zip", [A.Entry("a", b"x" * 1000), A.Entry("b", payload(500))])
    assert [(e.name, e.data) for e in A.entries("zip", A.raw_zip_copy(data, ["b"]))] == [("b", payload(500))]


@pytest.fixture
def collection(tmp_path):
    """Loose files, archives, a headered file and a broken archive."""
    files = {f"f{i}.bin": payload(1000 + i, i) for i in range(6)}
    base = tmp_path / "in"
    (base / "sub").mkdir(parents=True)
    for n in ("f0.bin", "f1.bin"):
        (base / "sub" / n).write_bytes(files[n])
    (base / "f2.nes").write_bytes(b"NES\x1a" + bytes(12) + files["f2.bin"])
    (base / "x.zip").write_bytes(A.write_archive("zip", [A.Entry(n, files[n]) for n in ("f3.bin", "f4.bin")]))
    (base / "y.tar.gz").write_bytes(A.write_archive("tar.gz", [A.Entry("in/f5.bin", files["f5.bin"])]))
    (base / "broken.zip").write_bytes(b"PK no zip")
    return base, files


def test_scan(spark, collection):
    base, files = collection
    rows = scan(list_files(spark, [str(base)]), detectors=[H.load_detector("nes.xml")]).collect()
    assert {r["sha1"] for r in rows if r["status"] == "OK"} == {hashlib.sha1(b).hexdigest() for b in files.values()}
    assert [(r["status"], r["archive_type"]) for r in rows if "broken" in r["path"]] == [("FAILED", None)]
    plain = scan(list_files(spark, [str(base)])).where("archive_type is null and path like '%f0.bin'").first()
    assert (plain["md5"], plain["size"], plain["crc"]) == (hashlib.md5(files["f0.bin"]).hexdigest(), 1000, f"{__import__('zlib').crc32(files['f0.bin']):08x}")
    big = scan(list_files(spark, [str(base)]), detectors=[H.load_detector("nes.xml")], large=10).where("archive_type is null and status = 'OK'").collect()
    assert {r["sha1"] for r in big} == {hashlib.sha1(files[f"f{i}.bin"]).hexdigest() for i in range(3)}
    few = scan(list_files(spark, [str(base)]), (1001, 1003)).collect()
    assert sorted(r["size"] for r in few) == [1001, 1003]


def test_scan_of_any_size(spark, collection):
    """Pieces of one byte, of a few, and whole contents give the same rows, with rules that fail and rules that swap too."""
    base, files = collection
    detectors = [H.Detector("no", (H.Rule(900, 100),)), H.load_detector("nes.xml"), H.Detector("swap", (H.Rule(operation="byteswap", tests=(H.FileTest(1004),)), H.Rule(operation="wordswap", tests=(H.FileTest(1003),)), H.Rule(-8, operation="bitswap", tests=(H.FileTest(1001),))))]
    for own in ([], detectors):
        rows = [sorted(map(str, scan(list_files(spark, [str(base)]), detectors=own, large=n).collect())) for n in (1, 7, 1 << 20)]
        assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 7
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(base))
        assert sorted(map(str, scan(held, detectors=own, by_content=True).collect())) == rows[0]


def test_unreadable_files_are_rows(spark, tmp_path):
    listed = spark.createDataFrame([(f"file:{tmp_path}/gone.bin", 3), (f"file:{tmp_path}/gone.zip", 3), (f"file:{tmp_path}/a%20b.bin", 3)], "path string, length long")
    (tmp_path / "a b.bin").write_bytes(b"abc")
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["size"]) for r in scan(listed).collect()}
    assert got == {"gone.bin": ("FAILED", None), "gone.zip": ("FAILED", None), "a%20b.bin": ("OK", 3)}


NAMES = ["_a.bin", ".b.bin", "_sub/k.bin", ".h/m.bin", "x._COPYING_", "x#1.bin", "q?r.bin", "y%20z.bin", "p q.bin", "é.bin", "a*b.bin", "[c].bin", "{d,e}.bin", "f\\g.bin", "deep/er/h.bin", "i.zip"]


def test_listing_of_all_names(spark, tmp_path):
    """Every regular file, whatever its name; no link; what cannot be looked at is a row."""
    base = tmp_path / "in"
    for n in NAMES:
        (base / n).parent.mkdir(parents=True, exist_ok=True)
        (base / n).write_bytes(n.encode())
    (base / "empty").mkdir()
    os.symlink(base / "_a.bin", base / "link.bin")
    os.symlink(base / "_sub", base / "linked")
    os.symlink(base / "nowhere", base / "broken")
    listed = list_files(spark, [str(base), str(tmp_path / "gone")])
    rows = {r["path"]: (r["length"], r["message"]) for r in listed.collect()}
    assert {k: v for k, v in rows.items() if v[1] is None} == {f"file:{base}/{n}": (len(n.encode()), None) for n in NAMES}
    assert [v[1].split(":")[0] for k, v in rows.items() if v[1]] == ["FileNotFoundError"] and len(rows) == len(NAMES) + 1
    scanned = {r["path"]: (r["status"], r["size"], r["md5"]) for r in scan(listed).collect()}
    want = {f"file:{base}/{n}": ("OK", len(n.encode()), hashlib.md5(n.encode()).hexdigest()) for n in NAMES}
    want |= {f"file:{base}/i.zip": ("FAILED", 5, hashlib.md5(b"i.zip").hexdigest()), f"file:{tmp_path}/gone": ("FAILED", None, None)}
    assert scanned == want
    # one loaded source asked with and without a range
    assert (listed.where("length > 8").count(), listed.count()) == (sum(len(n.encode()) > 8 for n in NAMES), len(rows))


def test_listing_of_a_range(spark, tmp_path):
    for n, size in (("a", 3), ("b", 30), ("c.zip", 3), ("d.ZIP", 300)):
        (tmp_path / n).write_bytes(bytes(size))
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(list_files(spark, [str(tmp_path)], (10, 50))) == ["b", "c.zip", "d.ZIP"]
    assert names(list_files(spark, [str(tmp_path)], (10, 50), archives=False)) == ["b"]
    assert names(list_files(spark, [str(tmp_path), str(tmp_path / "gone")], (10, 50))) == ["b", "c.zip", "d.ZIP", "gone"]


def test_listing_over_partitions(spark, tmp_path, monkeypatch):
    """The driver stops going down at FOLDERS; what is below comes from the tasks."""
    from shelfwise.sources import listing

    want = set()
    for i in range(40):
        f = tmp_path / f"d{i % 5}" / f"e{i % 7}" / f"f{i}"
        f.mkdir(parents=True)
        (f / "x").write_bytes(b"1")
        want.add(str(f / "x"))
    for most in (1, 3, 20, 1000):
        monkeypatch.setattr(listing, "FOLDERS", most)
        reader = listing.ListingReader([f"file:{tmp_path}"], None, True)
        parts = reader.partitions()
        got = [p.as_py() for part in parts for batch in reader.read(part) for p in batch.column(0)]
        assert sorted(got) == sorted(f"file:{w}" for w in want)
        assert any(p.deep for p in parts) == (most < 1000)
    assert [b.num_rows for p in [listing.ListingReader([], None, True)] for part in p.partitions() for b in p.read(part)] == []


def test_names_are_no_urls(spark, tmp_path):
    from shelfwise.sources import storage

    assert storage.local("file:///a/x#1?%20") == "/a/x#1?%20" == storage.local("file:/a/x#1?%20") and storage.local("file://host/a") == "/a" and storage.local("hdfs://h/a") is None
    out = tmp_path / "out"
    plan = []
    for i in (1, 2, 3):
        (tmp_path / f"{i}#?.bin").write_bytes(b"%d" % i)
        plan.append(("copy", f"file:{tmp_path}/{i}#?.bin", None, f"file:{out}/Foo #{i}?%41", None, []))
    assert {r["status"] for r in run_plan(spark.createDataFrame(plan, SPEC)).collect()} == {"OK"}
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {f"Foo #{i}?%41": b"%d" % i for i in (1, 2, 3)}


def test_schedule(spark):
    """Bytes of the fullest task against the mean or the largest file; nothing lost, largest first, ties and nulls too."""
    import random

    rng = random.Random(2)
    for rows in ([(f"f{i}", int(rng.paretovariate(0.9) * 1000)) for i in range(1500)] + [("n", None), ("z", 0), ("z", 0)], [(f"e{i}", 100) for i in range(37)], [("one", 7)], [], [("n", None)] * 3):
        dealt = schedule(spark.createDataFrame(rows, "path string, length long").repartition(3), 8)
        got = dealt.withColumn("p", F.spark_partition_id()).collect()
        assert sorted((r["path"], r["length"] or -1) for r in got) == sorted((p, n or -1) for p, n in rows)
        loads = [sum(r["length"] or 0 for r in got if r["p"] == p) for p in range(8)]
        assert max(loads) <= max(1.2 * sum(loads) / 8, max((n or 0 for _, n in rows), default=0))
        for p in range(8):
            own = [r["length"] or 0 for r in got if r["p"] == p]
            assert own == sorted(own, reverse=True)


def test_entries_before_a_break_stay(spark, tmp_path):
    data = A.write_archive("tar", [A.Entry("a", payload(600)), A.Entry("b", payload(70_000))])
    (tmp_path / "x.tar").write_bytes(data[:40_000])
    rows = {(r["archive_path"], r["status"]) for r in scan(list_files(spark, [str(tmp_path)])).collect()}
    assert ("a", "OK") in rows and (None, "FAILED") in rows


SPEC = "kind string, from_path string, from_type string, to_path string, to_type string, entries array<struct<from_name:string,to_name:string>>"


def test_every_spec_of_an_archive_runs(spark, tmp_path):
    """Two games of one archive and one folder, an entry for two targets, and a spec with a missing entry."""
    (tmp_path / "x.tar.gz").write_bytes(A.write_archive("tar.gz", [A.Entry(f"e{i}", b"%d" % i) for i in range(4)]))
    src, out = str(tmp_path / "x.tar.gz"), str(tmp_path / "o")
    spec = lambda to, *names: ("extract", src, "tar.gz", to, None, [(n, f"{to}/{t}") for n, t in names])
    plan = spark.createDataFrame([spec(out, ("e0", "a")), spec(out, ("e1", "b"), ("e3", "c")), spec(out + "2", ("e0", "d"), ("none", "x")), spec(out, ("e0", "a"))], SPEC)
    got = sorted((r["to_path"], r["status"]) for r in run_plan(plan).collect())
    assert got == [(out, "OK"), (out, "OK"), (out + "2", "FAILED")]
    assert {p.relative_to(tmp_path).as_posix(): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file() and "x." not in p.name} == {"o/a": b"0", "o/b": b"1", "o/c": b"3", "o2/d": b"0"}


OWNED = SPEC + ", owner struct<dat_ord:int,game_ord:long>, refused string"


def test_one_target_is_written_once(spark, tmp_path):
    """Copies of different files to one target, games that share a target or an archive, and one game with two sources of a file."""
    for n in "abc":
        (tmp_path / n).write_bytes(n.encode())
    for k in (1, 2):
        (tmp_path / f"{k}.zip").write_bytes(A.write_archive("zip", [A.Entry("e", b"%d" % k), A.Entry("o", b"own %d" % k)]))
    t, copy = str(tmp_path / "o"), lambda src, to, owner=None, refused=None: ("copy", f"{tmp_path}/{src}", None, f"{tmp_path}/o/{to}", None, [], owner, refused)
    extract = lambda k, owner, *to: ("extract", f"{tmp_path}/{k}.zip", "zip", t, None, [(n, f"{t}/{x}") for n, x in to], owner, None)
    pack = lambda src, owner: ("compress", None, None, f"{t}/p.zip", "zip", [(f"{tmp_path}/{src}", src)], owner, None)
    plan = spark.createDataFrame([
        copy("a", "x"), copy("b", "x"), copy("c", "y"), copy("a", "z", (0, 2)), copy("b", "z", (0, 1)), copy("a", "../../out", (0, 1), "leads out"),
        extract(1, (0, 5), ("e", "m"), ("o", "n1")), extract(2, (0, 6), ("e", "m"), ("o", "n2")), copy("c", "w", (1, 0)), extract(1, (1, 0), ("e", "w")),
        pack("a", (0, 7)), pack("b", (0, 7)), pack("c", (0, 8)),
    ], OWNED)
    got = sorted((r["kind"], (r["from_path"] or "").rsplit("/", 1)[-1], r["to_path"].rsplit("/", 1)[-1], r["status"]) for r in run_plan(plan).collect())
    assert got == sorted([
        ("copy", "a", "x", "OK"), ("copy", "b", "x", "FAILED"), ("copy", "c", "y", "OK"), ("copy", "a", "z", "FAILED"), ("copy", "b", "z", "OK"), ("copy", "a", "out", "FAILED"),
        ("extract", "1.zip", "o", "OK"), ("extract", "2.zip", "o", "FAILED"), ("copy", "c", "w", "OK"), ("extract", "1.zip", "o", "OK"), ("compress", "", "p.zip", "OK"), ("compress", "", "p.zip", "OK"), ("compress", "", "p.zip", "FAILED"),
    ])
    files = {p.name: p.read_bytes() for p in (tmp_path / "o").iterdir()}
    assert {k: files[k] for k in ("x", "y", "z", "m", "n1", "n2")} == {"x": b"a", "y": b"c", "z": b"b", "m": b"1", "n1": b"own 1", "n2": b"own 2"}
    with zipfile.ZipFile(tmp_path / "o" / "p.zip") as z:
        assert sorted(z.namelist()) == ["a", "b"]
    assert not (tmp_path.parent / "out").exists()


@pytest.mark.parametrize("archive", [None, "zip"])
def test_names_that_lead_out_are_refused(spark, tmp_path, archive):
    games = [(0, k, name, [(rom, 1, None, None, f"s{k}", None, None)]) for k, (name, rom) in enumerate([("A", "../../a.bin"), ("..", "b.bin"), ("C", "c..bin"), ("D", "x\\..\\d.bin")])]
    best = spark.createDataFrame(games, ROM)
    (tmp_path / "src").write_bytes(b"1")
    chosen = spark.createDataFrame([(0, k, 0, roms[0][0], None, str(tmp_path / "src"), None) for _, k, _, roms in games], "dat_ord int, game_ord int, rom_ord int, rom_name string, archive_type string, path string, archive_path string")
    got = run_plan(plan_files(best, chosen, FileOutput(str(tmp_path / "o" / "p"), archive))).collect()
    assert sorted(r["status"] for r in got) == ["FAILED"] * 3 + ["OK"]
    assert [p.name for p in tmp_path.rglob("*") if p.is_file() and p.name != "src"] == ["C.zip" if archive else "c..bin"]


def test_cover_needs_every_file(spark):
    """An archive that holds one file twice and the other never covers nothing; with over 64 files none may be missing."""
    rows = [(0, 0, r, 2, f"e{e}", "zip", "twice", f"e{e}") for r, e in ((0, 0), (0, 1))] + [(0, 0, r, 2, f"e{r}", "zip", "both", f"e{r}") for r in (0, 1)]
    rows += [(0, 1, r, 70, f"e{r}", "zip", p, f"e{r}") for p, gone in (("all", None), ("most", 69)) for r in range(70) if r != gone] + [(0, 1, 5, 70, "more", "zip", "most", "more")] * 3
    packed = spark.createDataFrame(rows, "dat_ord int, game_ord int, rom_ord int, n_roms int, rom_name string, archive_type string, path string, archive_path string")
    assert {(r["game_ord"], r["path"]) for r in M.cover(packed).collect()} == {(0, "both"), (1, "all")}
    assert {r["game_ord"] for r in M.complete_games(packed.where("path <> 'all' or rom_ord <> 69")).collect()} == {0}


def test_progress(spark):
    from shelfwise.plans.progress import Progress

    p, lines = Progress(spark, "scan"), []
    with p.shown(lines.append, 0.01):
        spark.range(10).foreach(lambda _: p.add(1, 1024, 0))
    assert lines[-1].startswith("scan: 10 items, 10.00 KB, ") and lines[-1].endswith(" 0 failed")


def test_observed_figures_of_retried_tasks(tmp_path):
    """Tasks that fail once and run again: the result's own figures count every row once."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2, 4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from shelfwise.functions.tables import materialize
from shelfwise.plans.progress import Progress
from shelfwise.workers import ship
ship(spark)
p, lines = Progress(spark, "scan"), []
def run(frames):
    for pdf in frames:
        p.add(len(pdf), int(pdf["id"].sum()))
        yield pd.DataFrame({{"size": pdf["id"], "status": ["OK" if i % 5 else "FAILED" for i in pdf["id"]]}})
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2:
        raise ValueError("once")
with p.shown(lines.append):
    out = materialize(p.observed(spark.range(100).repartition(4).mapInPandas(run, "size long, status string"), "size"), "out")
print("FIGURES", p.figures(), out.count(), lines[-1].split("/s")[0].split(",")[0], lines[-1].split(", ")[-1])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "FIGURES (100, 4950, 20) 100 scan: 100 items 20 failed" in out.stdout, out.stdout + out.stderr[-2000:]


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace as N

    from shelfwise.functions.tables import shared_dir

    cluster = N(conf=N(get=lambda k, d=None: None), sparkContext=N(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


ROM = "dat_ord int, game_ord int, name string, rom array<struct<name:string,size:bigint,crc:string,md5:string,sha1:string,sha256:string,status:string>>"
SCAN = "archive_type string, path string, archive_path string, unheadered_size long, crc string, md5 string, sha1 string, sha256 string"


def test_cascade_and_choice(spark):
    rom = lambda n, **k: (n, k.get("size"), k.get("crc"), k.get("md5"), k.get("sha1"), None, None)
    games = spark.createDataFrame([
        (0, 0, "by sha1", [rom("a", sha1="S1", md5="m9")]), (0, 1, "falls to md5", [rom("a", sha1="absent", md5="m2")]), (0, 2, "to crc", [rom("a", size=3, crc="C3")]),
        (0, 3, "no size", [rom("a", crc="c3")]), (0, 4, "half", [rom("a", sha1="s1"), rom("b", sha1="none")]), (0, 5, "empty", []), (0, 6, "packed", [rom("a", sha1="p1"), rom("b", sha1="p2")]),
        (0, 7, "mixed", [rom("a", sha1="s1"), rom("b", sha1="p2")]),
    ], ROM)
    scanned = spark.createDataFrame([
        (None, "l1", None, 3, "c1", "m1", "s1", None), (None, "l2", None, 3, "c2", "m2", "s2", None), (None, "l3", None, 3, "c3", None, None, None), ("zip", "z0", "e", 3, "c1", "m1", "s1", None),
        ("zip", "z1", "e1", 1, "c", "m", "p1", None), ("zip", "z1", "e2", 1, "d", "n", "p2", None), ("tar", "t1", "e1", 1, "c", "m", "p1", None),
    ], SCAN)
    matches = M.match_roms(M.rom_rows(games), scanned)
    first = {r["game_ord"]: r["path"] for r in M.match_order(matches).where("match_ord = 1 and rom_ord = 0").collect()}
    assert first == {0: "l1", 1: "l2", 2: "l3", 4: "l1", 6: "z1", 7: "l1"}
    assert sorted(r["game_ord"] for r in M.complete_games(matches).collect()) == [0, 1, 2, 6, 7]
    pick = lambda to: {(r["game_ord"], r["rom_ord"], r["path"], r["choice"]) for r in M.choose_sources(matches, to).collect()}
    assert {x for x in pick(True) if x[0] >= 6} == {(6, 0, "z1", "archive"), (6, 1, "z1", "archive")}
    assert {x for x in pick(False) if x[0] == 7} == {(7, 0, "l1", "mixed"), (7, 0, "z0", "mixed"), (7, 1, "z1", "mixed")}


def test_sources_without_all_matches(spark):
    """The factorised choice against the one from all matches, on files of few digests: hot ones, copies in one archive, gaps."""
    import random

    rng = random.Random(8)
    pick = lambda k: rng.choice(["hot"] * 3 + [f"k{i}" for i in range(k)])
    games = [(0, g, f"g{g}", [(f"r{i}", 1, None, None, pick(12), None, None) for i in range(rng.randint(1, 4))]) for g in range(60)]
    copies = [(kind, f"{kind or 'f'}{rng.randrange(25)}", None if kind is None else f"e{j}", 1, "c", None, pick(10).upper(), None) for j in range(160) for kind in [rng.choice([None, "zip", "tar"])]]
    roms, scanned = M.rom_rows(spark.createDataFrame(games, ROM)), spark.createDataFrame(copies, SCAN).cache()
    matches = M.match_roms(roms, scanned).cache()
    cols = ["game_ord", "rom_ord", "n_roms", "rom_name", "archive_type", "path", "archive_path"]
    rows = lambda df, *more: sorted(map(str, df.select(*cols, *more).collect()))
    assert rows(M.first_sources(roms, scanned)) == rows(M.first_matches(matches))
    for to_archive in (True, False):
        assert rows(M.choose(roms, scanned, to_archive), "choice") == rows(M.choose_sources(matches, to_archive), "choice")
    hot = spark.range(3000).select(F.lit(0).alias("dat_ord"), F.col("id").cast("int").alias("game_ord"), F.expr("array(named_struct('name', 'r', 'size', 0L, 'crc', 'c', 'md5', 'm', 'sha1', 's', 'sha256', 'x', 'status', ''))").alias("rom"))
    seen = spark.range(3000).select(F.lit("zip").alias("archive_type"), F.concat(F.lit("z"), F.col("id").cast("string")).alias("path"), F.lit("e").alias("archive_path"), F.lit(0).cast("long").alias("unheadered_size"), F.lit("c").alias("crc"), F.lit("m").alias("md5"), F.lit("s").alias("sha1"), F.lit("x").alias("sha256"))
    assert M.first_sources(M.rom_rows(hot), seen).agg(F.count("path"), F.min("path"), F.max("path")).first()[:] == (3000, "z0", "z0")


XML = """<datafile><header><name>S</name><description>S</description><version>1</version><author>a</author><clrmamepro header="nes.xml"/></header>
{games}</datafile>"""


def catalog(path, files, groups):
    parts = []
    for name, parent, roms in groups:
        clone = f' cloneof="{parent}"' if parent else ""
        body = "".join(f'<rom name="{r}" size="{len(files[r])}" sha1="{hashlib.sha1(files[r]).hexdigest().upper()}"/>' for r in roms)
        parts.append(f'<game name="{name}"{clone}><description>x</description>{body}</game>')
    path.write_text(XML.format(games="".join(parts)))
    return str(path)


def test_command_line(spark, collection, tmp_path, capsys):
    base, files = collection
    files = files | {"gone.bin": b"gone"}
    dat = catalog(tmp_path / "c.xml", files, [("A (USA)", None, ["f0.bin"]), ("A (Europe)", "A (USA)", ["gone.bin"]), ("B (Japan)", "A (USA)", ["f2.bin"]), ("C", None, ["f3.bin", "f4.bin"]), ("D", None, ["f5.bin"])])
    run = lambda *a: cli.run(spark, cli.parser().parse_args(["1g1r", dat, *a]))
    assert run("--sort-regions", "eur,usa") == 0 and capsys.readouterr().out.splitlines() == ["A (Europe)", "C", "D"]
    assert run("--sort-regions", "eur,jpn", "--in-dir", str(base)) == 0 and capsys.readouterr().out.splitlines() == ["B (Japan)", "C", "D"]
    assert run("--sort-regions", "usa", "--in-dir", str(base), "--out-dir", str(tmp_path / "o1"), "--alphabetic") == 0
    assert {p.relative_to(tmp_path / "o1").as_posix(): p.read_bytes() for p in (tmp_path / "o1").rglob("*") if p.is_file()} == {
        "a/f0.bin": files["f0.bin"], "c/C/f3.bin": files["f3.bin"], "c/C/f4.bin": files["f4.bin"], "d/f5.bin": files["f5.bin"]}
    assert run("--sort-regions", "usa", "--in-dir", str(base), "--out-dir", str(tmp_path / "o2"), "--archive", ".zip") == 0
    with zipfile.ZipFile(tmp_path / "o2" / "C" / "C.zip") as z:
        assert {n: z.read(n) for n in z.namelist()} == {k: files[k] for k in ("f3.bin", "f4.bin")}
    assert (tmp_path / "o2" / "A (USA).zip").exists() and (tmp_path / "o2" / "D.zip").exists()
    assert run("--out-file", str(tmp_path / "n" / "out.json"), "--out-mode", "JSON", "--exclude", "C") == 0 and '"S (1G1R)"' in (tmp_path / "n" / "out.json").read_text()
    with pytest.raises(cli.InvalidCatalog):
        run("--out-dir", "x")


def test_debug_report(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "BASE", tmp_path)
    (tmp_path / "region-data.yaml").write_text('regions:\n  - {code: MARS, pattern: "Mars"}\n')
    (tmp_path / "c.xml").write_text(XML.format(games='<game name="A (Mars) (En)"><release name="A" region="EUR" language="Fr"/></game><game name="B" cloneof="A (Mars) (En)"/>'))
    assert cli.run(spark, cli.parser().parse_args(["1g1r", str(tmp_path / "c.xml"), "--debug"])) == 0
    err = capsys.readouterr().err
    assert "regions ['MARS'] are not all among the provided ['EUR']" in err and "languages ['en'] are not all among the provided ['fr']" in err


def test_failed_specs_are_rows(spark, tmp_path):
    plan = spark.createDataFrame([("copy", str(tmp_path / "none"), None, str(tmp_path / "t"), None, [])], "kind string, from_path string, from_type string, to_path string, to_type string, entries array<struct<from_name:string,to_name:string>>")
    assert [r["status"] for r in run_plan(plan).collect()] == ["FAILED"]


def test_plan_of_nothing(spark):
    best = spark.createDataFrame([], ROM)
    chosen = spark.createDataFrame([], "dat_ord int, game_ord int, rom_ord int, rom_name string, archive_type string, path string, archive_path string, match_ord int")
    assert plan_files(best, chosen, FileOutput("o")).count() == 0


def test_configuration(tmp_path):
    (tmp_path / "r.yaml").write_text('regions:\n  - {code: ABC, pattern: "(?i)Abc", languages: [xx]}\n  - {code: D}\n')
    assert [(r.code, r.pattern, r.languages) for r in load_regions(tmp_path / "r.yaml")] == [("ABC", "(?i)Abc", ("xx",)), ("D", "a^", ())]
    assert len(load_regions(tmp_path / "none.yaml")) == 30
    (tmp_path / "p").write_text('{"strings": ["a.b"], "patterns": ["c.d"]}')
    assert load_patterns(tmp_path / "p") == patterns_of(["a.b"], ["c.d"])
    (tmp_path / "c.yaml").write_text('scanner:\n  threads: "3"\n  forceUnrar: true\ncopier:\n  allowRawZipCopy: true\n')
    c = load_app_config(tmp_path / "c.yaml")
    assert (c.scanner.threads, c.scanner.force_unrar, c.copier.allow_raw_zip_copy, c.scanner.buffer_size) == (3, True, True, 32768)


def test_stream(spark, collection):
    base, files = collection
    q = scan_stream(spark, str(base)).select("path", "sha1", "status").writeStream.format("memory").queryName("scans").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = spark.table("scans").where(F.col("status") == "OK").collect()
    finally:
        q.stop()
    assert {hashlib.sha1(files[k]).hexdigest() for k in ("f0.bin", "f3.bin", "f5.bin")} <= {r["sha1"] for r in got}


def test_stream_of_old_files(spark, tmp_path):
    base, done = tmp_path / "in", str(tmp_path / "checkpoint")
    base.mkdir()
    now = time.time()

    def run(name, days):
        """The names that come out once a file of this age has been added, in a run of its own of the same stream."""
        (base / name).write_bytes(name.encode())
        os.utime(base / name, (now - days * 86400,) * 2)
        rows = []
        q = scan_stream(spark, str(base)).select("path").writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", done).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return [r["path"].rsplit("/", 1)[1] for r in rows]

    assert [run(f"{d}.bin", d) for d in (0, 1, 3, 30, 9000)] == [["0.bin"], ["1.bin"], ["3.bin"], ["30.bin"], ["9000.bin"]]
    os.utime(base / "3.bin", (now - 3 * 86400,) * 2)
    assert run("1.bin", 1) == []


def test_stream_of_all_names(spark, tmp_path):
    """Names of every form, moved files and folders, rewritten files, and links, over runs of one stream."""
    base, out, done = tmp_path / "in", tmp_path / "out", str(tmp_path / "checkpoint")
    base.mkdir()

    def run():
        rows = []
        q = scan_stream(spark, str(base), (0, 30)).select("path", "size", "status").writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", done).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return {r["path"].removeprefix(f"file:{base}/"): (r["size"], r["status"]) for r in rows}

    assert run() == {}
    for n in NAMES:
        for root in (base, out):
            (root / n).parent.mkdir(parents=True, exist_ok=True)
            (root / n).write_bytes(n.encode())
    os.symlink(base / "_a.bin", base / "link.bin")
    os.symlink(base, base / "_sub" / "round")
    assert run() == {n: (len(n.encode()), "FAILED" if n.endswith(".zip") else "OK") for n in NAMES}
    assert run() == {}
    os.rename(out / "_a.bin", base / "moved")
    os.rename(out / "_sub", base / "moved folder")
    (base / ".b.bin").write_bytes(b"again")
    (base / "too large").write_bytes(b"x" * 31)
    os.chmod(base / "x#1.bin", 0o600)
    inside = {n.replace("_sub", "moved folder", 1): (len(n.encode()), "OK") for n in NAMES if n.startswith("_sub/")}
    assert inside and run() == {"moved": (6, "OK"), ".b.bin": (5, "OK")} | inside
    os.rename(base / "moved", out / "moved")
    assert run() == {}


def test_offsets_of_arrivals(tmp_path):
    """An offset stays while nothing changes; a listing up to it never has what changed later."""
    from shelfwise.sources import listing

    reader = listing.ArrivalReader(listing.ListingReader([f"file:{tmp_path}"], None, True))
    listed = lambda end: sorted(os.path.basename(x) for p in reader.partitions({}, end) for b in reader.read(p) for x in b.column("path").to_pylist())
    assert reader.latestOffset() == reader.initialOffset()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"1")
    first = reader.latestOffset()
    assert first == reader.latestOffset() != reader.initialOffset() and listed(first) == ["a"]
    time.sleep(0.05)
    (tmp_path / "b").write_bytes(b"2")
    os.utime(tmp_path / "b", (1, 1))
    second = reader.latestOffset()
    assert second != first and listed(first) == ["a"] and listed(second) == ["a", "b"]
    (tmp_path / "b").unlink()
    assert reader.latestOffset() == first


def test_completeness_as_files_arrive(spark, tmp_path):
    """After each batch the stream's games are those of all rows so far, each once; copies, late files and over 64 files of a game."""
    rom = lambda k: (f"r{k}", 1, None, None, f"s{k}", None, None)
    games = [(0, g, f"g{g}", [rom(g), rom(g + 1)]) for g in range(8)] + [(0, 8, "many", [rom(k) for k in range(70)]), (0, 9, "none", [])]
    roms = M.rom_rows(spark.createDataFrame(games, ROM)).cache()
    batches = [[0, 1, 1], [3, 3], [2, 0], [*range(3, 40)], [*range(40, 70)], [5, 69]]
    folder, found, so_far = tmp_path / "in", [], []
    folder.mkdir()
    rows = spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for k, batch in enumerate(batches):
        part = spark.createDataFrame([(None, f"p{k}-{i}", None, 1, None, None, f"S{i}", None) for i in batch] + [(None, "bad", None, None, None, None, None, None)], SCAN)
        part.coalesce(1).write.mode("append").parquet(str(folder))
        so_far += batch
        new = []
        q = complete_as_seen(rows, roms).writeStream.foreachBatch(lambda df, _: new.extend(r["game_ord"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        found += new
        seen = spark.createDataFrame([(None, "p", None, 1, None, None, f"s{i}", None) for i in so_far], SCAN)
        assert sorted(found) == sorted(r["game_ord"] for r in M.complete_games(M.match_levels(roms, seen)).collect())
    assert sorted(found) == list(range(9))
