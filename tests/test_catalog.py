"""Names, filters, ranking, validity and rendering."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.config import Filter, InvalidCatalog, PostFilter, Preference, allowed
from shelfwise.functions import files as FF
from shelfwise.functions import names as N
from shelfwise.operators.derive import derive, divergence
from shelfwise.operators import patterns
from shelfwise.operators.filters import apply_filter, post_filter, validate
from shelfwise.operators.ranking import pick_best, rank, rank_by_ranges
from shelfwise.plans.render import MODES, catalog_text, name_list, rebuild, render
from shelfwise.plans.sink import text_rows, write_catalog, write_names
from shelfwise.plans.selection import select_best
from shelfwise.schema import GAME as GAME_SCHEMA
from shelfwise.sources import catalog
from shelfwise.sources.catalog import load_catalogs, read_catalog, read_documents

GAME = ("dat_ord int, game_ord int, name string, isbios string, cloneof string, romof string, release array<struct<name:string,region:string,language:string>>, "
        "rom array<struct<name:string,size:bigint,crc:string,md5:string,sha1:string,sha256:string,status:string>>, disk array<struct<name:string,status:string>>")  # fmt: skip


def table(spark, rows):
    """rows: (name, cloneof) or dicts; the place is the input order."""
    made = []
    for i, r in enumerate(rows):
        r = r if isinstance(r, dict) else dict(zip(("name", "cloneof"), r if isinstance(r, tuple) else (r,)))
        made.append((r.get("dat_ord", 0), i, r["name"], r.get("isbios"), r.get("cloneof"), r.get("romof"), r.get("release"), r.get("rom"), r.get("disk")))
    return spark.createDataFrame(made, GAME)


CASES = [
    ("A (World) (En)", "EUR,JPN,USA", "en", "", ""),
    ("A (Japan, USA)", "JPN,USA", "ja,en", "", ""),
    ("A (Europe) (Es,It+En)", "EUR", "es,it,en", "", ""),
    ("A (USA) (Rev 1)", "USA", "en", "1", ""),
    ("A (USA) (Rev 10)", "USA", "en", "16", ""),
    ("A (USA) (Rev B)", "USA", "en", "11", ""),
    ("A (USA) (Rev 1.2.)", "USA", "en", "1,2", ""),
    ("A (USA) (Rev 1..2)", "USA", "en", "1,0,2", ""),
    ("A (USA) (Rev gz)", "USA", "en", "1770", ""),
    ("A (Rev ..)", "", "", "", ""),
    ("A (v1.0, v2.0)", "", "", "", "1,0,2,0"),
    ("A (UK)", "", "uk", "", ""),
    ("A (Atlantis)", "", "", "", ""),
    ("A (Rev ffffffffffffffffffff)", "", "", None, ""),
    ("", "", "", "", ""),
]


def test_names(spark):
    rows = derive(table(spark, [c[0] for c in CASES])).orderBy("game_ord").collect()
    text = lambda x: ",".join(map(str, x))
    for case, r in zip(CASES, rows):
        assert text(r["regions"]) == case[1], case
        assert text(r["eff_languages"]) == case[2], case
        if case[3] is not None:
            assert text(r["revision"]) == case[3], case
        assert text(r["version"]) == case[4], case


def test_flags_and_releases(spark):
    rows = derive(table(spark, [
        "A (Proto)", "A (Beta 2)", "[BIOS] A [b]", ("B", "A"), {"name": "C", "romof": "A"}, {"name": "D", "isbios": "yes", "rom": [("x", 1, None, None, None, None, "baddump")]},
        {"name": "E (USA) (En)", "release": [("E", " jpn ", "Fr"), ("E", "XYZ", None), ("E", "", "")]},
    ])).orderBy("game_ord").collect()
    assert (rows[0]["proto"], rows[0]["is_prerelease"], rows[1]["beta"], rows[1]["proto"]) == ([0], True, [2], [])
    assert rows[2]["is_bios"] and rows[2]["is_bad"] and rows[2]["is_parent"]
    assert [r["parent_name"] for r in rows[3:5]] == ["A", "A"] and not rows[4]["is_parent"]
    assert rows[5]["is_bios"] and rows[5]["is_bad"]
    assert rows[6]["regions"] == ["USA", "JPN", "XYZ"] and rows[6]["languages"] == ["en", "fr"]


def test_divergence(spark):
    df = spark.createDataFrame([(["a"], ["b"]), (["a"], ["a", "b"]), (["a"], []), (["a"], ["a"])], "d array<string>, p array<string>")
    got = df.select(*(divergence(F.col("d"), F.col("p"), m) for m in ("ignore", "one_way", "two_way", "always"))).collect()
    assert [tuple(r) for r in got] == [(False, True, True, True), (False, False, True, True), (False, False, False, True), (False, False, False, False)]


def test_filters(spark):
    df = derive(table(spark, ["A (USA)", ("A (Europe) (Rev 1)", "A (USA)"), ("A (Japan) (Demo)", "A (USA)"), "B (Beta)", "Q.x"]))
    names = lambda f: sorted(r["name"] for r in apply_filter(df, f).collect())
    assert names(Filter(allow_demo=False, allow_beta=False)) == ["A (Europe) (Rev 1)", "A (USA)", "Q.x"]
    assert names(Filter(include_regions=("USA", "JPN"))) == ["A (Japan) (Demo)", "A (USA)"]
    assert names(Filter(exclude_languages=("en",))) == ["A (Japan) (Demo)", "B (Beta)", "Q.x"]
    assert names(Filter(excludes=(r"^A",), includes=(N.quote("(Rev 1)"),))) == ["A (Europe) (Rev 1)", "B (Beta)", "Q.x"]
    assert names(Filter(excludes=(N.quote("Q.x"),), include_languages=("en",))) == ["A (Europe) (Rev 1)", "A (USA)"]
    assert sorted(r["name"] for r in post_filter(df, PostFilter((r"Demo",))).collect()) == ["B (Beta)", "Q.x"]
    assert [allowed(x, n) for n in (False, True) for x in (None, True, False)] == [True, True, False, False, True, False]


def test_validity(spark):
    with pytest.raises(InvalidCatalog):
        validate(derive(table(spark, [])))
    with pytest.raises(InvalidCatalog):
        validate(derive(table(spark, ["A", "B"])))
    validate(derive(table(spark, ["A", ("B", "A")])))
    two = derive(table(spark, ["A", ("B", "A")])).withColumn("detector", F.col("name"))
    with pytest.raises(InvalidCatalog):
        validate(two, needs_one_detector=True)


@pytest.mark.parametrize("names,pref,first", [
    (["A (Europe)", "A (USA)"], Preference(regions=("USA", "EUR")), "A (USA)"),
    (["A (Europe)", "A (USA)"], Preference(), "A (Europe)"),
    (["A (USA)", "A (USA) (Rev 1)"], Preference(), "A (USA) (Rev 1)"),
    (["A (USA)", "A (USA) (Rev 1)"], Preference(early_revisions=True), "A (USA)"),
    (["A (USA) [b]", "A (Japan)"], Preference(regions=("USA",)), "A (Japan)"),
    (["A (Beta)", "A"], Preference(), "A"),
    (["A", "A (Beta)"], Preference(prefer_prereleases=True), "A (Beta)"),
    (["A (Proto)", "A (Sample)"], Preference(), "A (Sample)"),
    (["A (Sample)", "A (Proto)"], Preference(early_prereleases=True), "A (Proto)"),
    (["A (USA) (Fr)", "A (Japan) (En)"], Preference(regions=("USA", "JPN"), languages=("en", "fr")), "A (USA) (Fr)"),
    (["A (USA) (Fr)", "A (Japan) (En)"], Preference(regions=("USA", "JPN"), languages=("en", "fr"), prioritize_languages=True), "A (Japan) (En)"),
    (["A (En)", "A (En,Fr)"], Preference(), "A (En,Fr)"),
    (["A x", "A y"], Preference(prefers=("y",)), "A y"),
    (["A x", "A y"], Preference(avoids=("x",)), "A y"),
    (["A (v1.0)", "A (v1.1)"], Preference(), "A (v1.1)"),
    (["A (v1.0)", "A (v1.1)"], Preference(early_versions=True), "A (v1.0)"),
])
def test_ranking(spark, names, pref, first):
    df = derive(table(spark, [(n, "P") for n in names]))
    assert [r["name"] for r in pick_best(df, pref).collect()] == [first]


def test_parent_preference(spark):
    df = derive(table(spark, [("B (Rev 1)", "A"), "A"]))
    assert pick_best(df, Preference()).first()["name"] == "B (Rev 1)"
    assert pick_best(df, Preference(prefer_parents=True)).first()["name"] == "A"


def test_ranking_against_model(spark):
    """Random names against a plain Python sort of the default vector."""
    rng = random.Random(4)
    tags = ["(USA)", "(Europe)", "(Japan)", "(Rev 1)", "(Rev 2)", "(Beta)", "(Proto 2)", "(En,Fr)", "(v1.2)", "[b]"]
    rows = [(f"A {i} " + " ".join(rng.sample(tags, rng.randint(0, 4))), f"P{i % 7}") for i in range(140)]
    pref = Preference(regions=("EUR", "USA"), languages=("fr",))
    got = rank(derive(table(spark, rows)), pref).orderBy("parent_name", "rank").collect()

    def key(r):
        place = lambda xs, order: min((order.index(x) for x in xs if x in order), default=99)
        late = lambda xs: [tuple(-x for x in xs) + (1,)]  # noqa: E731  longer lists first
        langs = set(r["eff_languages"])
        return (r["is_bad"], place(r["regions"], pref.regions), place(r["eff_languages"], pref.languages), late(r["revision"]), late(r["version"]), r["is_prerelease"],
                late(r["sample"]), late(r["demo"]), late(r["beta"]), late(r["proto"]), -len(langs & {"fr"}), -len(langs), not r["is_parent"], r["game_ord"])

    for p in {r["parent_name"] for r in got}:
        own = [r for r in got if r["parent_name"] == p]
        assert own == sorted(own, key=key)


def test_ranks_by_ranges(spark):
    """One family of most rows, small ones and a null family, against the window."""
    rng = random.Random(9)
    rows = [(f"A {i % 50} " + rng.choice(["(USA)", "(Europe)", "(Rev 1)", "[b]", ""]), "huge" if i % 4 else f"P{i % 5}") for i in range(400)]
    df = derive(table(spark, rows)).withColumn("parent_name", F.when(F.col("parent_name") != "P4", F.col("parent_name"))).repartition(6)
    pref = Preference(regions=("EUR", "USA"))
    ranks = lambda r: sorted((x["game_ord"], x["rank"]) for x in r.select("game_ord", "rank").collect())
    ranked = rank_by_ranges(df, pref)
    assert ranks(ranked) == ranks(rank(df, pref)) and ranked.schema["rank"].dataType.simpleString() == "int"
    assert rank_by_ranges(df.limit(0), pref).count() == 0


def test_sizes_and_types(spark):
    shown = lambda n: spark.range(1).select(FF.format_size(F.lit(n)), FF.format_size(F.lit(n), True)).first()
    assert tuple(shown(1536)) == ("1.50 KB", "   1.50 KB") and shown(5)[0] == "5.00 B" and shown(1 << 40)[0] == "1.00 TB"
    texts = ["1.5 MB", "64k", "7", "2 x", "-1", "1.9999B", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(FF.parse_size(F.col("t"))).collect()
    assert [r[0] for r in got] == [1572864, 65536, 7, None, None, 2, None]
    assert str(FF.ByteSize.parse("2048 KB").normalized()) == "2.00 MB" and FF.ByteSize.parse("1KB") < FF.ByteSize.parse("1M")
    names = ["a.zip", "a.RAR", "a.7z", "a.tar.7z", "a.tar", "a.tbz", "a.tar.bz2", "a.taz", "a.tgz", "a.tar.lz4", "a.tar.lzma", "a.txz", "a.gz", "zip"]
    want = ["zip", "rar", "7z", None, "tar", "tar.bz2", "tar.bz2", "tar.gz", "tar.gz", "tar.lz4", "tar.lzma", "tar.xz", None, None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(FF.archive_type(F.col("n"))).collect()
    assert [r[0] for r in got] == want == [FF.archive_type_of(n) for n in names]


def test_times(spark):
    df = spark.sql("SELECT timestamp'2020-01-02 03:04:05.678901' AS t, timestamp'1970-01-01 00:00:00' AS z")
    r = df.select(FF.truncated_time(F.col("t"), "second").cast("string"), FF.truncated_time(F.col("t"), "millisecond").cast("string"), FF.windows_ticks(F.col("z")), (FF.from_windows_ticks(FF.windows_ticks(F.col("t"))) == F.col("t"))).first()
    assert tuple(r) == ("2020-01-02 03:04:05", "2020-01-02 03:04:05.678", 116444736000000000, True)


def test_bytes_as_text(spark):
    df = spark.createDataFrame([(b"\x4e\x45S\x1a",), (b"",)], "b binary")
    shown = [r[0] for r in df.select(FF.spaced_hex(F.col("b"))).collect()]
    assert shown == ["4E 45 53 1A", ""] and bytes(df.select(FF.from_spaced_hex(FF.spaced_hex(F.col("b")))).first()[0]) == b"NES\x1a"
    items = spark.createDataFrame([(" Ab , ,c,",)], "t string").select(FF.comma_list(F.col("t")), FF.joined_list(FF.comma_list(F.col("t")), True)).first()
    assert items[0] == ["ab", "c"] and items[1] == "Ab, C"


XML = """<?xml version="1.0"?>
<!DOCTYPE datafile PUBLIC "-//Logiqx//DTD ROM Management Datafile//EN" "http://www.logiqx.com/Dats/datafile.dtd">
<datafile>
  <header><name>Set</name><description>A set</description><version>1</version><author>x</author><clrmamepro header="nes.xml"/></header>
  <game name="A (USA)"><description>A (USA)</description><release name="A" region="USA"/><rom name="a.bin" size="4" crc="0e000002" sha1="AA"/></game>
  <game name="#B" cloneof="A (USA)" romof="A (USA)"><description>B</description><rom name="b1.bin" size="5"/><rom name="b2.bin" status="baddump"/></game>
  <game name="a c"><description>c</description></game>
</datafile>
"""


def test_catalog_round_trip(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    docs = read_documents(spark, [str(tmp_path / "a.xml")])
    games = read_catalog(spark, [str(tmp_path / "a.xml")])
    rows = games.orderBy("game_ord").collect()
    assert [r["name"] for r in rows] == ["A (USA)", "#B", "a c"] and rows[0]["rom"][0]["crc"] == "0e000002" and rows[0]["detector"] == "nes.xml" and rows[2]["rom"] == []
    best = select_best(games)
    assert name_list(best) == ["A (USA)", "a c"]  # the better child is a bad dump
    catalog = rebuild(games, docs.first()["header"])
    for mode in ("xml", "json", "yaml"):
        (tmp_path / f"b.{mode}").write_text(render(catalog, mode))
        again = read_catalog(spark, [str(tmp_path / f"b.{mode}")]).orderBy("game_ord").collect()
        assert [r["name"] for r in again] == ["#B", "A (USA)", "a c"], mode
        assert again[0]["cloneof"] is None and again[0]["romof"] == "A (USA)" and again[0]["rom"][1]["status"] == "baddump"
        assert read_documents(spark, [str(tmp_path / f"b.{mode}")]).first()["header"]["name"] == "Set (1G1R)"


def test_sink_writes_what_the_text_is(spark, tmp_path):
    """Parts of several tasks, empty ones among them, joined in order: the bytes of the text made in one place."""
    entry = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in GAME_SCHEMA) + ">"
    made = [tuple({"_name": f"g{i} <é>", "comment": ["a", "b\nc"] if i % 3 else None, "rom": [(f"r{i}", i, *[None] * 10)]}.get(f.name) for f in GAME_SCHEMA) for i in range(25)]
    header = {"name": "N & M", "clrmamepro": {"_header": "x.xml", "_forcepacking": "zip"}}
    for rows in (made, []):
        df = spark.createDataFrame([(i, g) for i, g in enumerate(rows)], f"i int, game {entry}").repartition(5).orderBy("i")
        for kind in MODES:
            for more in ({}, {"build": "7", "debug": "yes"}):
                write_catalog(df, str(tmp_path / "#1 out" / f"c.{kind}"), kind, header if more else None, **more)
                want = "".join(catalog_text(header if more else None, (r["game"].asDict(True) for r in df.collect()), kind, **more))
                assert (tmp_path / "#1 out" / f"c.{kind}").read_text() == want
        assert [p.name for p in (tmp_path / "#1 out").iterdir() if "parts" in p.name] == []
    names = spark.createDataFrame([("b",), ("é",), (None,), ("a",)], "name string").coalesce(1)
    write_names(names, str(tmp_path / "n.txt"))
    assert (tmp_path / "n.txt").read_text() == "b\né\n\na\n"
    assert [tuple(r) for r in text_rows(spark, str(tmp_path / "n.txt")).orderBy("line").collect()] == [(1, "b"), (2, "é"), (3, ""), (4, "a")]
    with pytest.raises(Exception, match="no such thing"):
        write_names(names.select(F.raise_error(F.concat(F.lit("no such thing"), "name")).alias("name")), str(tmp_path / "n.txt"))
    assert (tmp_path / "n.txt").read_text() == "b\né\n\na\n"  # an older file stays where a write fails


GAMES = [f'<game name="g{i}" cloneof="g0"><description>d &amp; {i}</description><rom name="r{i}" size="{i}" status="GOOD"/></game>' for i in range(120)]
HEAD = '<?xml version="1.0"?>\n<!DOCTYPE datafile PUBLIC "-//x//y" "http://x/y.dtd">\n<!-- made <game name="no"> by hand -->\n<datafile build="1" debug="No"><header><name>S</name><clrmamepro header="nes.xml" forcepacking="unzip"/></header>\n'


def write(tmp_path, body, name="c [1] #2.xml", encoding="utf-8"):
    (tmp_path / name).write_bytes(body.encode(encoding))
    return str(tmp_path / name)


def test_catalog_over_many_splits(spark, tmp_path):
    """Games of one document come from different tasks and keep their places."""
    path = write(tmp_path, HEAD + "\n".join(GAMES) + "\n</datafile>\n")
    for size in (None, 1500):
        rows = read_catalog(spark, [path], size).select("game_ord", "name", "split", "detector", F.col("rom")[0]["size"].alias("size"), F.col("rom")[0]["status"].alias("status"), "game.description").collect()
        assert sorted((r["game_ord"], r["name"], r["size"], r["description"]) for r in rows) == [(i, f"g{i}", i, f"d & {i}") for i in range(120)]
        assert {(r["detector"], r["status"]) for r in rows} == {("nes.xml", "good")} and (len({r["split"] for r in rows}) > 5) == (size == 1500)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in ("134217728b", "128MB", str(128 << 20))
    docs, two = load_catalogs(spark, [path, path], 3000)
    assert docs.count() == 2 and [(r["dat_ord"], r["n"]) for r in two.groupBy("dat_ord").agg(F.count("*").alias("n")).orderBy("dat_ord").collect()] == [(0, 120), (1, 120)]


def test_forms_of_catalogs(spark, tmp_path):
    """Comments and CDATA that hide games, ends of tags in other forms, games without content, other encodings, empty catalogs."""
    games = '<game name="a"><description>x</description></game >\n<game name="b"/><game name="c" ></game><!-- <game name="no"/> --> <game\nname="d"><game_id>1</game_id><description><![CDATA[<b> & -->]]></description></game><game name="e"/>'
    names = lambda path, size=None: [r["name"] for r in read_catalog(spark, [path], size).orderBy("game_ord").collect()]
    path = write(tmp_path, f"\ufeff<datafile>{games}</datafile >")
    assert names(path, 100) == ["a", "b", "c", "d", "e"] and read_catalog(spark, [path]).where("name = 'd'").first()["game"]["description"] == "<b> & -->"
    assert names(write(tmp_path, '<datafile><game name="a"></game><!-- <game name="no"></game> <game name="nor"></game> --><game name="b"></game></datafile>'), 20) == ["a", "b"]
    assert names(write(tmp_path, '<?xml version="1.0" encoding="ISO-8859-1"?><datafile><game name="\xe9"/></datafile>', encoding="latin-1")) == ["\xe9"]
    assert names(write(tmp_path, '<?xml version="1.0" encoding="UTF-16"?><datafile><game name="\u65e5"></game><game name="b"/></datafile>', encoding="utf-16")) == ["\u65e5", "b"]
    assert names(write(tmp_path, "<datafile/>")) == [] == names(write(tmp_path, "<datafile></datafile>\n\n"))


WRONG = {
    "a number": ('<game name="g"><rom name="r" size="0x5"/></game>', "game 121 .*size=\"0x5\""),
    "an attribute": ('<game name="g" foo="1"/>', "game 121 \\(g\\): unknown part game/foo"),
    "an element": ('<game name="g"><zzz/></game>', "unknown part game/zzz"),
    "an inner attribute": ('<game name="g"><rom name="r" sise="1"/></game>', "unknown part rom/sise"),
    "an element between games": ("<zzz/>", "unknown part"),
    "text between games": ('<game name="g"/> text', "unknown part"),
    "text in a game": ('<game name="g">text</game>', "unknown part game//text"),
    "a status": ('<game name="g"><rom name="r" status="fine"/></game>', "status='fine'"),
    "a flag": ('<game name="g" isbios="maybe"/>', "isbios='maybe'"),
    "no name": ("<game><description>x</description></game>", "game without name"),
    "a file without name": ('<game name="g"><rom size="1"/></game>', "rom without name"),
    "bytes": ('<game name="g"><rom name="r" header="4G"/></game>', "header='4G'"),
    "a tag": ('<game name="g"><rom name="r"></game>', "cannot be read"),
    "an entity": ('<game name="g &none;"/>', "cannot be read"),
}


def test_bad_parts(spark, tmp_path):
    """What is wrong with each part of one document, and the error that the first one gives."""
    parts = catalog._parsed_xml(spark, write(tmp_path, HEAD + "\n".join(GAMES) + "".join(b for b, _ in WRONG.values()) + '<game name="last"></game></datafile>'))
    got = [r["problem"] for r in parts.orderBy("block", "at").select("problem").where("problem is not null").collect()]
    want = [said.split(": ")[-1].split(".*")[-1] for _, said in WRONG.values()]
    assert len(got) == len(want) and all(re.search(w, g) for w, g in zip(want, got)), got
    for what in ("a number", "an attribute"):
        body, said = WRONG[what]
        with pytest.raises(InvalidCatalog, match=said):
            load_catalogs(spark, [write(tmp_path, HEAD + "\n".join(GAMES) + body + '<game name="last"></game></datafile>')], 3000)


def test_cut_catalogs_are_errors(spark, tmp_path):
    whole = HEAD + "\n".join(GAMES) + "</datafile>"
    ends = [whole[: whole.index("g50")], whole[: whole.index("</game>\n<game name=\"g51") + 7], whole[:-5], "", "no catalog", whole + "<game name='x'></game>", whole + whole, whole[: whole.index("</header>")], '<datafile debug="x"></datafile>', "<datafile x='1'></datafile>"]
    for k, end in enumerate(ends):
        with pytest.raises(InvalidCatalog):
            load_catalogs(spark, [write(tmp_path, end)], 4000 if k < 2 else None)
    for kind, text in (("json", '{"game": [{"_name": "a"}, {"_na'), ("json", '{"game": [{"_name": "a", "rom": [{"_name": "r", "_size": "0x5"}]}]}'), ("json", '{"game": [{"_isbios": "no"}]}'), ("json", ""), ("yaml", "game: [{"), ("yaml", "game:\n- {_name: a, _isbios: maybe}\n")):
        with pytest.raises(InvalidCatalog):
            load_catalogs(spark, [write(tmp_path, text, f"c.{kind}")])
    with pytest.raises(InvalidCatalog, match="none.xml"):
        load_catalogs(spark, [str(tmp_path / "none.xml")])
    good = write(tmp_path, whole, "good.xml")
    with pytest.raises(InvalidCatalog, match="bad.xml"):
        load_catalogs(spark, [good, write(tmp_path, whole[:-30], "bad.xml")])


def test_name_order_is_the_collators(spark):
    """Sort keys against the JVM's collator itself, over names of many characters."""
    import random

    rng = random.Random(3)
    chars = "abAB 01-_,.;:!?'\"(){}[]@*#%&+<=>|~$^`\u00e9\u00c9\u00e4\u00df\u00e6\u00f1\u0301\u2019\u20ac\u65e5\u0439 \t"
    names = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    collator = spark.sparkContext._jvm.java.text.Collator.getInstance()
    collator.setStrength(1)
    key = lambda n: (0, n[0], b"") if n[0] in "[{(#" else (1, "", bytes(collator.getCollationKey(n).toByteArray()))
    rows = spark.createDataFrame([(n, 0, i) for i, n in enumerate(names)], "name string, dat_ord int, game_ord int")
    assert name_list(rows) == sorted(names, key=key)


@pytest.mark.parametrize("locale", ["cs", "da", "es", "hr"])
def test_name_order_of_a_language(spark, locale):
    """Letters that are one element together, and elements of other languages, against the JVM's collator."""
    rng = random.Random(5)
    parts = ["ch", "Ch", "CH", "c", "h", "aa", "Aa", "a", "ll", "l", "dž", "lj", "nj", "č", "ñ", "å", "ø", "æ", "ß", " ", "-", "z", "Z", "日", "½", "é", "´"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    jvm = spark.sparkContext._jvm
    collator = jvm.java.text.Collator.getInstance(jvm.java.util.Locale.forLanguageTag(locale))
    collator.setStrength(1)
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int")
    got = [r["name"] for r in rows.orderBy(*N.name_order(F.col("name"), locale), "i").collect()]
    assert got == sorted(names, key=lambda n: bytes(collator.getCollationKey(n).toByteArray()))


def test_required_literals():
    want = {r"\QA.b\E": "a.b", r"(?i)\(Rev 1\)": "(rev 1)", "abc?def": "def", "ab+cd": "ab", "a|b": "", "(abc|d)efg": "efg", "[abc]xyz[^]]": "xyz", r"ab\d+cde": "cde", "x{2}yz": "yz", r"\Qab\E?cde": "cde",
            "é-abc": "-abc", "a.*b": "a", "(?x) a b c": "", "(abc": "", r"(\)abc)def": "def", r"\Qab": "ab", "abc*?de": "ab", "": "", r"[\]x]abc": "abc"}
    assert {p: patterns.required(p) for p in want} == want


def test_many_patterns_are_as_each(spark):
    """Long lists of literals and expressions against the plain form, in filters, family filters and ranks."""
    rng = random.Random(6)
    names = [" ".join(rng.choice(["Alpha", "beta", "Gamma 2", "(USA)", "(Rev 1)", "é", "x", "[b]"]) for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["", "ab", None]
    pool = ["alph", "Alpha", "ta Ga", "2 (U", "(Rev 1)", "x", "é x", "a beta", "[b] [b]"]
    made = [N.quote(rng.choice(pool)) for _ in range(30)] + [rng.choice([r"(?i)ALPHA\s+BETA", r"^x", r"\[b\]$", "Gam+a", "be?ta (?:x|é)", "(?i)usa|rev", "[A-G]amma"]) for _ in range(30)]
    made += [N.quote(f"none {i}") for i in range(300)]
    df = derive(table(spark, [(n, "P" if i % 2 else f"Q{i % 9}") for i, n in enumerate(names)]))
    plain = df.select("game_ord", F.coalesce(N.count_matches(F.col("name"), made), F.lit(0)).alias("n"))
    got = patterns.with_counts(df, tuple(made), "n").select("game_ord", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == len(names)
    excludes, includes = tuple(made[10:14] + made[100:]), tuple(made[31:33])
    f = Filter(excludes=excludes, includes=includes)
    few = Filter(excludes=excludes[:4], includes=includes)
    ids = lambda rows: sorted(r["game_ord"] for r in rows.collect())
    assert ids(apply_filter(df, f)) == ids(apply_filter(df, few)) and apply_filter(df, f).columns == df.columns
    assert ids(post_filter(df, PostFilter(excludes))) == ids(post_filter(df, PostFilter(excludes[:4])))
    ranks = lambda p: sorted((r["game_ord"], r["rank"]) for r in rank(df, p).collect())
    assert ranks(Preference(prefers=excludes, avoids=includes)) == ranks(Preference(prefers=excludes[:4], avoids=includes))
