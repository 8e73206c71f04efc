"""JSON and YAML catalogs cut into games, from splits and as streams."""

import io
import json

import pytest
from pyspark.sql import functions as F

from shelfwise.config import InvalidCatalog
from shelfwise.sources import structured
from shelfwise.sources.catalog import load_catalogs

GAMES = [{"_name": f"g{i} – {'x' * (i % 7)}", "description": "a: b\n- c\n\ngame:\n- d" if i % 5 == 0 else "d", "rom": [{"_name": f"r{k}", "_size": 7 * i + k} for k in range(i % 3)]} for i in range(90)]
HEAD = {"header": {"name": "a, {b}", "comment": "- x"}, "_build": "1"}


def loaded(spark, path, size=None):
    docs, games = load_catalogs(spark, [str(path)], size)
    rows = games.select("game_ord", "name", "game.description", F.expr("aggregate(rom, 0L, (a, r) -> a + r.size)").alias("n"), "split").orderBy("game_ord").collect()
    return docs.select("header.name", "_build").first(), rows


WANT = [(i, g["_name"], g["description"], sum(r["_size"] for r in g["rom"])) for i, g in enumerate(GAMES)]


@pytest.mark.parametrize("indent", [0, 2])
@pytest.mark.parametrize("tail", ["", "_build: '1'\n# end\n"])
def test_yaml_in_splits(spark, tmp_path, indent, tail):
    import textwrap

    import yaml

    games = textwrap.indent(yaml.safe_dump(GAMES, sort_keys=False, allow_unicode=True), " " * indent)
    head = {"header": HEAD["header"]} if tail else HEAD
    text = "# made\n" + yaml.safe_dump(head) + "game: # games\n" + games + tail
    (tmp_path / "c.yaml").write_text(text, encoding="utf-8")
    assert {k: v for k, v in yaml.safe_load(text).items() if k != "game"} == HEAD
    assert structured.yaml_pieces(spark, str(tmp_path / "c.yaml")) is not None
    head, rows = loaded(spark, tmp_path / "c.yaml", 1500)
    assert tuple(head) == ("a, {b}", "1") and [tuple(r)[:4] for r in rows] == WANT and len({r["split"] for r in rows}) > 3


FORMS = {
    "flow": "{header: {name: n}, game: [{_name: a}, {_name: b}]}",
    "quoted over lines": 'game:\n- _name: a\n  description: "x\n- _name: no"\n- _name: b\n',
    "aliases": "game:\n- &one\n  _name: a\n  rom: &r [{_name: x}]\n- _name: b\n  rom: *r\n",
    "dash alone": "game:\n-\n  _name: a\n-\n  _name: b\n",
    "marks": "---\ngame:\n- _name: a\n- _name: b\n...\n",
    "quoted key": '"game":\n- _name: a\n- _name: b\n',
    "lines of CRLF": "header:\r\n  name: n\r\ngame:\r\n- _name: a\r\n- _name: b\r\n",
    "another list": "x:\n- 1\n- 2\ngame:\n- _name: a\n- _name: b\ny:\n- 3\n",
}


def test_yaml_of_other_forms(spark, tmp_path):
    for form, text in FORMS.items():
        (tmp_path / "c.yml").write_bytes(text.encode())
        assert [r["name"] for r in loaded(spark, tmp_path / "c.yml")[1]] == ["a", "b"], form
    for text in ("game:\n- _name: a\n---\ngame:\n- _name: b\n", "game:\n- _name: a\ngame:\n- _name: b\n", "game:\n- _name: a\n- _name: [\n", "- _name: a\n", "game:\n- _name: a\n  year: 2001-01-01\n", "game:\n- _name: a\n...\n- _name: b\n"):
        (tmp_path / "c.yml").write_text(text)
        with pytest.raises(InvalidCatalog):
            load_catalogs(spark, [str(tmp_path / "c.yml")])


def test_json_of_any_layout(spark, tmp_path, monkeypatch):
    for k, text in enumerate([json.dumps(HEAD | {"game": GAMES}), json.dumps({"game": GAMES} | HEAD, indent=1, ensure_ascii=False), " \n" + json.dumps({"x": [1, {"game": [2]}], "game": GAMES, **HEAD}) + "\n"]):
        (tmp_path / "c.json").write_text(text, encoding="utf-16" if k == 1 else "utf-8")
        head, rows = loaded(spark, tmp_path / "c.json")
        assert tuple(head) == ("a, {b}", "1") and [tuple(r)[:4] for r in rows] == WANT
    plan = load_catalogs(spark, [str(tmp_path / "c.json")])[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # no task sorts all games of a document
    for bad in ('{"game": [{"_name": "a"} {"_name": "b"}]}', '{"game": [{"_name": "a"}]} x', '{"game": [{"_name": "a"},]}', '{"game": {"_name": "a"}}', '{"game": [{"_name": "a"}], "game": []}', '{"game": [null]}', "[]", '{"game": [{"_name": NaN}]}'):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(InvalidCatalog):
            load_catalogs(spark, [str(tmp_path / "c.json")])


def test_json_is_held_in_pieces(monkeypatch):
    """A long document is gone through with a few pieces of it held, whatever the pieces cut."""
    monkeypatch.setattr(structured, "PIECE", 50)
    text = json.dumps({"a": -12.5e3, "game": GAMES, "b": True}, ensure_ascii=False)
    held = []
    more = structured._Text.more
    monkeypatch.setattr(structured._Text, "more", lambda self: (more(self), held.append(len(self.text)))[0])
    got = list(structured.json_pieces(io.BytesIO(text.encode())))
    assert [json.loads(t) for kind, t in got if kind == "game"] == GAMES and json.loads(got[-1][1]) == {"a": -12.5e3, "b": True}
    assert max(held) < 1000 < len(text)
