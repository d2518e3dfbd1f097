"""Schema files' references."""

import json

from loglathe.sources.lints import reference_edges, reference_problems, shared_problems


def write(folder, **files):
    for name, made in files.items():
        (folder / f"{name}.json").write_text(json.dumps(made))
    return str(folder)


def test_references_are_followed(tmp_path):
    inner = tmp_path / "schemas"
    inner.mkdir()
    (tmp_path / "words.json").write_text(json.dumps({"$defs": {"a/b": {"enum": ["x"]}}}))
    folder = write(inner, one={"$id": "urn:one", "properties": {"p": {"$ref": "two.json#/$defs/d"}, "q": {"$ref": "../words.json#/$defs/a~1b"}}}, two={"$defs": {"d": {"items": [{"$ref": "urn:one#/properties/q"}]}}})
    assert reference_problems(folder) == []
    assert reference_edges(folder) == [
        ("one.json#/properties/p", "two.json#/$defs/d", "two.json#/$defs/d"),
        ("one.json#/properties/q", "../words.json#/$defs/a~1b", f"{(tmp_path / 'words.json').resolve().as_posix()}#/$defs/a~1b"),
        ("two.json#/$defs/d/items/0", "urn:one#/properties/q", "one.json#/properties/q"),
    ]


def test_rings_and_dangling_references_are_told_by_path(tmp_path):
    folder = write(tmp_path, a={"$defs": {"x": {"properties": {"n": {"$ref": "b.json#/$defs/y"}}}, "free": {"$ref": "#/$defs/none"}}}, b={"$defs": {"y": {"$ref": "a.json#/$defs/x"}}, "more": {"$ref": "c.json"}})
    found = reference_problems(folder)
    assert set(found[:2]) == {"a.json#/$defs/free: '#/$defs/none' names nothing", "b.json#/more: 'c.json' names nothing"}
    assert found[2:] == ["ring: a.json#/$defs/x/properties/n -> b.json#/$defs/y -> a.json#/$defs/x/properties/n"]


def test_a_whole_document_in_a_ring(tmp_path):
    assert reference_problems(write(tmp_path, a={"properties": {"self": {"$ref": "#"}}})) == ["ring: a.json#/properties/self -> a.json#/properties/self"]


def test_shared_definitions(tmp_path):
    vocabulary = {"$defs": {x: {"enum": ["w"]} for x in ("levels", "categories", "sub_categories", "outcomes", "safety_flags")}}
    ref = lambda x: {"$ref": f"words.json#/$defs/{x}"}
    good = {"$defs": {"level": ref("levels"), "category": {"allOf": [ref("categories")]}, "sub_category": ref("sub_categories"), "outcome": ref("outcomes"), "safety_flag": ref("safety_flags")}}
    write(tmp_path, words=vocabulary, good=good, bad={"$defs": {"level": {"enum": ["x"]}, "category": ref("levels"), "outcome": ref("outcomes"), "safety_flag": ref("safety_flags"), "error_code": ref("error_codes")}})
    words = str(tmp_path / "words.json")
    assert shared_problems(str(tmp_path / "good.json"), words) == []
    assert shared_problems(str(tmp_path / "bad.json"), words) == [
        "#/$defs/level: words of its own", "#/$defs/level: 0 references", "#/$defs/category: 'words.json#/$defs/levels' isn't the vocabulary's categories",
        "#/$defs/sub_category: missing", "#/$defs/error_code: the vocabulary has no error_codes",
    ]
