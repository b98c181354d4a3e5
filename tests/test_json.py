from lexengine.functions import content as C
from lexengine.functions.json_schema import errors, with_defaults

SCHEMA = {
    "type": "object", "required": ["a", "n"], "additionalProperties": False,
    "properties": {
        "a": {"type": "array", "items": [{"type": "string"}, {"$ref": "#/definitions/small"}], "default": []},
        "n": {"type": "integer", "minimum": 1, "default": 3}, "o": {"oneOf": [{"type": "string"}, {"const": 1}]},
        "c": {"if": {"type": "string"}, "then": {"pattern": "^x"}, "else": {"enum": [1, 2]}},
    },
    "definitions": {"small": {"type": "number", "exclusiveMaximum": 10, "multipleOf": 0.5}},
}


def test_validation():
    assert errors({"a": ["x", 1.5], "n": 2, "o": 1, "c": "xy"}, SCHEMA) == []
    for bad in ({"n": 1}, {"a": [1], "n": 1}, {"a": ["x", 10], "n": 1}, {"a": ["x", 0.3], "n": 1}, {"a": [], "n": 0}, {"a": [], "n": True}, {"a": [], "n": 1, "o": 2}, {"a": [], "n": 1, "c": "y"}, {"a": [], "n": 1, "c": 3}, {"a": [], "n": 1, "z": 1}, []):
        assert errors(bad, SCHEMA), bad


def test_defaults():
    assert with_defaults({"n": 0, "z": 1}, SCHEMA) == {"a": [], "n": 3}
    assert with_defaults("no", SCHEMA) == {"a": [], "n": 3}


def test_contents():
    assert C.glossary_plain(['"one"', '{"type": "text", "text": "two"}', '{"type": "image", "path": "p"}', '["base", ["past"]]']) == ["one", "two"]
    nested = '{"type": "structured-content", "content": [{"tag": "div", "content": ["a", {"tag": "ruby", "content": ["b", {"tag": "rt", "content": "c"}]}]}, "d"]}'
    assert C.glossary_plain([nested]) == ["ab\nd"]
    assert C.regex_replace("aXbx", "(x)", "<$1>", "gi") == "a<X>b<x>" and C.regex_match("a1b22", r"\d+") == "122"
    assert C.merge_tags([("n", "A"), ("v", "A")]) == "n, A, v"
