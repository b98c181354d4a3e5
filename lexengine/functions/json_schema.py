"""Validation of JSON values by schemas, and values made valid by their defaults."""

from __future__ import annotations

import copy
import re

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int) or isinstance(value, float) and value == int(value):
        return "integer"
    if isinstance(value, float):
        return "number"
    return next(k for k, t in _KINDS.items() if isinstance(value, t))


def _is(value, kind: str) -> bool:
    own = kind_of(value)
    return own == kind or kind == "number" and own == "integer"


def resolved(schema, root):
    """A schema whose reference, if it has one, is followed."""
    seen = set()
    while isinstance(schema, dict) and "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen:
            raise ValueError(f"references go in a circle at {ref}")
        seen.add(ref)
        schema = root
        for part in ref.removeprefix("#").strip("/").split("/"):
            schema = schema[part] if part else schema
    return schema


def errors(value, schema, root=None, at: str = "$") -> list[str]:
    """Where and why a value breaks a schema; nothing if it doesn't."""
    root = schema if root is None else root
    schema = resolved(schema, root)
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    out: list[str] = []
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: {kind_of(value)} in place of {kinds}"]
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    for key, good in (("allOf", lambda n, all_: n == all_), ("anyOf", lambda n, all_: n > 0), ("oneOf", lambda n, all_: n == 1)):
        if key in schema:
            n = sum(not errors(value, s, root, at) for s in schema[key])
            if not good(n, len(schema[key])):
                out.append(f"{at}: {key} holds {n} times")
    if "not" in schema and not errors(value, schema["not"], root, at):
        out.append(f"{at}: not allowed")
    if "if" in schema:
        branch = schema.get("then" if not errors(value, schema["if"], root, at) else "else")
        out += errors(value, branch, root, at) if branch is not None else []
    if _is(value, "number") and not isinstance(value, bool):
        out += _number(value, schema, at)
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value, re.IGNORECASE if "i" in schema.get("patternFlags", "") else 0):
            out.append(f"{at}: pattern")
    elif isinstance(value, list):
        out += _array(value, schema, root, at)
    elif isinstance(value, dict):
        out += _object(value, schema, root, at)
    return out


def _number(value, schema, at):
    checks = {"multipleOf": lambda m: value / m == int(value / m), "minimum": lambda m: value >= m, "exclusiveMinimum": lambda m: value > m, "maximum": lambda m: value <= m, "exclusiveMaximum": lambda m: value < m}
    return [f"{at}: {k}" for k, ok in checks.items() if k in schema and not ok(schema[k])]


def _item_schema(schema, i: int):
    items = schema.get("items")
    if isinstance(items, list):
        return items[i] if i < len(items) else schema.get("additionalItems", True)
    return True if items is None else items


def _array(value, schema, root, at):
    out = []
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
        out.append(f"{at}: number of items")
    for i, v in enumerate(value):
        out += errors(v, _item_schema(schema, i), root, f"{at}[{i}]")
    if "contains" in schema and not any(not errors(v, schema["contains"], root, at) for v in value):
        out.append(f"{at}: contains")
    return out


def _object(value, schema, root, at):
    out = [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
        out.append(f"{at}: number of properties")
    for k, v in value.items():
        out += errors(v, schema.get("properties", {}).get(k, schema.get("additionalProperties", True)), root, f"{at}.{k}")
    return out


def with_defaults(value, schema, root=None):
    """value made valid: what is missing or of a wrong type gets the schema's default, objects and arrays part by part."""
    root = schema if root is None else root
    schema = resolved(schema, root)
    if isinstance(schema, bool):
        return value
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)) or errors(value, {k: v for k, v in schema.items() if k in ("enum", "const", "minimum", "maximum", "pattern")}, root):
        if "default" not in schema:
            first = kinds if isinstance(kinds, str) else (kinds or ["null"])[0]
            value = {"object": {}, "array": [], "string": "", "boolean": False, "null": None}.get(first, 0)
        else:
            value = copy.deepcopy(schema["default"])
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out = {k: with_defaults(value.get(k), s, root) for k, s in known.items() if k in value or k in schema.get("required", [])}
        rest = schema.get("additionalProperties", True)
        return out | {k: with_defaults(v, rest, root) for k, v in value.items() if k not in known and rest is not False}
    if isinstance(value, list):
        return [with_defaults(v, _item_schema(schema, i), root) for i, v in enumerate(value)]
    return value
