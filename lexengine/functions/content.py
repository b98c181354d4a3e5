"""Structured contents of glossaries as plain text, and helpers of note templates."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that stand on lines of their own.
_BLOCKS = {"div", "p", "li", "ul", "ol", "tr", "table", "thead", "tbody", "tfoot", "details", "summary", "br"}


def plain(item) -> str:
    """The text of a glossary item: a string, a text, structured contents; images have none."""
    if isinstance(item, str):
        return item
    if isinstance(item, list):
        return "".join(map(plain, item))
    if not isinstance(item, dict):
        return ""
    if item.get("type") == "text":
        return item.get("text", "")
    if item.get("type") == "image" or item.get("tag") in ("img", "rt", "rp"):
        return ""
    inner = plain(item.get("content", ""))
    if item.get("tag") == "br":
        return "\n"
    return f"{inner}\n" if item.get("tag") in _BLOCKS and inner and not inner.endswith("\n") else inner


def glossary_plain(glossary: list[str]) -> list[str]:
    """Plain texts of a glossary's JSON items; redirects to other forms are left out."""
    items = [json.loads(g) for g in glossary]
    return [t for i in items if not isinstance(i, list) and (t := plain(i.get("content") if isinstance(i, dict) and i.get("type") == "structured-content" else i).strip("\n"))]


def regex_replace(text: str, pattern: str, replacement: str, flags: str = "g") -> str:
    return re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), text, count=0 if "g" in flags else 1, flags=re.IGNORECASE if "i" in flags else 0)


def regex_match(text: str, pattern: str, flags: str = "g") -> str:
    found = [m[0] for m in re.finditer(pattern, text, re.IGNORECASE if "i" in flags else 0)]
    return "".join(found if "g" in flags else found[:1])


def merge_tags(tags: list[tuple[str, str]], by_dictionary: bool = True, by_category: bool = True) -> str:
    """Names of tags (name, dictionary) in order, each once, with or without dictionaries between them."""
    out: list[str] = []
    for name, dictionary in tags:
        for part, wanted in ((name, by_category), (dictionary, by_dictionary)):
            if wanted and part not in out:
                out.append(part)
    return ", ".join(out)


def dumped(value: Column) -> Column:
    """A value as JSON text."""
    return F.to_json(value)


def spread(*lists: Column) -> Column:
    """Lists one after another; a null one counts as empty."""
    return F.flatten(F.array(*(F.coalesce(x, F.array()) for x in lists)))


def joined(separator: str, *values: Column) -> Column:
    """Values with a separator between them; null ones are left out."""
    return F.array_join(F.filter(F.array(*(v.cast("string") for v in values)), lambda x: x.isNotNull()), separator)


def property_of(json: Column, *path: str | int) -> Column:
    """The value at a path of JSON text, as JSON or plain text; null where there is none."""
    at = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.try_variant_get(F.try_parse_json(json), at, "string")


def kind_of(json: Column) -> Column:
    """What JSON text holds: undefined, object (lists and null too), string, number or boolean."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return (
        F.when(kind.isNull(), "undefined").when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"), "object")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    )


#: Operators of templates, by how many operands they take.
_UNARY = {"+": lambda a: a.try_cast("double"), "-": lambda a: -a.try_cast("double"), "~": lambda a: F.bitwise_not(a.cast("int")), "!": lambda a: ~a.cast("boolean")}
_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)),
    "%": lambda a, b: a % F.nullif(b, F.lit(0)), "**": lambda a, b: F.pow(a, b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "===": lambda a, b: a.eqNullSafe(b), "!==": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<<": lambda a, b: F.call_function("shiftleft", a.cast("int"), b.cast("int")), ">>": lambda a, b: F.call_function("shiftright", a.cast("int"), b.cast("int")),
    ">>>": lambda a, b: F.call_function("shiftrightunsigned", a.cast("int"), b.cast("int")), "&": lambda a, b: a.cast("int").bitwiseAND(b.cast("int")),
    "|": lambda a, b: a.cast("int").bitwiseOR(b.cast("int")), "^": lambda a, b: a.cast("int").bitwiseXOR(b.cast("int")),
    "&&": lambda a, b: F.when(a.cast("boolean"), b).otherwise(a), "||": lambda a, b: F.when(a.cast("boolean"), a).otherwise(b),
}


def op(name: str, *values: Column) -> Column:
    """A template operator on one, two or three columns."""
    if len(values) == 3 and name == "?:":
        return F.when(values[0].cast("boolean"), values[1]).otherwise(values[2])
    table = {1: _UNARY, 2: _BINARY}.get(len(values), {})
    if name not in table:
        raise ValueError(f"no operator {name} of {len(values)}")
    return table[name](*values)
