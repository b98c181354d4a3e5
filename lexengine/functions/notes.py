"""Functions on notes and fields, as columns where Spark has them."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexengine.functions import japanese as J

_MARKER = r"\{([\p{L}\p{N}\-]+)\}"


def root_deck(name: Column) -> Column:
    return F.substring_index(name, "::", 1)


def field_markers(field: Column) -> Column:
    """Names in braces, in order."""
    return F.regexp_extract_all(field, F.lit(_MARKER), F.lit(1))


def has_marker(field: Column) -> Column:
    return field.rlike(_MARKER)


def valid_note(deck: Column, model: Column, fields: Column) -> Column:
    """Whether a note names a deck and a model and has fields; what these hold doesn't matter."""
    return (deck != "") & (model != "") & (F.size(fields) > 0)


def escaped(text: Column) -> Column:
    """HTML with seven characters as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c, e in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("`", "&#x60;"), ("=", "&#x3D;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def file_name(name: Column) -> Column:
    """Characters that file names can't have, as hyphens."""
    return F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "-")


def multi_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def first_match(groups: list[list[tuple[str, str, object]]], context: dict[str, Column]) -> Column:
    """A profile's conditions on columns of the context: groups are alternatives, all conditions of one must hold.

    Conditions are (type, operator, value); unknown ones and empty groups don't count, and without any group nothing matches.
    """
    out = F.lit(False)
    for group in groups:
        known = [c for t, o, v in group if (c := _condition(t, o, v, context)) is not None]
        if known:
            each = F.lit(True)
            for c in known:
                each &= c
            out |= each
    return out


def _condition(kind: str, operator: str, value, context: dict[str, Column]) -> Column | None:
    if kind not in context:
        return None
    c = context[kind]
    if kind == "popupLevel":
        n = F.lit(int(value))
        return {"equal": c == n, "notEqual": c != n, "lessThan": c < n, "greaterThan": c > n, "lessThanOrEqual": c <= n, "greaterThanOrEqual": c >= n}.get(operator)
    if kind == "url":
        if operator == "matchDomain":
            host = F.lower(F.parse_url(c, F.lit("HOST")))
            return host.isin([d.strip().lower() for d in str(value).split(",") if d.strip()])
        return c.rlike(f"(?i){value}") if operator == "matchRegExp" else None
    if kind in ("modifierKeys", "flags"):
        wanted = F.array(*(F.lit(x.strip()) for x in str(value).split(",") if x.strip())) if str(value).strip() else F.array().cast("array<string>")
        have = F.array_distinct(c)
        all_, none = F.size(F.array_except(wanted, have)) == 0, F.size(F.array_intersect(wanted, have)) == 0
        exact = all_ & (F.size(F.array_except(have, wanted)) == 0)
        return {"are": exact, "areNot": ~exact, "include": all_, "notInclude": none}.get(operator)
    return None


def lookup_worthy(text: Column, language: str) -> Column:
    """Whether a text can hold words of a language: Japanese and Chinese ones need a character of theirs."""
    if language == "ja":
        return text.rlike(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ　-〿！-｠]")
    if language in ("zh", "yue"):
        return text.rlike(r"[㄀-ㄯㆠ-ㆿ㐀-䶿一-鿿豈-﫿　-〿]")
    from lexengine.functions.processors import BEFORE

    return F.lit(language in BEFORE or language in ("xxx", "he", "hi", "lo", "kn", "km", "th", "ka"))


def primary_segment(text: Column, terminators: str = "。．.？?！!…", particles: str = "はがをにでとも") -> Column:
    """The part of a text that is scanned first: up to a terminator that isn't its first character, then up to a particle from the third on."""
    head = F.regexp_extract(text, rf"(?s)\A.[^{re.escape(terminators)}]*", 0)
    return F.regexp_extract(head, rf"(?s)\A.{{0,2}}[^{particles}]*", 0)


def furigana_html(parts: list[tuple[str, str]]) -> str:
    """Ruby marks of (text, reading) parts."""
    return "".join(f"<ruby>{html.escape(t)}<rt>{html.escape(r)}</rt></ruby>" if r else html.escape(t) for t, r in parts)


def furigana_plain(parts: list[tuple[str, str]]) -> str:
    """Readings in brackets; a part with a reading is set off from what stands before it by a space."""
    out = ""
    for t, r in parts:
        out += (" " if out and r else "") + (f"{t}[{r}]" if r else t)
    return out


def converted_reading(reading: str, mode: str | None) -> str:
    return {"hiragana": J.to_hiragana, "katakana": J.to_katakana}.get(mode or "", lambda t: t)(reading) if mode != "none" else ""


def cloze(sentence: str, offset: int, source: str) -> dict[str, str]:
    """What stands in a sentence before, in and behind the source at offset."""
    end = offset + len(source)
    return {"prefix": sentence[:offset], "body": sentence[offset:end], "suffix": sentence[end:]}
