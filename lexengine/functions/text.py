"""Language-neutral text functions, as columns where Spark has them and as plain functions where it has not."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def decapitalized(text: Column) -> Column:
    return F.array(text, F.lower(text))


def capitalized_first(text: Column) -> Column:
    return F.array(text, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))


def case_variants(text: Column) -> Column:
    """The text, in lower case, and each with its first letter in upper case; every one once."""
    variants = F.flatten(F.transform(decapitalized(text), capitalized_first))
    return F.array_distinct(variants)


def letter_substrings(text: Column) -> Column:
    """text and all its beginnings, longest first."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.length(text), F.lit(1), F.lit(-1)), lambda n: F.substring(text, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def word_substrings(text: Column) -> Column:
    """text, and what is left as its last word is cut off again and again."""
    cut = r"[^\p{L}][\p{L}\p{N}]*\z"
    steps = F.sequence(F.lit(1), F.size(F.split(text, r"[^\p{L}]")))
    all_ = F.aggregate(
        steps,
        F.array(text),
        lambda done, _: F.when(F.element_at(done, -1).rlike(cut), F.concat(done, F.array(F.regexp_replace(F.element_at(done, -1), cut, "")))).otherwise(done),
    )
    return F.filter(F.array_distinct(all_), lambda t: t != "")


def normalized_pinyin(text: Column) -> Column:
    """A reading in lower case without spaces, marks between syllables and double slashes; text must be composed (NFC)."""
    return F.regexp_replace(F.lower(text), r"[\s・:'’\-]|//", "")


def trimmed_trailing(text: Column) -> Column:
    """Newlines at the ends as one, other white space at the end as one space."""
    out = F.regexp_replace(text, r"\A\n+|\n+\z", "\n")
    return F.regexp_replace(out, r"[^\S\n]+\z", " ")


def strip_diacritics(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


_TERMINATORS = "…。．.？?！!"
_QUOTES = {"「": "」", "『": "』", '"': '"', "'": "'", "“": "”", "‘": "’", "(": ")", "（": "）"}
_CLOSING = {v: k for k, v in _QUOTES.items()}


def sentence_at(text: str, offset: int, newline_ends: bool = True) -> tuple[str, int]:
    """The sentence around offset, without white space around it, and the offset within it.

    Terminators belong to the sentence they end; quotes that open within it are not left before they close.
    """
    text = text or ""
    offset = max(0, min(offset, len(text)))
    start, stack = offset, []
    while start > 0:
        c = text[start - 1]
        if c == "\n" and newline_ends:
            break
        if not stack and c in _TERMINATORS:
            break
        if c in _CLOSING and _CLOSING[c] != c:
            stack.append(_CLOSING[c])
        elif c in _QUOTES and _QUOTES[c] != c:
            if not stack:
                break
            if stack[-1] == c:
                stack.pop()
        start -= 1
    end, stack = offset, []
    while end < len(text):
        c = text[end]
        if c == "\n" and newline_ends:
            break
        if not stack and c in _TERMINATORS:
            while end < len(text) and text[end] in _TERMINATORS:
                end += 1
            break
        if c in _QUOTES and _QUOTES[c] != c:
            stack.append(_QUOTES[c])
        elif c in _CLOSING and _CLOSING[c] != c:
            if not stack:
                break
            if stack[-1] == c:
                stack.pop()
        end += 1
    raw = text[start:end]
    lead = len(raw) - len(raw.lstrip())
    return raw.strip(), offset - start - lead


def replaced(text: str, pattern: str, replacement: str, ignore_case: bool = False) -> str:
    """All matches replaced; $1 and $<name> stand for groups, other specials stay as they are, and an invalid pattern changes nothing."""
    if ignore_case:
        pattern = re.sub(r"['’]", "['’]", pattern)
    try:
        compiled = re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern), re.IGNORECASE if ignore_case else 0)
    except re.error:
        return text

    def fill(m: re.Match) -> str:
        def group(t: re.Match) -> str:
            if t[1]:
                n = int(t[1])
                if n < 1 or n > compiled.groups + 1:
                    return t[0]
                return "undefined" if n == compiled.groups + 1 else m[n] or ""
            named = m.groupdict()
            return (named[t[2]] or "") if t[2] in named else t[0]

        return re.sub(r"\$(?:(\d{1,2})|<([^>]*)>)", group, replacement)

    return compiled.sub(fill, text)
