"""Text processors by language: functions from a text to its variants, in the order that variants are tried.

Tables of characters are fixed values.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from lexengine.functions import japanese as J
from lexengine.functions.text import strip_diacritics

Processor = Callable[[str], list[str]]
#: Variants of one processor at most.
MOST = 4096


def _nfc(t: str) -> str:
    return unicodedata.normalize("NFC", t)


def _nfd(t: str) -> str:
    return unicodedata.normalize("NFD", t)


def _either(f: Callable[[str], str]) -> Processor:
    return lambda t: [t, f(t)]


def _both(*fs: Callable[[str], str]) -> Processor:
    return lambda t: [t, *(f(t) for f in fs)]


def _swap(*pairs: tuple[str, str]) -> Callable[[str], str]:
    def run(t: str) -> str:
        for a, b in pairs:
            t = t.replace(a, b)
        return t

    return run


def _back(*pairs: tuple[str, str]) -> Callable[[str], str]:
    return _swap(*((b, a) for a, b in pairs))


decapitalize: Processor = lambda t: [t, t.lower()]
capitalize_first: Processor = lambda t: [t, t[:1].upper() + t[1:]]
remove_diacritics = _either(strip_diacritics)

_ESZETT = (("ß", "ss"), ("ẞ", "SS"))
eszett = _both(_swap(*_ESZETT), _back(*_ESZETT))
apostrophes = _both(_swap(("'", "’")), _swap(("’", "'")))
_LIGATURES = (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"))
diphthongs = _both(_swap(*_LIGATURES), _back(*_LIGATURES))
_YO = (("ё", "е"), ("Ё", "Е"))
yo_to_e = _both(_swap(*_YO), _back(*_YO))
russian_accents = _either(lambda t: t.replace("́", ""))


def _first_acute(t: str) -> str:
    head, mark, rest = _nfd(t).partition("́")
    return _nfc(head + mark + rest.replace("́", ""))


double_acutes = _either(_first_acute)
apostrophed_words = _either(lambda t: re.sub(r"(?:l|dell|all|dall|nell|sull|coll|un|quest|quell|c|n)['’]", "", t))

#: Arabic marks that are dropped.
ARABIC_MARKS = "ًٌٍَُِّْؐؑؒؓؔؕٓٔ"
arabic_marks = _either(lambda t: t.translate(dict.fromkeys(map(ord, ARABIC_MARKS))))
tatweel = _either(lambda t: t.replace("ـ", ""))
compatibility_form = _either(lambda t: unicodedata.normalize("NFKC", t))
hamza_top = _either(lambda t: t.replace("ا", "أ", 1))
hamza_bottom = _either(lambda t: t.replace("ا", "إ", 1))
alif_maqsura = _either(lambda t: re.sub("ى\\Z", "ي", t))
ta_marbuta = _either(lambda t: re.sub("ه\\Z", "ة", t))
syriac_marks = _either(lambda t: "".join(c for c in t if not ("ܰ" <= c <= "݊" or "̀" <= c <= "ͯ")))

_SERBO = {"c": "cčć", "z": "zž", "s": "sš", "C": "CČĆ", "Z": "ZŽ", "S": "SŠ"}


def serbo_croatian(t: str) -> list[str]:
    """All ways to write carons and accents that a text leaves out, as far as the limit goes."""
    parts = re.findall("dj|Dj|DJ|.", _nfc(t), re.DOTALL)
    out = [""]
    for p in parts:
        options = [p, "đ" if p == "dj" else "Đ"] if p.lower() == "dj" else list(_SERBO.get(p, p))
        out = [a + b for a in out for b in options][:MOST]
    return out


serbo_croatian_accents = _either(lambda t: re.sub("([aeiourAEIOUR])[̀-ͯ]", r"\1", _nfd(t)))


def _viet(t: str, old: bool) -> str:
    """Tone marks on the place that either style gives them: on the first or on the second vowel of oa, oe and uy."""
    tones = "̣̀́̃̉"
    d = _nfd(t)
    d = re.sub(f"(o[{tones}]?)(a|e)(?![a-zđ̛̂̆])|(u[{tones}]?)(y)(?![a-z])", lambda m: m[0], d)
    if old:
        d = re.sub(f"(o)([ae])([{tones}])(?![a-z])|(u)(y)([{tones}])(?![a-z])", lambda m: (m[1] or m[4]) + (m[3] or m[6]) + (m[2] or m[5]), d)
    else:
        d = re.sub(f"(o)([{tones}])([ae])(?![a-z])|(u)([{tones}])(y)(?![a-z])", lambda m: (m[1] or m[4]) + (m[3] or m[6]) + (m[2] or m[5]), d)
    return _nfc(d)


viet_tones = _both(lambda t: _viet(t, True), lambda t: _viet(t, False))

_GREEK = {"th": "θ", "ph": "φ", "ch": "χ", "kh": "χ", "ps": "ψ", "ks": "ξ", "x": "ξ", "a": "α", "b": "β", "g": "γ", "d": "δ", "e": "ε", "z": "ζ", "i": "ι", "k": "κ", "l": "λ", "m": "μ", "n": "ν", "o": "ο", "p": "π", "r": "ρ", "s": "σ", "t": "τ", "u": "υ", "y": "υ", "w": "ω", "c": "κ"}
latin_to_greek = _either(lambda t: re.sub("|".join(sorted(_GREEK, key=len, reverse=True)), lambda m: _GREEK[m[0]], strip_diacritics(t).lower()))

#: Yiddish finals and ligatures.
_YIDDISH_FINALS = {"כ": "ך", "מ": "ם", "נ": "ן", "פ": "ף", "צ": "ץ"}
_YIDDISH_LIGATURES = (("וו", "װ"), ("וי", "ױ"), ("יי", "ײ"))
yiddish_marks: Processor = lambda t: ["".join(c for c in t if not "֑" <= c <= "ׇ")]


def yiddish_ligatures(t: str) -> list[str]:
    for a, b in _YIDDISH_LIGATURES:
        t = t.replace(a, b, 1)
    return [t]


yiddish_finals: Processor = lambda t: [t[:-1] + _YIDDISH_FINALS.get(t[-1:], t[-1:])]
yiddish_split = _both(_back(*_YIDDISH_LIGATURES), _swap(*_YIDDISH_LIGATURES))

_LEAD = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_VOWEL = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_TAIL = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
#: Letters that are written as two.
_COMPOUND = {"ㅘ": "ㅗㅏ", "ㅙ": "ㅗㅐ", "ㅚ": "ㅗㅣ", "ㅝ": "ㅜㅓ", "ㅞ": "ㅜㅔ", "ㅟ": "ㅜㅣ", "ㅢ": "ㅡㅣ", "ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}
_JOINED = {v: k for k, v in _COMPOUND.items()}


def _letters_of(c: str) -> str:
    n = ord(c) - 0xAC00
    if not 0 <= n < 11172:
        return _COMPOUND.get(c, c)
    parts = _LEAD[n // 588], _VOWEL[n % 588 // 28], _TAIL[n % 28]
    return "".join(_COMPOUND.get(p, p) for p in parts)


disassemble_hangul: Processor = lambda t: ["".join(map(_letters_of, t))]


def reassemble_hangul(t: str) -> list[str]:
    """Letters as syllables: a consonant goes to the syllable before it unless a vowel follows."""
    out, i = "", 0

    def vowel(k: int) -> tuple[str, int]:
        if t[k : k + 2] in _JOINED and _JOINED[t[k : k + 2]] in _VOWEL:
            return _JOINED[t[k : k + 2]], 2
        return (t[k], 1) if k < len(t) and t[k] in _VOWEL else ("", 0)

    while i < len(t):
        v, n = vowel(i + 1) if t[i] in _LEAD else ("", 0)
        if not n:
            out += t[i]
            i += 1
            continue
        code, i_next = 0xAC00 + _LEAD.index(t[i]) * 588 + _VOWEL.index(v) * 28, i + 1 + n
        tail = ""
        for k in (2, 1):
            part = t[i_next : i_next + k]
            joined = _JOINED.get(part, part) if k == 2 else part
            if len(part) == k and joined in _TAIL[1:] and not vowel(i_next + k)[1]:
                tail, i_next = joined, i_next + k
                break
        out += chr(code + _TAIL.index(tail))
        i = i_next
    return [out]


ja_width = _both(J.to_half_width, J.to_full_width)
ja_kana = _both(J.to_katakana, J.to_hiragana)
ja_marks = _both(J.repeat_marks_to_kanji, J.kanji_to_repeat_marks)
ja_emphatic = _both(lambda t: J.collapse_emphatic(t, False), lambda t: J.collapse_emphatic(t, True))
radicals = _either(lambda t: re.sub("[⺀-⿟㇀-㇯]", lambda m: unicodedata.normalize("NFKD", m[0]), t))

_CASE = [decapitalize, capitalize_first]
_ARABIC = [arabic_marks, tatweel, compatibility_form, hamza_top, hamza_bottom, alif_maqsura]
_CASED = "be bg cs da de el en eo es et eu fi fr ga grc haw hu id it la lv mn mt nl no pl pt ro ru sga sh sq sv tl tr tok uk vi cy"
#: Processors before deinflection, by language. Languages that are not here have none.
BEFORE: dict[str, list[Processor]] = {code: list(_CASE) for code in _CASED.split()}
for _code in "grc id it la ro sga tl".split():
    BEFORE[_code].append(remove_diacritics)
BEFORE["de"].append(eszett)
BEFORE["el"].append(double_acutes)
BEFORE["fr"].append(apostrophes)
BEFORE["grc"].append(latin_to_greek)
BEFORE["it"].append(apostrophed_words)
BEFORE["la"].append(diphthongs)
BEFORE["ru"] += [yo_to_e, russian_accents]
BEFORE["sh"] += [serbo_croatian_accents, serbo_croatian]
BEFORE["vi"].append(viet_tones)
BEFORE |= {
    "ar": _ARABIC, "arz": [*_ARABIC, ta_marbuta], "fa": [arabic_marks], "aii": [syriac_marks], "zh": [radicals], "yue": [radicals],
    "ko": [disassemble_hangul], "yi": [yiddish_marks, yiddish_ligatures],
    "ja": [
        _either(J.half_kana_to_full), _either(J.compose_marks), _either(J.compatibility), radicals, ja_width, ja_kana, ja_marks, ja_emphatic,
    ],
}
#: Processors after deinflection.
AFTER: dict[str, list[Processor]] = {"ko": [reassemble_hangul], "yi": [yiddish_finals, yiddish_split]}


def variants(text: str, processors: list[Processor]) -> list[str]:
    """All variants of a text in the order that they are found, each once."""
    out = [text]
    for f in processors:
        out = list(dict.fromkeys(v for t in out for v in f(t)[:MOST]))
    return out
