"""Arabic inflection rules: particles before words, pronouns behind them, and the forms of verbs between both."""

from __future__ import annotations

from lexengine.operators.deinflect import Language, Rule

#: Pronouns that follow verbs and nouns, by person, and letters of words.
FIRST, SECOND, THIRD = ["ني", "نا"], ["ك", "كما", "كم", "كن"], ["ه", "ها", "هما", "هم", "هن"]
OBJECTS = [*FIRST, *SECOND, *THIRD]
OTHERS = ["نا", *SECOND, *THIRD]
OWNERS = ["ي", *OTHERS]
_LETTERS = "[ؠ-ٟٮ-ۓەۮۯۺ-ۼۿ]"


def _s(a, b, needs, gives, after: str = ""):
    """A suffix; after: a look-behind that holds before it."""
    if after:
        return Rule("other", f"{after}{a}\\Z", lambda t: t[: len(t) - len(a)] + b, tuple(needs), tuple(gives))
    return Rule("suffix", a, b, tuple(needs), tuple(gives))


def _each(stem: str, pronouns, b, needs, gives, after: str = ""):
    return [_s(stem + p, b, needs, gives, after) for p in pronouns]


def _p(a, b, needs, gives):
    return Rule("prefix", a, b, tuple(needs), tuple(gives))


def _led(particle: str, b: str, needs: str):
    """A particle before nouns, also behind the conjunctions."""
    return [_p(c + particle, b, [needs], ["n"]) for c in ("", "و", "ف")]


def _around(before: str, to_before: str, behind: str, to_behind: str, needs, gives, end: str):
    """A rule for what stands before and behind a stem; either may be empty."""
    if not behind and not to_behind:
        return _p(before, to_before, needs, gives)
    pattern = f"\\A{before}{_LETTERS}+{end}{behind}\\Z"
    return Rule("other", pattern, lambda t: to_before + t[len(before) : len(t) - len(behind)] + to_behind, tuple(needs), tuple(gives))


def _imperfect(prefix: str, to_prefix: str = "", suffix: str = "", to_suffix: str = "", joined: str | None = None, first=True, second=True, li=True, end=""):
    """Forms of the imperfect, alone and with pronouns, behind particles; of stems with any beginning if none is given."""
    joined = suffix if joined is None else joined
    pronouns = [*(FIRST if first else []), *(SECOND if second else []), *THIRD]
    particles = ["", "و", "ف", "س", "وس", "فس", *(["ل", "ول", "فل"] if li else [])]
    out = [
        _around(particle + prefix, begin, s, to_suffix, ["iv_p"], ["iv"], end)
        for begin in ([to_prefix] if to_prefix else ["", "أ", "ا"])
        for particle in particles
        for s in [suffix, *(joined + p for p in pronouns)]
    ]
    return out


def _ending(suffix: str, pairs, pronouns, gives, joined: str | None = None):
    """A noun's ending in place of each of pairs, alone and with pronouns."""
    joined = suffix if joined is None else joined
    return [r for b in pairs for r in ([_s(suffix, b, ["n_s"], gives)] if suffix else []) + _each(joined, pronouns, b, ["n_s"], gives)]


_P, _NOM, _NOM_I, _INDEF = ["n_p", "n"], ["n_nom", "n"], ["n_nom_indef", "n"], ["n_indef", "n"]
_PV = (["pv_s"], ["pv"])
_CV = (["cv_s"], ["cv"])


def _perfect(stem: str, b: str, pronouns, after: str = "", joined: str | None = None):
    return [_s(stem, b, *_PV, after), *_each(stem if joined is None else joined, pronouns, b, *_PV, after)]


def _second_person(after: str, b: str):
    """Endings of the second person, of stems that end in its letter or do not."""
    some = [*FIRST, *THIRD]
    return [*_perfect("تما", b, some, after), *_perfect("تم", b, some, after, "تمو"), *_perfect("تن", b, some, after)]


ARABIC = Language(
    "ar",
    {
        "n": (), "n_p": ("n_wa", "n_bi", "n_ka", "n_li", "n_al", "n_bi_al", "n_ka_al", "n_lil", "n_li_al"), "n_def": ("n_al", "n_bi_al", "n_ka_al", "n_lil", "n_li_al"),
        "n_indef": ("n_wa", "n_bi", "n_ka", "n_li"), "n_nom": ("n_wa", "n_li", "n_al"), "n_nom_indef": ("n_wa", "n_li"),
        **{c: () for c in "n_wa n_bi n_ka n_li n_al n_bi_al n_ka_al n_lil n_li_al n_s".split()},
        "v": ("pv", "iv", "cv"), **{c: () for c in "pv pv_p pv_s iv iv_p iv_s cv cv_p cv_s".split()},
    },
    {
        "NPref-Wa": [_p("و", "", ["n_wa"], ["n"]), _p("ف", "", ["n_wa"], ["n"])], "NPref-Bi": _led("ب", "", "n_bi"), "NPref-Ka": _led("ك", "", "n_ka"), "NPref-Li": _led("ل", "", "n_li"),
        "NPref-Al": _led("ال", "", "n_al"), "NPref-BiAl": _led("بال", "", "n_bi_al"), "NPref-KaAl": _led("كال", "", "n_ka_al"),
        "NPref-Lil": [Rule("other", f"\\A{c}لل(?!ل)", lambda t, n=len(c) + 2: t[n:], ("n_lil",), ("n",)) for c in ("", "و", "ف")], "NPref-LiAl": _led("لل", "ل", "n_li_al"),
        "NSuff-h": [*_each("", OTHERS, "", ["n_s"], _INDEF), _s("ي", "", ["n_s"], _INDEF, "(?<!ي)")], "NSuff-ap": [_s("ة", "", ["n_s"], _P)], "NSuff-ath": [r for b in ("", "ة") for r in _each("ت", OWNERS, b, ["n_s"], _INDEF)],
        "NSuff-AF": [_s(x, "", ["n_s"], ["n_wa", "n"]) for x in ("ا", "اً", "ًا")], "NSuff-An": [_s("ان", "", ["n_s"], _NOM), _s("آن", "أ", ["n_s"], _NOM)],
        "NSuff-Ah": [*_ending("ا", [""], OWNERS, _NOM_I), *_ending("آ", ["أ"], OWNERS, _NOM_I)], "NSuff-ayn": [_s("ين", "", ["n_s"], _P)], "NSuff-ayh": _ending("ي", [""], OTHERS, _INDEF),
        "NSuff-atAn": _ending("تان", ["", "ة"], [], _NOM), "NSuff-atAh": _ending("تا", ["", "ة"], OWNERS, _NOM_I), "NSuff-tayn": _ending("تين", ["", "ة"], [], _P), "NSuff-tayh": _ending("تي", ["", "ة"], OTHERS, _INDEF),
        "NSuff-At": [*_ending("ات", ["", "ة"], [], _P), *_ending("آت", ["أ", "أة"], [], _P)], "NSuff-Ath": [*(r for b in ("", "ة") for r in _each("ات", OWNERS, b, ["n_s"], _INDEF)), *(r for b in ("أ", "أة") for r in _each("آت", OWNERS, b, ["n_s"], _INDEF))],
        "NSuff-wn": [_s("ون", "", ["n_s"], _NOM)], "NSuff-wh": _ending("و", [""], OTHERS, _NOM_I), "NSuff-iyn": [_s("ين", "", ["n_s"], _P)], "NSuff-iyh": _ending("ي", [""], OTHERS, _INDEF),
        "PVPref-Wa": [_p("و", "", ["pv_p"], ["pv_s", "pv"]), _p("ف", "", ["pv_p"], ["pv_s", "pv"])], "PVPref-La": [_p("ل", "", ["pv_p"], ["pv_s", "pv"])], "PVSuff-ah": _each("", OBJECTS, "", *_PV),
        "PVSuff-n": [r for after, b in (("(?<!ن)", ""), ("", "ن")) for r in ([_s("ن", "", *_PV, after)] if after else []) + _each("ن", OBJECTS, b, *_PV, after) + _perfect("نا", b, [*SECOND, *THIRD], after)],
        "PVSuff-t": [*_perfect("ت", "", OBJECTS), *_second_person("(?<!ت)", ""), *_each("ت", OBJECTS, "ت", *_PV), *_second_person("", "ت")],
        "PVSuff-at": _perfect("تا", "", OBJECTS), "PVSuff-A": [*_perfect("ا", "", OBJECTS), *_perfect("آ", "أ", OBJECTS)], "PVSuff-uw": _perfect("وا", "", OBJECTS, joined="و"),
        "IVPref-hw": _imperfect("ي"), "IVPref-hy": _imperfect("ت"),
        **{
            name: [*_imperfect(c, suffix="ان", li=False), *_imperfect(c, suffix="آن", to_suffix="أ", li=False), *_imperfect(c, suffix="ا"), *_imperfect(c, suffix="آ", to_suffix="أ")]
            for name, c in (("IVPref-hmA", "ي"), ("IVPref-hmA-ta", "ت"))
        },
        "IVPref-hm": [*_imperfect("ي", suffix="ون", li=False), *_imperfect("ي", suffix="وا", joined="و")], "IVPref-hn": [*_imperfect("ي", suffix="ن", end="(?<!ن)"), *_imperfect("ي", suffix="ن", to_suffix="ن")],
        "IVPref-Anta": _imperfect("ت", second=False), "IVPref-Anti": [*_imperfect("ت", suffix="ين", second=False, li=False), *_imperfect("ت", suffix="ي", second=False)],
        "IVPref-AntmA": [*_imperfect("ت", suffix="ان", second=False, li=False), *_imperfect("ت", suffix="آن", to_suffix="أ", second=False, li=False), *_imperfect("ت", suffix="ا", second=False), *_imperfect("ت", suffix="آ", to_suffix="أ", second=False)],
        "IVPref-Antm": [*_imperfect("ت", suffix="ون", second=False, li=False), *_imperfect("ت", suffix="وا", joined="و", second=False)],
        "IVPref-Antn": [*_imperfect("ت", suffix="ن", second=False, end="(?<!ن)"), *_imperfect("ت", suffix="ن", to_suffix="ن", second=False)],
        "IVPref-AnA": [*_imperfect("أ", first=False), *_imperfect("آ", "أ", first=False)], "IVPref-nHn": _imperfect("ن", first=False),
        "CVPref": [_p("و", "", ["cv_p"], ["cv_s"]), _p("ف", "", ["cv_p"], ["cv_s"]), *(_p(x, "", ["cv_p"], ["cv_s", "cv"]) for x in ("ا", "وا", "فا"))],
        "CVSuff": [*_each("", [*FIRST, *THIRD], "", *_CV), *(r for alone, joined in (("ي", "ي"), ("ا", "ا"), ("وا", "و"), ("ن", "ن")) for r in [_s(alone, "", *_CV), *_each(joined, [*FIRST, *THIRD], "", *_CV)])],
    },
)
