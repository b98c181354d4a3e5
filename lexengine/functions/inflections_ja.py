"""Japanese inflection rules, made from the rows of the kana table and the stems of each class of verbs."""

from __future__ import annotations

from lexengine.operators.deinflect import Language, Rule

#: Endings of godan verbs with their rows, in the order a, i, u, e, o.
ROWS = {"う": "わいうえお", "く": "かきくけこ", "ぐ": "がぎぐげご", "す": "さしすせそ", "つ": "たちつてと", "ぬ": "なにぬねの", "ぶ": "ばびぶべぼ", "む": "まみむめも", "る": "らりるれろ"}
#: What godan endings become before て and た; the second kind voices these.
TE_STEMS = [("い", "く"), ("い゙", "ぐ"), ("し", "す"), ("っ", "う"), ("っ", "つ"), ("っ", "る"), ("ん゙", "ぬ"), ("ん゙", "ぶ"), ("ん゙", "む")]
VOICED = {"て": "で", "た": "だ", "ち": "じ"}
#: Verbs with forms of their own before て and た, and honorific ones before ます.
IKU = ["いく", "行く", "逝く", "往く"]
U_VERBS = ["こう", "とう", "請う", "乞う", "恋う", "問う", "訪う", "宣う", "曰う", "給う", "賜う", "揺蕩う"]
FU_VERBS = {"のたまう": "のたもう", "たまう": "たもう", "たゆたう": "たゆとう"}
HONORIFIC = ["いらっしゃる", "ござる", "なさる", "くださる", "下さる", "おっしゃる", "仰る", "仰有る"]


def _s(a, b, needs=(), gives=()):
    return Rule("suffix", a, b, tuple(needs), tuple(gives))


def _on(column: int, ending: str, needs, zuru: str, suru: str | None, kuru: str, godan=("v5",), ichidan=True, skip=""):
    """Rules of an ending on one column of the kana table, and on the stems of the irregular verbs."""
    out = [_s(ending, "る", needs, ["v1"])] if ichidan else []
    out += [_s(row[column] + ending, u, needs, godan) for u, row in ROWS.items() if u not in skip]
    out.append(_s(zuru + ending, "ずる", needs, ["vz"]))
    if suru is not None:
        out += [_s(suru + ending, "する", needs, ["vs"]), _s("為" + ending, "為る", needs, ["vs"])]
    return out + [_s(kuru + ending, "くる", needs, ["vk"]), _s("来" + ending, "来る", needs, ["vk"]), _s("來" + ending, "來る", needs, ["vk"])]


def _masu(ending: str, needs, adjective: bool = False):
    return [*([_s(ending, "い", needs, ["adj-i"])] if adjective else []), *_on(1, ending, needs, "じ", "し", "き")]


def _nai(ending: str, needs, zuru="ぜ", suru="せ"):
    return _on(0, ending, needs, zuru, suru, "こ")


def _te(ending: str, needs, adjective: str | None = None, irregular: bool = True):
    """An ending that begins with て, た or ち, on the forms before these."""
    out = [_s(adjective, "い", needs, ["adj-i"])] if adjective else []
    out.append(_s(ending, "る", needs, ["v1"]))
    for stem, u in TE_STEMS:
        voiced = stem.endswith("゙")
        out.append(_s((stem[0] + VOICED[ending[0]] + ending[1:]) if voiced else stem + ending, u, needs, ["v5"]))
    out += [_s("じ" + ending, "ずる", needs, ["vz"]), _s("し" + ending, "する", needs, ["vs"]), _s("為" + ending, "為る", needs, ["vs"])]
    out += [_s(k + ending, v, needs, ["vk"]) for k, v in (("き", "くる"), ("来", "来る"), ("來", "來る"))]
    if irregular:
        out += [_s(v[0] + "っ" + ending, v, needs, ["v5"]) for v in IKU]
        out += [_s(v + ending, v, needs, ["v5"]) for v in U_VERBS]
        out += [_s(stem + ending, v, needs, ["v5"]) for v, stem in FU_VERBS.items()]
    return out


def _irregular(zuru, suru, kuru, needs, each=("", "来", "來")):
    """Whole stems of the irregular verbs: several of zuru and suru, one of kuru."""
    out = [_s(z, "ずる", needs, ["vz"]) for z in zuru] + [_s(a, b, needs, ["vs"]) for a, b in suru]
    return out + [_s(kuru, "くる", needs, ["vk"]), *(_s(k + kuru[1:], k + "る", needs, ["vk"]) for k in each[1:])]


_KANSAI = {"お": "あ", "こ": "か", "ご": "が", "そ": "さ", "ぞ": "ざ", "と": "た", "ど": "だ", "の": "な", "ほ": "は", "ぼ": "ば", "も": "ま", "ろ": "ら", "よ": "や"}
_KANSAI_ADJECTIVES = {"こ": "か", "そ": "さ", "と": "た", "の": "な", "ぼ": "ば", "も": "ま", "ろ": "ら", "よ": "よ"}


def _kansai_verbs(end: str, needs):
    """Forms with う in place of っ before て and た."""
    return [_s("う" + end, "っ" + end, needs, needs), *(_s(o + "う" + end, a + "っ" + end, needs, needs) for o, a in _KANSAI.items()), _s("ゆう" + end, "いっ" + end, needs, needs)]


def _kansai_adjectives(end: str, needs):
    return [_s("う" + end, "く" + end, needs, needs), *(_s(o + "う" + end, a + "く" + end, needs, needs) for o, a in _KANSAI_ADJECTIVES.items()), _s("しゅう" + end, "しく" + end, needs, needs)]


def _godan(column: int, needs, gives=("v5",), end="", skip=""):
    return [_s(row[column] + end, u, needs, gives) for u, row in ROWS.items() if u not in skip]


_CAUSATIVE = _irregular(["じさせる", "ぜさせる"], [("させる", "する"), ("為せる", "為る"), ("せさせる", "する"), ("為させる", "為る")], "こさせる", ["v1"])
_SHORT_CAUSATIVE = _irregular(["じさす", "ぜさす"], [("さす", "する"), ("為す", "為る")], "こさす", ["v5ss"])
_ICHIDAN_STEMS = "いえきぎけげじせぜちてでにねひびへべみめりれ"
JAPANESE = Language(
    "ja",
    {
        "v": ("v1", "v5", "vk", "vs", "vz"), "v1": ("v1d", "v1p"), "v1d": (), "v1p": (), "v5": ("v5d", "v5s"), "v5d": (), "v5s": ("v5ss", "v5sp"),
        "v5ss": (), "v5sp": (), "vk": (), "vs": (), "vz": (), "adj-i": (), "-ます": (), "-ません": (), "-て": (), "-ば": (), "-く": (), "-た": (), "-ん": (), "-なさい": (), "-ゃ": (),
    },
    {
        "-ば": [_s("ければ", "い", ["-ば"], ["adj-i"]), *_godan(3, ["-ば"], end="ば", skip="る"), _s("れば", "る", ["-ば"], ["v1", "v5", "vk", "vs", "vz"]), _s("れば", "", ["-ば"], ["-ます"])],
        "-ゃ": [_s("けりゃ", "ければ", ["-ゃ"], ["-ば"]), _s("きゃ", "ければ", ["-ゃ"], ["-ば"]), _s("や", "えば", ["-ゃ"], ["-ば"]), *(_s(r[1] + "ゃ", r[3] + "ば", ["-ゃ"], ["-ば"]) for u, r in ROWS.items() if u != "う")],
        "-ちゃ": _te("ちゃ", ["v5"], irregular=False),
        "-ちゃう": _te("ちゃう", ["v5"], irregular=False),
        "-ちまう": _te("ちまう", ["v5"], irregular=False),
        "-しまう": [_s("てしまう", "て", ["v5"], ["-て"]), _s("でしまう", "で", ["v5"], ["-て"])],
        "-なさい": _masu("なさい", ["-なさい"]),
        "-そう": _masu("そう", [], True),
        "-すぎる": _masu("すぎる", ["v1"], True),
        "-過ぎる": _masu("過ぎる", ["v1"], True),
        "-たい": _masu("たい", ["adj-i"]),
        "-たら": [*_te("たら", [], "かったら"), _s("ましたら", "ます", [], ["-ます"])],
        "-たり": [*_te("たり", [], "かったり"), _s("ましたり", "ます", [], ["-ます"])],
        "-て": [*_te("て", ["-て"], "くて"), _s("まして", "ます", ["-て"], ["-ます"])],
        "-ず": _nai("ず", []),
        "-ぬ": _nai("ぬ", []),
        "-ん": _nai("ん", ["-ん"]),
        "-んばかり": _nai("んばかり", []),
        "-んとする": _nai("んとする", ["vs"]),
        "-む": _nai("む", []),
        "-ざる": _nai("ざる", []),
        "-ねば": _nai("ねば", ["-ば"]),
        "-く": [_s("く", "い", ["-く"], ["adj-i"])],
        "causative": [_s("させる", "る", ["v1"], ["v1"]), *_godan(0, ["v1"], end="せる"), *_CAUSATIVE],
        "short causative": [_s("さす", "る", ["v5ss"], ["v1"]), *(_s(r[0] + "す", u, ["v5ss" if u == "す" else "v5sp"], ["v5"]) for u, r in ROWS.items()), *_SHORT_CAUSATIVE],
        "imperative": [_s("ろ", "る", (), ["v1"]), _s("よ", "る", (), ["v1"]), *_godan(3, ()), *_irregular(["じろ", "ぜよ"], [("しろ", "する"), ("せよ", "する"), ("為ろ", "為る"), ("為よ", "為る")], "こい", ())],
        "continuative": [*(_s(c, c + "る", (), ["v1d"]) for c in _ICHIDAN_STEMS), *_godan(1, ()), *_irregular([], [("し", "する"), ("為", "為る")], "き", ())],
        "negative": [_s("くない", "い", ["adj-i"], ["adj-i"]), *_nai("ない", ["adj-i"], "じ", "し"), _s("ません", "ます", ["-ません"], ["-ます"])],
        "-さ": [_s("さ", "い", (), ["adj-i"])],
        "passive": [*(_s(r[0] + "れる", u, ["v1"], ["v5d", "v5sp"] if u == "す" else ["v5"]) for u, r in ROWS.items()), *_irregular(["じされる", "ぜされる"], [("される", "する"), ("為れる", "為る")], "こられる", ["v1"])],
        "-た": [*_te("た", ["-た"], "かった"), _s("ました", "ます", ["-た"], ["-ます"]), _s("でした", "", ["-た"], ["-ません"]), _s("かった", "", ["-た"], ["-ません", "-ん"])],
        "-ます": [
            _s("ます", "る", ["-ます"], ["v1"]), *(Rule("whole", v[:-1] + "います", v, ("-ます",), ("v5d",)) for v in HONORIFIC),
            *(_s(r[1] + "ます", u, ["-ます"], ["v5d", "v5s"] if u == "す" else ["v5d"]) for u, r in ROWS.items()),
            *_irregular(["じます"], [("します", "する"), ("為ます", "為る")], "きます", ["-ます"]), _s("くあります", "い", ["-ます"], ["adj-i"]),
        ],
        "potential": [_s("れる", "る", ["v1"], ["v1", "v5d"]), *_godan(3, ["v1"], ["v5d"], "る", skip="る"), *_irregular([], [("できる", "する"), ("出来る", "する")], "これる", ["v1"])],
        "potential or passive": [_s("られる", "る", ["v1"], ["v1"]), *_irregular(["ざれる", "ぜられる"], [("せられる", "する"), ("為られる", "為る")], "こられる", ["v1"])],
        "volitional": [_s("よう", "る", (), ["v1"]), *_godan(4, (), end="う"), *_irregular(["じよう"], [("しよう", "する"), ("為よう", "為る")], "こよう", ()), _s("ましょう", "ます", (), ["-ます"]), _s("かろう", "い", (), ["adj-i"])],
        "volitional slang": [_s("よっか", "る", (), ["v1"]), *_godan(4, (), end="っか"), *_irregular(["じよっか"], [("しよっか", "する"), ("為よっか", "為る")], "こよっか", ()), _s("ましょっか", "ます", (), ["-ます"])],
        "-まい": [_s("まい", "", (), ["v"]), _s("まい", "る", (), ["v1"]), *_irregular(["じまい"], [("しまい", "する"), ("為まい", "為る")], "こまい", ()), _s("まい", "", (), ["-ます"])],
        "-おく": [_s(a, b, ["v5"], ["-て"]) for a, b in (("ておく", "て"), ("でおく", "で"), ("とく", "て"), ("どく", "で"))] + [_s("ないでおく", "ない", ["v5"], ["adj-i"]), _s("ないどく", "ない", ["v5"], ["adj-i"])],
        "-いる": [_s(t + e, t, [n], ["-て"]) for t in "てで" for e, n in (("いる", "v1"), ("おる", "v5"), ("る", "v1p"))] + [_s("とる", "て", ["v5"], ["-て"]), _s("ないでいる", "ない", ["v1"], ["adj-i"])],
        "-き": [_s("き", "い", (), ["adj-i"])],
        "-げ": [_s("げ", "い", (), ["adj-i"]), _s("気", "い", (), ["adj-i"])],
        "-がる": [_s("がる", "い", ["v5"], ["adj-i"])],
        "-やがる": _masu("やがる", ["v5"]),
        "n-slang": [_s("んなさい", "りなさい", (), ["-なさい"]), _s("らんない", "られない", ["adj-i"], ["adj-i"]), _s("んない", "らない", ["adj-i"], ["adj-i"]), _s("んなきゃ", "らなきゃ", (), ["-ゃ"]), _s("んなきゃ", "れなきゃ", (), ["-ゃ"])],
        "imperative negative slang": [_s("んな", "る", (), ["v"])],
        "kansai-ben negative": [_s("へん", "ない", (), ["adj-i"]), _s("ひん", "ない", (), ["adj-i"]), _s("せえへん", "しない", (), ["adj-i"]), _s("へんかった", "なかった", ["-た"], ["-た"]), _s("ひんかった", "なかった", ["-た"], ["-た"]), _s("うてへん", "ってない", (), ["adj-i"])],
        "kansai-ben -て": _kansai_verbs("て", ["-て"]),
        "kansai-ben -た": _kansai_verbs("た", ["-た"]),
        "kansai-ben -たら": _kansai_verbs("たら", ()),
        "kansai-ben -たり": _kansai_verbs("たり", ()),
        "kansai-ben -く": _kansai_adjectives("", ["-く"]),
        "kansai-ben adjective -て": _kansai_adjectives("て", ["-て"]),
        "kansai-ben adjective negative": _kansai_adjectives("ない", ["adj-i"]),
    },
)
