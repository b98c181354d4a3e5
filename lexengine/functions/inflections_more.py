"""Inflection rules of languages with few endings. Endings are fixed values."""

from __future__ import annotations

from lexengine.operators.deinflect import Language, Rule


def _s(a, b, needs=(), gives=()):
    return Rule("suffix", a, b, tuple(needs), tuple(gives))


def _p(a, b="", needs=(), gives=()):
    return Rule("prefix", a, b, tuple(needs), tuple(gives))


def _pairs(text: str, needs=(), gives=()):
    """Rules from "ending>ending" words."""
    return [_s(*p.split(">"), needs, gives) for p in text.split()]


ESPERANTO = Language(
    "eo",
    {"n": (), "adj": (), "adv": (), "v": ()},
    {
        "accusative": [_s("n", "")], "plural": [_s("j", "")], "diminutive": [_s("eto", "o", (), ["n"])], "directional": [_s("en", "e", (), ["adv"])],
        "locational": [_s("e", "o", (), ["n"])], "adjectival": [_s("a", "o", (), ["n"])],
        "adverbial (adj -> adv)": [_s("e", "a", (), ["adj"])], "adverbial (v -> adv)": [_s("e", "i", (), ["v"])],
        "-ejo (noun)": [_s("ejo", "o", (), ["n"])], "-ejo (verb)": [_s("ejo", "i", (), ["v"])], "-ujo (noun)": [_s("ujo", "o", (), ["n"])],
        "-ujo (adjective)": [_s("ujo", "a", (), ["adj"])], "-ujo (verb)": [_s("ujo", "i", (), ["v"])], "-ebla": [_s("ebla", "i", (), ["v"])], "-ado": [_s("ado", "i", (), ["v"])],
        **{f"{p}-": [_p(p)] for p in "mal kun ekster ek ĵus el dis for mis".split()},
    },
)

LATIN = Language(
    "la",
    {
        "v": (), "n": ("ns", "np"), "ns": tuple(f"n{i}s" for i in range(1, 6)), "np": tuple(f"n{i}p" for i in range(1, 6)),
        **{f"n{i}": (f"n{i}s", f"n{i}p") for i in range(1, 6)}, **{f"n{i}{k}": () for i in range(1, 6) for k in "sp"},
        "adj": ("adj3", "adj12"), "adj12": (), "adj3": (), "adv": (),
    },
    {
        "plural": [_s("i", "us", ["n2p"], ["n2s"]), _s("i", "us", ["adj12"], ["adj12"]), _s("e", "", ["n1p"], ["n1s"]), _s("ae", "a", ["adj12"], ["adj12"]), _s("a", "um", ["adj12"], ["adj12"])],
        "feminine": [_s("a", "us", ["adj12"], ["adj12"])], "neuter": [_s("um", "us", ["adj12"], ["adj12"])], "ablative": [_s("o", "um", ["n2s"], ["n2s"])],
    },
)

_WORDS = {"v": (), "n": ("np", "ns"), "np": (), "ns": (), "adj": (), "adv": ()}
IRISH = Language(
    "ga", {**_WORDS, "v": ("v_phr",), "v_phr": ()},
    {"eclipsis": [_p(a, b, ["n"], ["n"]) for a, b in (x.split(">") for x in "mb>b gc>c nd>d bhf>f ng>g bp>p dt>t".split())]},
)

_NOMINAL = (["n", "adj"], ["n", "adj"])
#: The name is not the code that lookups use, so that Georgian is deinflected only when it is asked for by this name.
GEORGIAN = Language(
    "kat", dict(_WORDS),
    {
        "nounAdjSuffixStripping": [_s(x, "", *_NOMINAL) for x in "ები ებს ებების მა ს ის ით ად ო ში ზე შია ზეა".split()],
        "nounAdjStemCompletion": _pairs("გნ>გნი ნ>ნი", *_NOMINAL), "vowelRestoration": _pairs("გ>გა", *_NOMINAL),
    },
)

#: Cases with their endings in singular, plural and indefinite; those in the second table also make adverbs.
_BASQUE_CASES = {
    "Absolutive": "a ak -", "Ergative": "ak ek k", "Dative": "ari ei ri", "Genitive": "aren en ren", "Comitative": "arekin ekin rekin",
    "Inessive": "an etan tan", "Allative": "ra etara tara", "Ablative": "tik etatik tatik", "Locative Genitive": "ko etako tako",
    "Directional Allative": "rantz etarantz tarantz", "Terminative Allative": "raino etaraino taraino", "Inessive Animate": "arengan engan rengan",
    "Allative Animate": "arengana engana rengana", "Ablative Animate": "arengandik engandik rengandik",
    "Directional Allative Animate": "arenganantz enganantz renganantz", "Terminative Allative Animate": "arenganaino enganaino renganaino",
}
_BASQUE_ADVERBIAL = {"Benefactive": "arentzat entzat rentzat", "Instrumental": "az ez z"}
_BASQUE_VERBS = {
    "Future Participle": ("v", "ko>"), "Future Participle (Voiced)": ("v", "go>"), "Habitual to -tu": ("v", "tzen>tu"), "Habitual to -tu (Soft)": ("v", "ten>tu"),
    "Habitual to -i": ("v", "tzen>i"), "Habitual to -n": ("v", "ten>n"), "Habitual to -si": ("v", "sten>si"), "Habitual to -tzi": ("v", "zten>tzi"), "Habitual to -tsi": ("v", "sten>tsi"),
    "Verbal Noun to -tu": ("n", "tzea>tu"), "Verbal Noun to -tu (Soft)": ("n", "tea>tu"), "Verbal Noun to -i": ("n", "tzea>i"), "Verbal Noun to -n": ("n", "tea>n"),
    "Verbal Noun to -si": ("n", "stea>si"), "Verbal Noun to -tzi": ("n", "ztea>tzi"), "Adverbial Participle to -tu": ("adv", "ta>"), "Adverbial Participle after n": ("adv", "da>"),
    "Adverbial Participle to -i": ("adv", "ita>i"), "Negative/Adverbial Participle 1": ("adv", "ik>"), "Negative/Adverbial Participle 2": ("adv", "rik>"),
}
BASQUE = Language(
    "eu", {"n": (), "adj": (), "adv": (), "v": ()},
    {
        **{
            f"{case} {number}": [_s(ending, "", [*_NOMINAL[0], *more], _NOMINAL[1])]
            for cases, more in ((_BASQUE_CASES, []), (_BASQUE_ADVERBIAL, ["adv"]))
            for case, endings in cases.items()
            for number, ending in zip(("Singular", "Plural", "Indefinite"), endings.split())
            if ending != "-"
        },
        "Locative Genitive Singular (Voiced)": [_s("go", "", *_NOMINAL)],
        **{name: _pairs(pair, [needs], ["v"]) for name, (needs, pair) in _BASQUE_VERBS.items()},
        "Adverbializer -ki": [_s("ki", "", ["adv"], ["n", "adj"])],
    },
)


def _not_after_j(pair: str):
    """An ending that does not follow a j."""
    a, b = pair.split(">")
    return Rule("other", f".*[^j]{a}\\Z", lambda t: t[: len(t) - len(a)] + b, (), ("v",))


#: Forms of Albanian verbs; the second part holds endings that do not follow a j.
_ALBANIAN = {
    "present indicative second-person singular": ("on>oj uan>uaj n>j hesh>hem", ""), "present indicative third-person singular": ("on>oj uan>uaj n>j het>hem", ""),
    "present indicative first-person plural": ("më> im> hemi>hem", ""), "present indicative second-person plural": ("ni>j ni> heni>hem", ""), "present indicative third-person plural": ("në> in> hen>hem", ""),
    "imperfect first-person singular indicative": ("ja>j ja> hesha>hem", ""), "imperfect second-person singular indicative": ("je>j je> heshe>hem", ""), "imperfect third-person singular indicative": ("nte>j te> hej>hem", ""),
    "imperfect first-person plural indicative": ("nim>j nim> heshim>hem", ""), "imperfect second-person plural indicative": ("nit>j nit> heshit>hem", ""), "imperfect third-person plural indicative": ("nin>j nin> heshin>hem", ""),
    "aorist first-person singular indicative": ("ova>uaj va>j", "a>"), "aorist second-person singular indicative": ("ove>uaj ve>j", "e>"), "aorist third-person singular indicative": ("oi>oj oi>uaj u>j ye>ej", "i>"),
    "aorist first-person plural indicative": ("uam>oj uam>uaj më>j", "ëm>"), "aorist second-person plural indicative": ("uat>oj uat>uaj të>j", "ët>"), "aorist third-person plural indicative": ("uan>oj uan>uaj në>j", "ën>"),
    "imperative second-person singular present": ("o>oj hu>hem", ""), "imperative second-person plural present": ("ni>j ni> huni>hem", ""), "participle": ("uar>oj ur> rë>j yer>ej", ""),
    "optative first-person singular present": ("fsha>j", ""), "optative second-person singular present": ("fsh>j", ""), "optative third-person singular present": ("ftë>j", ""),
    "optative first-person plural present": ("fshim>j", ""), "optative second-person plural present": ("fshi>j", ""), "optative third-person plural present": ("fshin>j", ""), "nominalization": ("im>oj im>ej je>", ""),
}
ALBANIAN = Language(
    "sq", dict(_WORDS),
    {
        "definite": _pairs("ku>k gu>g hu>h au>a iu>i eu>e i>ë i>", (), ["n"]), "singular definite accusative": [_s("n", "", (), ["n"])],
        "plural": _pairs("e> t>", ["np"], ["ns"]), "mediopassive": _pairs("hem>h hem>j", ["v"], ["v"]),
        **{name: [*_pairs(plain, (), ["v"]), *map(_not_after_j, others.split())] for name, (plain, others) in _ALBANIAN.items()},
    },
)

#: Forms of Ancient Greek words, written without accents.
_GREEK_VERBS = {
    "2nd person singular present active indicative": "εις>ω εις>εω", "3rd person singular present active indicative": "ει>ω ει>εω", "1st person plural present active indicative": "ομεν>ω",
    "2nd person plural present active indicative": "ετε>ω", "3rd person plural present active indicative": "ουσι>ω ουσιν>ω", "2nd person singular present middle indicative": "ῃ>ομαι ει>ομαι",
    "3rd person singular present middle indicative": "εται>ομαι", "1st person plural present middle indicative": "ομεθα>ομαι", "2nd person plural present middle indicative": "εσθε>ομαι",
    "3rd person plural present middle indicative": "ονται>ομαι", "nominalization": "ος>εω",
}
_GREEK_NOUNS = {
    "genitive singular": "ου>ος ας>α ου>ας ου>ον ης>η", "dative singular": "ω>ος α>ας ω>ον", "accusative singular": "ον>ος αν>α αν>ας ην>η", "vocative singular": "ε>ος α>ας η>η",
    "nominative plural": "οι>ος αι>α αι>ας α>ον αι>η", "genitive plural": "ων>ος ων>α ων>ας ων>ον ων>η", "dative plural": "οις>ος αις>α αις>ας οις>ον αις>η",
    "accusative plural": "ους>ος ας>α α>ον ας>η", "vocative plural": "οι>ος αι>α αι>ας α>ον αι>η",
}
ANCIENT_GREEK = Language(
    "grc", {"v": (), "n": (), "adj": ()},
    {
        **{name: _pairs(forms, (), ["v"]) for name, forms in _GREEK_VERBS.items()}, **{name: _pairs(forms, (), ["n"]) for name, forms in _GREEK_NOUNS.items()},
        "accusative singular masculine": [_s("ον", "ος", (), ["adj"])],
    },
)

#: Yiddish vowels as they are changed and as they were, and letters that count as vowels.
_UMLAUTS = (("ע", "אַ"), ("ע", "אָ"), ("ע", "א"), ("ױ", "ע"), ("ײ", "ױ"), ("י", "ו"))
_YIDDISH_VOWELS = "עװאאַױוײיִײַיאָ"


def _umlaut(ending: str, needs, gives):
    """Rules that drop an ending and take back the change of the last vowel."""

    def one(new: str, old: str):
        def back(text: str) -> str:
            last = max(text.rfind(v) for v in _YIDDISH_VOWELS)
            return text[:last] + old + text[last + 1 : len(text) - len(ending)] if last >= 0 and text[last] == new else ""

        return Rule("other", f"{ending}\\Z", back, tuple(needs), tuple(gives))

    return [one(new, old) for new, old in _UMLAUTS]


YIDDISH = Language(
    "yi",
    {"v": ("vpast", "vpresent"), "vpast": (), "vpresent": (), "n": ("np", "ns"), "np": (), "ns": (), "adj": (), "adv": ()},
    {
        "plural": [_s(x, "", ["np"], ["ns"]) for x in "ס ן ים ער עך ען עס ות נס ערען ענעס ענס ערס".split()],
        "umlaut_plural": [r for x in "ער עס ים ען ן ס עך ערס".split() for r in _umlaut(x, ["np"], ["ns"])],
        "diminutive": [_s(x, "", ["n"], ["n"]) for x in "טשיק קע ל עלע".split()],
        "diminutive_and_umlaut": [r for x in "ל עלע".split() for r in _umlaut(x, ["n"], ["n"])],
        "verb_present_singular_to_first_person": [_s(x, "", ["v"], ["vpresent"]) for x in "סט ט נדיק".split()],
        "verb_present_plural_to_first_person": _pairs("טס>נ ט>נ", ["v"], ["vpresent"]),
    },
)
