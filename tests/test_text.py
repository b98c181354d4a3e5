import random
from collections import Counter

import pytest

from lexengine.functions import japanese as J
from lexengine.functions import text as T
from lexengine.functions.inflections import ENGLISH, GERMAN, JAPANESE, LANGUAGES, SPANISH
from lexengine.operators import tokens
from lexengine.operators.deinflect import Language, closure


@pytest.mark.parametrize(
    ("language", "source", "term", "reason"),
    [
        (ENGLISH, "walked", "walk", "past"), (ENGLISH, "hoping", "hope", "ing"), (ENGLISH, "stopped", "stop", "past"),
        (ENGLISH, "looked up", "look up", "past"), (ENGLISH, "happier", "happy", "comparative"), (ENGLISH, "tries", "try", "plural"),
        (GERMAN, "gekauft", "kaufen", "past participle"), (GERMAN, "aufzumachen", "aufmachen", "zu-infinitive"),
        (JAPANESE, "打ち込んでいませんでした", "打ち込む", "-て"), (JAPANESE, "食べられなかった", "食べる", "potential or passive"),
        (JAPANESE, "行って", "行く", "-て"), (JAPANESE, "高くなければ", "高い", "negative"), (JAPANESE, "のたもうた", "のたまう", "-た"),
        (JAPANESE, "読んじゃう", "読む", "-ちゃう"), (JAPANESE, "来させる", "来る", "causative"), (JAPANESE, "しよう", "する", "volitional"),
        (LANGUAGES["eo"], "malbonajn", "bona", "mal-"), (LANGUAGES["la"], "populi", "populus", "plural"), (LANGUAGES["ga"], "mbean", "bean", "eclipsis"),
        (LANGUAGES["eu"], "etxearekin", "etxe", "Comitative Singular"), (LANGUAGES["grc"], "λογοις", "λογος", "dative plural"), (LANGUAGES["ar"], "والكتاب", "كتاب", "NPref-Al"), (LANGUAGES["ar"], "سيكتبون", "كتب", "IVPref-hm"), (LANGUAGES["ar"], "كتبتم", "كتب", "PVSuff-t"), (LANGUAGES["yi"], "בוכסל", "בוכס", "diminutive"), (LANGUAGES["sq"], "punova", "punuaj", "aorist first-person singular indicative"),
        (SPANISH, "hablamos", "hablar", "present indicative"), (SPANISH, "canciones", "canción", "plural"),
    ],
)
def test_closure_finds_the_dictionary_form(language, source, term, reason):
    assert any(t == term and trace and reason in (trace[0], trace[-1]) for t, _, trace in closure(language, source))


def test_conditions_stop_impossible_chains():
    # a plural of a past form isn't one
    assert not any(t == "walk" and trace == ("past", "plural") for t, _, trace in closure(ENGLISH, "walkeds"))


def test_conditions_compile_to_flags():
    assert ENGLISH.flags["n"] == ENGLISH.flags["np"] | ENGLISH.flags["ns"]
    with pytest.raises(ValueError):
        Language("x", {"a": ("b",), "b": ("a",)}, {})
    with pytest.raises(ValueError):
        Language("x", {str(i): () for i in range(33)}, {})


def test_kana():
    assert J.to_hiragana("カタカナー") == "かたかなあ"
    assert J.to_katakana("ひらがな") == "ヒラガナ"
    assert J.half_kana_to_full("ｶﾞﾊﾟｱ") == "ガパア"
    assert J.to_half_width(J.to_full_width("aZ9")) == "aZ9"
    assert J.morae("きょうと") == ["きょ", "う", "と"]
    assert J.collapse_emphatic("すっっごーーい", False) == "すっごーい"
    assert J.collapse_emphatic("すっっごーーい", True) == "すごい"
    assert J.repeat_marks_to_kanji("人々") == "人人" and J.kanji_to_repeat_marks("人人") == "人々"


def test_pitch():
    assert [J.pitch_category("うちこむ", p) for p in (0, 1, 3, 4)] == ["heiban", "atamadaka", "nakadaka", "odaka"]
    assert J.downsteps("LHHL") == [3] and J.downsteps("LHH") == [0] and J.downsteps("HHH") == [-1]


def test_furigana():
    assert J.furigana("打ち込む", "うちこむ") == [("打", "う"), ("ち", ""), ("込", "こ"), ("む", "")]
    assert J.furigana("テスト", "テスト") == [("テスト", "")]
    assert J.furigana("日本語", "にほんご") == [("日本語", "にほんご")]


def test_sentence():
    assert T.sentence_at("One. Two is here! Three", 7) == ("Two is here!", 2)
    assert T.sentence_at("first\nsecond", 8) == ("second", 2)
    assert T.sentence_at("これは「中。身」です。次", 1)[0] == "これは「中。身」です。"
    assert T.sentence_at("「中。身」です。次", 2)[0] == "中。"
    assert T.sentence_at("", 0) == ("", 0)


def test_replacements():
    assert T.replaced("打(う)ち", r"\(([^)]*)(?:\))", "") == "打ち"
    assert T.replaced("(打)", r"\(([^)]*)(?:\))", "$1") == "打"
    assert T.replaced("ab", r"(?<x>a)", "$<x>$2$$") == "aundefined$$b"
    assert T.replaced("a", "(", "x") == "a"


def test_segments():
    assert tokens.segments("the catx", {"the", "cat", "c"}, 3) == [(0, 3, True), (3, 4, False), (4, 7, True), (7, 8, False)]
    assert tokens.segments("", {"a"}, 1) == []


def test_notes(spark):
    from pyspark.sql import functions as F

    from lexengine.functions import notes as N

    row = spark.createDataFrame([("a::b", "{x} and {y-1}", "<a='`>", "https://M.Example.com/a", 2, ["shift"])], "deck string, field string, raw string, url string, level int, keys array<string>")
    context = {"url": F.col("url"), "popupLevel": F.col("level"), "modifierKeys": F.col("keys")}
    out = row.select(
        N.root_deck(F.col("deck")).alias("root"), N.field_markers(F.col("field")).alias("markers"), N.escaped(F.col("raw")).alias("escaped"),
        N.first_match([[("url", "matchDomain", "m.example.com"), ("popupLevel", "greaterThan", 1)]], context).alias("yes"),
        N.first_match([[], [("modifierKeys", "are", "ctrl")]], context).alias("no"),
        N.first_match([[("modifierKeys", "notInclude", "ctrl"), ("unknown", "x", "y")]], context).alias("skipped"),
        N.primary_segment(F.lit("食べ物を買う。次")).alias("segment"), N.lookup_worthy(F.lit("abc"), "ja").alias("worthy"),
    ).collect()[0]
    assert (out.root, out.markers, out.escaped) == ("a", ["x", "y-1"], "&lt;a&#x3D;&#x27;&#x60;&gt;")
    assert out.yes and not out.no and out.skipped and out.segment == "食べ物" and not out.worthy
    parts = J.furigana("打ち込む", "うちこむ")
    assert N.furigana_plain(parts) == "打[う]ち 込[こ]む"
    assert N.furigana_html(parts) == "<ruby>打<rt>う</rt></ruby>ち<ruby>込<rt>こ</rt></ruby>む"
    assert N.cloze("one two three", 4, "two") == {"prefix": "one ", "body": "two", "suffix": " three"}


def test_short_notes_are_contained(spark):
    notes = spark.createDataFrame([(1, "anvil"), (2, "blue anvil"), (3, "nvil i"), (4, "gear"), (5, ""), (6, None), (7, "is blue here"), (8, "the blue anvil is here")], "item_id long, text string")
    texts = spark.createDataFrame([("the blue anvil is here",), (None,), ("nothing",)], "text string")
    out = {r.item_id: r.known for r in tokens.contained(notes, texts).collect()}
    assert out == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False, 8: True}


def test_texts_are_tokenized_by_every_word(spark):
    """More words than were kept before, and the segments that each text has by itself."""
    rng = random.Random(6)
    many = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(51_000)]
    rows = [(i, "xx", " ".join(many)) for i in range(3)]
    for i in range(3, 60):
        text = "".join(rng.choice([rng.choice(many), rng.choice(many).upper(), "ab", "q", " ", ", ", "²x", "日本", "İ", ""]) for _ in range(rng.randint(0, 15)))
        rows.append((i, rng.choice(["xx", "yy", None]), text))
    rows += [(60, "xx", None), (60, "xx", "ab"), *[(i, None, "null word 日") for i in range(61, 65)]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    known: dict = {}
    for r in tokens.vocabulary(docs).collect():
        lang, word = r.entry.split("\n")
        known.setdefault(None if lang == "-" else lang[1:], set()).add(word)
    assert set(many) <= known["xx"] and "null" in known[None]
    expected = Counter()
    for i, lang, text in rows:
        found = tokens.segments(text or "", known.get(lang, set()), 20)
        expected[i, len(found), sum(k for *_, k in found), sum(e - s for s, e, k in found if k)] += 1
    assert Counter(map(tuple, tokens.tokenized(docs, tokens.vocabulary(docs)).collect())) == expected


def test_merged_lookup_gives_all_entries(spark):
    from lexengine.plans import catalog

    out = catalog.find_terms_merge(spark, "/root/testdata/sf0.01")
    assert out.agg({"rank": "max"}).first()[0] > 10


def test_kana_and_letters():
    from lexengine.functions import japanese as J

    pairs = {"きゃ": "kya", "しゅ": "shu", "がっこう": "gakkou", "まっちゃ": "matcha", "しんよう": "shin'you", "さんぽ": "sanpo", "ちょうちん": "chouchin", "つき": "tsuki", "ふじ": "fuji"}
    for kana, letters in pairs.items():
        assert J.to_romaji(kana) == letters and J.from_romaji(letters) == kana
    assert J.to_romaji("カード abc") == "kaado abc" and J.from_romaji("Tsuki 1") == "つき 1" and J.from_romaji("situ") == "しつ"
    assert [J.kana_script(c) for c in "あアｱ漢"] == ["hiragana", "katakana", "katakana", None]
    assert J.kana_diacritic("が") == ("か", "dakuten") and J.kana_diacritic("ぱ") == ("は", "handakuten") and J.kana_diacritic("か") is None
    assert J.is_korean("한") and J.is_korean("ㅏ") and not J.is_korean("字")


def test_template_operators(spark):
    from pyspark.sql import functions as F

    from lexengine.functions import content as C

    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    one, two, zero = F.lit(5), F.lit(2), F.lit(0)
    got = [value(C.op(name, one, two)) for name in ("+", "-", "*", "/", "%", "**", "==", "!==", "<", ">=", "<<", ">>", "&", "|", "^", "&&", "||")]
    assert got == [7, 3, 10, 2.5, 1, 25.0, False, True, False, True, 20, 1, 0, 7, 7, 2, 5]
    assert value(C.op("/", one, zero)) is None and value(C.op("?:", F.lit(True), one, two)) == 5 and value(C.op("-", one)) == -5
    with pytest.raises(ValueError):
        C.op("?", one)
    json = F.lit('{"a": [1, {"b": "x"}], "c": null}')
    assert value(C.property_of(json, "a", 1, "b")) == "x" and value(C.property_of(json, "z")) is None
    assert [value(C.kind_of(F.lit(t))) for t in ('{"a":1}', "[1]", '"x"', "1.5", "true", "{")] == ["object", "object", "string", "number", "boolean", "undefined"]
    assert value(C.joined("-", F.lit("a"), F.lit(None), F.lit(3))) == "a-3" and value(F.size(C.spread(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3))))) == 3
