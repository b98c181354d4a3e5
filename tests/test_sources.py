import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexengine.functions import processors as P
from lexengine.plans import translate
from lexengine.sources import archive, database
from lexengine.streaming import imports

TERMS = [
    ["打", "だ", "n", "n", 10, ["one", {"type": "image", "path": "a/b.png"}], 1, "E1"],
    ["打つ", "うつ", "vt", "v5", 10, ["two"], 3, ""],
    ["打つ", "ぶつ", "vt", "v5", 1, [{"type": "text", "text": "three"}], 3, "P E1"],
    ["English", "", "n", "n", 1, ["four"], 19, ""],
    ["form", "form", None, "", 0, [["base", ["past"]]], 16, ""],
]
META = [
    ["打", "freq", 1], ["打", "freq", "four"], ["打", "freq", "five (5)"], ["打", "freq", {"value": 7, "displayValue": "seven"}],
    ["打", "freq", {"reading": "だ", "frequency": "twenty (20)"}], ["打", "freq", {"reading": "だ", "frequency": {"value": 27, "displayValue": "twenty-seven"}}],
    ["打つ", "pitch", {"reading": "うつ", "pitches": [{"position": 2, "nasal": 3, "tags": ["P1"]}, {"position": "HHL", "devoice": [1, 2]}]}],
]
INDEX = {"title": "Test", "format": 3, "revision": "r1", "sequenced": True, "tagMeta": {"old": {"category": "c", "order": 2, "notes": "n", "score": 1}}}
FILES = {
    "index.json": INDEX, "term_bank_1.json": TERMS, "term_meta_bank_1.json": META, "kanji_bank_1.json": [["打", "ダ", "う.つ ぶ.つ", "K1", ["strike"], {"k": "1"}]],
    "kanji_meta_bank_1.json": [["打", "freq", 3]], "tag_bank_1.json": [["E1", "default", 0, "example", 0], ["P", "popular", 1, "", 5]],
}


def packed(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in files.items():
            z.writestr(name, json.dumps(content))
        z.writestr("a/b.png", b"picture")
    return str(path)


def test_archive(spark, tmp_path):
    t = archive.load(spark, packed(tmp_path / "d.zip", FILES))
    rows = t.terms.orderBy("sequence", "reading").collect()
    assert [(r.expression, r.reading, r.rules, r.score, r.sequence, r.term_tags) for r in rows][:2] == [("打", "だ", ["n"], 10.0, 1, ["E1"]), ("打つ", "うつ", ["v5"], 10.0, 3, [])]
    assert next(r for r in rows if r.sequence == 19).reading == "English"
    assert next(r for r in rows if r.sequence == 16).definition_tags == []
    assert [(r.frequency, r.display_value, r.reading) for r in archive.frequencies(t.term_meta).collect()] == [
        (1.0, None, None), (0.0, "four", None), (5.0, "five (5)", None), (7.0, "seven", None), (20.0, "twenty (20)", "だ"), (27.0, "twenty-seven", "だ"),
    ]
    assert [(r.position, r.nasal, r.devoice, r.tags) for r in archive.pitches(t.term_meta).collect()] == [("2", [3], [], ["P1"]), ("HHL", [], [1, 2], [])]
    assert {r.name for r in t.tags.collect()} == {"E1", "P", "old"}
    assert [(r.path, bytes(r.content)) for r in t.media.collect()] == [("a/b.png", b"picture")]
    assert t.kanji.collect()[0].kunyomi == ["う.つ", "ぶ.つ"] and t.kanji.collect()[0].stats == {"k": "1"}


def test_first_format(spark, tmp_path):
    files = {"index.json": {"title": "Old", "version": 1, "revision": "1"}, "term_bank_1.json": [["a", "", "n", "", 2, "x", "y"]], "kanji_bank_1.json": [["b", "", "", "", "m1", "m2"]]}
    t = archive.load(spark, packed(tmp_path / "o.zip", files))
    r = t.terms.collect()[0]
    assert (r.reading, [json.loads(g) for g in r.glossary], r.sequence) == ("a", ["x", "y"], -1)
    assert t.kanji.collect()[0].meanings == ["m1", "m2"]


@pytest.mark.parametrize(
    "bad",
    [
        {"index.json": INDEX | {"format": 0}}, {"index.json": {"format": 3, "title": "x"}}, {"term_bank_1.json": [["a", "b", "", "", 1, False, 1, ""]]},
        {"term_bank_1.json": False}, {"term_meta_bank_1.json": [["a", "other", 1]]}, {"kanji_bank_1.json": [[]]}, {"kanji_meta_bank_1.json": {}},
        {"tag_bank_1.json": [[{"no": "name"}, "", 0, "", 0]]},
    ],
)
def test_invalid_archives_are_refused(spark, tmp_path, bad):
    t = archive.load(spark, packed(tmp_path / "bad.zip", FILES | bad))
    with pytest.raises(Exception, match="row|format|revision|list|glossary|text"):
        for name in database.NAMES:
            getattr(t, name).collect()


def test_database(spark, tmp_path):
    one = archive.load(spark, packed(tmp_path / "1.zip", FILES))
    two = archive.load(spark, packed(tmp_path / "2.zip", FILES | {"index.json": INDEX | {"title": "Other: b"}}))
    db = database.Database(spark, f"file://{tmp_path}/db")
    db.add(one)
    db.add(two)
    assert db.titles() == ["Other: b", "Test"] and db.incomplete() == []
    with pytest.raises(ValueError, match="already"):
        db.add(one)
    counts = {(r.dictionary, r.name): r.n for r in db.counts().collect()}
    assert counts["Test", "terms"] == 5 and counts[None, "terms"] == 10
    assert db.delete("Other: b")["terms"] == 5
    assert db.titles() == ["Test"] and db.table("terms").count() == 5
    rows, contents = database.deduplicated(db.table("terms"))
    assert rows.count() == 5 and contents.count() <= 5
    db.export(f"file://{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy/terms").count() == 5
    db.purge()
    assert not db.has("terms")


def test_database_maintenance(spark, tmp_path):
    rows = lambda n: {"terms": [(f"w{i}", "A" if i % 2 else "B") for i in range(n)], "media": [("A", "x.png", b"1"), ("B", "y.png", b"2")]}
    made = rows(20)
    empty = spark.createDataFrame([], "dictionary string")
    tables = database.Tables(
        spark.createDataFrame([("A", "r1", True), ("B", "r1", True)], "title string, revision string, importSuccess boolean"),
        spark.createDataFrame(made["terms"], "expression string, dictionary string"), empty, empty, empty, empty,
        spark.createDataFrame(made["media"], "dictionary string, path string, content binary"),
    )
    db = database.Database(spark, f"file://{tmp_path}/db")
    db.add(tables)
    assert db.update("A", revision="r2") == 1 and db.update("none", revision="r2") == 0
    assert {(r.title, r.revision) for r in db.table("dictionaries").collect()} == {("A", "r2"), ("B", "r1")}
    with pytest.raises(ValueError):
        db.update("A", nothing=1)
    db.rename("B", "C d")
    assert db.titles() == ["A", "C d"] and db.table("terms").filter("dictionary = 'C d'").count() == 10 and db.probe("C d").startswith("w")
    db.replace("A", "C d")
    assert db.titles() == ["A"] and db.table("terms").count() == 10 and db.table("dictionaries").first().revision == "r1"
    wanted = spark.createDataFrame([(1, "A", "y.png"), (2, "A", "y.png"), (3, "A", "none")], "k int, dictionary string, path string")
    assert {(r.k, bytes(r.content) if r.content else None) for r in db.media(wanted).collect()} == {(1, b"2"), (2, b"2"), (3, None)}
    ids = [r.id for r in db.with_ids("terms", spark.range(500).withColumnRenamed("id", "n").withColumn("m", F.col("n") % 7)).collect()]
    assert sorted(ids) == list(range(1, 501))
    db.export(f"file://{tmp_path}/out")
    db.update("A", importSuccess=False)
    assert db.cleaned() == ["A"] and db.titles() == []
    database.restored(f"file://{tmp_path}/out", db)
    assert db.titles() == ["A"] and db.table("terms").count() == 10
    index = spark.createDataFrame([("A", "1", "https://a.example/i.json", "http://a.example/d.zip"), ("B", "2", "ftp://x", None)], "title string, revision string, indexUrl string, downloadUrl string")
    assert {(r.title, r.n_terms, r.updatable) for r in database.summary(index, tables.terms).collect()} == {("A", 10, True), ("B", 10, False)}


def test_streamed_import(spark, tmp_path):
    (tmp_path / "banks").mkdir()
    at = [str(tmp_path / x) for x in ("banks", "out", "state")]
    (tmp_path / "banks" / "term_bank_1.json").write_text(json.dumps(TERMS[:2]))
    imports.import_terms(spark, *at, "D").awaitTermination()
    (tmp_path / "banks" / "term_bank_2.json").write_text(json.dumps(TERMS[2:]))
    imports.import_terms(spark, *at, "D").awaitTermination()
    assert spark.read.parquet(at[1]).count() == 5


def test_processors():
    assert P.variants("Straße", P.BEFORE["de"]) == ["Straße", "Strasse", "straße", "strasse"]
    assert P.reassemble_hangul(P.disassemble_hangul("마시거나 값이 왜")[0]) == ["마시거나 값이 왜"]
    assert P.serbo_croatian("dj") == ["dj", "đ"] and len(P.serbo_croatian("c" * 20)) == P.MOST
    assert "ウツ" in P.variants("ｳﾂ", P.BEFORE["ja"]) and "うつ" in P.variants("ｳﾂ", P.BEFORE["ja"])
    assert P.variants("l'amico", P.BEFORE["it"])[-1] != "" and "amico" in P.variants("l'amico", P.BEFORE["it"])
    assert "все" in P.variants("всё", P.BEFORE["ru"])


def test_full_lookup(spark):
    rows = [
        (1, "A", 0, "walk", "walk", ["v"], 5.0, 1), (2, "A", 0, "walk", "walk", ["n"], 1.0, 2), (3, "B", 1, "walked", "walked", ["adj"], 0.0, -1),
        (4, "A", 0, "wal", "wal", ["n"], 0.0, 3),
    ]
    terms = spark.createDataFrame(rows, "id long, dictionary string, dict_idx int, expression string, reading string, rules array<string>, score double, sequence long")
    q = spark.createDataFrame([(0, "Walked home"), (1, "zzz")], "query_id int, text string")
    found = translate.find_terms(q, terms, "en", "split").orderBy("rank").collect()
    assert [(r.term, r.source_length, r.definitions) for r in found] == [("walked", 6, 1), ("walk", 6, 1), ("walk", 4, 1), ("wal", 3, 1)]
    grouped = translate.find_terms(q, terms, "en", "term").orderBy("rank").collect()
    assert [r.term for r in grouped] == ["walked", "walk", "walk", "wal"]  # one walk through its past, one as it is
    assert translate.find_terms(q, terms, "en", "merge", main="A").filter(F.col("query_id") == 1).count() == 0
    assert [r.term for r in translate.find_terms(q, terms, "en", "split", resolution="word").orderBy("rank").collect()] == ["walked", "walk"]
    with pytest.raises(ValueError):
        translate.find_terms(q, terms, "en", "other")
