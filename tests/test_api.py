from lexengine.api import Service


def test_service(spark):
    rows = [(1, "A", 0, "walk", "walk", ["v"], 5.0, 1), (2, "A", 0, "home", "home", ["n"], 1.0, 2)]
    terms = spark.createDataFrame(rows, "id long, dictionary string, dict_idx int, expression string, reading string, rules array<string>, score double, sequence long")
    s = Service(spark, terms)
    code, body = s.call("termEntries", {"term": "walked home"})
    assert code == 200 and body["originalTextLength"] == 6 and body["dictionaryEntries"][0]["term"] == "walk"
    assert [x["text"] for x in s.call("tokenize", {"text": "walk home"})[1][0]["content"]] == ["walk", " ", "home"]
    assert s.call("kanjiEntries", {"character": "a"}) == (200, [])
    assert s.call("nothing", {})[0] == 400 and s.call("termEntries", {"wrong": 1})[0] == 500


def test_the_library_stands_without_its_llm_part():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lexengine"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p.name for p in others if "lexengine.llm" in p.read_text()]
