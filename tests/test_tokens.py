"""Memory of the Python workers that tokenize texts."""

import random

import pandas as pd

from lexengine.operators import tokens
from lexengine.staging import staged


def test_workers_hold_few_texts(spark):
    """What a worker gets and gives at once follows a number of characters, not the rows of a partition."""
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    batch = pd.DataFrame({"key": range(2000), "doc_id": range(2000), "lang": "en", "text": text})
    frames = list(tokens._runs([batch]))
    assert sum(map(len, frames)) == 2000 and max(map(len, frames)) * len(text) < 2 * tokens.AT_ONCE

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = staged(spark.range(0, 3000, 1, 1).mapInPandas(sizes, "n long")).collect()
    assert sum(r.n for r in rows) == 3000 and max(r.n for r in rows) <= 256
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_languages_of_any_characters(spark):
    """A line feed in a language's name does not change a text's segments, nor does a cache that is too small for the runs."""
    rows = [(i, lang, "alphabeta beta alpha q日本") for i, lang in enumerate(["a\nb", "a\nb", "a\nb", "c"])]
    rows += [(i, "a\nb", "alpha, beta! 日 本") for i in range(4, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = [tuple(r) for r in tokens.tokenized(docs, tokens.vocabulary(docs)).orderBy("doc_id").collect()]
    words = {"alpha", "beta", "alphabeta", "日", "本", "q日本"}
    for (i, *found), (_, lang, text) in zip(out, rows):
        own = tokens.segments(text, words if lang != "c" else set(), 20)
        assert found == [len(own), sum(k for *_, k in own), sum(e - s for s, e, k in own if k)], text


def test_notes_meet_texts_at_any_edge(spark):
    """Whether a note stands in a text is what Python's in says, for white space of every kind and repeated words; one id may have several notes."""
    rng = random.Random(8)

    def words(n):
        return "".join(rng.choice(["a", "ab", "abc", "bca", "ß"]) + rng.choice([" ", " ", " ", "\n", "  ", "\t "]) for _ in range(n))

    texts = [rng.choice(["", " ", "\n"]) + words(rng.randint(0, 40)) for _ in range(60)] + [None]
    notes = [(i // 2, t[(a := rng.randint(0, len(t))) : a + rng.randint(0, 25)] + rng.choice(["", "", "b", " "])) for i in range(400) for t in [rng.choice(texts[:-1])]]
    notes += [(1000, None), (None, "a"), (1001, "abc abc abc abc")]
    out = tokens.contained(spark.createDataFrame(notes, "item_id long, text string"), spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    expected = {(i, n is not None and any(n in t for t in texts if t is not None)) for i, n in notes}
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == expected and len(rows) == len(expected) and {k for _, k in expected} == {True, False}


def test_each_word_of_a_text_is_a_row_at_most(spark):
    """Texts meet notes by their words, not by all runs of one to four of them."""
    notes, texts = spark.createDataFrame([(1, "x abc def ghi jkl y")], "item_id long, text string"), spark.createDataFrame([("one two three four five six",)], "text string")
    plan = tokens.contained(notes, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "array_distinct" not in plan


def test_few_unknown_parts_are_shuffled(spark):
    """Known entries all stay; of the others about as many as there are bits set."""
    known = spark.range(2000).selectExpr("concat('+en\n', id) AS entry")
    out = {r.entry for r in tokens._likely(spark.range(20_000).selectExpr("id", "concat('+en\n', id) AS entry"), known).select("entry").collect()}
    assert {f"+en\n{i}" for i in range(2000)} <= out and len(out) < 2200
