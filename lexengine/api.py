"""The actions of the lookup service as functions; unknown actions and errors have the codes that clients expect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.operators import lookup, tokens
from lexengine.plans import translate

VERSION = "1"


@dataclass
class Service:
    """Lookups on a dictionary's tables, in one language."""

    spark: SparkSession
    terms: DataFrame
    language: str = "en"
    characters: DataFrame | None = None
    character_meta: DataFrame | None = None

    def version(self) -> dict:
        return {"version": VERSION}

    def term_entries(self, term: str, max_entries: int | None = None, mode: str = "group") -> dict:
        """Entries of the longest match of a text, and its length."""
        q = self.spark.createDataFrame([(0, term)], "query_id int, text string")
        found = translate.find_terms(q, self.terms, self.language, mode, most=max_entries).orderBy("rank")
        rows = [r.asDict() for r in found.collect()]
        return {"dictionaryEntries": rows, "originalTextLength": max((r["source_length"] for r in rows), default=0), "index": 0}

    def kanji_entries(self, character: str) -> list[dict]:
        if self.characters is None or self.character_meta is None:
            return []
        chars = list(dict.fromkeys(character))
        q = self.spark.createDataFrame(list(enumerate(chars)), "pos int, term string")
        return [r.asDict() for r in lookup.find_characters(q, self.characters, self.character_meta).orderBy("pos").collect()]

    def tokenize(self, text: str | list[str], scan_length: int = 20) -> list[dict]:
        """Segments of texts by the dictionary's expressions that stand in them."""
        texts = [text] if isinstance(text, str) else text
        own = self.spark.createDataFrame([(t,) for t in texts], "text string")
        # only expressions that some text holds are collected: at most as many as the texts have substrings
        parts = own.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(scan_length)), lambda n: F.lower(F.substring(F.col("text"), i, n)))))).alias("key")).distinct()
        known = {r.key for r in parts.join(self.terms.select(F.lower("expression").alias("key")).distinct(), "key").collect()}
        out = []
        for i, t in enumerate(texts):
            found = tokens.segments(t, known, scan_length)
            out.append({"id": "scan", "source": "scanning-parser", "index": i, "content": [{"text": t[a:b], "known": k} for a, b, k in found]})
        return out

    def call(self, action: str, params: dict) -> tuple[int, object]:
        """(code, body): 400 for an unknown action, 500 for an error."""
        actions = {"version": self.version, "termEntries": self.term_entries, "kanjiEntries": self.kanji_entries, "tokenize": self.tokenize}
        if action not in actions:
            return 400, {"error": f"unknown action {action}"}
        try:
            return 200, actions[action](**params)
        except Exception as error:  # a service answers, whatever went wrong
            return 500, {"error": str(error)}
