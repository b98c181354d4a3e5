"""Deinflection: declarative rules, compiled to flags, and their closure over words.

Rules of suffixes, prefixes and whole words are a relation that is joined with the words level by level: a word's own
suffixes up to the longest rule are its join keys. Rules of other kinds are functions; languages that have such are
deinflected by ``closure``, which walks breadth first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.staging import staged


@dataclass(frozen=True)
class Rule:
    kind: str  # suffix, prefix, whole or other
    inflected: str  # a pattern, if the kind is other
    deinflected: str | Callable[[str], str]
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()

    def apply(self, text: str) -> str | None:
        if self.kind == "suffix":
            return text[: len(text) - len(self.inflected)] + self.deinflected if text.endswith(self.inflected) else None
        if self.kind == "prefix":
            return self.deinflected + text[len(self.inflected) :] if text.startswith(self.inflected) else None
        if self.kind == "whole":
            return self.deinflected if text == self.inflected else None
        return self.deinflected(text) if re.search(self.inflected, text, re.ASCII) else None


@dataclass
class Language:
    """Conditions, with the sub-conditions that some stand for, and transforms: names with rules."""

    name: str
    conditions: dict[str, tuple[str, ...]]
    transforms: dict[str, list[Rule]]
    flags: dict[str, int] = field(init=False)

    def __post_init__(self):
        flags: dict[str, int] = {}
        for c in (c for c, subs in self.conditions.items() if not subs):
            flags[c] = 1 << len(flags)
        if len(flags) > 32:
            raise ValueError("more than 32 conditions")
        todo = {c: subs for c, subs in self.conditions.items() if subs}
        while todo:
            ready = [c for c, subs in todo.items() if all(s in flags for s in subs)]
            if not ready:
                raise ValueError(f"conditions go in a circle, or are not known: {sorted(todo)}")
            for c in ready:
                flags[c] = sum({flags[s] for s in todo[c]}) if all(bin(flags[s]).count("1") == 1 for s in todo[c]) else self._union(flags, todo[c])
                del todo[c]
        self.flags = flags

    @staticmethod
    def _union(flags: dict[str, int], subs) -> int:
        out = 0
        for s in subs:
            out |= flags[s]
        return out

    def mask(self, conditions) -> int:
        return self._union(self.flags, conditions)

    def rows(self) -> list[tuple]:
        """(language, transform, rule number, kind, inflected, deinflected, needs, gives) of the rules that are no functions."""
        out = []
        for name, rules in self.transforms.items():
            for i, r in enumerate(rules):
                if r.kind != "other":
                    out.append((self.name, name, i, r.kind, r.inflected, r.deinflected, self.mask(r.needs), self.mask(r.gives)))
        return out


def matches(current: int, needs: int) -> bool:
    return current == 0 or (current & needs) != 0


def closure(language: Language, text: str) -> list[tuple[str, int, tuple[str, ...]]]:
    """(text, conditions, transforms with the newest first) of all that text may be an inflection of, itself first."""
    out = [(text, 0, ())]
    paths: list[frozenset] = [frozenset()]
    i = 0
    while i < len(out):
        current, conditions, trace = out[i]
        for name, rules in language.transforms.items():
            for k, rule in enumerate(rules):
                if not matches(conditions, language.mask(rule.needs)):
                    continue
                found = rule.apply(current)
                if found is None or (name, k, current) in paths[i]:
                    continue
                out.append((found, language.mask(rule.gives), (name, *trace)))
                paths.append(paths[i] | {(name, k, current)})
        i += 1
    return out


RULES = "language string, transform string, no int, kind string, inflected string, deinflected string, needs int, gives int"


def rule_table(spark: SparkSession, languages: list[Language]) -> DataFrame:
    return spark.createDataFrame([r for l in languages for r in l.rows()], RULES)


def deinflected(words: DataFrame, rules: list[tuple]) -> DataFrame:
    """words (language, source) with all that they may inflect from: text, conditions, trace (newest first), depth; themselves first.

    rules are rows as ``Language.rows`` gives them, a table of settings, which does not grow with the words. Levels are added
    until one is empty. A rule is not applied twice to one text in a chain, so that circles end.
    """
    small = F.broadcast(words.sparkSession.createDataFrame(rules, RULES).withColumnRenamed("language", "lang__"))
    # a text is looked up by those of its ends, and whole, that any rule has
    sizes = {kind: sorted({len(r[4]) for r in rules if r[3] == kind}) for kind in ("suffix", "prefix", "whole")}
    n, size = F.length("text"), F.length("inflected")

    def key(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("k"), text.alias("t"))

    keys = [key("suffix", F.when(n >= k, F.substring(F.col("text"), n - k + 1, F.lit(k)))) for k in sizes["suffix"]]
    keys += [key("prefix", F.when(n >= k, F.substring(F.col("text"), 1, k))) for k in sizes["prefix"]]
    keys += [key("whole", F.col("text"))] if sizes["whole"] else []
    on = (F.col("language") == F.col("lang__")) & (F.col("key.k") == F.col("kind")) & (F.col("key.t") == F.col("inflected"))
    step = F.concat_ws("\x1f", "transform", F.col("no").cast("string"), "text")
    new = (
        F.when(F.col("kind") == "suffix", F.concat(F.substring(F.col("text"), F.lit(1), n - size), F.col("deinflected")))
        .when(F.col("kind") == "prefix", F.concat(F.col("deinflected"), F.substring(F.col("text"), size + 1, n)))
        .otherwise(F.col("deinflected"))
    )
    trace = F.when(F.col("trace") == "", F.col("transform")).otherwise(F.concat_ws("<", "transform", "trace"))
    path = F.array().cast("array<string>").alias("path")
    level = words.select("language", "source", F.col("source").alias("text"), F.lit(0).alias("conditions"), F.lit("").alias("trace"), F.lit(0).alias("depth"), path)
    levels = []
    while keys and (not levels or not level.isEmpty()):
        levels.append(level.drop("path"))
        hits = level.withColumn("key", F.explode(F.array(*keys))).join(small, on)
        hits = hits.filter(((F.col("conditions") == 0) | (F.col("conditions").bitwiseAND(F.col("needs")) != 0)) & ~F.array_contains("path", step))
        level = staged(hits.select("language", "source", new.alias("text"), F.col("gives").alias("conditions"), trace.alias("trace"), F.lit(len(levels)).alias("depth"), F.array_append("path", step).alias("path")))
    return reduce(DataFrame.unionByName, levels or [level.drop("path")])
