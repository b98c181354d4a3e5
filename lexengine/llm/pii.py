"""PII: detected entities are replaced by keyed surrogates of their own type and format, in DataFrame operations only.

A surrogate depends on the key, the type and the entity alone, so that an entity has one surrogate in all of the corpus
(coreference), also in parts: a family name has the same one with and without its given name. Surrogates keep gender,
script, case, length and marks. Two entities that would share a surrogate, and surrogates that occur as entities, are
found by grouping all distinct entities, and drawn again until all are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexengine.llm.common import keyed, staged

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles by gender, as they stand before names.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle", "Госпожа", "Κυρία"],
    "m": ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"],
}
_TITLE = "|".join(t for k in ("f", "m") for t in TITLES[k])
#: Words between the parts of a name.
PARTICLES = ["von", "van", "vom", "zu", "zur", "der", "den", "ten", "de", "del", "della", "di", "da", "dos", "la", "le", "du", "bin", "ibn", "al", "af"]
_NAME = r"\p{Lu}[\p{L}'\-]++"
_BETWEEN = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
#: Types and their patterns; of several that match at a place the first counts. Loops whose parts vary in length are
#: possessive: the others recur, and texts of a million characters would end the executor.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?<!\w)(?i:password|passwd|pwd|token|secret|api[_\-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?[^\s\"',;]{6,}+",
    "key": r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.+\-])(?:\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    # nine digits at least, and no date
    "phone": r"(?<![\w.+])(?!\d{4}-\d{2}-\d{2}(?!\d))(?=(?:[+ .()\-]{0,3}\d){9})(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,5}\)[ .\-]?|\d{2,5}[ .\-])\d{2,4}[ .\-]?\d{2,4}(?:[ .\-]\d{2,4})?(?!\w)|(?<!\w)\+\d{8,15}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_BETWEEN}{_NAME}(?: {_BETWEEN}{_NAME}){{0,4}}",
}
#: What each pattern needs, so that a text without any of these has no entity: digits, an at sign, a label's mark, a key's start, a title.
_SIGN = rf"[0-9@=:]|A[KS]IA|(?:{_TITLE})\.? \p{{L}}"


def _pattern() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    # what an edge keeps from matching alone is told by its shape
    return F.coalesce(out, F.when(match.contains("@"), "email").otherwise("card"))


def units(match: Column, kind: Column) -> Column:
    """The parts of a match that are replaced, with their types and places: names word by word, secrets without their label."""
    part = lambda k, v, at: F.struct(k.alias("kind"), v.alias("unit"), at.cast("int").alias("at"))
    head = F.regexp_extract(match, rf"\A(?:{_TITLE})\.? ", 0)
    gender = F.when(F.regexp_extract(match, rf"\A({_TITLE})", 1).isin(TITLES["f"]), F.lit("f")).otherwise("m")
    words = F.split(F.substring(match, F.length(head) + 1, F.length(match)), " ")
    starts = F.transform(words, lambda w, i: F.struct(w.alias("w"), (F.length(head) + 1 + F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1)).alias("at")))
    named = F.filter(starts, lambda x: x["w"].rlike(r"\A\p{Lu}"))
    # the last one is the family's, those before it are given
    name = F.transform(named, lambda x, i: part(F.when(i < F.size(named) - 1, F.concat(F.lit("given_"), gender)).otherwise("family"), x["w"], x["at"]))
    value = F.regexp_extract(match, r"[=:][ ]{0,2}[\"']?(.*)\z", 1)
    return F.when(kind == "name", name).when(kind == "secret", F.array(part(kind, value, F.length(match) - F.length(value) + 1))).otherwise(F.array(part(kind, match, F.lit(1))))


def _number(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 for place i of a digest."""
    return F.conv(F.substring(digest, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def _letters(digest: Column, i: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(_number(digest, i), F.lit(len(alphabet))) + 1, F.lit(1))


def _shaped(text: Column, digest: Column, keep: int = 0, hexes: bool = False) -> Column:
    """text with other digits for its digits and other letters of the case for its letters; the first keep characters stay."""
    lower = "abcdef" if hexes else "abcdefghijklmnopqrstuvwxyz"

    def other(c: Column, i: Column) -> Column:
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), _letters(digest, i, "0123456789"))
            .when(c.rlike("[a-z]"), _letters(digest, i, lower))
            .when(c.rlike("[A-Z]"), _letters(digest, i, lower.upper()))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _luhn(text: Column) -> Column:
    """text with its last digit such that the Luhn sum is a multiple of ten."""
    digits = F.reverse(F.split(F.regexp_replace(text, "[^0-9]", ""), ""))
    weight = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    rest = F.aggregate(F.transform(digits, lambda d, i: F.when(i == 0, F.lit(0)).otherwise(weight(d, i))), F.lit(0), lambda a, x: a + x)
    head = F.substring(text, F.lit(1), F.length(text) - 1)
    return F.concat(head, F.pmod(F.lit(10) - rest % 10, F.lit(10)).cast("string"))


def _name(unit: Column, kind: Column, digest: Column) -> Column:
    """A name of about unit's length, in its script, ending by its gender."""

    def made(consonants: str, vowels: str, female: str, male: str) -> Column:
        n = F.greatest(F.lit(2), F.least(F.lit(8), F.floor(F.length(unit) / 2)))
        body = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.concat(_letters(digest, i * 2, consonants), _letters(digest, i * 2 + 1, vowels))), "")
        end = F.when(kind == "given_f", F.lit(female)).when(kind == "given_m", F.lit(male)).otherwise(F.lit(""))
        return F.concat(body, end)

    name = (
        F.when(unit.rlike(r"\p{IsCyrillic}"), made("бвгдзклмнпрст", "аеиоу", "на", "н"))
        .when(unit.rlike(r"\p{IsGreek}"), made("βγδζκλμνπρστ", "αεηιο", "να", "ς"))
        .otherwise(made("bdfgklmnprstvz", "aeiou", "na", "n"))
    )
    return F.when(unit == F.upper(unit), F.upper(name)).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 99)))


def surrogate(kind: Column, unit: Column, attempt: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, unit, attempt.cast("string")), 512)
    # bound to a variable, as the functions of single characters would compute it again for each
    return F.get(F.transform(F.array(digest), lambda d: _drawn(kind, unit, d)), F.lit(0))


def _drawn(kind: Column, unit: Column, digest: Column) -> Column:
    """The surrogate that a digest gives."""
    at, dot = F.instr(unit, "@"), F.length(F.substring_index(unit, ".", -1)) + 1
    email = F.concat(_shaped(F.substring(unit, F.lit(1), F.length(unit) - dot), digest), F.substring(unit, F.length(unit) - dot + 1, dot))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i) % 254 + 1).cast("string")), ".")
    prefix = F.length(F.regexp_extract(unit, r"\A(?:\+\d{1,3}(?=[ .\-(]))?", 0))
    return (
        F.when(kind == "email", F.when(at > 0, email).otherwise(_shaped(unit, digest)))
        .when(kind == "ip", octets)
        .when(kind == "card", _luhn(_shaped(unit, digest, 1)))
        .when(kind == "key", _shaped(unit, digest, 4))
        .when(kind == "iban", _shaped(unit, digest, 2))
        .when(kind == "phone", F.concat(F.substring(unit, F.lit(1), prefix), _shaped(F.substring(unit, prefix + 1, F.length(unit)), digest)))
        .when(kind == "secret", F.when(unit.rlike(r"\A[0-9a-f]+\z"), _shaped(unit, digest, 0, True)).otherwise(_shaped(unit, digest)))
        .when(kind.isin("given_f", "given_m", "family"), _name(unit, kind, digest))
        .otherwise(_shaped(unit, digest))
    )


def distinct_surrogates(entities: DataFrame, key: str, most: int = 8) -> DataFrame:
    """kind, unit, surrogate of all distinct entities (kind, unit): no surrogate twice, of whatever kind, and none that is an entity.

    Where a format has no room left (after most draws) a hash of the entity is appended, which is distinct.
    """
    own = staged(entities.distinct().withColumn("attempt", F.lit(0)))
    same = Window.partitionBy("surrogate").orderBy("attempt", "kind", "unit")
    real = own.select(F.col("unit").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    for turn in range(most + 1):
        drawn = own.withColumn("surrogate", surrogate(F.col("kind"), F.col("unit"), F.col("attempt"), key))
        # first the row that drew least often, so that one of each group stays as it is
        checked = staged(drawn.join(real, "surrogate", "left").withColumn("no", F.row_number().over(same)))
        bad = F.coalesce(F.col("real"), F.lit(False)) | (F.col("no") > 1)
        if turn == most:
            more = F.concat("surrogate", F.lit("~"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "unit"), 256), 1, 24))
            return checked.select("kind", "unit", F.when(bad, more).otherwise(F.col("surrogate")).alias("surrogate"))
        if checked.filter(bad).isEmpty():
            return checked.select("kind", "unit", "surrogate")
        own = checked.select("kind", "unit", (F.col("attempt") + F.when(bad, 1).otherwise(0)).alias("attempt"))
    raise AssertionError


def replace_pii(docs: DataFrame, key: str = "lexengine", id_col="doc_id", text_col="text") -> DataFrame:
    """id, text, n_entities: one row per input row, with surrogates in place of entities.

    Names count where a title stands before them; the words of such a name are replaced in the rest of their text too.
    Texts without entities, empty and null ones stay as they are, with 0. Repeated rows are replaced alike, long texts are
    read whole. Other columns are not read, and an empty table gives an empty result.
    """
    own = keyed(docs, id_col, text_col)
    found = F.when(F.col("text").rlike(_SIGN), F.regexp_extract_all("text", F.lit(_pattern()), F.lit(0)))
    own = own.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    some = staged(own.filter(F.size("found") > 0))
    rest = own.filter(F.size("found") == 0)
    each = some.select("key", F.posexplode("found").alias("pos", "match"))
    each = each.withColumn("kind", kind_of(F.col("match")))
    each = staged(each.select("key", "pos", "match", F.explode(units(F.col("match"), F.col("kind"))).alias("u")).select("key", "pos", "match", "u.at", "u.kind", "u.unit"))
    known = distinct_surrogates(each.select("kind", "unit"), key)
    parts = each.join(known, ["kind", "unit"]).groupBy("key", "pos", "match").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "unit", "surrogate"))).alias("parts"))
    new = F.aggregate(
        "parts",
        F.struct(F.lit("").alias("done"), F.lit(1).alias("next")),
        lambda a, p: F.struct(
            F.concat(a["done"], F.substring(F.col("match"), a["next"], p["at"] - a["next"]), p["surrogate"]).alias("done"),
            (p["at"] + F.length(p["unit"])).alias("next"),
        ),
        lambda a: F.concat(a["done"], F.substring(F.col("match"), a["next"], F.length("match"))),
    )
    names = F.filter("parts", lambda p: p["kind"].isin("given_f", "given_m", "family") & (F.length(p["unit"]) > 2))
    rows = parts.select("key", names.alias("names"), F.struct("pos", new.alias("new")).alias("r"))
    rows = rows.groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("r"), F.array_distinct(F.flatten(F.collect_list(F.transform("names", lambda p: F.struct(p["unit"].alias("unit"), p["surrogate"].alias("surrogate")))))).alias("names"))
    joined = some.join(rows, "key")
    between = F.split("text", _pattern(), -1)

    def renamed(piece: Column) -> Column:
        whole = lambda p: F.concat(F.lit(r"(?<!\p{L})\Q"), p["unit"], F.lit(r"\E(?!\p{L})"))
        return F.when(F.size("names") == 0, piece).otherwise(F.aggregate("names", piece, lambda t, p: F.regexp_replace(t, whole(p), p["surrogate"])))

    text = F.array_join(F.flatten(F.transform(between, lambda p, i: F.array(renamed(p), F.coalesce(F.get("r", i)["new"], F.lit(""))))), "")
    done = joined.select("id", text.alias("text"), F.size("found").cast("long").alias("n_entities"))
    return done.unionByName(rest.select("id", "text", F.lit(0).cast("long").alias("n_entities"))).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")
