"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexengine.functions import inflections, notes as N, text as T
from lexengine.operators import deinflect, entries, lookup, tokens
from lexengine.plans import model as M
from lexengine.plans import translate

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What the lookups ask for, as a user would in one batch.
TERMS = ["blue anvil", "bolt", "small ring", "bolt", "no such term", "gear", "red widget", "rod"]
STARTS = ["blue", "r", "plate", "blue", "", "col", "wid"]
ENDS = ["ring", "t", "ate", "ring", "gizmo"]
PAIRS = [("blue anvil", "anvil"), ("small ring", "ring"), ("small ring", "bolt"), ("red widget", "widget")]
SEQUENCES = [(1, "ECONOMY"), (7, "LARGE"), (-1, "SMALL"), (7, "PROMO")]
WILDCARDS = ["*ring", "blue*", "bolt", "*e*", "＊rod"]

T_SQL = """dicts AS (SELECT p_type AS dictionary, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS dict_idx FROM (SELECT DISTINCT p_type FROM part)),
terms AS (SELECT p_partkey AS id, p_type AS dictionary, p_name AS expression, split_part(p_name, ' ', 2) AS reading, p_brand AS tag,
                 CAST(p_size AS DOUBLE) AS score, p_partkey % 50 AS sequence, dict_idx FROM part JOIN dicts ON p_type = dictionary),
keys AS (SELECT expression AS key, 0 AS src, id, dictionary FROM terms UNION ALL SELECT reading, 1, id, dictionary FROM terms)"""
F_SQL = """freq AS (SELECT l_returnflag AS dictionary, p_name AS expression, count(*) AS frequency FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
TAG_SQL = """tags AS (SELECT DISTINCT dictionary, tag AS name, CAST(split_part(tag, '#', 2) AS INTEGER) AS ord FROM terms WHERE CAST(split_part(tag, '#', 2) AS INTEGER) <= 20)"""
W_SQL = """words AS (SELECT DISTINCT lang AS language, lower(w) AS source FROM (SELECT lang, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents))"""


def _values(rows) -> str:
    def one(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(v) for v in ((i, *r) if isinstance(r, tuple) else (i, r))) + ")" for i, r in enumerate(rows))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _batch(spark, rows, schema="pos int, term string"):
    return spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], schema)


# --- ranking, the flagship


def _hits(spark, d):
    t = M.terms(spark, d)
    hits = lookup.find_exact(_batch(spark, TERMS), lookup.term_keys(t))
    order = entries.sort_frequency(t, M.frequencies(spark, d), "R")
    return hits.drop("dictionary").join(t, "id").join(order, "expression")


_RANK = f"""WITH {T_SQL}, {F_SQL}, q(pos, term) AS (VALUES {_values(TERMS)}), f AS (SELECT term, min(pos) AS fp FROM q GROUP BY term),
h AS (SELECT fp, src, term, id, row_number() OVER (PARTITION BY id ORDER BY fp, src) AS r FROM f JOIN keys ON term = key),
o AS (SELECT expression, min(frequency) AS f FROM freq WHERE dictionary = 'R' GROUP BY expression),
x AS (SELECT q.pos, h.term, t.id, t.expression, CASE src WHEN 0 THEN 'term' ELSE 'reading' END AS match_source,
             coalesce(f, 9007199254740991) AS frequency_order, dict_idx, score
      FROM h JOIN q ON q.term = h.term JOIN terms t ON t.id = h.id LEFT JOIN o ON o.expression = t.expression WHERE r = 1),
z AS (SELECT pos, term, id, expression, frequency_order, dict_idx, score, CAST(row_number() OVER (PARTITION BY pos ORDER BY
             (match_source = 'term') DESC, frequency_order, dict_idx, score DESC, length(expression) DESC, expression, id) AS INTEGER) AS rank FROM x)
SELECT * FROM z"""
_RANKED = ["pos", "term", "id", "expression", "frequency_order", "dict_idx", "score", "rank"]


@query(_RANK)
def rank_results(spark, d):
    return entries.ranked(_hits(spark, d)).select(*_RANKED)


@query(_RANK + " WHERE rank <= 5")
def top_k_results(spark, d):
    return entries.ranked(_hits(spark, d)).filter("rank <= 5").select(*_RANKED)


# --- lookups


@query(f"""WITH {T_SQL}, q(pos, term) AS (VALUES {_values(TERMS)}), f AS (SELECT term, min(pos) AS fp FROM q GROUP BY term),
h AS (SELECT term, src, id, dictionary, row_number() OVER (PARTITION BY id ORDER BY fp, src) AS r FROM f JOIN keys ON term = key)
SELECT q.pos, h.term, id, dictionary, CASE src WHEN 0 THEN 'term' ELSE 'reading' END AS match_source, 'exact' AS match_type
FROM h JOIN q ON q.term = h.term WHERE r = 1""")
def find_terms_exact(spark, d):
    return lookup.find_exact(_batch(spark, TERMS), lookup.term_keys(M.terms(spark, d)))


@query(f"""WITH {T_SQL}, q(pos, term) AS (VALUES {_values(STARTS)}), f AS (SELECT term, min(pos) AS fp FROM q WHERE term <> '' GROUP BY term),
h AS (SELECT fp, term, src, key, id, dictionary, row_number() OVER (PARTITION BY id ORDER BY src, fp) AS r FROM f JOIN keys ON starts_with(key, term))
SELECT fp AS pos, term, id, dictionary, CASE src WHEN 0 THEN 'term' ELSE 'reading' END AS match_source,
       CASE WHEN key = term THEN 'exact' ELSE 'prefix' END AS match_type FROM h WHERE r = 1""")
def find_terms_prefix(spark, d):
    return lookup.find_prefix(_batch(spark, STARTS), lookup.term_keys(M.terms(spark, d)))


@query(f"""WITH {T_SQL}, q(pos, term) AS (VALUES {_values(ENDS)}), f AS (SELECT term, min(pos) AS fp FROM q WHERE term <> '' GROUP BY term),
h AS (SELECT fp, term, src, key, id, dictionary, row_number() OVER (PARTITION BY id ORDER BY src, fp) AS r FROM f JOIN keys ON starts_with(reverse(key), reverse(term)))
SELECT fp AS pos, term, id, dictionary, CASE src WHEN 0 THEN 'term' ELSE 'reading' END AS match_source,
       CASE WHEN reverse(key) = term THEN 'exact' ELSE 'suffix' END AS match_type FROM h WHERE r = 1""")
def find_terms_suffix(spark, d):
    return lookup.find_suffix(_batch(spark, ENDS), lookup.term_keys(M.terms(spark, d)))


@query(f"""WITH {T_SQL}, q(pos, term, reading) AS (VALUES {_values(PAIRS)})
SELECT pos, term, q.reading, id, dictionary FROM q JOIN terms ON term = expression AND q.reading = terms.reading""")
def find_terms_pair(spark, d):
    return lookup.find_pairs(_batch(spark, PAIRS, "pos int, term string, reading string"), M.terms(spark, d))


@query(f"""WITH {T_SQL}, q(pos, query, dictionary) AS (VALUES {_values(SEQUENCES)})
SELECT pos, query, q.dictionary, id, expression, 'sequence' AS match_source FROM q JOIN terms ON query = sequence AND q.dictionary = terms.dictionary WHERE query >= 0""")
def find_terms_sequence(spark, d):
    return lookup.find_sequences(_batch(spark, SEQUENCES, "pos int, query int, dictionary string"), M.terms(spark, d))


@query(f"""WITH {F_SQL}, q(pos, term) AS (VALUES {_values(TERMS)})
SELECT pos, term, dictionary, frequency, CAST(row_number() OVER (PARTITION BY pos ORDER BY dictionary) - 1 AS INTEGER) AS index FROM q JOIN freq ON term = expression""")
def term_meta_lookup(spark, d):
    return lookup.find_meta(_batch(spark, TERMS), M.frequencies(spark, d))


@query(f"""WITH {T_SQL}, {TAG_SQL} SELECT t.id, t.dictionary, t.tag AS name, coalesce(CASE WHEN ord IS NULL THEN NULL ELSE 'brand' END, 'default') AS category,
coalesce(ord, 0) AS ord, coalesce(10.0 - ord, 0.0)::DOUBLE AS score FROM terms t LEFT JOIN tags ON tags.dictionary = t.dictionary AND tags.name = t.tag""")
def tag_lookup_left(spark, d):
    requests = M.terms(spark, d).select("id", "dictionary", F.col("tag").alias("name"))
    return lookup.find_tags(requests, M.tags(spark, d))


@query("""WITH c AS (SELECT n_name AS character, r_name AS category, n_nationkey AS stat, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT n_name AS character, count(*) AS frequency FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
q(pos, term) AS (VALUES (0, 'NATION_3'), (1, 'NATION_7'), (2, 'NATION_99'), (3, 'NATION_3'))
SELECT pos, c.character, category, stat, frequency FROM q JOIN c ON term = c.character LEFT JOIN m ON m.character = c.character""")
def kanji_lookup(spark, d):
    nation, region = M.table(spark, d, "nation"), M.table(spark, d, "region")
    chars = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("character"), F.col("r_name").alias("category"), F.col("n_nationkey").alias("stat"))
    per = M.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("frequency"))
    meta = per.join(nation, per["c_nationkey"] == nation["n_nationkey"]).select(F.col("n_name").alias("character"), "frequency")
    return lookup.find_characters(_batch(spark, ["NATION_3", "NATION_7", "NATION_99", "NATION_3"]), chars, meta)


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_anti(spark, d):
    return lookup.orphans(M.table(spark, d, "documents").select("doc_id", "source"), M.table(spark, d, "labels"), "doc_id")


@query(f"""WITH {T_SQL}, q(pos, text) AS (VALUES {_values(WILDCARDS)}),
w AS (SELECT pos, text, CASE WHEN regexp_matches(text, '^[*＊]') THEN 'suffix' WHEN regexp_matches(text, '[*＊]$') THEN 'prefix' ELSE 'exact' END AS match,
             regexp_replace(regexp_replace(text, '^[*＊]+', ''), '[*＊]+$', '') AS term FROM q),
h AS (SELECT match, term, pos, src, id, row_number() OVER (PARTITION BY match, id ORDER BY CASE match WHEN 'exact' THEN pos ELSE src END, CASE match WHEN 'exact' THEN src ELSE pos END) AS r
      FROM w JOIN keys ON CASE match WHEN 'exact' THEN key = term WHEN 'prefix' THEN starts_with(key, term) ELSE suffix(key, term) END)
SELECT pos, match, term, id FROM h WHERE r = 1""")
def wildcard_lookup(spark, d):
    q = lookup.wildcards(_batch(spark, WILDCARDS, "pos int, text string"))
    keys = lookup.term_keys(M.terms(spark, d))
    out = None
    for kind, find in (("exact", lookup.find_exact), ("prefix", lookup.find_prefix), ("suffix", lookup.find_suffix)):
        part = find(q.filter(F.col("match") == kind).select("pos", "term"), keys).select("pos", F.lit(kind).alias("match"), "term", "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {T_SQL}, q(pos, term) AS (VALUES {_values(["bolt", "NATION_3", "gear", "nothing"])}),
a AS (SELECT DISTINCT pos, q.term, 'term' AS kind, id FROM q JOIN keys ON term = key),
b AS (SELECT pos, term, 'character' AS kind, CAST(n_nationkey AS BIGINT) AS id FROM q JOIN nation ON term = n_name WHERE pos NOT IN (SELECT pos FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def term_else_character_fallback(spark, d):
    q = _batch(spark, ["bolt", "NATION_3", "gear", "nothing"])
    found = lookup.find_exact(q, lookup.term_keys(M.terms(spark, d))).select("pos", "term", F.lit("term").alias("kind"), "id")
    nation = M.table(spark, d, "nation")
    rest = q.join(found.select("pos").distinct(), "pos", "left_anti")
    chars = rest.join(nation, rest["term"] == nation["n_name"]).select("pos", "term", F.lit("character").alias("kind"), F.col("n_nationkey").cast("long").alias("id"))
    return found.unionByName(chars)


@query(f"""WITH {T_SQL}, q(pos, term) AS (VALUES {_values(["blue anvil", "small ring"])}),
h AS (SELECT DISTINCT pos, id, dictionary, reading FROM q JOIN terms ON term = expression)
SELECT DISTINCT pos, h.id AS source_id, h.reading AS form_of, keys.id FROM h JOIN keys ON h.reading = key AND h.dictionary = keys.dictionary WHERE keys.id <> h.id""")
def formof_second_pass(spark, d):
    t = M.terms(spark, d)
    keys = lookup.term_keys(t)
    hits = lookup.find_exact(_batch(spark, ["blue anvil", "small ring"]), keys)
    return lookup.form_of(hits, t.select("id", F.col("reading").alias("form_of")), keys)


# --- counts and contents


@query("SELECT p_type AS dictionary, count(*) AS n FROM part GROUP BY ROLLUP (p_type)")
def dictionary_counts_rollup(spark, d):
    return M.table(spark, d, "part").rollup(F.col("p_type").alias("dictionary")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS mode, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM events")
def meta_counts_by_mode(spark, d):
    by = M.table(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("n"))
    return by.unionByName(by.agg(F.sum("n").alias("n")).select(F.lit("total").alias("mode"), "n"))


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY md5(text)")
def content_dedup(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# --- expansion of texts


@query("""WITH n AS (SELECT DISTINCT p_name AS text FROM part), s AS (SELECT text, unnest(range(1, length(text) + 1)) AS n FROM n)
SELECT text, CAST(n AS INTEGER) AS length, substr(text, 1, n) AS substring FROM s""")
def substrings_letter(spark, d):
    names = M.table(spark, d, "part").select(F.col("p_name").alias("text")).distinct()
    out = names.select("text", F.explode(T.letter_substrings(F.col("text"))).alias("substring"))
    return out.select("text", T.utf16_length(F.col("substring")).alias("length"), "substring")


@query(r"""WITH RECURSIVE n AS (SELECT DISTINCT p_name || ' of ' || p_type AS text FROM part),
s AS (SELECT text, text AS substring FROM n UNION SELECT text, regexp_replace(substring, '[^\p{L}][\p{L}\p{N}]*$', '') FROM s WHERE regexp_matches(substring, '[^\p{L}][\p{L}\p{N}]*$'))
SELECT text, substring FROM s WHERE substring <> ''""")
def substrings_word(spark, d):
    names = M.table(spark, d, "part").select(F.concat_ws(" of ", "p_name", "p_type").alias("text")).distinct()
    return names.select("text", F.explode(T.word_substrings(F.col("text"))).alias("substring"))


@query(r"""WITH w AS (SELECT DISTINCT w AS text FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)),
v AS (SELECT text, text AS variant FROM w UNION SELECT text, lower(text) FROM w UNION SELECT text, upper(text[1]) || text[2:] FROM w UNION SELECT text, upper(text[1]) || lower(text[2:]) FROM w)
SELECT text, variant FROM v""")
def text_variants_case(spark, d):
    docs = M.table(spark, d, "documents")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("text")).distinct()
    return words.select("text", F.explode(T.case_variants(F.col("text"))).alias("variant"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([aeiou])th', '<\1>', 'g')) AS replaced FROM documents")
def text_replacements(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", "([aeiou])th", "<$1>").cast("binary")).alias("replaced"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[\s・:''’\-]|//', '', 'g')) AS normalized FROM documents")
def reading_normalize(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5(T.normalized_pinyin(F.col("text")).cast("binary")).alias("normalized"))


@query("SELECT c AS character, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_lookup(spark, d):
    chars = M.table(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("character"))
    return chars.filter("character != ''").groupBy("character").agg(F.count("*").alias("docs"))


@query(r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def html_links_media(spark, d):
    links = M.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


# --- deinflection


def _rules(name):
    return inflections.LANGUAGES[name].rows()


def _deinflect_sql(name: str) -> str:
    rows = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in _rules(name))
    return f"""WITH RECURSIVE {W_SQL}, rules(language, transform, no, kind, inflected, deinflected, needs, gives) AS (VALUES {rows}),
d AS (SELECT source, source AS text, 0 AS conditions, '' AS trace, 0 AS depth, CAST([] AS VARCHAR[]) AS path FROM words WHERE language = '{name}'
      UNION ALL
      SELECT source, CASE kind WHEN 'suffix' THEN left(text, length(text) - length(inflected)) || deinflected WHEN 'prefix' THEN deinflected || substr(text, length(inflected) + 1) ELSE deinflected END,
             gives, CASE WHEN trace = '' THEN transform ELSE transform || '<' || trace END, depth + 1, list_append(path, transform || '|' || no || '|' || text)
      FROM d JOIN rules ON CASE kind WHEN 'suffix' THEN suffix(text, inflected) WHEN 'prefix' THEN starts_with(text, inflected) ELSE text = inflected END
      WHERE (conditions = 0 OR (conditions & needs) <> 0) AND NOT list_contains(path, transform || '|' || no || '|' || text)),
g AS (SELECT source, text, conditions, trace, depth, count(*) AS n FROM d GROUP BY ALL) SELECT * FROM g"""


def _deinflect(name: str):
    def run(spark, d):
        words = M.words(spark, d).filter(F.col("language") == name)
        out = deinflect.deinflected(words, _rules(name))
        return out.groupBy("source", "text", "conditions", "trace", "depth").agg(F.count("*").alias("n"))

    run.__name__ = f"deinflect_{name}"
    query(_deinflect_sql(name))(run)


for _name in ("en", "de", "es", "fr"):
    _deinflect(_name)


def _english_bases(spark, d):
    """Words of English texts with those of them that they inflect from."""
    words = M.words(spark, d).filter("language = 'en'")
    out = deinflect.deinflected(words, _rules("en")).filter("depth > 0")
    known = words.select(F.col("source").alias("text"))
    return out.join(known, "text").select("source", F.col("text").alias("term"), "conditions", "trace")


_BASES = _deinflect_sql("en").replace("g AS (", "g0 AS (").rsplit(" SELECT * FROM g", 1)[0]


@query(_BASES + ", b AS (SELECT DISTINCT source, text AS term FROM d WHERE depth > 0 AND text IN (SELECT source FROM words WHERE language = 'en')), m AS (SELECT term, max(length(source)) AS source_length FROM b GROUP BY term) SELECT b.term, CAST(source_length AS INTEGER) AS source_length, string_agg(source, ',' ORDER BY source) AS sources FROM b JOIN m ON b.term = m.term AND length(source) = source_length GROUP BY ALL")
def dedup_longest(spark, d):
    return entries.longest(_english_bases(spark, d).select("source", "term"))


_FLAGS = inflections.ENGLISH.flags


@query(
    _BASES
    + f""", b AS (SELECT source, text AS term, conditions, trace, CASE WHEN suffix(text, 'ly') THEN {_FLAGS["adv"]} WHEN suffix(text, 's') THEN {_FLAGS["np"]} ELSE {_FLAGS["v"] | _FLAGS["ns"]} END AS pos FROM d WHERE depth > 0 AND text IN (SELECT source FROM words WHERE language = 'en'))
SELECT source, term, trace, conditions, pos, count(*) AS n FROM b WHERE conditions = 0 OR (conditions & pos) <> 0 GROUP BY ALL"""
)
def pos_filter_join(spark, d):
    pos = F.when(F.col("term").endswith("ly"), _FLAGS["adv"]).when(F.col("term").endswith("s"), _FLAGS["np"]).otherwise(_FLAGS["v"] | _FLAGS["ns"])
    rows = _english_bases(spark, d).withColumn("pos", pos)
    rows = rows.filter((F.col("conditions") == 0) | (F.col("conditions").bitwiseAND(F.col("pos")) != 0))
    return rows.groupBy("source", "term", "trace", "conditions", "pos").agg(F.count("*").alias("n"))


# --- entries


def _group_sql(keys: str) -> str:
    return f"""WITH {T_SQL} SELECT {keys}, max(score) AS score, CAST(min(dict_idx) AS BIGINT) AS dict_idx, count(*) AS definitions,
string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM terms GROUP BY {keys}"""


@query(_group_sql("expression, reading"))
def group_by_headword(spark, d):
    return entries.grouped(M.terms(spark, d), ["expression", "reading"])


@query(_group_sql("expression"))
def group_by_term(spark, d):
    return entries.grouped(M.terms(spark, d), ["expression"])


@query(f"""WITH {T_SQL}, own AS (SELECT * FROM terms WHERE dictionary = 'ECONOMY'), heads AS (SELECT DISTINCT sequence, expression, reading FROM own),
r AS (SELECT sequence, expression, score, true AS p FROM own
      UNION ALL SELECT h.sequence, t.expression, t.score, false FROM terms t JOIN heads h ON h.expression = t.expression AND h.reading = t.reading WHERE t.dictionary = 'PROMO')
SELECT 'ECONOMY' AS dictionary, sequence, count(*) AS n, count(*) FILTER (p) AS n_primary, max(score) AS score, string_agg(DISTINCT expression, ',' ORDER BY expression) AS expressions FROM r GROUP BY sequence""")
def merge_by_sequence(spark, d):
    t = M.terms(spark, d)
    return entries.merged_by_sequence(t.filter("dictionary = 'ECONOMY'"), t.filter("dictionary = 'PROMO'").select("id", "expression", "reading", "score"))


@query(f"""WITH {T_SQL}, h AS (SELECT DISTINCT expression, reading, sequence FROM terms WHERE dictionary = 'ECONOMY')
SELECT t.id, t.expression, t.reading, h.sequence FROM terms t LEFT JOIN h ON h.expression = t.expression AND h.reading = t.reading WHERE t.dictionary = 'PROMO'""")
def secondary_related(spark, d):
    found, rest = entries.secondary(M.terms(spark, d), "ECONOMY", "PROMO")
    return found.select("id", "expression", "reading", "sequence").unionByName(rest.withColumn("sequence", F.lit(None).cast("long")))


@query(f"WITH {T_SQL} SELECT expression, count(*) AS definitions, CAST(min(dict_idx) AS BIGINT) AS dict_idx FROM terms WHERE dictionary NOT IN ('ECONOMY', 'SMALL') GROUP BY expression")
def exclude_definitions(spark, d):
    return entries.without_dictionaries(M.terms(spark, d), ["ECONOMY", "SMALL"])


@query(f"WITH {T_SQL} SELECT id, expression, dictionary, coalesce(lag(tag) OVER (PARTITION BY expression, dictionary ORDER BY id) = tag, false) AS redundant FROM terms")
def redundant_pos_flag(spark, d):
    return entries.redundant_tags(M.terms(spark, d))


@query(f"""WITH {T_SQL}, {TAG_SQL} SELECT name, 'brand' AS category, min(ord) AS ord, CAST(max(10.0 - ord) AS DOUBLE) AS score, string_agg(DISTINCT dictionary, ',' ORDER BY dictionary) AS dictionaries FROM tags GROUP BY name""")
def similar_tag_merge(spark, d):
    return entries.similar_tags(M.tags(spark, d))


@query(f"""WITH {T_SQL}, {TAG_SQL}, s AS (SELECT expression, sum(10.0 - ord) AS s FROM terms t JOIN tags ON tags.name = t.tag AND tags.dictionary = t.dictionary GROUP BY expression)
SELECT expression, CASE WHEN s > 0 THEN 'popular' WHEN s < 0 THEN 'rare' ELSE 'normal' END AS popularity FROM s""")
def term_popularity(spark, d):
    t = M.terms(spark, d).select("expression", "dictionary", F.col("tag").alias("name"))
    return entries.popularity(t.join(M.tags(spark, d), ["dictionary", "name"]))


# --- frequencies


@query(f"WITH {T_SQL}, {F_SQL}, o AS (SELECT expression, min(frequency) AS f FROM freq WHERE dictionary = 'R' GROUP BY expression) SELECT DISTINCT t.expression, coalesce(f, 9007199254740991) AS frequency_order FROM terms t LEFT JOIN o ON o.expression = t.expression")
def sort_frequency(spark, d):
    return entries.sort_frequency(M.terms(spark, d), M.frequencies(spark, d), "R")


_MEANS = "m AS (SELECT expression, CAST(floor(count(*) / sum(1.0::DOUBLE / frequency) + 1e-9) AS BIGINT) AS harmonic, CAST(floor(sum(frequency)::DOUBLE / count(*)) AS BIGINT) AS average FROM freq WHERE frequency > 0 GROUP BY expression)"


@query(f"WITH {F_SQL}, {_MEANS} SELECT expression, harmonic FROM m")
def freq_harmonic(spark, d):
    return entries.harmonic(M.frequencies(spark, d)).select("expression", "harmonic")


@query(f"WITH {F_SQL}, {_MEANS} SELECT expression, average FROM m")
def freq_average(spark, d):
    return entries.harmonic(M.frequencies(spark, d)).select("expression", "average")


@query(f"WITH {F_SQL}, {_MEANS} SELECT dictionary, expression, CAST(frequency AS BIGINT) AS frequency FROM freq UNION ALL SELECT 'Average', expression, harmonic FROM m")
def group_frequencies_display(spark, d):
    return entries.displayed_frequencies(M.frequencies(spark, d))


@query(r"""SELECT event_id, coalesce(try_cast(nullif(regexp_extract(props, '[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?', 0), '') AS DOUBLE), 0) AS parsed,
CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events""")
def freq_parse(spark, d):
    events = M.table(spark, d, "events")
    return events.select("event_id", entries.number_of(F.col("props")).alias("parsed"), F.get_json_object("props", "$.k").cast("long").alias("value"))


@query(r"""WITH r AS (SELECT event_id, (event_id % 3) || '.' || (event_id % 11) AS a, (event_id % 4) || '.' || (event_id % 7) || CASE WHEN event_id % 5 = 0 THEN 'b' ELSE '' END AS b FROM events)
SELECT event_id, CASE WHEN regexp_matches(a, '^\d+(\.\d+)*$') AND regexp_matches(b, '^\d+(\.\d+)*$') AND len(string_split(a, '.')) = len(string_split(b, '.'))
THEN list_transform(string_split(a, '.'), lambda x: CAST(x AS INTEGER)) < list_transform(string_split(b, '.'), lambda x: CAST(x AS INTEGER)) ELSE a < b END AS newer FROM r""".replace("CASE WHEN regexp", "CASE WHEN regexp"))
def compare_revisions(spark, d):
    e, i = M.table(spark, d, "events"), F.col("event_id")
    a = F.concat_ws(".", i % 3, i % 11)
    b = F.concat(F.concat_ws(".", i % 4, i % 7), F.when(i % 5 == 0, "b").otherwise(""))
    return e.select("event_id", entries.newer(a, b).alias("newer"))


# --- notes


@query("""WITH n AS (SELECT conv_id, text FROM conversations WHERE turn = 0), k AS (SELECT md5(text) AS h, min(conv_id) AS first_id FROM n GROUP BY ALL)
SELECT conv_id, first_id, conv_id <> first_id AS duplicate FROM n JOIN k ON md5(text) = h""")
def duplicate_notes(spark, d):
    notes = M.table(spark, d, "conversations").filter("turn = 0").select("conv_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = notes.groupBy("h").agg(F.min("conv_id").alias("first_id"))
    return notes.join(first, "h").select("conv_id", "first_id", (F.col("conv_id") != F.col("first_id")).alias("duplicate"))


@query("SELECT DISTINCT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS known FROM benchmark b")
def note_addible_partition(spark, d):
    return tokens.contained(M.table(spark, d, "benchmark").select("item_id", "text"), M.table(spark, d, "documents").select("text"))


@query("SELECT o_orderkey AS note_id, min(l_linenumber) AS card FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def first_cards(spark, d):
    cards = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("card"))
    notes = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"))
    return notes.join(entries.first_of(cards, "note_id", "card", "card"), "note_id", "left")


# --- entries once more


@query(f"""WITH {T_SQL}, s AS (SELECT expression, min(sequence) FILTER (dictionary = 'ECONOMY') AS a, max(sequence) FILTER (dictionary = 'ECONOMY') AS b FROM terms GROUP BY expression)
SELECT expression, CASE WHEN a = b THEN a ELSE -1 END AS sequence FROM s""")
def entry_sequences(spark, d):
    return entries.entry_sequences(M.terms(spark, d), "ECONOMY")


@query(f"WITH {T_SQL} SELECT expression, string_agg(DISTINCT reading, ',' ORDER BY reading) AS readings, string_agg(DISTINCT dictionary, ',' ORDER BY dictionary) AS dictionaries FROM terms GROUP BY expression")
def unique_readings(spark, d):
    return entries.readings(M.terms(spark, d))


@query(f"""WITH {T_SQL}, shown AS (SELECT DISTINCT reading, expression FROM terms WHERE dictionary = 'SMALL' AND score > 45)
SELECT reading, count(*) AS n, string_agg(expression, ',' ORDER BY expression) AS others FROM (SELECT DISTINCT reading, expression FROM terms) t
WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.reading = t.reading AND s.expression = t.expression) GROUP BY reading""")
def disambiguations(spark, d):
    t = M.terms(spark, d)
    return entries.disambiguations(t, t.filter("dictionary = 'SMALL' AND score > 45").select("reading", "expression").distinct())


@query(f"""WITH {T_SQL}, m AS (SELECT expression, id AS idx, dictionary, CAST(score AS BIGINT) AS frequency FROM terms),
c AS (SELECT *, coalesce(lag(dictionary) OVER (PARTITION BY expression ORDER BY idx) <> dictionary, true) AS changed FROM m)
SELECT expression, idx, dictionary, frequency FROM c WHERE changed AND frequency > 0""")
def frequency_runs(spark, d):
    return entries.frequency_runs(M.terms(spark, d).select("expression", F.col("id").alias("idx"), "dictionary", F.col("score").cast("long").alias("frequency")))


@query("SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def batch_durations(spark, d):
    return entries.durations(M.table(spark, d, "events").select("event_type", "value"), "event_type", "value")


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) IN ('ththre.example.com', 'm.ththth.example.net') OR regexp_matches(url, '(?i)/(EN|DE)/') AS profile FROM pages""")
def profile_conditions(spark, d):
    groups = [[("url", "matchDomain", "ththre.example.com, M.ththth.example.net")], [("url", "matchRegExp", "/(EN|DE)/"), ("unknown", "x", 1)], []]
    return M.table(spark, d, "pages").select("page_id", N.first_match(groups, {"url": F.col("url")}).alias("profile"))


@query("SELECT user_id, count(*) AS n FROM events e WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0) GROUP BY user_id")
def options_with_dictionary(spark, d):
    """Options whose dictionary is installed; stale ones go."""
    installed = M.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return M.table(spark, d, "events").join(installed, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


# --- tokens and sentences: no SQL has their rules


@query(None)
def tokenize_greedy(spark, d):
    """Segments of every text, by the words of its language that at least three others use."""
    docs = M.table(spark, d, "documents").select("doc_id", "lang", "text")
    return tokens.tokenized(docs, tokens.vocabulary(docs))


@query(None)
def sentence_extract(spark, d):
    """The sentence in the middle of every text."""
    return tokens.middle_sentences(M.table(spark, d, "documents").select("doc_id", "text"))


@query(None)
def furigana_segments(spark, d):
    """Furigana, morae and pitch of terms."""
    return tokens.furigana_table(_batch(spark, tokens.READINGS, "pos int, term string, reading string, pitch int"))


#: Texts that users point at, in English and German.
TEXTS = ["blue anvils on", "Small rings", "bolts", "RED WIDGET x", "nothing here"]


def _lookup_terms(spark, d):
    return M.terms(spark, d).withColumn("rules", F.array(F.lit("n"), F.lit("np")))


@query(None)
def find_terms_group(spark, d):
    """The full lookup of a few texts: substrings, case variants, English deinflection, grouping by headword, ranking."""
    t = _lookup_terms(spark, d)
    out = translate.find_terms(_batch(spark, TEXTS, "query_id int, text string"), t, "en", "group", frequency=entries.sort_frequency(t, M.frequencies(spark, d), "R"))
    return out.withColumn("expressions", F.array_join("expressions", ","))


@query(None)
def find_terms_merge(spark, d):
    """The same, merged by the sequences of one dictionary."""
    out = translate.find_terms(_batch(spark, TEXTS, "query_id int, text string"), _lookup_terms(spark, d), "en", "merge", main="ECONOMY")
    return out.withColumn("expressions", F.array_join("expressions", ","))


def entry(spark, sf_dir):
    return rank_results(spark, sf_dir)
