"""Queries over what results show: chains, headwords, definitions, tags, metadata, orders, notes and database work, and their SQL.

Rows that share a sequence are an entry; the dictionary ECONOMY is the main one, whose rows are primary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexengine.operators import entries, results as R
from lexengine.plans import model as M
from lexengine.plans.catalog import T_SQL, _batch, _values, query

MAIN = "ECONOMY"
E_SQL = f"""{T_SQL}, rows AS (SELECT sequence AS entry, id, dictionary, dict_idx, expression, reading, score, tag, tag AS content, dictionary = '{MAIN}' AS is_primary FROM terms),
heads AS (SELECT entry, CAST(row_number() OVER (PARTITION BY entry ORDER BY is_primary DESC, dict_idx, first_id) - 1 AS INTEGER) AS headword, * EXCLUDE (entry, first_id)
          FROM (SELECT entry, expression, reading, bool_or(is_primary) AS is_primary, min(dict_idx) AS dict_idx, min(id) AS first_id, count(DISTINCT id) AS n_sources,
                       string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM rows GROUP BY entry, expression, reading))"""
#: Frequencies: flag A is for all readings, N for the term's own, R for another one.
FM_SQL = """meta AS (SELECT l_returnflag AS dictionary, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS dict_idx, p_name AS expression,
 CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN split_part(p_name, ' ', 2) ELSE 'other' END AS reading, l_linenumber AS idx, count(*) AS frequency
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _rows(spark, d):
    return M.terms(spark, d).select(
        F.col("sequence").alias("entry"), "id", "dictionary", "dict_idx", "expression", "reading", "score", "tag", F.col("tag").alias("content"), (F.col("dictionary") == MAIN).alias("is_primary")
    )


def _meta(spark, d):
    flag = F.col("l_returnflag")
    part = M.table(spark, d, "part").select("p_partkey", "p_name")
    lines = M.table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    reading = F.when(flag == "N", F.split_part("p_name", F.lit(" "), F.lit(2))).when(flag == "R", "other")
    by = [flag.alias("dictionary"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("dict_idx"), F.col("p_name").alias("expression"), reading.alias("reading"), F.col("l_linenumber").alias("idx")]
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy(*by).agg(F.sum("n").alias("frequency"))


def _listed(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


# --- chains


@query("""WITH c AS (SELECT l_partkey AS entry, CASE WHEN l_linenumber % 2 = 0 THEN 'algorithm' ELSE 'dictionary' END AS source, [l_returnflag, l_linestatus] AS rules,
 l_orderkey * 10 + l_linenumber AS idx FROM lineitem)
SELECT entry, array_to_string(arg_min(rules, idx), ',') AS rules, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source FROM c GROUP BY entry, list_sort(rules)""")
def inflection_chains_merged(spark, d):
    c = M.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entry"), F.when(F.col("l_linenumber") % 2 == 0, "algorithm").otherwise("dictionary").alias("source"),
        F.array("l_returnflag", "l_linestatus").alias("rules"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"),
    )
    return R.merged_chains(c).select("entry", _listed("rules"), "source")


@query("""WITH c AS (SELECT user_id AS entry, CASE WHEN event_id % 3 = 0 THEN [event_type, 'trim'] ELSE ['trim', event_type] END AS processors, event_id AS idx FROM events)
SELECT entry, array_to_string(arg_min(processors, idx), ',') AS processors, min(idx) AS idx FROM c GROUP BY entry, list_sort(processors)""")
def text_processes_merged(spark, d):
    kind = F.col("event_type")
    chain = F.when(F.col("event_id") % 3 == 0, F.array(kind, F.lit("trim"))).otherwise(F.array(F.lit("trim"), kind))
    c = M.table(spark, d, "events").select(F.col("user_id").alias("entry"), chain.alias("processors"), F.col("event_id").alias("idx"))
    return R.merged_processes(c).select("entry", _listed("processors"), "idx")


# --- headwords, definitions, tags


@query(f"WITH {E_SQL} SELECT entry, headword, expression, reading, is_primary, dict_idx, n_sources, tags FROM heads")
def headwords_of_entries(spark, d):
    return R.headwords(_rows(spark, d))


@query(f"""WITH {E_SQL}, defs AS (SELECT entry, dictionary, rows.dict_idx AS dict_idx, content, list_sort(list(DISTINCT headword)) AS headwords, max(score) AS score,
 bool_or(rows.is_primary) AS "primary", count(*) AS n FROM rows JOIN heads USING (entry, expression, reading) GROUP BY entry, dictionary, rows.dict_idx, content)
SELECT entry, dictionary, dict_idx, content, array_to_string(headwords, ',') AS headwords, score, "primary", n FROM defs""")
def definitions_merged(spark, d):
    rows = _rows(spark, d)
    return R.definitions(rows, R.headwords(rows), merge=True).select("entry", "dictionary", "dict_idx", "content", _listed("headwords"), "score", "primary", "n")


@query(f"""WITH {E_SQL}, freq AS (SELECT p_name AS expression, min(n) AS f FROM (SELECT p_name, l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY p_name),
defs AS (SELECT entry, dictionary, rows.dict_idx AS dict_idx, content, list_sort(list(DISTINCT headword)) AS headwords, max(score) AS score, min(id) AS first_id,
 coalesce(min(f), 9007199254740991) AS frequency_order FROM rows JOIN heads USING (entry, expression, reading) LEFT JOIN freq USING (expression) GROUP BY entry, dictionary, rows.dict_idx, content)
SELECT entry, dictionary, content, frequency_order, CAST(row_number() OVER (PARTITION BY entry ORDER BY frequency_order, dict_idx, score DESC, len(headwords) DESC, headwords, first_id) AS INTEGER) AS rank FROM defs""")
def definition_order(spark, d):
    rows = _rows(spark, d)
    heads = R.headwords(rows)
    each = entries.sort_frequency(rows, M.frequencies(spark, d), "R")
    # a definition's frequency is the least of its headwords'
    order = rows.join(each, "expression").groupBy("entry", "dictionary", "content").agg(F.min("frequency_order").alias("frequency_order"))
    defs = R.definitions(rows, heads, merge=True).join(order, ["entry", "dictionary", "content"])
    return R.definition_order(defs).select("entry", "dictionary", "content", "frequency_order", "rank")


@query(f"WITH {E_SQL} SELECT entry, expression, dictionary, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM rows GROUP BY entry, expression, dictionary")
def tag_groups(spark, d):
    return R.tag_groups(_rows(spark, d), ["entry", "expression"]).select("entry", "expression", "dictionary", _listed("tags"))


@query(f"""WITH {E_SQL}, t AS (SELECT DISTINCT entry, tag AS name, CAST(split_part(tag, '#', 2) AS INTEGER) % 7 AS ord FROM rows)
SELECT entry, name, ord, CAST(row_number() OVER (PARTITION BY entry ORDER BY ord, name) AS INTEGER) AS place FROM t""")
def tag_order(spark, d):
    t = _rows(spark, d).select("entry", F.col("tag").alias("name"), (F.split_part("tag", F.lit("#"), F.lit(2)).cast("int") % 7).alias("ord")).distinct()
    return R.tag_order(t, ["entry"])


@query(f"""WITH {E_SQL} SELECT entry, tag, array_to_string(list_sort(list(DISTINCT headword)), ',') AS headwords FROM rows JOIN heads USING (entry, expression, reading) GROUP BY entry, tag""")
def term_tags_grouped(spark, d):
    rows = _rows(spark, d)
    return R.grouped_tags(rows, R.headwords(rows)).select("entry", "tag", _listed("headwords"))


@query(f"""WITH {E_SQL}, k AS (SELECT rows.*, headword FROM rows JOIN heads USING (entry, expression, reading) WHERE dictionary NOT IN ('{MAIN}', 'PROMO'))
SELECT entry, id, headword, CAST(dense_rank() OVER (PARTITION BY entry ORDER BY headword) - 1 AS INTEGER) AS new_headword FROM k""")
def exclude_and_renumber(spark, d):
    rows = _rows(spark, d)
    defs = rows.join(R.headwords(rows).select("entry", "expression", "reading", "headword"), ["entry", "expression", "reading"])
    return R.excluded(defs, [MAIN, "PROMO"]).select("entry", "id", "headword", "new_headword")


@query(f"""WITH {T_SQL}, x AS (SELECT reading AS deinflection, expression AS entry, sequence % 3 = 0 AS form_of FROM terms)
SELECT deinflection, entry, count(*) AS definitions FROM x WHERE NOT form_of GROUP BY ALL""")
def form_of_dropped(spark, d):
    defs = M.terms(spark, d).select(F.col("reading").alias("deinflection"), F.col("expression").alias("entry"), (F.col("sequence") % 3 == 0).alias("form_of"))
    return R.without_form_of(defs)


# --- metadata


@query(f"""WITH {E_SQL}, {FM_SQL} SELECT entry, headword, meta.dictionary, frequency, meta.reading IS NOT NULL AS has_reading,
 CAST(row_number() OVER (PARTITION BY entry ORDER BY headword, meta.dict_idx, idx) - 1 AS INTEGER) AS index
FROM heads JOIN meta ON heads.expression = meta.expression WHERE meta.reading IS NULL OR meta.reading = heads.reading""")
def headword_frequencies(spark, d):
    out = R.meta_for_headwords(R.headwords(_rows(spark, d)), _meta(spark, d))
    return out.select("entry", "headword", "dictionary", "frequency", "has_reading", "index")


ASKED = [("blue anvil", None), ("blue anvil", "anvil"), ("small ring", "bolt"), ("small ring", None), ("no such term", None)]
_ASKED = "(VALUES " + ", ".join(f"({i}, '{t}', {'NULL' if r is None else repr(r)})" for i, (t, r) in enumerate(ASKED)) + ")"


@query(f"""WITH {FM_SQL}, q(pos, term, reading) AS {_ASKED} SELECT pos, term, coalesce(q.reading, meta.reading) AS reading, meta.reading IS NOT NULL AS has_reading, dictionary, frequency
FROM q JOIN meta ON term = expression WHERE q.reading IS NULL OR meta.reading IS NULL OR q.reading = meta.reading""")
def term_frequencies(spark, d):
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(ASKED)], "pos int, term string, reading string")
    return R.wanted_frequencies(asked, _meta(spark, d))


@query(f"""WITH {FM_SQL} SELECT dictionary, expression, reading, array_to_string(list_sort(list(DISTINCT frequency)), ',') AS frequencies FROM meta GROUP BY dictionary, expression, reading""")
def frequencies_by_reading(spark, d):
    return R.grouped_frequencies(_meta(spark, d), ["expression", "reading"]).select("dictionary", "expression", "reading", _listed("frequencies"))


@query("""WITH m AS (SELECT c_mktsegment AS dictionary, n_name AS "character", count(*) AS frequency FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name, c_custkey % 3)
SELECT dictionary, "character", array_to_string(list_sort(list(DISTINCT frequency)), ',') AS frequencies FROM m GROUP BY ALL""")
def kanji_frequencies_grouped(spark, d):
    nation = M.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("character"))
    c = M.table(spark, d, "customer")
    m = c.join(nation, c["c_nationkey"] == nation["n_nationkey"]).groupBy(F.col("c_mktsegment").alias("dictionary"), "character", F.col("c_custkey") % 3).agg(F.count("*").alias("frequency"))
    return R.grouped_frequencies(m, ["character"]).select("dictionary", "character", _listed("frequencies"))


@query("""WITH s AS (SELECT r_name AS "character", CASE WHEN n_nationkey % 2 = 0 THEN 'misc' ELSE 'class' END AS category, n_name AS name, n_nationkey % 4 AS ord, 'about ' || n_name AS content FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT "character", category, name, ord, CAST(row_number() OVER (PARTITION BY "character", category ORDER BY ord, content COLLATE "en", name) AS INTEGER) AS place FROM s""".replace(' COLLATE "en"', ""))
def kanji_stats_grouped(spark, d):
    region = M.table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("character"))
    n = M.table(spark, d, "nation")
    s = n.join(region, n["n_regionkey"] == region["r_regionkey"]).select(
        "character", F.when(F.col("n_nationkey") % 2 == 0, "misc").otherwise("class").alias("category"), F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 4).alias("ord"), F.concat(F.lit("about "), "n_name").alias("content"),
    )
    return R.grouped_stats(s, "character").select("character", "category", "name", "ord", "place")


_PITCH = f"""WITH {T_SQL}, p AS (SELECT sequence AS entry, dictionary, expression, reading, CAST(score AS INTEGER) % 4 AS position FROM terms),
a AS (SELECT entry, count(DISTINCT expression) AS nt, count(DISTINCT reading) AS nr FROM p GROUP BY entry),
g AS (SELECT entry, dictionary, position, list_sort(list(DISTINCT expression)) AS terms, list_sort(list(DISTINCT reading)) AS readings FROM p GROUP BY entry, dictionary, position)"""


def _pitch(spark, d):
    return M.terms(spark, d).select(F.col("sequence").alias("entry"), "dictionary", "expression", "reading", (F.col("score").cast("int") % 4).alias("position"))


@query(_PITCH + """ SELECT entry, dictionary, position, array_to_string(terms, ',') AS terms, array_to_string(readings, ',') AS readings,
 CASE WHEN len(terms) < nt THEN array_to_string(terms, ',') ELSE '' END AS exclusive_terms, CASE WHEN len(readings) < nr THEN array_to_string(readings, ',') ELSE '' END AS exclusive_readings FROM g JOIN a USING (entry)""")
def pronunciations_grouped(spark, d):
    out = R.grouped_pronunciations(_pitch(spark, d), ["position"])
    return out.select("entry", "dictionary", "position", *map(_listed, ("terms", "readings", "exclusive_terms", "exclusive_readings")))


@query(_PITCH + """, k AS (SELECT expression, CASE WHEN position = 0 THEN 'heiban' WHEN length(expression) % 2 = 0 THEN 'kifuku' WHEN position = 1 THEN 'atamadaka' WHEN position >= length(reading) - 2 THEN 'odaka' ELSE 'nakadaka' END AS c FROM p)
SELECT expression, string_agg(DISTINCT c, ',' ORDER BY c) AS categories FROM k GROUP BY expression""")
def pitch_categories(spark, d):
    rows = _pitch(spark, d).select("expression", "position", (F.length("reading") - 2).alias("morae"), (F.length("expression") % 2 == 0).alias("inflects"))
    return R.pitch_categories(rows, "expression").select("expression", _listed("categories"))


@query(f"""WITH {FM_SQL}, x AS (SELECT expression, unnest(regexp_extract_all(frequency || ' (' || (frequency * 3 % 7 + 1) || '/' || idx || ')', '\\d+')) AS n FROM meta WHERE dictionary = 'N')
SELECT expression, min(CAST(n AS BIGINT)) AS frequency FROM x GROUP BY expression""")
def selected_frequency(spark, d):
    f = F.col("frequency")
    shown = F.concat(f.cast("string"), F.lit(" ("), (f * 3 % 7 + 1).cast("string"), F.lit("/"), F.col("idx").cast("string"), F.lit(")"))
    return R.selected_frequency(_meta(spark, d).withColumn("display", shown), "N")


# --- sets, texts, database


@query(f"""WITH {T_SQL}, s AS (SELECT sequence, list_sort(list(DISTINCT expression)) AS terms, list_sort(list(DISTINCT reading)) AS readings FROM terms GROUP BY sequence)
SELECT sequence, list_has_any(terms, ['blue anvil', 'small ring']) AS any_of, len(list_filter(readings, lambda x: NOT list_contains(['ring', 'bolt'], x))) AS others FROM s""")
def set_tests(spark, d):
    s = M.terms(spark, d).groupBy("sequence").agg(F.collect_set("expression").alias("terms"), F.collect_set("reading").alias("readings"))
    some, known = F.array(F.lit("blue anvil"), F.lit("small ring")), F.array(F.lit("ring"), F.lit("bolt"))
    return s.select("sequence", F.arrays_overlap("terms", some).alias("any_of"), F.size(F.array_except("readings", known)).cast("long").alias("others"))


@query(r"""WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_custkey || '日本語' || c_name WHEN 1 THEN 'かな漢字' || c_custkey || '한국 text' WHEN 2 THEN c_name ELSE '中文。' || c_name END AS text FROM customer)
SELECT id, regexp_extract(text, '^[0-9\x{1100}-\x{11FF}\x{2E80}-\x{2FDF}\x{3000}-\x{318F}\x{31A0}-\x{32FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF01}-\x{FFEF}\x{20000}-\x{323AF}]*') AS prefix FROM t""")
def cjk_prefix(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    text = (
        F.when(key % 4 == 0, F.concat(key.cast("string"), F.lit("日本語"), name)).when(key % 4 == 1, F.concat(F.lit("かな漢字"), key.cast("string"), F.lit("한국 text")))
        .when(key % 4 == 2, name).otherwise(F.concat(F.lit("中文。"), name))
    )
    return M.table(spark, d, "customer").select(key.alias("id"), R.cjk_prefix(text).alias("prefix"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp') ELSE substr(url, 9) END AS url FROM pages)
SELECT page_id, coalesce(regexp_matches(url, '^(?i:https?)://[^/?#\s]+'), false) AS valid FROM u""")
def url_validation(spark, d):
    url, k = F.col("url"), F.col("page_id") % 3
    u = F.when(k == 0, url).when(k == 1, F.replace(url, F.lit("http"), F.lit("ftp"))).otherwise(F.substring(url, 9, 1 << 20))
    return M.table(spark, d, "pages").select("page_id", R.valid_url(u).alias("valid"))


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN epoch_us(ts) // 1000 + 3600000 WHEN 2 THEN epoch_us(ts) // 1000 + 86400000 ELSE epoch_us(ts) // 1000 + 604800000 END AS next_ms FROM events""")
def next_updates(spark, d):
    k = F.col("user_id") % 4
    kind = F.when(k == 0, "manual").when(k == 1, "hourly").when(k == 2, "daily").otherwise("weekly")
    return M.table(spark, d, "events").select("event_id", R.next_update(F.unix_millis(F.col("ts").cast("timestamp")), kind).alias("next_ms"))


@query("""WITH w AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, substr(t, 1, 7) AS forward, CASE WHEN length(t) <= 5 THEN t ELSE substr(t, length(t) - 4) END AS backward FROM w""")
def code_point_slices(spark, d):
    t = F.coalesce("text", F.lit(""))
    return M.table(spark, d, "documents").select("doc_id", F.substring(t, 1, 7).alias("forward"), F.when(F.length(t) <= 5, t).otherwise(F.substring(t, F.length(t) - 4, F.lit(5))).alias("backward"))


@query(f"""WITH {T_SQL}, r AS (SELECT p_name || '/' || p_partkey AS keyword, CASE WHEN p_partkey % 5 = 0 THEN '@@@LINK= ' || p_name || '/' || (p_partkey + 1 + p_partkey % 3) ELSE p_brand END AS text, p_partkey AS seq FROM part),
l AS (SELECT keyword AS alias, trim(substr(text, 9)) AS target FROM r WHERE starts_with(text, '@@@LINK=')), o AS (SELECT * FROM r WHERE NOT starts_with(text, '@@@LINK='))
SELECT keyword AS expression, seq, false AS alias FROM o UNION ALL SELECT l.alias, seq, true FROM l JOIN o ON target = keyword WHERE l.alias <> keyword""")
def redirect_join(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    link = F.concat(F.lit("@@@LINK= "), name, F.lit("/"), (k + 1 + k % 3).cast("string"))
    r = M.table(spark, d, "part").select(F.concat(name, F.lit("/"), k.cast("string")).alias("keyword"), F.when(k % 5 == 0, link).otherwise(F.col("p_brand")).alias("text"), k.alias("seq"))
    return R.redirected(r)


@query("""SELECT documents.doc_id, md5(coalesce(text, '')) AS content, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id""")
def left_outer_content(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    return docs.join(M.table(spark, d, "labels"), "doc_id", "left").select("doc_id", "content", "quality", "toxic")


@query("""SELECT d.doc_id, (SELECT min(c.doc_id) FROM documents c WHERE coalesce(c.text, '') = coalesce(d.text, '')) AS content_id FROM documents d""")
def content_id_update(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("content_id")), "h").select("doc_id", "content_id")


_NOTES = """n AS (SELECT conv_id * 1000 + turn AS note_id, role AS model, 'deck' || conv_id % 2 || '::' || conv_id % 5 AS deck, substr(text, 1, 3) AS first_field FROM conversations)"""


def _notes(spark, d):
    c = F.col("conv_id")
    deck = F.concat(F.lit("deck"), (c % 2).cast("string"), F.lit("::"), (c % 5).cast("string"))
    return M.table(spark, d, "conversations").select((c * 1000 + F.col("turn")).alias("note_id"), F.col("role").alias("model"), deck.alias("deck"), F.substring("text", 1, 3).alias("first_field"))


@query(f"""WITH {_NOTES}, f AS (SELECT a.note_id, list_sort(list(DISTINCT b.note_id)) AS x FROM n a JOIN n b ON a.first_field = b.first_field AND a.model = b.model AND split_part(a.deck, '::', 1) = split_part(b.deck, '::', 1) AND a.note_id <> b.note_id GROUP BY a.note_id)
SELECT n.note_id, coalesce(array_to_string(x, ','), '') AS duplicates FROM n LEFT JOIN f ON n.note_id = f.note_id""")
def note_duplicates_deck_root(spark, d):
    n = _notes(spark, d)
    return R.duplicate_notes(n, n, "deck-root").select("note_id", _listed("duplicates"))


@query(f"""WITH {T_SQL}, s AS (SELECT DISTINCT dictionary FROM terms WHERE dict_idx % 2 = 1), h AS (SELECT DISTINCT expression, reading, sequence FROM terms WHERE dictionary = '{MAIN}' AND sequence >= 0),
r AS (SELECT id, expression, reading FROM terms JOIN s USING (dictionary)) SELECT h.sequence, r.id, r.expression FROM r JOIN h USING (expression, reading)""")
def secondary_dictionaries(spark, d):
    t = M.terms(spark, d)
    allowed = t.select("dictionary", (F.col("dict_idx") % 2 == 1).alias("allow_secondary")).distinct().filter("allow_secondary").select("dictionary")
    heads = t.filter((F.col("dictionary") == MAIN) & (F.col("sequence") >= 0)).select("expression", "reading", "sequence").distinct()
    rows = t.join(F.broadcast(allowed), "dictionary").select("id", "expression", "reading")
    return rows.join(heads, ["expression", "reading"]).select("sequence", "id", "expression")


@query(f"""WITH {T_SQL}, g AS (SELECT sequence, list_sort(list(DISTINCT expression)) AS x FROM terms GROUP BY sequence) SELECT sequence, array_to_string(x[1:3], ',') AS shown FROM g""")
def each_up_to(spark, d):
    g = M.terms(spark, d).groupBy("sequence").agg(F.slice(F.array_sort(F.collect_set("expression")), 1, 3).alias("shown"))
    return g.select("sequence", _listed("shown"))


@query(f"""WITH {T_SQL}, q(pos, term) AS (VALUES {_values(["Brand#13", "Brand#99", "Brand#21"])})
SELECT pos, term, CAST(min(dict_idx) AS INTEGER) AS dict_idx FROM q JOIN terms ON term = tag GROUP BY pos, term""")
def single_tag_lookup(spark, d):
    q = _batch(spark, ["Brand#13", "Brand#99", "Brand#21"])
    t = M.terms(spark, d).groupBy(F.col("tag").alias("term")).agg(F.min("dict_idx").alias("dict_idx"))
    return q.join(t, "term").select("pos", "term", "dict_idx")


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (SELECT doc_id, regexp_extract(text, '^(?s:.)[^.?!…。．？！]*') AS segment FROM t)
SELECT doc_id, segment FROM h""")
def primary_segments(spark, d):
    from lexengine.functions.notes import primary_segment

    return M.table(spark, d, "documents").select("doc_id", primary_segment(F.coalesce("text", F.lit("")), particles="\x00").alias("segment"))
