"""Registered queries over legal text that is built from table columns, so that SQL can tell the facts without reading it.

An order is an article: its law, numbers and which clauses its text has follow from its keys. The library reads the
text; the SQL beside it takes the same facts from the columns.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexmill.functions import arabic, articles, coerce
from lexmill.operators import cases, chunking, extraction, graph, quality, search
from lexmill.session import new_folder

from .catalogue import query, table

#: Columns of an article by expressions that Spark and DuckDB read alike.
_BASE = """o_orderkey AS k, 'law' || (o_orderkey % 25) AS law_id, CAST(o_orderkey AS STRING) AS article_number, 1 + o_orderkey % 7 AS a,
  2 + o_orderkey % 7 + o_custkey % 9 AS b, 1000 + o_custkey AS f, 6000 + o_custkey AS g, o_orderkey - 25 AS ref"""
_TEXT = """'نص عام رقم ' || k || '. ' ||
  CASE WHEN k % 3 = 0 THEN 'يعاقب بالسجن مدة من ' || a || ' إلى ' || b || ' سنوات. ' ELSE '' END ||
  CASE WHEN k % 3 = 1 THEN 'يعاقب بغرامة لا تقل عن ' || f || ' جنيه ولا تزيد على ' || g || ' جنيه. ' ELSE '' END ||
  CASE WHEN k % 11 = 0 THEN 'وتكون العقوبة الإعدام. ' ELSE '' END ||
  CASE WHEN k % 5 = 0 THEN 'تسري المادة ' || ref || ' على ذلك. ' ELSE '' END ||
  CASE WHEN k % 4 = 0 THEN 'يُقصد ب "مصطلح' || (k % 50) || '": معنى ' || k || '. ' ELSE '' END ||
  CASE WHEN k % 6 = 1 THEN 'جريمة سرقة. ' WHEN k % 6 = 2 THEN 'حيازة سلاح. ' ELSE '' END"""
_SQL = f"WITH base AS (SELECT {_BASE} FROM orders), art AS (SELECT *, {_TEXT} AS text FROM base)"


def _articles(spark, sf_dir):
    base = table(spark, sf_dir, "orders").selectExpr(*re.split(r",\s+", _BASE))
    return base.withColumn("text", F.expr(_TEXT))


_PENALTIES = """SELECT law_id, article_number, 'سجن' AS penalty_type, CAST(a AS BIGINT) AS min_value, CAST(b AS BIGINT) AS max_value, 'سنوات' AS unit FROM base WHERE k % 3 = 0
  UNION ALL SELECT law_id, article_number, 'غرامة', CAST(f AS BIGINT), CAST(g AS BIGINT), 'جنيه' FROM base WHERE k % 3 = 1
  UNION ALL SELECT law_id, article_number, 'إعدام', NULL, NULL, NULL FROM base WHERE k % 11 = 0"""


@query(f"{_SQL} {_PENALTIES}")
def penalties_of_articles(spark, sf_dir):
    return extraction.penalties(_articles(spark, sf_dir))


_DEFINITIONS = """SELECT law_id, 'مصطلح' || (k % 50) AS term, min_by('معنى ' || k, article_number) AS definition_text, min(article_number) AS defined_in_article
  FROM base WHERE k % 4 = 0 GROUP BY 1, 2"""


@query(f"{_SQL} {_DEFINITIONS}")
def definitions_of_articles(spark, sf_dir):
    return extraction.definitions(_articles(spark, sf_dir))


@query(f"{_SQL} SELECT law_id, article_number AS from_article, CAST(ref AS STRING) AS to_article, 'mentions' AS reference_type FROM base WHERE k % 5 = 0 AND ref > 0")
def references_of_articles(spark, sf_dir):
    return extraction.references(_articles(spark, sf_dir).filter("ref > 0"))


_TOPICS = "SELECT law_id, article_number, CASE WHEN k % 6 = 1 THEN 'سرقة' ELSE 'أسلحة' END AS topic_name, CAST(0.8 AS DOUBLE) AS confidence FROM base WHERE k % 6 IN (1, 2)"


@query(f"{_SQL} {_TOPICS}")
def topics_of_articles(spark, sf_dir):
    return extraction.topics(_articles(spark, sf_dir))


@query(f"{_SQL} SELECT law_id, article_number, unnest(list_filter(['money', 'theft'], lambda t: (t = 'money' AND k % 3 = 1) OR (t = 'theft' AND k % 6 = 1))) AS topic_name FROM base")
def topics_by_pattern(spark, sf_dir):
    patterns = spark.createDataFrame([("money", r"(?U)جنيه"), ("theft", "سرقة")], "topic_name string, pattern string")
    return extraction.topics_by_patterns(_articles(spark, sf_dir), patterns)


@query(f"""{_SQL}, w AS (SELECT DISTINCT 'مصطلح' || (k % 50) AS term, k % 50 AS n FROM base)
  SELECT law_id, article_number, 't' || (k % 50) AS topic_name FROM base WHERE k % 4 = 0 UNION ALL SELECT law_id, article_number, 'range' FROM base WHERE k % 3 = 0 UNION ALL SELECT law_id, article_number, 'either' FROM base WHERE k % 6 IN (1, 2)""")
def topics_by_many_patterns(spark, sf_dir):
    """A pattern for each term of the texts, one of two words, and one that names no word."""
    art = _articles(spark, sf_dir)
    terms = art.select((F.col("k") % 50).alias("n")).distinct().select(F.concat(F.lit("t"), "n").alias("topic_name"), F.concat(F.lit('["]مصطلح'), "n", F.lit('["]')).alias("pattern"))
    more = spark.createDataFrame([("range", r"[0-9]+\s+\S+\s+[0-9]+\s+[^\s.]+[.]"), ("either", "سرقة|سلاح")], "topic_name string, pattern string")
    return extraction.topics_by_patterns(art, terms.unionByName(more))


@query(f"""{_SQL}, p AS ({_PENALTIES}), d AS ({_DEFINITIONS}), t AS ({_TOPICS}) SELECT law_id, count(*) AS articles,
  (SELECT count(*) FROM p WHERE p.law_id = base.law_id) AS penalties, (SELECT count(*) FROM d WHERE d.law_id = base.law_id) AS definitions,
  (SELECT count(*) FROM t WHERE t.law_id = base.law_id) AS topics FROM base GROUP BY law_id""")
def extraction_summary(spark, sf_dir):
    art = _articles(spark, sf_dir)
    return extraction.summary(art, {"penalties": extraction.penalties(art), "definitions": extraction.definitions(art), "topics": extraction.topics(art)})


_WHOLE = "'قانون عام\n' || string_agg('المادة ' || article_number || ': ' || text, chr(10) ORDER BY k)"


def _law_parts(spark, sf_dir):
    """Laws in parts of some lines, as a law's whole text grows with the table: first its title, then its articles."""
    listed = F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("المادة "), "article_number", F.lit(": "), "text").alias("t"))))
    lines = F.array_join(F.transform(listed, lambda x: x["t"]), "\n")
    parts = _articles(spark, sf_dir).groupBy("law_id", F.expr("k div 6400").alias("part")).agg(lines.alias("text"))
    return parts.unionByName(_articles(spark, sf_dir).select("law_id").distinct().select("law_id", F.lit(-(1 << 62)).alias("part"), F.lit("قانون عام").alias("text")))


_SPLIT = """SELECT law_id, 0 AS pos, CAST(NULL AS STRING) AS article_number, 'قانون عام' AS page_content FROM base GROUP BY 1
  UNION ALL SELECT law_id, CAST(row_number() OVER (PARTITION BY law_id ORDER BY k) AS INTEGER), article_number, trim(text) FROM art"""


@query(f"{_SQL}, s AS ({_SPLIT}) SELECT law_id, pos, article_number, CASE WHEN article_number IS NULL THEN 'preamble' ELSE 'article' END AS chunk_type, sha256(page_content) AS sha FROM s")
def articles_of_law_texts(spark, sf_dir):
    split = chunking.split_articles_of_parts(_law_parts(spark, sf_dir), "law_id")
    return split.select("law_id", "pos", "article_number", chunking.chunk_type(F.col("article_number")).alias("chunk_type"), F.sha2("page_content", 256).alias("sha"))


@query(f"""{_SQL} SELECT law_id, CAST(k % 40 + 1 AS STRING) AS table_number, sha256('جدول رقم ' || (k % 40 + 1) || chr(10) || string_agg(k || ' - مادة', chr(10) ORDER BY k)) AS sha
  FROM base GROUP BY law_id, k % 40 + 1""")
def tables_of_law_texts(spark, sf_dir):
    rows = _articles(spark, sf_dir).groupBy("law_id", F.expr("k % 40 + 1").alias("n")).agg(F.array_sort(F.collect_list("k")).alias("ks"))
    one = rows.select("law_id", "n", F.concat(F.lit("جدول رقم "), "n", F.lit("\n"), F.array_join(F.transform("ks", lambda k: F.concat(k, F.lit(" - مادة"))), "\n")).alias("t"))
    files = one.groupBy("law_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return chunking.split_tables(files).select("law_id", "table_number", F.sha2(F.regexp_replace("page_content", r"\s+$", ""), 256).alias("sha"))


_MONTH = "CASE k % 3 WHEN 0 THEN 'يناير' WHEN 1 THEN 'مايو' ELSE 'ديسمبر' END"
_AMEND = f"""'مقدمة القانون رقم ' || (1 + k % 300) || ' لسنة ' || (1950 + k % 60) || ' ' ||
  CASE k % 4 WHEN 0 THEN 'تضاف مادة' WHEN 1 THEN 'يلغى نص' ELSE 'يستبدل نص' END || ' المادة ' || (k % 90 + 1) || ' والمادة ' || (k % 70 + 2) ||
  CASE WHEN k % 2 = 0 THEN ' الموافق الاثنين ' || (10 + k % 18) || ' ' || {_MONTH} || ' سنة ' || (1950 + k % 60) ELSE '' END || '. المادة الأولى: وصف ' || k || ' المادة الثانية: ينشر'"""


@query(f"""{_SQL} SELECT k, CAST(1 + k % 300 AS STRING) AS amendment_law_number, 'قانون رقم ' || (1 + k % 300) || ' لسنة ' || (1950 + k % 60) AS amendment_law_title,
  (1950 + k % 60) || CASE WHEN k % 2 = 1 THEN '-01-01' ELSE CASE k % 3 WHEN 0 THEN '-01-' WHEN 1 THEN '-05-' ELSE '-12-' END || (10 + k % 18) END AS amendment_date,
  CASE k % 4 WHEN 0 THEN 'addition' WHEN 1 THEN 'deletion' ELSE 'modification' END AS amendment_type,
  CASE WHEN k % 90 + 1 = k % 70 + 2 THEN CAST(k % 90 + 1 AS STRING) ELSE (k % 90 + 1) || ',' || (k % 70 + 2) END AS touched, 'وصف ' || k AS description FROM base""")
def amendments_of_files(spark, sf_dir):
    files = _articles(spark, sf_dir).select(F.concat("law_id", F.lit("#"), "k").alias("law_id"), F.lit("file.txt").alias("name"), F.expr(_AMEND).alias("text"))
    found = extraction.amendments(files)
    return found.select(F.substring_index("law_id", "#", -1).cast("long").alias("k"), "amendment_law_number", "amendment_law_title", "amendment_date", "amendment_type", F.array_join("amended_article_numbers", ",").alias("touched"), "description")


@query(f"{_SQL} SELECT k, CAST(k % 900 + 1 AS STRING) AS number, CAST(1990 + k % 30 AS STRING) AS year FROM base")
def amendment_law_of_names(spark, sf_dir):
    name = F.expr("CASE k % 3 WHEN 0 THEN 'x_num' || (k % 900 + 1) || '_' || (1990 + k % 30) || '.txt' WHEN 1 THEN 'law_' || (k % 900 + 1) || '_' || (1990 + k % 30) || '.TXT' ELSE (1990 + k % 30) || '-' || (k % 900 + 1) || ' amendment.txt' END")
    number, year = chunking.amendment_law(name, F.lit(""))
    return _articles(spark, sf_dir).select("k", number.alias("number"), year.alias("year"))


@query(f"""{_SQL} SELECT k, CAST(k AS STRING) AS case_number, CAST(1 + k % 90 AS STRING) AS case_year, (1 + k % 28) || '/' || (1 + k % 12) || '/' || (1980 + k % 40) AS ruling_date,
  'الجنائية رقم ' || (k % 9) AS chamber FROM base""")
def ruling_heads(spark, sf_dir):
    text = F.expr("'الطعن رقم ' || k || ' لسنة ' || (1 + k % 90) || ' ق، جلسة ' || (1 + k % 28) || '/' || (1 + k % 12) || '/' || (1980 + k % 40) || chr(10) || 'الدائرة الجنائية رقم ' || (k % 9) || '، باسم الشعب'")
    return _articles(spark, sf_dir).withColumn("t", text).select("k", *chunking.ruling_fields(F.col("t")))


#: Articles of a customer's orders, some after a section's or a chapter's head, of very different lengths.
_OUTLINE = """SELECT o_custkey AS doc_id, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'الباب ' || (o_orderkey % 90) || chr(10) ELSE '' END AS sec,
  CASE WHEN o_orderkey % 6 = 0 THEN 'الفصل ' || (o_orderkey % 70) || chr(10) ELSE '' END AS cha, 'المادة ' || o_orderkey || ': ' || repeat('كلمة ', CAST(o_orderkey % 120 AS INTEGER)) || chr(10) AS art FROM orders"""


@query(f"""WITH o AS ({_OUTLINE}), p AS (SELECT *, coalesce(sum(length(sec) + length(cha) + length(art)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM o),
  a AS (SELECT doc_id, k, begin + length(sec) + length(cha) AS place, trim(art, ' ' || chr(10)) AS body FROM p),
  h AS (SELECT doc_id, 'section' AS kind, begin AS place, trim(sec, chr(10)) AS value FROM p WHERE sec <> '' UNION ALL SELECT doc_id, 'chapter', begin + length(sec), trim(cha, chr(10)) FROM p WHERE cha <> ''),
  s AS (SELECT a.*, (SELECT min_by(value, h.place) FROM h WHERE h.doc_id = a.doc_id AND kind = 'section' AND h.place < a.place AND h.place >= a.place - 500) AS section,
    (SELECT min_by(value, h.place) FROM h WHERE h.doc_id = a.doc_id AND kind = 'chapter' AND h.place < a.place AND h.place >= a.place - 500) AS chapter FROM a),
  nexts AS (SELECT *, lead(place) OVER (PARTITION BY doc_id ORDER BY place) AS next_place FROM s), heads AS (SELECT doc_id, k, (SELECT string_agg(value, chr(10) ORDER BY h.place) FROM h WHERE h.doc_id = n.doc_id AND h.place > n.place AND (n.next_place IS NULL OR h.place < n.next_place)) AS rest FROM nexts n)
  SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(k AS STRING) AS article_number, last_value(section IGNORE NULLS) OVER w AS section, last_value(chapter IGNORE NULLS) OVER w AS chapter,
    sha256(CASE WHEN rest IS NULL THEN body ELSE art || rest END) AS sha FROM nexts JOIN heads USING (doc_id, k) JOIN (SELECT k, art FROM p) USING (k) WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def articles_with_context(spark, sf_dir):
    made = spark.sql(_OUTLINE.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    listed = F.array_sort(F.collect_list(F.struct("k", F.concat("sec", "cha", "art").alias("t"))))
    texts = made.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "").alias("text"))
    found = chunking.articles_in_context(texts)
    return found.select("doc_id", F.col("at").alias("place"), "article_number", "section", "chapter", F.sha2("page_content", 256).alias("sha"))


# The graph -------------------------------------------------------------------------------------------------------------

_ID = "substring(sha256(law_id || '|' || article_number || '|' || k), 1, 16)"


def _nodes(spark, sf_dir):
    return graph.article_nodes(_articles(spark, sf_dir).withColumn("pos", F.col("k")))


def _kept(facts):
    """facts written to the shared folder and read again."""
    path = new_folder(facts.sparkSession, "facts")
    facts.write.parquet(path)
    return facts.sparkSession.read.schema(facts.schema).parquet(path)


def _graph(spark, sf_dir, **options):
    art = _articles(spark, sf_dir)
    found = [extraction.penalties(art), extraction.definitions(art), extraction.references(art.filter("ref > 0")), extraction.topics(art)]
    return graph.build_facts(_nodes(spark, sf_dir), *found, **options)


@query(f"""{_SQL}, p AS ({_PENALTIES}), d AS ({_DEFINITIONS}), t AS ({_TOPICS}), n(kind, name, n) AS (
  SELECT 'node', 'Article', count(*) FROM base UNION ALL SELECT 'node', 'Penalty', count(*) FROM p UNION ALL SELECT 'node', 'Definition', count(*) FROM d
  UNION ALL SELECT 'node', 'Topic', count(DISTINCT topic_name) FROM t UNION ALL SELECT 'edge', 'CONTAINS', count(*) FROM base UNION ALL SELECT 'edge', 'HAS_PENALTY', count(*) FROM p
  UNION ALL SELECT 'edge', 'DEFINES', count(*) FROM d UNION ALL SELECT 'edge', 'TAGGED_WITH', count(*) FROM t
  UNION ALL SELECT 'edge', 'REFERENCES', count(*) FROM base x JOIN base y ON y.k = x.ref WHERE x.k % 5 = 0 AND x.ref > 0)
  SELECT * FROM n UNION ALL SELECT 'node', unnest(['Law', 'Amendment', 'Table', 'TableChunk']), 0 UNION ALL SELECT 'edge', unnest(['HAS_TABLE', 'HAS_CHUNK', 'HAS_AMENDMENT', 'AMENDED_BY', 'SUPERSEDES']), 0""")
def graph_statistics(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir, keep=_kept)
    return graph.statistics(nodes, edges, spark)


@query(f"{_SQL} SELECT {_ID.replace('law_id', 'x.law_id').replace('article_number', 'x.article_number').replace('|| k', '|| x.k')} AS id, CAST(y.article_number AS STRING) AS referenced FROM base x JOIN base y ON y.k = x.ref WHERE x.k % 5 = 0 AND x.ref > 0")
def referenced_articles(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    found = graph.with_references(nodes["Article"], edges).filter("size(referenced) > 0")
    return found.select("id", F.array_join(F.col("referenced.article_number"), ",").alias("referenced"))


@query(f"{_SQL} SELECT {_ID} AS id, law_id, article_number FROM base WHERE k % 6 = 1")
def articles_of_topic(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.linked_articles(edges, nodes["Article"], "TAGGED_WITH", nodes["Topic"].filter("name = 'سرقة'")).select("id", "law_id", "article_number")


#: Amendments by lineitem: of the article of its order, dated by its supplier, an addition, deletion or modification.
_CHANGES = """SELECT 'am' || l_orderkey || '.' || l_linenumber AS amendment_id, 'law' || (l_orderkey % 25) AS law_id, CAST(l_suppkey AS STRING) AS amendment_law_number,
  (1950 + l_suppkey % 60) || '-01-' || (10 + l_linenumber) AS amendment_date,
  CASE l_partkey % 3 WHEN 0 THEN 'addition' WHEN 1 THEN 'modification' ELSE 'deletion' END AS amendment_type, CAST(l_orderkey AS STRING) AS article_number, 'd' || l_partkey AS description
  FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2)"""


def _changes(spark, sf_dir):
    columns = _CHANGES.removeprefix("SELECT ").split("\n  FROM ")[0]
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    return spark.sql(f"SELECT {columns} FROM {{lines}}", lines=lines).withColumn("amended_article_numbers", F.array("article_number")).drop("article_number")


_MADE = f"""c AS ({_CHANGES}), seq AS (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY amendment_date, amendment_law_number, amendment_id) AS seq FROM c),
  made AS (SELECT *, CASE amendment_type WHEN 'addition' THEN 'added' ELSE 'amended' END AS tag, CAST(article_number AS BIGINT) AS k FROM seq WHERE amendment_type <> 'deletion'),
  vers AS (SELECT substring(sha256(law_id || '|' || article_number || '|' || tag || '|' || amendment_date), 1, 16) AS id, law_id, article_number, tag, amendment_date AS version, min(seq) AS since FROM made GROUP BY ALL),
  olds AS (SELECT law_id, article_number, {_ID} AS id, 'original' AS tag, 0 AS since, NULL AS version FROM base UNION ALL SELECT law_id, article_number, id, tag, since, version FROM vers)"""


@query(f"""{_SQL}, {_MADE} SELECT rel, count(*) AS n FROM (
  SELECT DISTINCT 'AMENDED_BY' AS rel, o.id, s.amendment_id AS other FROM seq s JOIN olds o USING (law_id, article_number) WHERE o.since < s.seq OR (s.amendment_type = 'addition' AND o.tag = 'added' AND o.version = s.amendment_date)
  UNION ALL SELECT DISTINCT 'SUPERSEDES', v.id, o.id FROM made m JOIN vers v ON v.law_id = m.law_id AND v.article_number = m.article_number AND v.tag = m.tag AND v.version = m.amendment_date
    JOIN olds o ON o.law_id = m.law_id AND o.article_number = m.article_number WHERE o.since < m.seq AND o.id <> v.id AND o.tag <> 'amended' AND (m.tag = 'amended' OR o.tag = 'original')
  UNION ALL SELECT 'HAS_AMENDMENT', law_id, amendment_id FROM c) GROUP BY rel""")
def amendment_edges(spark, sf_dir):
    _, edges = graph.apply_amendments(_nodes(spark, sf_dir), _kept(_changes(spark, sf_dir)), keep=_kept)
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_SQL}, {_MADE}, t AS (SELECT s.amendment_id, string_agg(DISTINCT s.article_number, ',') AS affected FROM seq s JOIN olds o USING (law_id, article_number)
  WHERE o.since < s.seq OR (s.amendment_type = 'addition' AND o.tag = 'added' AND o.version = s.amendment_date) GROUP BY 1)
  SELECT amendment_id, amendment_date, coalesce(affected, '') AS affected FROM c LEFT JOIN t USING (amendment_id)""")
def affected_by_amendments(spark, sf_dir):
    changes = _kept(_changes(spark, sf_dir))
    versions, edges = graph.apply_amendments(_nodes(spark, sf_dir), changes, keep=_kept)
    return graph.affected_articles(changes, edges, versions).select("amendment_id", "amendment_date", F.coalesce(F.array_join("affected", ","), F.lit("")).alias("affected"))


@query(f"""{_SQL}, {_MADE} SELECT version, is_amended FROM (SELECT o.version, coalesce(o.tag = 'amended', false) AS is_amended, o.id FROM olds o
  WHERE law_id = 'law1' AND article_number = '1' ORDER BY version DESC NULLS LAST, id LIMIT 1)""")
def latest_of_article(spark, sf_dir):
    versions, _ = graph.apply_amendments(_nodes(spark, sf_dir), _changes(spark, sf_dir))
    return graph.latest_article(versions, "law1", "1").select("version", "is_amended")


_CHUNKS = f"""chunks AS (SELECT law_id, 'title of ' || law_id AS law_title, k AS pos, CASE WHEN k % 10 = 0 THEN 'preamble' WHEN k % 10 < 7 THEN 'article' WHEN k % 10 < 9 THEN 'amended_article' WHEN k % 20 = 9 THEN 'table' END AS chunk_type,
  CASE WHEN k % 10 > 0 THEN article_number END AS article_number, CASE WHEN k % 97 = 0 THEN '' ELSE text END AS page_content,
  CASE WHEN k % 10 IN (7, 8) AND k % 13 > 0 THEN CAST(k % 5 AS STRING) END AS amendment_law_number, CASE WHEN k % 10 IN (7, 8) THEN (1990 + k % 4) || '-01-02' END AS amendment_date,
  CAST(NULL AS STRING) AS amendment_type FROM art)"""


def _chunks(spark, sf_dir):
    return spark.sql("WITH " + _CHUNKS.replace("FROM art)", "FROM {art})") + " SELECT * FROM chunks", art=_articles(spark, sf_dir))


@query(f"{_SQL}, {_CHUNKS} SELECT coalesce(chunk_type, 'unknown') AS chunk_type, count(*) AS n FROM chunks GROUP BY 1")
def chunk_type_counts(spark, sf_dir):
    return graph.chunk_counts(_chunks(spark, sf_dir))


@query(f"{_SQL}, {_CHUNKS} SELECT law_id, count(*) AS articles, sha256(string_agg(page_content, chr(10) || chr(10) ORDER BY pos)) AS sha FROM chunks WHERE chunk_type IN ('article', 'preamble') GROUP BY 1")
def law_texts_from_chunks(spark, sf_dir):
    return graph.law_texts(_chunks(spark, sf_dir)).select("law_id", F.size("articles").cast("long").alias("articles"), F.sha2("text", 256).alias("sha"))


@query(f"""{_SQL}, {_CHUNKS} SELECT law_id, amendment_law_number, amendment_date, string_agg(article_number, ',' ORDER BY pos) AS touched, sha256(string_agg(page_content, chr(10) || chr(10) ORDER BY pos)) AS sha
  FROM chunks WHERE chunk_type = 'amended_article' GROUP BY 1, 2, 3""")
def amendment_chunk_groups(spark, sf_dir):
    found = graph.amendment_groups(_chunks(spark, sf_dir))
    return found.select("law_id", "amendment_law_number", "amendment_date", F.array_join("amended_article_numbers", ",").alias("touched"), F.sha2("text", 256).alias("sha"))


@query(f"""{_SQL}, {_CHUNKS}, u AS (SELECT *, page_content <> '' AS usable, amendment_law_number IS NOT NULL AND amendment_date IS NOT NULL AS dated FROM chunks)
  SELECT (SELECT count(DISTINCT law_id) FROM chunks) AS laws, count(*) FILTER (WHERE usable AND (chunk_type IN ('article', 'preamble') OR (chunk_type = 'amended_article' AND NOT dated))) AS articles,
  count(*) FILTER (WHERE usable AND chunk_type = 'amended_article' AND dated) AS amendments,
  count(*) FILTER (WHERE NOT usable OR chunk_type IS NULL OR chunk_type = 'table' OR (chunk_type = 'amended_article' AND NOT dated)) AS skipped FROM u""")
def graph_from_chunks(spark, sf_dir):
    _, _, counters = graph.graph_from_chunks(_chunks(spark, sf_dir))
    return counters


@query(f"""{_SQL}, {_CHUNKS} SELECT law_id, count(*) FILTER (WHERE chunk_type IN ('article', 'preamble')) AS articles, count(*) FILTER (WHERE chunk_type = 'amended_article') AS amendments,
  count(*) FILTER (WHERE chunk_type = 'table') AS tables, CAST(sum(length(page_content)) AS BIGINT) AS characters FROM chunks GROUP BY ROLLUP (law_id)""")
def law_import_counts(spark, sf_dir):
    return graph.import_counts(_chunks(spark, sf_dir))


@query(f"""{_SQL}, {_CHUNKS} SELECT law_id, count(*) AS chunks, round(avg(length(page_content)), 4) AS mean_chars, CASE WHEN avg(length(page_content)) < 60 THEN 'short' WHEN avg(length(page_content)) > 75 THEN 'long' END AS warning,
  CASE WHEN avg(length(page_content)) < 60 OR avg(length(page_content)) > 75 THEN 'warning' ELSE 'ok' END AS status FROM chunks GROUP BY 1""")
def law_ingest_summary(spark, sf_dir):
    return graph.ingest_summary(_chunks(spark, sf_dir), short=60, long=75)


@query(f"""{_SQL}, {_CHUNKS}, r AS (SELECT *, CASE WHEN chunk_type = 'amended_article' AND coalesce(amendment_date, '') <> '' THEN 0 WHEN chunk_type = 'article' THEN 1 ELSE 2 END AS kind FROM chunks)
  SELECT law_id, pos FROM r WHERE article_number IS NULL UNION ALL SELECT law_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY law_id, CAST(article_number AS INTEGER) % 100 ORDER BY kind, CASE WHEN kind = 0 THEN amendment_date END DESC NULLS LAST, pos) AS rn
  FROM r WHERE article_number IS NOT NULL) WHERE rn = 1""")
def latest_versions_of_chunks(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).withColumn("article_number", (F.col("article_number").cast("int") % 100).cast("string"))
    return chunking.latest_versions(chunks).select("law_id", "pos")


@query("""SELECT 'rule' AS kind, count(DISTINCT p_partkey) AS n FROM part UNION ALL SELECT 'concept', count(DISTINCT trim(c)) FROM (SELECT unnest(string_split(p_name, ' ')) AS c FROM part) WHERE trim(c) <> ''
  UNION ALL SELECT 'CONTAINS_RULE', count(*) FROM part UNION ALL SELECT 'RELATES_TO', count(*) FROM (SELECT DISTINCT p_partkey, trim(c) FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS c FROM part) WHERE trim(c) <> '')""")
def rule_graph_counts(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.lit("a").alias("article_id"), F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_name").alias("rule_text"), F.split("p_name", " ").alias("concepts"), F.struct("p_size").alias("penalty"))
    nodes, edges = graph.rule_graph(rules)
    kinds = [nodes["LegalRule"].agg(F.lit("rule").alias("kind"), F.count(F.lit(1)).alias("n")), nodes["LegalConcept"].agg(F.lit("concept").alias("kind"), F.count(F.lit(1)).alias("n"))]
    return kinds[0].unionByName(kinds[1]).unionByName(edges.groupBy(F.col("rel").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query(f"""{_SQL}, w AS (SELECT k, law_id, CAST(k + 7 * (k % 2) AS STRING) AS wanted FROM base), e AS (SELECT w.k AS key, min({_ID.replace('law_id', 'b.law_id').replace('article_number', 'b.article_number').replace('|| k', '|| b.k')}) AS article_id
  FROM w JOIN base b ON b.law_id = w.law_id AND b.article_number = w.wanted GROUP BY 1)
  SELECT key, article_id, CAST(1 AS DOUBLE) AS score, 'exact' AS how FROM e UNION ALL SELECT k, 'near' || k, CAST(printf('%.3f', (k % 1000) / 1000.0) AS DOUBLE), 'semantic' FROM base WHERE k NOT IN (SELECT key FROM e) AND (k % 1000) / 1000.0 >= 0.45""")
def exact_else_semantic(spark, sf_dir):
    art = _articles(spark, sf_dir)
    wanted = art.select(F.col("k").alias("key"), "law_id", F.expr("CAST(k + 7 * (k % 2) AS STRING)").alias("article_number"))
    hits = art.select(F.col("k").alias("key"), F.concat(F.lit("near"), "k").alias("article_id"), F.expr("(k % 1000) / 1000.0D").alias("score"))
    return search.exact_or_semantic(wanted, _nodes(spark, sf_dir), hits)


@query(f"""{_SQL} SELECT k AS key, 'law' || (k % 25) AS law_id, {_ID} AS article_id, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS variant_pos FROM base""")
def first_variant_of_articles(spark, sf_dir):
    wanted = _articles(spark, sf_dir).select(F.col("k").alias("key"), "law_id", "article_number")
    variants = F.when(F.col("key") % 2 == 0, F.array(F.lit("none"), F.col("article_number"))).otherwise(F.array("article_number", F.lit("none")))
    return graph.first_variant(wanted, _nodes(spark, sf_dir), variants).select("key", "law_id", "article_id", "variant_pos")


# Columns ---------------------------------------------------------------------------------------------------------------


@query(f"""{_SQL} SELECT k, CASE k % 4 WHEN 0 THEN k || ' (أ)' WHEN 1 THEN k || ' مكرر (أ)' WHEN 2 THEN k || '/ب' ELSE CAST(k AS STRING) END AS standard,
  CASE k % 4 WHEN 0 THEN k || ' (أ)|' || k || '/أ' WHEN 1 THEN k || ' مكرر (أ)|' || k || ' مكرر/أ' WHEN 2 THEN k || '/ب' ELSE CAST(k AS STRING) END AS variants FROM base""")
def article_number_variants(spark, sf_dir):
    given = _articles(spark, sf_dir).select("k", F.expr("CASE k % 4 WHEN 0 THEN k || 'أ' WHEN 1 THEN k || ' مكررا ( أ )' WHEN 2 THEN k || ' / ب' ELSE ' ' || k || ' ' END").alias("t"))
    text = F.col("t")
    return given.select("k", articles.normalize_article(text).alias("standard"), F.array_join(articles.article_variants(text), "|").alias("variants"))


_PLAIN = r"trim(regexp_replace(translate(regexp_replace(text, '[\x{0617}-\x{061a}\x{064b}-\x{0652}\x{0670}\x{0640}]', '', 'g'), 'أإآىئةؤ', 'اااييهو'), '\s+', ' ', 'g'))"


@query(f"{_SQL} SELECT k, {_PLAIN} AS plain, text AS digits FROM art")
def arabic_normalize(spark, sf_dir):
    art = _articles(spark, sf_dir)
    eastern = F.translate("text", "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return art.select("k", arabic.normalize_for_topics(F.col("text")).alias("plain"), arabic.western_digits(eastern).alias("digits"))


_STEMS = [("amr_ihala", "Amr-Ihala"), ("mahdar_dabt", "mahdar dabt"), ("taqrir_tibbi", "forensic-report"), ("mahdar_istijwab", "محضر_الاستجواب"), ("aqwal_shuhud", "أقوال_الشهود"), ("mozakeret_difa", "مذكرة الدفاع"), ("sawabiq", "criminal_record")]


@query("SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (kind, _) in enumerate(_STEMS)) + " END AS document_type FROM pages")
def filename_route(spark, sf_dir):
    stem = F.expr("CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{s}' || page_id" for i, (_, s) in enumerate(_STEMS)) + " ELSE 'zz' || page_id END")
    return table(spark, sf_dir, "pages").select("page_id", coerce.route(stem).alias("document_type"))


@query("""SELECT event_id, CAST(event_id % 90 AS INTEGER) AS age, event_id % 3 = 0 AS required, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS optional, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS audit,
  CASE event_id % 4 WHEN 0 THEN 'WEAK' WHEN 1 THEN 'STRONG' ELSE 'MODERATE' END AS strength FROM events""")
def bool_age_enum_coercion(spark, sf_dir):
    given = table(spark, sf_dir, "events").select("event_id", F.expr("CASE event_id % 2 WHEN 0 THEN 'نحو ' || (event_id % 90) ELSE translate(event_id % 90, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' سنة' END").alias("age"), F.expr("CASE event_id % 3 WHEN 0 THEN ' نعم' WHEN 1 THEN 'No' ELSE 'unknown' END").alias("flag"), F.expr("CASE event_id % 4 WHEN 0 THEN 'weak' WHEN 1 THEN ' Strong ' WHEN 2 THEN 'x' END").alias("strength"))
    flag = F.col("flag")
    return given.select("event_id", coerce.age(F.col("age")).alias("age"), coerce.bool_required(flag).alias("required"), coerce.bool_optional(flag).alias("optional"), coerce.bool_of_audit(flag).alias("audit"), coerce.enum_value(F.col("strength"), "strength", ["WEAK", "MODERATE", "STRONG"]).alias("strength"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'صباح — بيت — شهود: w1، w2' WHEN 1 THEN 'نص' ELSE NULL END AS alibi FROM events""")
def alibi_texts(spark, sf_dir):
    given = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"time": "صباح", "location": "بيت", "supporting_witnesses": ["w1", "w2"]}' WHEN 1 THEN ' نص ' ELSE '  ' END""")
    return table(spark, sf_dir, "events").select("event_id", coerce.alibi(given).alias("alibi"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'not an object' WHEN 2 THEN 'charges is not a list' WHEN 3 THEN 'case_meta is not an object' END AS error FROM events""")
def extraction_errors(spark, sf_dir):
    answer = F.expr("""CASE event_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"charges": {"a": 1}}' WHEN 3 THEN '{"charges": [], "case_meta": "x"}' ELSE '{"charges": null, "case_meta": {"court": "c"}}' END""")
    return table(spark, sf_dir, "events").select("event_id", cases.extraction_error(answer).alias("error"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 + event_id % 4 END AS arguments FROM events""")
def prosecution_answers(spark, sf_dir):
    one = """{"prosecution_narrative": {}, "prosecution_arguments": ["x"]}"""
    answer = F.expr(f"""CASE event_id % 4 WHEN 0 THEN '{one}' WHEN 1 THEN '[{one.replace('["x"]', '["x", "y"]')}]' WHEN 2 THEN '[{{"t": 1}}, {{"t": 2}}, {{"t": 3}}]' ELSE 'none' END""")
    fixed = cases.prosecution_answer(answer)
    size = F.coalesce(F.size(F.try_variant_get(F.try_parse_json(fixed), "$.prosecution_arguments", "array<variant>")), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.when(size > 0, size).otherwise(0).alias("arguments"))


# Cases -----------------------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS case_id, bool_or(o_orderkey % 7 = 0) AS has_alibi, string_agg(CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey || ',s' || o_orderkey END, ',' ORDER BY o_orderkey) AS arguments FROM orders GROUP BY 1""")
def defence_by_case(spark, sf_dir):
    documents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 7 = 1 THEN false END").alias("has_alibi"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array('f' || o_orderkey, 's' || o_orderkey) END").alias("arguments"))
    return cases.defence_summary(documents).select("case_id", "has_alibi", F.nullif(F.array_join("arguments", ","), F.lit("")).alias("arguments"))


@query("""SELECT c_custkey AS case_id, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS shown FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority <> '1-URGENT' GROUP BY 1""")
def stage_inputs(spark, sf_dir):
    all_cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    evidence = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("invalidated"))
    context = cases.stage_input(all_cases, {"evidence": (evidence, ["id", "status"])})
    rows = F.from_json("context", "evidence array<struct<id: bigint, status: string>>")["evidence"]
    return context.select("case_id", F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["id"], r["status"])), ",").alias("shown"))


@query("SELECT doc_id, doc_id % 3 AS verdict, coalesce(lang, '') AS lang FROM documents")
def stage_outputs(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("x").alias("court"), F.lit("n").alias("source_documents"), (F.col("doc_id") % 3).alias("verdict"), "lang")
    return cases.without_nulls(cases.stage_output(made)).select(F.col("case_id").alias("doc_id"), "verdict", "lang")


@query("SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS rulings, count(*) FILTER (WHERE doc_id % 3 = 1) AS principles, count(*) AS total FROM documents")
def corpus_counts(spark, sf_dir):
    return graph.corpus_counts(table(spark, sf_dir, "documents").select(F.expr("CASE doc_id % 3 WHEN 0 THEN 'ruling' WHEN 1 THEN 'principle' END").alias("doc_type")))


@query(f"""{_SQL} SELECT law_id, CAST(ref AS STRING) AS to_article, article_number AS from_article FROM base WHERE k % 5 = 0 AND ref > 0 AND ref % 3 = 0""")
def dangling_references(spark, sf_dir):
    art = _articles(spark, sf_dir)
    found = extraction.references(art.filter("ref > 0"))
    return quality.dangling(found, art.filter("k % 3 <> 0")).select("law_id", "to_article", "from_article")


# Rules, windows, principles --------------------------------------------------------------------------------------------


@query(f"""{_SQL} SELECT k, CASE WHEN k % 3 = 0 THEN 'سجن' WHEN k % 3 = 1 THEN 'غرامة' END AS kind, CASE WHEN k % 3 = 0 THEN CAST(b AS BIGINT) END AS years, count(*) AS n FROM (
    SELECT *, 1 AS x FROM base WHERE k % 3 <> 2 UNION ALL SELECT *, 2 FROM base WHERE k % 6 = 5 AND k % 11 <> 0) GROUP BY ALL""")
def rules_of_sentences(spark, sf_dir):
    art = _articles(spark, sf_dir).withColumnRenamed("k", "article_id")
    rules = extraction.sentence_rules(art).filter("penalty.type IS NOT NULL OR (size(concepts) = 0 AND rule_text LIKE 'نص عام%')").select(F.col("article_id").alias("k"), F.col("penalty.type").alias("kind"), F.col("penalty.min_value").alias("years"))
    return rules.groupBy("k", "kind", "years").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) > 2000 THEN CAST(i AS INTEGER) END AS chunk_index, CASE WHEN length(text) > 2000 THEN CAST(ceil(length(text) / 1800.0) AS INTEGER) END AS chunk_total,
  sha256(CASE WHEN length(text) > 2000 THEN substring(text, CAST(1800 * i + 1 AS BIGINT), 2000) ELSE text END) AS sha FROM documents, generate_series(0, CASE WHEN length(text) > 2000 THEN CAST(ceil(length(text) / 1800.0) AS BIGINT) - 1 ELSE 0 END) t(i)""")
def char_window_index(spark, sf_dir):
    found = chunking.document_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "chunk_index", "chunk_total", F.sha2("page_content", 256).alias("sha"))


@query("SELECT vec_id, greatest(1, least(CAST(label AS BIGINT), (SELECT count(*) FROM benchmark), 4)) AS k FROM embeddings")
def clamped_principles(spark, sf_dir):
    total = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("total"))
    return table(spark, sf_dir, "embeddings").join(F.broadcast(total), how="cross").select("vec_id", search.clamped(F.col("label").cast("long"), F.col("total")).alias("k"))  # one row


@query("SELECT doc_id, n_chars FROM documents WHERE contains(text, 'license') OR contains(text, 'token')")
def substring_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.holding(docs, "text", "license", "doc_id").unionByName(search.holding(docs, "text", "token", "doc_id")).select("doc_id", "n_chars").distinct()


@query("SELECT o_custkey AS case_id, 'orders' AS entity, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def entity_counts_by_case(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "case_id")
    return cases.entity_counts({"orders": rows, "urgent": rows.filter("o_orderpriority = '1-URGENT'")})
