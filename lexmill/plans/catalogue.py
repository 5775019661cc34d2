"""Registered queries over the driver's tables, each with the SQL that checks it.

The tables are not legal text, so each query applies an operator of the library, or its shape, to the table whose role
is nearest: documents are chunks, embeddings a vector index, events versions, orders and lineitem a property graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import arabic, coerce
from lexmill.operators import cases, chunking, dedup, graph, lexical_index, quality, search, vector_index
from lexmill.session import checkpoint_folder, new_folder
from lexmill.sources import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def literal(values: list[tuple]) -> str:
    """The rows of VALUES in SQL."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, v)) + ")" for v in values)


# Scans, filters, aggregates --------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def scan_filter_metadata(spark, sf_dir):
    return search.matching(table(spark, sf_dir, "documents"), {"lang": "en", "source": "src1", "doc_id": None}).select("doc_id", "source", "lang", "n_chars")


@query("""SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 4) AS mean, min(n_chars) AS least,
  max(n_chars) AS greatest FROM documents GROUP BY source, lang""")
def doc_stats_by_source(spark, sf_dir):
    size = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.round(F.avg(size), 4).alias("mean"), F.min(size).alias("least"), F.max(size).alias("greatest"))


_NODES = ["region", "nation", "customer", "supplier", "part", "orders"]
_EDGES = [("nation", "n_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_partkey")]


@query(" UNION ALL ".join([f"SELECT 'node' AS kind, '{t}' AS name, count(*) AS n FROM {t}" for t in _NODES] + [f"SELECT 'edge', '{c}', count({c}) FROM {t}" for t, c in _EDGES]))
def node_edge_statistics(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.lit("node").alias("kind"), F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in _NODES]
    parts += [table(spark, sf_dir, t).agg(F.lit("edge").alias("kind"), F.lit(c).alias("name"), F.count(c).alias("n")) for t, c in _EDGES]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT n_name, coalesce(s.names, '') AS suppliers, coalesce(s.n, 0) AS n_suppliers, coalesce(c.n, 0) AS n_customers FROM nation
  LEFT JOIN (SELECT s_nationkey, string_agg(s_name, '|' ORDER BY s_name) AS names, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey""")
def neighbors_optional_match(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("id", F.col("n_nationkey").cast("string"))
    supplier = table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey").cast("string"))
    edges = graph.edge("HAS", supplier, F.col("s_nationkey"), "id")
    sets = graph.neighbours(edges, "HAS", supplier, "found", ["s_name"])
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n_customers"))
    found = graph.expand(nation, [sets]).join(customers, "id", "left")
    return found.select("n_name", F.array_join(F.col("found.s_name"), "|").alias("suppliers"), F.size("found").cast("long").alias("n_suppliers"), F.coalesce("n_customers", F.lit(0).cast("long")).alias("n_customers"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS amended, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)), '') AS affected
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1, 2""")
def amendments_with_affected(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("amended"))
    parts = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("parts"))
    return orders.join(parts, "o_orderkey", "left").select("o_orderkey", "amended", F.coalesce(F.array_join("parts", ","), F.lit("")).alias("affected"))


@query("SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS above FROM events GROUP BY 1")
def entity_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("above"))


@query("""SELECT conv_id, bool_or(role = 'system') AS has_system, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1""")
def case_flags(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("has_system"), F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


@query("""SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT n_chars) AS lengths, count(*) AS n,
  rank() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source QUALIFY place <= 5""")
def law_summary(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("n_chars").alias("lengths"), F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "source").limit(5)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long"))


@query("""WITH k AS (SELECT DISTINCT l_suppkey, l_linenumber AS n FROM lineitem WHERE l_linenumber <> 3), s AS (SELECT l_suppkey, min(n) AS lo, max(n) AS hi FROM k GROUP BY 1)
  SELECT s.l_suppkey, CAST(g AS INTEGER) AS missing FROM s, generate_series(lo, hi) t(g) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_suppkey = s.l_suppkey AND k.n = g)""")
def numbering_gaps(spark, sf_dir):
    numbered = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 3").select("l_suppkey", "l_linenumber").distinct()
    return quality.numbering_gaps(numbered, "l_suppkey", "l_linenumber")


@query("""SELECT source AS law_id, count(*) AS articles, count(*) FILTER (WHERE length(text) = 0) AS empty, count(*) FILTER (WHERE length(text) BETWEEN 1 AND 19) AS short,
  count(*) FILTER (WHERE length(text) > 10000) AS long, CAST(min(length(text)) AS INTEGER) AS least, round(avg(length(text)), 4) AS mean, CAST(max(length(text)) AS INTEGER) AS greatest,
  (SELECT count(*) FROM (SELECT count(*) AS c FROM documents d WHERE d.source = documents.source GROUP BY n_chars HAVING count(*) > 1)) AS repeated_numbers
  FROM documents GROUP BY source""")
def extraction_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("law_id"), F.col("n_chars").cast("string").alias("article_number"), "text")
    return quality.article_report(docs)


# Versions, dedup, merge ------------------------------------------------------------------------------------------------

_KEY = ["user_id", "event_type"]


@query("""SELECT user_id, event_type, event_id AS latest, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 20 THEN ts END DESC NULLS FIRST, event_id) AS compat
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 20 THEN ts END DESC NULLS LAST, event_id) = 1""")
def exact_lookup_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("version", F.when(F.col("value") > 20, F.col("ts")))
    last = dedup.first_wins(events, _KEY, [F.col("version").desc_nulls_last(), "event_id"]).select(*_KEY, F.col("event_id").alias("latest"))
    first = dedup.first_wins(events, _KEY, [F.col("version").desc_nulls_first(), "event_id"]).select(*_KEY, F.col("event_id").alias("compat"))
    return last.join(first, _KEY)


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, CASE WHEN value > 50 THEN ts END DESC NULLS LAST, event_id) = 1""")
def latest_version_dedupe(spark, sf_dir):
    amended = F.col("value") > 50
    order = [F.when(amended, 0).otherwise(1), F.when(amended, F.col("ts")).desc_nulls_last(), "event_id"]
    return dedup.first_wins(table(spark, sf_dir, "events"), _KEY, order).select(*_KEY, "event_id", "value")


@query("SELECT min(doc_id) AS doc_id, substring(text, 1, 80) AS head FROM documents GROUP BY 2")
def first_wins_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("head"))
    return dedup.first_wins(docs, ["head"], ["doc_id"])


@query("""WITH k AS (SELECT event_id, nullif(event_type, 'view') AS kind, nullif(CAST(floor(value / 10) AS BIGINT), 3) AS band FROM events)
  SELECT event_id, kind, band FROM k WHERE kind IS NULL AND band IS NULL
  UNION ALL SELECT min(event_id), kind, band FROM k WHERE NOT (kind IS NULL AND band IS NULL) GROUP BY kind, band""")
def null_key_dedupe(spark, sf_dir):
    keyed = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.nullif(F.floor(F.col("value") / 10), F.lit(3)).alias("band"))
    return dedup.by_keys_keep_null(keyed, ["kind", "band"], ["event_id"])


@query("""SELECT user_id, min_by(event_type, event_id) FILTER (WHERE value > 30) AS kind, min_by(value, event_id) FILTER (WHERE event_type = 'purchase') AS value FROM events GROUP BY 1""")
def first_non_null_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 30, F.col("event_type")).alias("kind"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return dedup.first_non_null(parts, "user_id", ["kind", "value"], "event_id")


@query("""SELECT l_suppkey, max_by(l_partkey, l_orderkey * 10 + l_linenumber) AS l_partkey FROM lineitem GROUP BY 1""")
def last_write_wins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return dedup.last_wins(lines, "l_suppkey", "pos").drop("pos")


@query("""SELECT DISTINCT a.l_suppkey AS from_key, b.l_suppkey AS to_key FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a
  JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey WHERE a.l_suppkey <> b.l_suppkey""")
def reference_self_join(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = each.withColumnRenamed("l_suppkey", "from_key"), each.withColumnRenamed("l_suppkey", "to_key")
    # each pair meets once and is turned round when it is distinct
    pairs = a.join(b, "l_orderkey").filter("from_key < to_key").select("from_key", "to_key").distinct()
    return pairs.select(F.inline(F.array(F.struct("from_key", "to_key"), F.struct(F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key")))))


_PAIRS = """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"""


@query(f"""WITH RECURSIVE p AS ({_PAIRS}), w(start, node, distance) AS (SELECT src, src, 0 FROM p WHERE src LIKE 'r%' UNION SELECT w.start, p.dst, w.distance + 1 FROM w JOIN p ON p.src = w.node WHERE w.distance < 3)
  SELECT start, distance, count(*) AS n FROM (SELECT start, node, min(distance) AS distance FROM w GROUP BY 1, 2) WHERE distance > 0 GROUP BY 1, 2""")
def multi_hop_reach(spark, sf_dir):
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column)).alias
    ends = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("supplier", "n", "s_nationkey", "s", "s_suppkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    pairs = reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(name(a, x)("src"), name(b, y)("dst")) for t, a, x, b, y in ends])
    starts = table(spark, sf_dir, "region").select(name("r", "r_regionkey")("node"))
    return graph.within_hops(pairs, starts, 3).groupBy("start", "distance").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM conversations""")
def forward_fill_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("turn")).alias("context"))
    return chunking.carried_forward(turns, "context", "conv_id", ["turn", "role"])


# Chunks and extraction -------------------------------------------------------------------------------------------------


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (
    SELECT doc_id, generate_subscripts(x, 1) AS pos, trim(unnest(x)) AS s FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(1), ' '), '([.؛;])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents)) WHERE s <> ''),
  r AS (SELECT doc_id, i, 0 AS pos FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, r.pos + CASE WHEN length(p.s) < 40 THEN 0 ELSE 1 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
  SELECT doc_id, CAST(pos AS BIGINT) AS pos, sha256(string_agg(s, ' ' ORDER BY i)) AS piece_sha256 FROM r JOIN p USING (doc_id, i) GROUP BY doc_id, pos""")
def sentence_chunks(spark, sf_dir):
    text = F.translate("text", "\u0001", " ")
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.merge_short_sentences(text)).alias("pos", "piece"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2("piece", 256).alias("piece_sha256"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
  SELECT doc_id, CAST(s // 260 AS BIGINT) AS pos, len(w[s + 1 : s + 300]) AS words, sha256(array_to_string(w[s + 1 : s + 300], ' ')) AS window_sha256
  FROM w, generate_series(0, len(w) - 1, 260) t(s)""")
def word_window_chunks(spark, sf_dir):
    windows = chunking.word_windows(F.col("text"), 300, 40)
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(windows).alias("pos", "w"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size(F.split("w", " ")).cast("long").alias("words"), F.sha2("w", 256).alias("window_sha256"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
  r AS (SELECT doc_id, i, 0 AS part, length(line) AS used FROM l WHERE i = 1 UNION ALL
    SELECT l.doc_id, l.i, CASE WHEN r.used + 1 + length(l.line) <= 1200 THEN r.part ELSE r.part + 1 END, CASE WHEN r.used + 1 + length(l.line) <= 1200 THEN r.used + 1 ELSE 0 END + length(l.line)
    FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
  SELECT doc_id, CAST(part AS INTEGER) AS pos, CAST(length(string_agg(line, chr(10) ORDER BY i)) AS INTEGER) AS chars, sha256(string_agg(line, chr(10) ORDER BY i)) AS part_sha256
  FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, part""")
def table_line_pack(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pack_lines(F.col("text"))).alias("pos", "part"))
    return each.select("doc_id", "pos", F.length("part").alias("chars"), F.sha2("part", 256).alias("part_sha256"))


@query()
def recursive_word_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.split_recursively(docs, "text", 300, 40).select("doc_id", "pos", F.sha2("page_content", 256).alias("chunk_sha256"))


@query(r"""SELECT doc_id, m AS found, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+) = ', 1)) AS m FROM documents) GROUP BY 1, 2""")
def regex_extract_rows(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+) = "), 1)).alias("found"))
    return each.groupBy("doc_id", "found").agg(F.count(F.lit(1)).alias("n"))


_KINDS = [("license", ["license", "copyright"]), ("secret", ["token", "password"]), ("table", [" | "])]


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in _KINDS) + " ELSE 'other' END AS kind FROM documents")
def amendment_type_case(spark, sf_dir):
    low = F.lower("text")
    chain = F
    for kind, words in _KINDS:
        chain = chain.when(reduce(lambda x, y: x | y, [low.contains(w) for w in words]), kind)
    return table(spark, sf_dir, "documents").select("doc_id", chain.otherwise("other").alias("kind"))


@query("SELECT n_nationkey, substring(sha256(n_name || '|' || CAST(n_regionkey AS VARCHAR) || '|' || coalesce(nullif(n_name, 'FRANCE'), 'None')), 1, 16) AS id FROM nation")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", arabic.stable_id(F.col("n_name"), F.col("n_regionkey"), F.nullif("n_name", F.lit("FRANCE"))).alias("id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json(coerce.salvage_json(F.col("props")), "k bigint")["k"].alias("k"))


@query("""WITH new AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'new' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT -1 - o_orderkey, o_custkey, 'more' FROM orders WHERE o_orderkey % 7 = 0)
  SELECT o_orderkey, o_custkey, o_orderstatus FROM new UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def stored_upsert(spark, sf_dir):
    """Orders as a stored table, changed and added to twice by the same rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store = stored.KeyedTable(spark, new_folder(spark, "keyed-table"), "o_orderkey")
    store.create(orders)
    changed = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("new").alias("o_orderstatus"))
    new = changed.unionByName(orders.filter("o_orderkey % 7 = 0").select((F.lit(-1).cast("long") - F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("more").alias("o_orderstatus")))
    store.upsert(new)
    store.upsert(new)
    return store.read()


# Search ----------------------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_POSTINGS = f"p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY 1, 2), dl AS (SELECT doc_id, len({_WORDS.format('text')}) AS dl FROM documents)"


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY 1")
def token_df(spark, sf_dir):
    posted = search.postings(table(spark, sf_dir, "documents"), "doc_id", arabic.tokens(F.col("text")))
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {_POSTINGS} SELECT doc_id, dl FROM dl")
def doc_len(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(arabic.tokens(F.col("text"))).cast("long").alias("dl"))


_BM25 = f"""{_POSTINGS}, n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, n GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
scores AS (SELECT item_id AS query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN idf USING (term) JOIN p USING (term) JOIN dl USING (doc_id), n GROUP BY 1, 2),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10)"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _lexical(spark, sf_dir, k=10):
    scored = search.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), most=k, digits=6)
    return search.top(scored.withColumn("score", F.round("score", 6)), k).filter("score > 0")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical WHERE score > 0")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(ORACLES["bm25_topk"])
def lexical_index_topk(spark, sf_dir):
    """The same search through a stored index."""
    path = new_folder(spark, "lexical-index")
    lexical_index.write_lexical_index(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    found, _ = lexical_index.search_lexical_index(spark, path, _questions(spark, sf_dir), 10)
    return found.withColumn("rank", F.col("rank").cast("long"))


_VECTOR = """v AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round((1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / 2, 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v QUALIFY rank <= 10)"""


def _vector(spark, sf_dir, k=10):
    """The stated queries of a search: every vector whose id is divisible by 20, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return search.nearest(vectors, asked, k, digits=6)


@query(f"WITH {_VECTOR} SELECT query_id, doc_id, score, rank FROM vector")
def vector_cosine_topk(spark, sf_dir):
    return _vector(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _stored(spark, sf_dir, measure):
    """The path of a new index of all vectors."""
    path = new_folder(spark, "vector-index")
    vector_index.write_vector_index(table(spark, sf_dir, "embeddings"), path, key="vec_id", measure=measure)
    return path


@query(f"WITH {_VECTOR} SELECT query_id, doc_id AS vec_id, score, rank FROM vector")
def vector_index_topk(spark, sf_dir):
    """The same search through a stored index."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = vector_index.search_vector_index(spark, _stored(spark, sf_dir, "cosine"), asked, 10, key="vec_id", digits=6)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2)), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
  SELECT query_id, vec_id, label, score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 20) WHERE label <= 4""")
def vector_l2_topk_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    best = search.nearest(vectors, asked, 20, key="vec_id", measure="l2", digits=6)
    return best.join(vectors.select("vec_id", "label"), "vec_id").filter("label <= 4").select("query_id", "vec_id", "label", "score")


@query(ORACLES["vector_l2_topk_filtered"])
def vector_index_l2_filtered(spark, sf_dir):
    """The same through a stored index of distances, filtered after the search."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    best = vector_index.search_vector_index(spark, _stored(spark, sf_dir, "l2"), asked, 20, key="vec_id", digits=6)
    return best.join(vectors.select("vec_id", "label"), "vec_id").filter("label <= 4").select("query_id", "vec_id", "label", "score")


@query(f"""WITH {_VECTOR}, h AS (SELECT v.*, e.label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM v JOIN embeddings e ON e.vec_id = v.doc_id QUALIFY place <= 15),
  l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY doc_id % 3 DESC, place) = 1)
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM l QUALIFY rank <= 5""")
def latest_of_vector_hits(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("law").alias("law_id"), F.col("label").cast("string").alias("article_number"), (F.col("vec_id") % 3).alias("version"))
    return search.latest_of_hits(_vector(spark, sf_dir, 15), chunks, 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


_FUSED = f"""{_BM25}, {_VECTOR}, l AS (SELECT * FROM lexical WHERE score > 0),
f AS (SELECT coalesce(l.query_id, vector.query_id) AS query_id, coalesce(l.doc_id, vector.doc_id) AS doc_id,
  coalesce(0.4 / (60 + l.rank), 0) + coalesce(0.6 / (60 + vector.rank), 0) AS fused FROM l FULL JOIN vector ON l.query_id = vector.query_id AND l.doc_id = vector.doc_id)"""


@query(f"""WITH RECURSIVE {_FUSED} SELECT query_id, doc_id, round(fused, 8) AS fused,
  round((fused - min(fused) OVER w) / CASE WHEN max(fused) OVER w > min(fused) OVER w THEN max(fused) OVER w - min(fused) OVER w ELSE 1e-9 END, 6) AS score FROM f WINDOW w AS (PARTITION BY query_id)""")
def rrf_hybrid(spark, sf_dir):
    fused = search.fuse(_lexical(spark, sf_dir), _vector(spark, sf_dir))
    return fused.select("query_id", "doc_id", F.round("fused", 8).alias("fused"), F.round("score", 6).alias("score"))


@query(f"WITH {_FUSED} SELECT query_id, doc_id, round(fused, 8) AS score FROM f")
def ensemble_hybrid(spark, sf_dir):
    return search.fuse(_lexical(spark, sf_dir), _vector(spark, sf_dir), normalise=False).select("query_id", "doc_id", F.round("score", 8).alias("score"))


@query(f"""WITH {_VECTOR} SELECT 1 AS pinned, vec_id AS query_id, vec_id + 1 AS doc_id, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id % 20 = 0
  UNION ALL SELECT 0, query_id, doc_id, score FROM vector WHERE score >= 0.6 AND doc_id <> query_id + 1""")
def threshold_pin_exact(spark, sf_dir):
    hits = _vector(spark, sf_dir).filter("score >= 0.6").select("query_id", "doc_id", "score")
    pins = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("doc_id"), F.lit(1.0).alias("score"))
    return dedup.pinned_first(hits, pins, ["query_id", "doc_id"], "score").select("pinned", "query_id", "doc_id", "score")


@query(f"""WITH {_VECTOR}, b AS (SELECT query_id, doc_id % 7 AS table_id, doc_id, score FROM vector QUALIFY row_number() OVER (PARTITION BY query_id, doc_id % 7 ORDER BY score DESC, doc_id) = 1)
  SELECT query_id, table_id, doc_id AS chunk_id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) <= 5""")
def table_dedupe_top5(spark, sf_dir):
    hits = _vector(spark, sf_dir).select("query_id", (F.col("doc_id") % 7).alias("table_id"), F.col("doc_id").alias("chunk_id"), "score")
    return search.best_tables(hits)


@query("""WITH b AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, length(text) AS chars FROM documents),
  r AS (SELECT *, sum(chars + 1 + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b)
  SELECT query_id, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 9000""")
def context_budget(spark, sf_dir):
    return search.first_blocks(table(spark, sf_dir, "documents"), "source", "doc_id", "text").select(F.col("source").alias("query_id"), "doc_id", "used")


@query(f"""WITH {_VECTOR} SELECT query_id, 'article' AS type, CAST(doc_id AS VARCHAR) AS article_number, printf('%.3f', score) AS score FROM vector WHERE rank <= 3
  UNION ALL SELECT query_id, 'table', CAST(doc_id AS VARCHAR), printf('%.3f', score) FROM vector WHERE rank > 7""")
def sources_union_format(spark, sf_dir):
    shaped = _vector(spark, sf_dir).select("query_id", "rank", "score", F.lit("law").alias("law_id"), F.lit("title").alias("law_title"), F.col("doc_id").cast("string").alias("article_number"), F.lit("").alias("text"))
    return search.sources(shaped.filter("rank <= 3"), shaped.filter("rank > 7")).select("query_id", "type", "article_number", "score")


@query(f"""WITH {_VECTOR}, m AS (SELECT query_id, max(score) AS best FROM vector GROUP BY 1), d AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
  SELECT query_id, doc_id, round(0.5 * score + 0.3 * coalesce(n, 0) / max(coalesce(n, 0)) OVER () + 0.2 * score / best, 5) AS score FROM vector JOIN m USING (query_id) LEFT JOIN d ON l_suppkey = doc_id""")
def hybrid_rule_score(spark, sf_dir):
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.count_distinct("l_partkey").alias("n"))
    hits = _vector(spark, sf_dir).join(degree, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most, best = F.max("n").over(Window.partitionBy()), F.max("score").over(Window.partitionBy("query_id"))
    score = 0.5 * F.col("score") + 0.3 * F.col("n") / most + 0.2 * F.col("score") / best
    return hits.select("query_id", "doc_id", (F.floor(score * 1e5 + 0.5) / 1e5).alias("score"))


#: Titles of suppliers as laws: single words, with prefixes, one inside another; questions of orders that name one.
_TITLES = """SELECT s_suppkey, 'l' || s_suppkey AS law_id, CASE s_suppkey % 4 WHEN 0 THEN 'قانون ' || s_suppkey WHEN 1 THEN 'لائحة' || s_suppkey WHEN 2 THEN 'دستور' || substring('ابتثجحخدذرزسشصضطظعغفقكلمنهوي', CAST(1 + s_suppkey % 28 AS INTEGER), 1)
  ELSE 'نظام' END AS law_title FROM supplier"""
_NAMED = """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 9 = 0 THEN 'سؤال بلا اسم ' || o_orderkey ELSE 'ما حكم ' || CASE o_orderkey % 3 WHEN 0 THEN 'و' WHEN 1 THEN 'بال' ELSE '' END || law_title ||
  CASE o_orderkey % 2 WHEN 0 THEN 'ية وغيره' ELSE '0' END END AS question FROM orders JOIN titles ON s_suppkey = 1 + o_custkey % (SELECT count(*) FROM supplier)"""


@query(f"""WITH titles AS ({_TITLES}), named AS ({_NAMED}), laws AS (SELECT law_id, trim(regexp_replace(regexp_replace(law_title, '[\\x{{0610}}-\\x{{061a}}\\x{{064b}}-\\x{{065f}}]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM titles),
  asked AS (SELECT query_id, trim(regexp_replace(regexp_replace(question, '[\\x{{0610}}-\\x{{061a}}\\x{{064b}}-\\x{{065f}}]', '', 'g'), '\\s+', ' ', 'g')) AS q FROM named)
  SELECT query_id, (SELECT law_id FROM laws WHERE contains(q, title) AND title <> '' ORDER BY length(title) DESC, law_id DESC LIMIT 1) AS law_id FROM asked""")
def longest_title_in_text(spark, sf_dir):
    titles = spark.sql(_TITLES.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    named = spark.sql(_NAMED.replace("FROM orders", "FROM {orders}").replace("JOIN titles", "JOIN {titles}").replace("FROM supplier", "FROM {supplier}"), orders=table(spark, sf_dir, "orders"), titles=titles, supplier=table(spark, sf_dir, "supplier"))
    return search.asked_law(named, titles.select("law_id", "law_title")).select("query_id", "law_id")


#: Questions of the benchmark that name an article of a law; documents are articles, their sources laws.
_ASKED = """asked AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' المادة ' || (item_id * 7 % 300) || ' من قانون ' || (SELECT max(source) FROM documents WHERE doc_id = item_id * 7 % 300) WHEN 1 THEN ' المادة ' || item_id ELSE '' END AS text,
  CASE WHEN item_id % 3 < 2 THEN CASE item_id % 3 WHEN 0 THEN item_id * 7 % 300 ELSE item_id END END AS number, CASE WHEN item_id % 3 = 0 THEN (SELECT max(source) FROM documents WHERE doc_id = item_id * 7 % 300) END AS law FROM benchmark)"""
_AMENDED = "SELECT o_orderkey % (SELECT 1 + max(doc_id) FROM documents) AS id, o_orderkey AS amendment_id, substring(CAST(o_orderdate AS VARCHAR), 1, 10) AS date, CASE WHEN o_custkey % 5 > 0 THEN 'addition' END AS type, CAST(o_custkey AS VARCHAR) AS law_number, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE repeat('وصف ' || o_orderkey, 40) END AS description FROM orders"
_PENAL = "SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN 'سجن' END AS type, CAST(p_size AS BIGINT) AS min_value, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 3 AS BIGINT) END AS max_value, 'سنة' AS unit FROM part"
_MEANT = "SELECT s_suppkey % 100 AS id, s_name AS term, 'معنى ' || s_suppkey AS definition FROM supplier"
_TOPIC = "SELECT doc_id AS id, CASE quality WHEN 1 THEN 'good' END AS name FROM labels"
_WHOLE = f"""WITH {_ASKED}, {_BM25.replace("FROM benchmark", "FROM asked").split(", scores AS")[0].split("scores AS")[0].rstrip().rstrip(",")},
scored AS (SELECT item_id AS query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * CASE WHEN doc_id = any_value(number) THEN 10 ELSE 1 END, 6) AS score
  FROM q JOIN idf USING (term) JOIN p USING (term) JOIN dl USING (doc_id) JOIN asked USING (item_id), n GROUP BY 1, 2),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 15) WHERE score > 0),
near AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, e.label, round((1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / 2, 6) AS score FROM embeddings q JOIN asked ON item_id = q.vec_id, embeddings e),
vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near WHERE doc_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 15),
f AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(0.4 / (60 + l.rank), 0) + coalesce(0.6 / (60 + v.rank), 0) AS fused, l.rank AS lr, v.rank AS vr
  FROM lexical l FULL JOIN vector v ON l.query_id = v.query_id AND l.doc_id = v.doc_id),
s AS (SELECT *, round((fused - min(fused) OVER w) / CASE WHEN max(fused) OVER w > min(fused) OVER w THEN max(fused) OVER w - min(fused) OVER w ELSE 1e-9 END, 6) AS score,
  coalesce(lr, max(lr) OVER w + vr, vr) AS insertion FROM f WINDOW w AS (PARTITION BY query_id)),
pin AS (SELECT item_id AS query_id, doc_id FROM asked JOIN documents ON doc_id = number AND source = law),
hits AS (SELECT query_id, doc_id, 1.0 AS score, 0 AS insertion, 1 AS pinned FROM pin UNION ALL SELECT query_id, doc_id, score, insertion, 0 FROM s ANTI JOIN pin USING (query_id, doc_id) WHERE score >= 0.5),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, score DESC, insertion, doc_id) AS place FROM hits),
am AS (SELECT id, '    التعديلات:' || chr(10) || string_agg('      • [' || coalesce(type, '?') || '] ' || date || ' بموجب قانون ' || law_number || CASE WHEN description = '' THEN '' ELSE ': ' || substring(description, 1, 200) END, chr(10) ORDER BY date, amendment_id) AS note
  FROM (SELECT * FROM ({_AMENDED}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY date, amendment_id) <= 3) GROUP BY 1),
pe AS (SELECT id, '    العقوبات:' || chr(10) || string_agg('      • ' || type || ' من ' || min_value || coalesce(' إلى ' || max_value, '') || ' ' || unit, chr(10) ORDER BY type, min_value) AS note FROM ({_PENAL}) WHERE type IS NOT NULL GROUP BY 1),
de AS (SELECT id, '    التعريفات:' || chr(10) || string_agg('      • ' || term || ': ' || definition, chr(10) ORDER BY term) AS note FROM (SELECT * FROM ({_MEANT}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY term) <= 5) GROUP BY 1),
tp AS (SELECT id, '    الموضوعات: ' || string_agg(name, ', ') AS note FROM ({_TOPIC}) WHERE name IS NOT NULL GROUP BY 1),
ab AS (SELECT query_id, place, CASE WHEN place = 1 THEN chr(10) || chr(10) ELSE chr(10) || chr(10) || repeat('-', 60) || chr(10) || chr(10) END || '[' || place || '] القانون: ' || coalesce('قانون ' || source, '') || ' (ID: ' || source || ')' || chr(10) || '    المادة ' || d.doc_id || ' | درجة الصلة: ' || printf('%.3f', round(score, 3)) || chr(10)
    || chr(10) || regexp_replace(coalesce(text, ''), '(?m)^(.*\\S)', '    \\1', 'g') || coalesce(chr(10) || am.note, '') || coalesce(chr(10) || pe.note, '') || coalesce(chr(10) || de.note, '') || coalesce(chr(10) || tp.note, '') || chr(10) AS block
  FROM placed JOIN documents d USING (doc_id) LEFT JOIN am ON am.id = d.doc_id LEFT JOIN pe ON pe.id = d.doc_id LEFT JOIN de ON de.id = d.doc_id LEFT JOIN tp ON tp.id = d.doc_id),
ar AS (SELECT query_id, place, block, sum(length(block)) OVER (PARTITION BY query_id ORDER BY place) AS used FROM ab),
one AS (SELECT * FROM (SELECT query_id, label, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM near QUALIFY r <= 15) WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) = 1),
tb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS place, chr(10) || '[جدول ' || label || '] من src' || (label % 3) || ' | درجة الصلة: ' || printf('%.3f', round(score, 3)) || chr(10) || substring(trim(repeat('صف ' || doc_id || ' ', 200)), 1, 700) || chr(10) AS block FROM one QUALIFY place <= 5),
who AS (SELECT query_id FROM ab UNION SELECT query_id FROM tb),
a AS (SELECT who.query_id, coalesce(max(used) FILTER (WHERE used <= 9000), 0) AS used, coalesce(string_agg(block, '' ORDER BY place) FILTER (WHERE used <= 9000), '') AS text FROM who LEFT JOIN ar USING (query_id) GROUP BY 1),
head AS (SELECT *, chr(10) || chr(10) || repeat('=', 60) || chr(10) || 'الجداول القانونية ذات الصلة:' || chr(10) AS h FROM a),
room AS (SELECT *, used + CASE WHEN used + length(h) <= 9000 THEN length(h) ELSE 0 END AS begin FROM head),
tr AS (SELECT tb.query_id, tb.place, block, begin + sum(length(block)) OVER (PARTITION BY tb.query_id ORDER BY tb.place) AS total FROM tb JOIN room USING (query_id)),
t AS (SELECT query_id, count(*) AS n, coalesce(string_agg(block, '' ORDER BY place) FILTER (WHERE total <= 9000), '') AS text FROM tr GROUP BY 1),
contexts AS (SELECT query_id, room.text || CASE WHEN n > 0 AND used < 9000 THEN CASE WHEN begin > used THEN h ELSE '' END || t.text ELSE '' END AS context FROM room LEFT JOIN t USING (query_id))"""


def _retrieved(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    asked = spark.sql(f"WITH {_ASKED.replace('FROM documents', 'FROM {docs}').replace('FROM benchmark', 'FROM {items}')} SELECT item_id AS query_id, text AS question FROM asked", docs=docs, items=table(spark, sf_dir, "benchmark"))
    embedding = vectors.select(F.col("vec_id").alias("id"), "embedding")
    questions = asked.join(embedding.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id", "left")
    articles = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("law_id"), F.col("doc_id").cast("string").alias("article_number"), "text").join(embedding, "id", "left")
    laws = docs.select(F.col("source").alias("law_id")).filter("law_id IS NOT NULL").distinct().withColumn("law_title", F.concat(F.lit("قانون "), "law_id"))
    chunks = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("table_id"), F.expr("repeat('صف ' || vec_id || ' ', 200)").alias("text"), "embedding", F.expr("'src' || label % 3").alias("law_id"), F.col("label").alias("table_number"))
    about = {"amendments": (_AMENDED, "orders"), "penalties": (_PENAL, "part"), "definitions": (_MEANT, "supplier"), "topics": (_TOPIC, "labels")}
    rows = {name: spark.sql(sql.replace(f"FROM {own}", "FROM {own}").replace("FROM documents", "FROM {docs}").replace("VARCHAR", "STRING"), own=table(spark, sf_dir, own), docs=docs) if "FROM documents" in sql else spark.sql(sql.replace(f"FROM {own}", "FROM {own}"), own=table(spark, sf_dir, own)) for name, (sql, own) in about.items()}
    return search.answer_context(articles, chunks, questions, laws, rows)


@query(f"{_WHOLE} SELECT query_id, CAST(length(context) AS BIGINT) AS chars, sha256(context) AS sha FROM contexts")
def whole_retrieval(spark, sf_dir):
    """Every question's context: two searches, the named article, neighbours, tables, one budget."""
    contexts, _ = _retrieved(spark, sf_dir)
    return contexts.select("query_id", F.length("context").cast("long").alias("chars"), F.sha2("context", 256).alias("sha"))


@query(f"""{_WHOLE} SELECT query_id, 'article' AS type, source AS law_id, CAST(doc_id AS VARCHAR) AS article_number, printf('%.3f', round(score, 3)) AS score FROM placed JOIN documents USING (doc_id)
  UNION ALL SELECT query_id, 'table', 'src' || (label % 3), CAST(label AS VARCHAR), printf('%.3f', round(score, 3)) FROM tb""")
def sources_of_retrieval(spark, sf_dir):
    _, found = _retrieved(spark, sf_dir)
    return found.select("query_id", "type", "law_id", F.col("article_number").cast("string").alias("article_number"), "score")


# Case files ------------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(t.toxic = 1, false) AS invalidated FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) t USING (doc_id)")
def invalidated_semijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("source_document_id"), F.lit(0).alias("case_id"))
    issues = table(spark, sf_dir, "labels").select(F.lit(0).alias("case_id"), F.col("doc_id").alias("source_document_id"), F.when(F.col("toxic") == 1, "absolute").alias("nullity_type"))
    return cases.flag_invalidated(docs, cases.void_sources(issues)).select("doc_id", "invalidated")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'judge' ELSE 'continue' END AS route FROM orders")
def routing_split(spark, sf_dir):
    audits = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "fatal").alias("pipeline_fatality"))
    fatal, rest = cases.route_cases(audits)
    return fatal.select("o_orderkey", F.lit("judge").alias("route")).unionByName(rest.select("o_orderkey", F.lit("continue").alias("route")))


@query("""SELECT conv_id AS case_id, array_to_string(list_filter(['user', 'assistant', 'system'], lambda r: NOT list_contains(list(role), r)), ',') AS missing FROM conversations GROUP BY 1""")
def agent_dag_state(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), "role")
    branch = lambda role: (role, lambda c: c.filter(F.col("role") == role))
    done = cases.run_stages(turns, [branch(r) for r in ("user", "assistant", "system")]).distinct()
    state = turns.select("case_id").distinct().join(done.groupBy("case_id").agg(F.collect_set("agent").alias("completed_agents")), "case_id", "left")
    return cases.missing_agents(state, ["user", "assistant", "system"]).select("case_id", F.array_join("missing", ",").alias("missing"))


def _unrolled(rounds: int) -> str:
    steps = [f"r{i} AS (SELECT node, 0.15 + 0.85 * coalesce(given, 0) AS rank FROM nodes LEFT JOIN (SELECT dst AS node, sum(rank / degree) AS given FROM links JOIN r{i - 1} ON src = node GROUP BY 1) USING (node))" for i in range(1, rounds + 1)]
    return ", ".join(steps)


@query(f"""WITH one AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), pairs AS (SELECT p AS src, s AS dst FROM one UNION ALL SELECT s, p FROM one),
  links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM pairs), nodes AS (SELECT DISTINCT src AS node FROM pairs), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM nodes),
  {_unrolled(10)} SELECT node, round(rank, 6) AS rank FROM r10""")
def pagerank(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.pagerank(both, rounds=10).select("node", F.round("rank", 6).alias("rank"))
