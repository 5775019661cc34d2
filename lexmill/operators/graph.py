"""The law graph as tables: nodes, edges, amendments and versions, pattern queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.arabic import stable_id
from lexmill.functions.vocabulary import NODE_LABELS, RELATIONS

from .chunking import pack_lines
from .dedup import last_wins

#: Targets of a node in one row, at most about so many.
TARGETS = 4096
EDGE = "rel string, src_id string, dst_id string, position int, confidence double, reference_type string, amendment_id string, amendment_type string, amendment_date string"


def edge(rel: str, frame: DataFrame, src: str | Column, dst: str | Column, **props: Column) -> DataFrame:
    """Edges (EDGE) of one relation, one for each pair of ends: of several the last by date and position, and by the other
    properties where those are equal, so that any partitioning gives the same."""
    kinds = dict(x.split(" ") for x in EDGE.split(", "))
    ends = {"rel": F.lit(rel), "src_id": F.col(src) if isinstance(src, str) else src, "dst_id": F.col(dst) if isinstance(dst, str) else dst}
    columns = [(ends | props).get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]
    rows = frame.select(*columns)
    if not props:
        return rows.distinct()
    # as a struct date, position and the others are compared in this order, nulls first
    order = sorted(props, key=lambda c: (c != "amendment_date", c != "position", c))
    last = rows.groupBy(*ends).agg(F.max(F.struct(*order)).alias("last"))
    return last.select(*[F.col(f"last.{c}") if c in props else F.col(c) if c in ends else F.lit(None).cast(kinds[c]).alias(c) for c in kinds])


def article_nodes(articles: DataFrame) -> DataFrame:
    """Original articles from (law_id, article_number, pos, text): id, law_id, article_number, text, position."""
    number = F.coalesce("article_number", F.lit("preamble"))
    return articles.select(
        stable_id(F.col("law_id"), number, F.col("pos")).alias("id"),
        "law_id",
        "article_number",
        "text",
        F.col("pos").cast("int").alias("position"),
        F.lit(None).cast("string").alias("version"),
        F.lit(False).alias("is_addition"),
        F.lit(False).alias("is_amended"),
    )


def at_article(facts: DataFrame, articles: DataFrame, number: str = "article_number") -> DataFrame:
    """facts joined to the articles of their law and number as article_id; equal numbers in a law fan out."""
    ids = articles.select("law_id", F.col("article_number").alias(number), F.col("id").alias("article_id"))
    return facts.join(ids, ["law_id", number])


def build_facts(articles: DataFrame, penalties: DataFrame, definitions: DataFrame, references: DataFrame, topics: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda facts: facts) -> tuple[dict[str, DataFrame], DataFrame]:
    """(nodes, edges) of article nodes and extracted facts.

    A penalty's id has no range, so of several ranges of a type in an article the last by minimum stays; references to
    articles that the law does not have vanish. keep is given each table of facts that nodes and edges both read, and
    may write it, so that texts are read once.
    """
    penalties, definitions, topics = keep(penalties), keep(definitions), keep(topics)
    p = at_article(penalties, articles).withColumn("id", stable_id(F.col("law_id"), F.col("article_number"), F.col("penalty_type")))
    d = at_article(definitions, articles, "defined_in_article").withColumn("id", stable_id(F.col("law_id"), F.col("term")))
    t = at_article(topics, articles).withColumn("id", stable_id(F.col("topic_name")))
    source = at_article(references.withColumnRenamed("from_article", "article_number"), articles).withColumnRenamed("article_id", "from_id")
    r = at_article(source.drop("article_number").withColumnRenamed("to_article", "article_number"), articles)
    nodes = {
        "Article": articles,
        "Penalty": last_wins(p.select("id", "penalty_type", "min_value", "max_value", "unit").withColumn("at", F.coalesce("min_value", F.lit(-1))), "id", "at").drop("at"),
        "Definition": last_wins(d.select("id", "term", "definition_text"), "id", "definition_text"),
        "Topic": t.select("id", F.col("topic_name").alias("name")).distinct(),
    }
    edges = edge("CONTAINS", articles, "law_id", "id", position=F.col("position"))
    edges = edges.unionByName(edge("HAS_PENALTY", p, "article_id", "id")).unionByName(edge("DEFINES", d, "article_id", "id"))
    edges = edges.unionByName(edge("TAGGED_WITH", t, "article_id", "id", confidence=F.col("confidence")))
    return nodes, edges.unionByName(edge("REFERENCES", r, "from_id", "article_id", reference_type=F.col("reference_type")))


def build_tables(tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Table and TableChunk nodes and their edges, from (law_id, table_number, position, source_file, page_content)."""
    t = tables.withColumn("id", stable_id(F.col("law_id"), F.col("table_number"))).withColumn("parts", pack_lines(F.col("page_content")))
    c = t.select("law_id", "table_number", F.col("id").alias("table_id"), "source_file", F.posexplode("parts").alias("n", "text"))
    c = c.withColumn("chunk_number", F.col("n") + 1).withColumn("id", stable_id(F.col("law_id"), F.col("table_number"), F.lit("chunk"), F.col("chunk_number")))
    nodes = {
        "Table": t.select("id", "law_id", "table_number", "source_file", F.substring("page_content", 1, 1000).alias("text_preview"), F.size("parts").alias("chunk_count"), F.length("page_content").alias("total_chars")),
        "TableChunk": c.select("id", "table_id", "law_id", "table_number", "chunk_number", "text", F.length("text").alias("char_count"), "source_file"),
    }
    return nodes, edge("HAS_TABLE", t, "law_id", "id", position=F.col("position")).unionByName(edge("HAS_CHUNK", c, "table_id", "id"))


def _changes_of_articles(articles: DataFrame, amendments: DataFrame) -> DataFrame:
    """A row for each article that an amendment names: the version that it makes (version_id, none without made), whether
    no change before made that one (first), and olds, the distinct versions (id, tag) there were before the change.

    Originals and changes of an article meet in one shuffle; changes are ordered within their article alone.
    """
    tag = F.when(F.col("amendment_type") == "addition", "added").when(F.col("amendment_type") == "modification", "amended")
    each = amendments.select("law_id", F.explode(F.array_distinct("amended_article_numbers")).alias("article_number"), F.lit(1).alias("turn"), tag.alias("tag"), "amendment_id", "amendment_law_number", "amendment_type", "amendment_date", F.substring("description", 1, 500).alias("text"))
    each = each.withColumn("version_id", F.when(F.col("tag").isNotNull(), stable_id(F.col("law_id"), F.col("article_number"), F.col("tag"), F.col("amendment_date"))))
    named = F.col("law_id").isNotNull() & F.col("article_number").isNotNull()
    own = articles.filter(named).select("law_id", "article_number", F.lit(0).alias("turn"), F.lit("original").alias("tag"), F.col("id").alias("version_id"))
    order = Window.partitionBy("law_id", "article_number").orderBy("turn", "amendment_date", "amendment_law_number", "amendment_id")
    of_date = Window.partitionBy("law_id", "article_number", "turn", "amendment_date").orderBy("amendment_law_number", "amendment_id")  # in the same order
    until, ahead = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    there = F.max(F.col("tag").isin("original", "added")).over(order.rowsBetween(*until))
    rows = own.unionByName(each, allowMissingColumns=True).withColumn("made", F.coalesce((F.col("tag") != "amended") | there, F.lit(False)) & F.col("tag").isNotNull())
    earlier = {tag: F.count(F.when(F.col("made") & (F.col("tag") == tag), 1)).over(of_date.rowsBetween(*ahead)) for tag in ("added", "amended")}
    rows = rows.withColumn("first", F.col("made") & (F.when(F.col("tag") == "added", earlier["added"]).when(F.col("tag") == "amended", earlier["amended"]).otherwise(0) == 0))
    # a change without law or article amends nothing that was there before it
    olds = F.collect_list(F.when(F.col("first") & named, F.struct(F.col("version_id").alias("id"), "tag"))).over(order.rowsBetween(*ahead))
    return rows.withColumn("olds", olds).filter("turn = 1").drop("turn", "amendment_law_number")


def apply_amendments(articles: DataFrame, amendments: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(articles with their new versions, edges AMENDED_BY, SUPERSEDES and HAS_AMENDMENT).

    Amendments apply by date, number and id. An addition makes a version of each article that it names and supersedes
    the article's original; it exists even if no original does. A modification makes one only where the article exists
    already, original or from an earlier amendment, and supersedes all of them but modified versions. Every amendment
    is an AMENDED_BY of the versions that were there before it, an addition also of its own. Versions of one article,
    tag and date are one. keep is given the changes of articles, which versions and edges both read, and may write
    them, so that they are made once.
    """
    changes = keep(_changes_of_articles(articles, amendments))
    versions = changes.filter("first").select(F.col("version_id").alias("id"), "law_id", "article_number", "text", F.lit(None).cast("int").alias("position"), F.col("amendment_date").alias("version"), (F.col("tag") == "added").alias("is_addition"), (F.col("tag") == "amended").alias("is_amended"))
    props = {"amendment_id": F.col("amendment_id"), "amendment_type": F.col("amendment_type"), "amendment_date": F.col("amendment_date")}
    own = F.when(F.col("tag") == "added", F.array("version_id")).otherwise(F.array().cast("array<string>"))
    amended = changes.select("amendment_id", "amendment_type", "amendment_date", F.explode(F.array_union(F.col("olds.id"), own)).alias("old_id"))
    amended = amended.repartition("old_id")  # where both the edges and joins to their articles find them
    older = F.filter("olds", lambda o: (o["id"] != F.col("version_id")) & (o["tag"] != "amended") & ((F.col("tag") == "amended") | (o["tag"] == "original")))
    replaced = changes.filter("made").select("version_id", "amendment_id", "amendment_type", "amendment_date", F.explode(older).alias("old")).withColumn("old_id", F.col("old.id"))
    edges = edge("AMENDED_BY", amended, "old_id", "amendment_id", **props).unionByName(edge("SUPERSEDES", replaced, "version_id", "old_id", **props))
    return articles.unionByName(versions), edges.unionByName(edge("HAS_AMENDMENT", amendments, "law_id", "amendment_id"))


def statistics(nodes: dict[str, DataFrame], edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(kind, name, n): rows of each label and relation that reports list, 0 for absent ones."""
    listed = spark.createDataFrame([("node", x) for x in NODE_LABELS] + [("edge", x) for x in RELATIONS], "kind string, name string")
    counted = edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for label, frame in nodes.items():
        counted = counted.unionByName(frame.agg(F.lit("node").alias("kind"), F.lit(label).alias("name"), F.count(F.lit(1)).alias("n")))
    return listed.join(counted, ["kind", "name"], "left").na.fill(0, ["n"])


def neighbours(edges: DataFrame, rel: str, others: DataFrame, name: str, fields: Sequence[str], reverse: bool = False) -> DataFrame:
    """(id, name): for each node the sorted distinct set of structs of the nodes at the other end of rel."""
    near, far = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    ends = edges.filter(F.col("rel") == rel).select(F.col(near).alias("__near"), F.col(far).alias("__far"))
    joined = ends.join(others.select(F.col("id").alias("__far"), *fields), "__far")
    return joined.groupBy(F.col("__near").alias("id")).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(name))


def expand(hits: DataFrame, sets: Sequence[DataFrame]) -> DataFrame:
    """hits (id, ...) with each set of neighbours, empty where a node has none. Each set is made once, before the join."""
    out = hits
    for one in sets:
        name = [c for c in one.columns if c != "id"][0]
        out = out.join(one, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    return out


def affected_articles(amendments: DataFrame, edges: DataFrame, articles: DataFrame, law_id: str | None = None) -> DataFrame:
    """Amendments by date with the sorted numbers of the articles that they amend, none for some."""
    chosen = amendments if law_id is None else amendments.filter(F.col("law_id") == law_id)
    numbers = edges.filter("rel = 'AMENDED_BY'").join(articles, F.col("src_id") == articles["id"]).groupBy(F.col("dst_id").alias("amendment_id")).agg(F.array_sort(F.collect_set("article_number")).alias("affected"))
    return chosen.join(numbers, "amendment_id", "left").orderBy(F.col("amendment_date").asc_nulls_last(), "amendment_id")


def exact_article(articles: DataFrame, law_id: str, number: str) -> DataFrame:
    """At most one article of this law and number."""
    return articles.filter((F.col("law_id") == law_id) & (F.col("article_number") == number)).orderBy("id").limit(1)


def latest_article(articles: DataFrame, law_id: str, number: str, originals_first: bool = False) -> DataFrame:
    """The version of the latest date; with originals_first the one without a version counts as the latest."""
    order = F.col("version").desc_nulls_first() if originals_first else F.col("version").desc_nulls_last()
    return articles.filter((F.col("law_id") == law_id) & (F.col("article_number") == number)).orderBy(order, "id").limit(1)


def first_variant(wanted: DataFrame, articles: DataFrame, variants: Column) -> DataFrame:
    """wanted (key, law_id, article_number) with the first variant of the number that the law has."""
    each = wanted.select("key", "law_id", F.posexplode(variants).alias("variant_pos", "variant"))
    found = each.join(articles.select("law_id", F.col("article_number").alias("variant"), F.col("id").alias("article_id"), "text"), ["law_id", "variant"])
    order = Window.partitionBy("key").orderBy("variant_pos", "article_id")
    return found.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def within_hops(pairs: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance): nodes that at most so many edges (src, dst) lead to, each at its least distance.

    Each round joins the last frontier alone; a node that several rounds reach is settled once, by the least distance,
    at the end, and a step back to where the last edge came from is left out before.
    """
    frontier = starts.select(F.col("node").alias("start"), "node", F.lit(None).cast("string").alias("came")).distinct()
    seen = frontier.select("start", "node", F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        step = frontier.join(pairs, (F.col("node") == F.col("src")) & ~F.col("dst").eqNullSafe(F.col("came")) & (F.col("dst") != F.col("start")))
        frontier = step.groupBy("start", F.col("dst").alias("node")).agg(F.when(F.min("src") == F.max("src"), F.min("src")).alias("came"))
        seen = seen.unionByName(frontier.select("start", "node", F.lit(d).alias("distance")))
    return seen.groupBy("start", "node").agg(F.min("distance").alias("distance")).filter("distance > 0")


def pagerank(pairs: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds over the edges (src, dst): 1 - damping plus what the neighbours hand on.

    Every node's row holds its targets, so a round joins ranks to nodes and sums what targets are given; a node of very
    many targets has them in rows of TARGETS each. Lineage is cut every fifth round, where the session's checkpoint
    folder is.
    """
    pairs = pairs.distinct()
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / TARGETS))
    links = pairs.join(degree, "src").groupBy("src", "degree", part.alias("part")).agg(F.collect_list("dst").alias("targets")).drop("part").checkpoint()
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().checkpoint()
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        given = links.join(ranks, F.col("src") == F.col("node")).select(F.explode("targets").alias("node"), (F.col("rank") / F.col("degree")).alias("given"))
        given = given.groupBy("node").agg(F.sum("given").alias("given"))
        ranks = nodes.join(given, "node", "left").select("node", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            ranks = ranks.checkpoint()
    return ranks


def article_history(articles: DataFrame, edges: DataFrame, law_id: str, number: str) -> DataFrame:
    """All versions of an article by date, with the amendments on each and the versions before and after it."""
    own = articles.filter((F.col("law_id") == law_id) & (F.col("article_number") == number))

    def ends(rel: str, near: str, far: str, name: str) -> DataFrame:
        return edges.filter(F.col("rel") == rel).groupBy(F.col(near).alias("id")).agg(F.array_sort(F.collect_set(far)).alias(name))

    sets = [ends("AMENDED_BY", "src_id", "dst_id", "amendments"), ends("SUPERSEDES", "src_id", "dst_id", "supersedes"), ends("SUPERSEDES", "dst_id", "src_id", "superseded_by")]
    return expand(own, sets).orderBy(F.col("version").asc_nulls_first(), "id")


def linked_articles(edges: DataFrame, articles: DataFrame, rel: str, targets: DataFrame, most: int | None = None) -> DataFrame:
    """Articles that rel leads from to any of targets (id), each once: by topic, by concept, by term."""
    ends = edges.filter(F.col("rel") == rel).select(F.col("src_id").alias("id"), F.col("dst_id").alias("__to"))
    found = articles.join(ends.join(targets.select(F.col("id").alias("__to")).distinct(), "__to").select("id").distinct(), "id", "left_semi")
    return found if most is None else found.orderBy("law_id", "article_number", "id").limit(most)


def with_references(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """articles with referenced: the sorted numbers of the articles that each mentions."""
    return expand(articles, [neighbours(edges, "REFERENCES", articles, "referenced", ["article_number"])])


def allowed(nodes: DataFrame, edges: DataFrame, labels: Sequence[str], rels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) of allowed labels, and edges of allowed relations between them."""
    kept = nodes.filter(F.col("label").isin(list(labels)))
    ids = kept.select("id").distinct()
    between = edges.filter(F.col("rel").isin(list(rels))).join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return kept, between


def schedule_graph(entries: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """ScheduleEntry and Substance nodes and their edges, from (law_id, table_number, entry_number, name, latin_name)."""
    e = entries.withColumn("schedule_id", stable_id(F.col("law_id"), F.col("table_number"))).withColumn("id", stable_id(F.col("law_id"), F.col("table_number"), F.col("entry_number")))
    e = e.withColumn("substance_id", stable_id(F.coalesce("latin_name", "name")))
    nodes = {"ScheduleEntry": e.select("id", "law_id", "table_number", "entry_number", "name", "latin_name"), "Substance": e.select(F.col("substance_id").alias("id"), F.coalesce("latin_name", "name").alias("name")).dropDuplicates(["id"])}
    edges = edge("HAS_SCHEDULE", e, "law_id", "schedule_id").unionByName(edge("CONTAINS_ENTRY", e, "schedule_id", "id", position=F.col("entry_number")))
    return nodes, edges.unionByName(edge("DEFINES_SUBSTANCE", e, "id", "substance_id"))


# Building from chunks --------------------------------------------------------------------------------------------------


def law_texts(chunks: DataFrame) -> DataFrame:
    """(law_id, articles, text): each law's articles and preambles in order of pos, an array of structs and one text."""
    of_law = chunks.filter(F.col("chunk_type").isin("article", "preamble")).groupBy("law_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_number", "page_content"))).alias("articles"))
    return of_law.select("law_id", "articles", F.array_join(F.transform("articles", lambda a: a["page_content"]), "\n\n").alias("text"))


def amendment_groups(chunks: DataFrame) -> DataFrame:
    """(law_id, amendment_law_number, amendment_date, amended_article_numbers, text) of amended chunks: the distinct
    articles in the order in which they come first, and their texts."""
    keys = ["law_id", "amendment_law_number", "amendment_date"]
    rows = F.array_sort(F.collect_list(F.struct("pos", "article_number", "page_content")))
    each = chunks.filter("chunk_type = 'amended_article'").groupBy(*keys).agg(rows.alias("x"))
    numbers = F.array_distinct(F.filter(F.transform("x", lambda r: r["article_number"]), lambda n: n.isNotNull()))
    return each.select(*keys, numbers.alias("amended_article_numbers"), F.array_join(F.transform("x", lambda r: r["page_content"]), "\n\n").alias("text"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(chunk_type, n), "unknown" where there is none, the most first."""
    return chunks.groupBy(F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chunk_type")


def corpus_counts(documents: DataFrame) -> DataFrame:
    """One row: rulings, principles and total of documents (doc_type)."""
    return documents.agg(F.count_if(F.col("doc_type") == "ruling").alias("rulings"), F.count_if(F.col("doc_type") == "principle").alias("principles"), F.count(F.lit(1)).alias("total"))


def graph_from_chunks(chunks: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(nodes, edges, counters) of chunks (law_id, law_title, pos, chunk_type, article_number, page_content,
    amendment_law_number, amendment_date, amendment_type), in one call.

    Articles and preambles become articles; amended ones with a number and date become amendments of their law and the
    versions that they make, without either an article and a skip; anything else, and chunks without law or text, are
    skipped. counters has laws, articles, amendments and skipped.
    """
    usable = F.col("law_id").isNotNull() & (F.coalesce("page_content", F.lit("")) != "")
    amended = F.coalesce(F.col("chunk_type") == "amended_article", F.lit(False))
    dated = F.col("amendment_law_number").isNotNull() & F.col("amendment_date").isNotNull()
    kind = F.when(~usable, "skipped").when(F.coalesce(F.col("chunk_type").isin("article", "preamble"), F.lit(False)), "article").when(amended & dated, "amendment").when(amended, "undated").otherwise("skipped")
    routed = chunks.withColumn("kind", kind)
    laws = chunks.filter("law_id IS NOT NULL").groupBy(F.col("law_id").alias("id")).agg(F.coalesce(F.min_by("law_title", "pos"), F.first("law_id")).alias("title"))
    articles = article_nodes(routed.filter("kind IN ('article', 'undated')").select("law_id", "article_number", "pos", F.col("page_content").alias("text")))
    year = F.substring_index("amendment_date", "-", 1)
    changes = routed.filter("kind = 'amendment'").select(
        stable_id(F.col("law_id"), F.col("amendment_law_number"), year).alias("amendment_id"),
        "law_id",
        "amendment_law_number",
        "amendment_date",
        F.coalesce("amendment_type", F.lit("modification")).alias("amendment_type"),
        F.array_compact(F.array("article_number")).alias("amended_article_numbers"),
        F.substring("page_content", 1, 500).alias("description"),
    )
    versions, links = apply_amendments(articles, changes)
    heads = changes.groupBy(F.col("amendment_id").alias("id")).agg(F.first("law_id").alias("law_id"), F.first("amendment_law_number").alias("amendment_law_number"), F.min("amendment_date").alias("amendment_date"))
    edges = edge("CONTAINS", articles, "law_id", "id", position=F.col("position")).unionByName(links)
    counters = routed.agg(
        F.count_distinct("law_id").alias("laws"),
        F.count_if(F.col("kind").isin("article", "undated")).alias("articles"),
        F.count_if(F.col("kind") == "amendment").alias("amendments"),
        F.count_if(F.col("kind").isin("skipped", "undated")).alias("skipped"),
    )
    return {"Law": laws, "Article": versions, "Amendment": heads}, edges, counters


def import_counts(chunks: DataFrame) -> DataFrame:
    """(law_id, articles, amendments, tables, characters): each law's counts, and those of all laws with law_id null."""
    of_kind = lambda *kinds: F.count_if(F.coalesce(F.col("chunk_type"), F.lit("")).isin(*kinds))
    return chunks.filter("law_id IS NOT NULL").rollup("law_id").agg(of_kind("article", "preamble").alias("articles"), of_kind("amended_article").alias("amendments"), of_kind("table").alias("tables"), F.coalesce(F.sum(F.length("page_content")), F.lit(0)).alias("characters"))


def ingest_summary(chunks: DataFrame, short: float = 50.0, long: float = 5000.0) -> DataFrame:
    """(law_id, chunks, mean_chars, warning, status) of each law: a mean length below short or above long is a warning,
    a law without any text an error."""
    size = F.length(F.coalesce("page_content", F.lit("")))
    report = chunks.groupBy("law_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(size), 4).alias("mean_chars"), F.sum(size).alias("__all"))
    warning = F.when(F.col("mean_chars") < short, "short").when(F.col("mean_chars") > long, "long")
    status = F.when(F.col("__all") == 0, "error").when(warning.isNotNull(), "warning").otherwise("ok")
    return report.select("law_id", "chunks", "mean_chars", warning.alias("warning"), status.alias("status"))


def rule_graph(rules: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """LegalRule and LegalConcept nodes and their edges, from (article_id, rule_id, rule_text, concepts, penalty).

    penalty, a struct or map, is kept as JSON, {} where it is null; blank concepts are left out and equal ones are one.
    """
    nodes_rules = rules.groupBy(F.col("rule_id").alias("id")).agg(F.max_by(F.struct(F.col("rule_text").alias("text"), F.coalesce(F.to_json("penalty"), F.lit("{}")).alias("penalty")), "article_id").alias("x")).select("id", "x.*")
    named = rules.select("rule_id", F.explode("concepts").alias("name")).withColumn("name", F.trim("name")).filter("name <> ''").withColumn("id", stable_id(F.col("name")))
    nodes = {"LegalRule": nodes_rules, "LegalConcept": named.select("id", "name").distinct()}
    return nodes, edge("CONTAINS_RULE", rules, "article_id", "rule_id").unionByName(edge("RELATES_TO", named, "rule_id", "id"))


def section_graph(articles: DataFrame, sections: DataFrame, exceptions: DataFrame, concepts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Section, Exception and Concept nodes and their edges.

    sections (law_id, section_id, title, pos) contain articles (id, law_id, section_id); exceptions (article_id, text)
    and concepts (article_id, name) hang on articles. Of rows with one key the first in order stays; equal edges are one.
    """
    e = exceptions.withColumn("id", stable_id(F.col("article_id"), F.col("text")))
    c = concepts.withColumn("name", F.trim("name")).filter("name <> ''").withColumn("id", stable_id(F.col("name")))
    nodes = {
        "Section": sections.groupBy(F.col("section_id").alias("id")).agg(F.min_by(F.struct("law_id", "title"), "pos").alias("x")).select("id", "x.*"),
        "Exception": e.select("id", "text").distinct(),
        "Concept": c.select("id", "name").distinct(),
    }
    edges = edge("HAS_SECTION", sections, "law_id", "section_id").unionByName(edge("HAS_ARTICLE", articles.filter("section_id IS NOT NULL"), "section_id", "id"))
    return nodes, edges.unionByName(edge("HAS_EXCEPTION", e, "article_id", "id")).unionByName(edge("MENTIONS", c, "article_id", "id"))
