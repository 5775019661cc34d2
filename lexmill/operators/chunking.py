"""From texts to chunks: articles, tables, word windows, rulings, amendments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.arabic import tokens, western_digits
from lexmill.functions.articles import article_token
from lexmill.functions.reading import HEAD, read_articles, read_articles_of_part, read_gregorian, read_law_and_years, read_outline, read_ruling, read_tables
from lexmill.functions.vocabulary import ADDITION_WORDS, BOOKS, DELETION_WORDS
from lexmill.session import new_folder

TABLE_CHARS = 1200
BOOK_WORDS, BOOK_OVERLAP, RULING_WORDS, RULING_OVERLAP = 400, 50, 300, 40


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def split_articles(files: DataFrame, text: str = "text") -> DataFrame:
    """files with pos, article_number, page_content: one row for each article, what stands before the first has no number.

    Bodies that are blank are left out; a text without any header is one row without a number; a null text has none.
    """
    pieces = files.select("*", F.explode(read_articles(F.col(text))).alias("piece"))
    return pieces.select(*files.columns, "piece.pos", article_token(F.col("piece.number")).alias("article_number"), F.col("piece.body").alias("page_content"))


def split_articles_of_parts(parts: DataFrame, key: str, part: str = "part", text: str = "text") -> DataFrame:
    """(key, pos, article_number, page_content): what split_articles gives of texts that are too long for a row.

    Rows (key, part, text) are the lines of a text in some parts, by their order, each with a line break after it; an
    article may run over many parts, but its head lies in one. Parts are read by themselves and their pieces written;
    then only their numbers of heads and their first and last pieces meet.
    """

    def stored(frame: DataFrame, label: str) -> DataFrame:
        folder = new_folder(frame.sparkSession, label)
        frame.write.parquet(folder)
        return frame.sparkSession.read.schema(frame.schema).parquet(folder)

    pieces = parts.select(key, part, F.explode(read_articles_of_part(F.col(text))).alias("piece")).select(key, part, "piece.*")
    pieces = stored(pieces, "pieces")
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = pieces.groupBy(F.col(key).alias("__key"), F.col(part).alias("__part")).agg(F.max("last").alias("__heads"))
    heads = stored(heads.withColumn("__before", F.coalesce(F.sum("__heads").over(before), F.lit(0))), "heads")  # as files, Spark knows whether they are small
    placed = pieces.join(heads, F.col(key).eqNullSafe(F.col("__key")) & F.col(part).eqNullSafe(F.col("__part")))
    placed = placed.select(key, part, (F.col("__before") + F.col("pos")).cast("int").alias("pos"), "number", "body", ((F.col("pos") == 0) | (F.col("pos") == F.col("last"))).alias("edge"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part, "body"))), lambda x: x["body"]), "")
    edges = placed.filter("edge").groupBy(key, "pos").agg(F.max("number").alias("number"), joined.alias("body"))
    edges = edges.withColumn("body", F.regexp_replace("body", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")).filter("body <> ''")
    whole = placed.filter("NOT edge").select(key, "pos", "number", "body").unionByName(edges)
    return whole.select(key, "pos", article_token(F.col("number")).alias("article_number"), F.col("body").alias("page_content"))


def chunk_type(number: Column) -> Column:
    return F.when(number.isNull(), "preamble").otherwise("article")


def split_tables(files: DataFrame, text: str = "text") -> DataFrame:
    """files with pos, table_number, page_content: one row for each table, its header kept; no header gives number 0."""
    pieces = files.select("*", F.explode(read_tables(F.col(text))).alias("piece"))
    return pieces.select(*files.columns, "piece.pos", western_digits(F.col("piece.number")).alias("table_number"), F.col("piece.body").alias("page_content"))


def pack_lines(text: Column, most: int = TABLE_CHARS) -> Column:
    """Lines packed greedily into parts of at most so many characters; blank lines go, a longer line is a part alone."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"))

    def add(done: Column, line: Column) -> Column:
        fits = (done["open"] != "") & (F.length(done["open"]) + 1 + F.length(line) <= most)
        closed = F.when((done["open"] == "") | fits, done["parts"]).otherwise(F.concat(done["parts"], F.array(done["open"])))
        return F.struct(closed.alias("parts"), F.when(fits, F.concat(done["open"], F.lit("\n"), line)).otherwise(line).alias("open"))

    return F.aggregate(lines, empty, add, lambda d: F.when(d["open"] == "", d["parts"]).otherwise(F.concat(d["parts"], F.array(d["open"]))))


def word_windows(text: Column, words: int, overlap: int) -> Column:
    """Windows of so many words, each starting words - overlap after the one before."""
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(split) - 1, F.lit(0)), F.lit(words - overlap))
    return F.when(F.size(split) > 0, F.transform(starts, lambda s: F.array_join(F.slice(split, s + 1, words), " "))).otherwise(F.array().cast("array<string>"))


_SEPARATORS = ("\n\n", "\n", ".", " ", "")


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = _SEPARATORS) -> list[str]:
    """Chunks of at most size words, cut at the first separator that occurs, which starts the next piece.

    Pieces are merged while they fit; a new chunk repeats the last pieces of the one before up to overlap words;
    pieces that are too long are cut by the later separators.
    """
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, later = separators[at], separators[at + 1 :]
    pieces = re.split(f"(?={re.escape(separator)})", text) if separator else list(text)
    count = lambda s: len(s.split())
    chunks: list[str] = []
    held: list[str] = []

    def emit() -> None:
        joined = "".join(held).strip()
        if joined:
            chunks.append(joined)

    for piece in filter(None, pieces):
        n = count(piece)
        if n >= size and later:
            emit()
            held.clear()
            chunks += recursive_split(piece, size, overlap, later)
            continue
        total = sum(map(count, held))
        if held and total + n > size:
            emit()
            while held and (total > overlap or total + n > size):
                total -= count(held.pop(0))
        held.append(piece)
    emit()
    return chunks


def split_recursively(frame: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """frame with its text cut by recursive_split, as columns pos and page_content."""
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in frame.dtypes if c != text), "pos int, page_content string"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = batch[text].map(lambda t: list(enumerate(recursive_split(t, size, overlap))) if t else [])
            rows = batch.drop(columns=[text]).assign(__part=parts).explode("__part").dropna(subset=["__part"])
            yield rows.assign(pos=rows["__part"].str[0], page_content=rows["__part"].str[1]).drop(columns=["__part"])

    return frame.mapInPandas(cut, kinds)


def ruling_fields(text: Column) -> list[Column]:
    """case_number, case_year, ruling_date and chamber from the first 1000 characters."""
    head = read_ruling(F.substring(text, 1, 1000))
    return [
        western_digits(head["case_number"]).alias("case_number"),
        western_digits(head["case_year"]).alias("case_year"),
        head["ruling_date"].alias("ruling_date"),
        head["chamber"].alias("chamber"),
    ]


def amendment_type(text: Column) -> Column:
    """addition, deletion or modification by the words of the first 800 characters, in this order.

    The words count whole, but for a joined "and" or "so" before them.
    """
    words = tokens(F.substring(text, 1, 800))
    bare = F.array_union(words, F.transform(words, lambda w: F.regexp_replace(w, "^[وف]", "")))
    has = lambda some: F.arrays_overlap(bare, F.array(*map(F.lit, some)))
    return F.when(has(ADDITION_WORDS), "addition").when(has(DELETION_WORDS), "deletion").otherwise("modification")


def amendment_law(name: Column, text: Column, pairs: Column | None = None) -> tuple[Column, Column]:
    """(number, year) of an amending law: from the file's name, else from the first fitting mention in the text's head.

    A name ends in _num<N>_<year>.txt or _<N>_<year>.txt, or holds a year from 1900 to 2099 and another number. In the
    text the number from 1800 to 2100 is the year and the other, below 10000, the number; pairs are those of the head
    where they are read already.
    """
    tail = r"(?i)_(?:num)?([0-9]+)_([0-9]{4})\.txt$"
    years = F.regexp_extract_all(name, F.lit(r"((?:19|20)\d{2})"), 1)
    numbers = F.filter(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda n: ~F.array_contains(years, n))
    loose = (F.size(numbers) > 0) & (F.size(years) > 0)
    pairs = read_law_and_years(F.substring(text, 1, HEAD)) if pairs is None else pairs
    ordered = F.transform(pairs, lambda p: F.when(p["a"].between(1800, 2100), F.struct(p["b"].alias("n"), p["a"].alias("y"))).otherwise(F.struct(p["a"].alias("n"), p["b"].alias("y"))))
    found = F.get(F.filter(ordered, lambda p: p["y"].between(1800, 2100) & p["n"].between(1, 9999)), F.lit(0))
    number = F.coalesce(extract(name, tail, 1), F.when(loose, F.element_at(numbers, -1)), found["n"].cast("string"))
    year = F.coalesce(extract(name, tail, 2), F.when(loose, F.element_at(years, -1)), found["y"].cast("string"))
    return number, year


def amendment_date(text: Column, year: Column) -> Column:
    """The Gregorian date in the text as yyyy-mm-dd, or the year's first day."""
    return F.coalesce(read_gregorian(text), F.concat(year, F.lit("-01-01")))


def book_title(stem: Column) -> Column:
    chain = None
    for part, title in BOOKS.items():
        chain = F.when(stem.contains(part), title) if chain is None else chain.when(stem.contains(part), title)
    return chain.otherwise(stem)


def law_chunks(files: DataFrame) -> DataFrame:
    """Chunks of all files of sources.text_files.law_files: articles, preambles, tables and amended articles."""
    keep = ["law_id", "law_title", F.col("name").alias("source_file"), "pos", "page_content"]
    main = split_articles(files.filter("kind = 'main'")).select(*keep, "article_number", chunk_type(F.col("article_number")).alias("chunk_type"))
    tables = split_tables(files.filter("kind = 'tables'")).select(*keep, "table_number", F.lit("table").alias("chunk_type"))
    number, year = amendment_law(F.col("name"), F.col("text"))
    dated = files.filter("kind = 'amendment'").withColumn("amendment_law_number", number).withColumn("__year", year)
    dated = dated.filter("amendment_law_number IS NOT NULL AND __year IS NOT NULL")
    dated = dated.withColumn("amendment_date", amendment_date(F.col("text"), F.col("__year"))).withColumn("amendment_type", amendment_type(F.col("text")))
    amended = split_articles(dated).select(*keep, "article_number", "amendment_law_number", "amendment_date", "amendment_type", F.lit("amended_article").alias("chunk_type"))
    return main.unionByName(tables, allowMissingColumns=True).unionByName(amended, allowMissingColumns=True)


def case_law_chunks(files: DataFrame) -> DataFrame:
    """Chunks of rulings and of books of principles."""
    rulings = files.filter("doc_type = 'ruling'").select("doc_type", F.col("folder").alias("crime_category"), F.col("name").alias("source_file"), *ruling_fields(F.col("text")), "text")
    books = files.filter("doc_type = 'principle'").select("doc_type", book_title(F.col("stem")).alias("book_title"), F.col("name").alias("source_file"), "text")
    return split_recursively(rulings, "text", RULING_WORDS, RULING_OVERLAP).unionByName(split_recursively(books, "text", BOOK_WORDS, BOOK_OVERLAP), allowMissingColumns=True)


def carried_forward(frame: DataFrame, column: str, group: str, order: list[str]) -> DataFrame:
    """frame with each null of column replaced by the last value before it in the group."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn(column, F.last(column, ignorenulls=True).over(upto))


#: How many characters before an article a head is looked for.
REACH = 500


def articles_in_context(texts: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, at, article_number, law, section, chapter, page_content) of each article of texts (key, text).

    Of the heads of a kind within so many characters before an article the first one counts; an article without any has
    what the one before it had. Heads and articles are rows with their place in the text; article_number is in Western
    digits, null for ordinals; texts without articles and null ones have no rows; keys are distinct.
    """
    rows = texts.select(key, F.explode(read_outline(F.col(text))).alias("h")).select(key, "h.*")
    near = Window.partitionBy(key).orderBy("at").rangeBetween(-reach, -1)
    kinds = ("law", "section", "chapter")
    seen = rows.withColumns({k: F.first(F.when(F.col("kind") == k, F.col("value")), ignorenulls=True).over(near) for k in kinds}).filter("kind = 'article'")
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(k, ignorenulls=True).over(upto).alias(k) for k in kinds]
    return seen.select(key, "at", western_digits(F.col("value")).alias("article_number"), *carried, F.col("body").alias("page_content"))


def latest_versions(chunks: DataFrame) -> DataFrame:
    """For each law and article the amended chunk of the latest date, else the first original one, else the first.

    Chunks without an article number all stay.
    """
    amended = (F.col("chunk_type") == "amended_article") & (F.coalesce("amendment_date", F.lit("")) != "")
    rank = F.when(amended, 0).when(F.col("chunk_type") == "article", 1).otherwise(2)
    order = Window.partitionBy("law_id", "article_number").orderBy(rank, F.when(amended, F.col("amendment_date")).desc_nulls_last(), "pos")
    numbered = chunks.filter("article_number IS NOT NULL").withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")
    return numbered.unionByName(chunks.filter("article_number IS NULL"))


def merge_short_sentences(text: Column, least: int = 40) -> Column:
    """Sentences of a text, pieces of fewer than so many characters joined to the one before."""
    bare = lambda s: F.regexp_replace(s, r"^\p{Zs}+|\p{Zs}+$", "")  # noqa: E731 - as a lambda of one argument: F.trim itself would get the place as the characters to trim
    pieces = F.filter(F.transform(F.split(text, r"(?<=[.؛;])\s+"), bare), lambda s: s != "")

    def add(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", last, piece)))
        return F.when((F.size(done) > 0) & (F.length(piece) < least), joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), add)


def char_windows(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of so many characters, each starting size - overlap after the one before."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def document_index(documents: DataFrame, text: str = "text", size: int = 2000, overlap: int = 200) -> DataFrame:
    """documents with page_content, chunk_index and chunk_total in place of the text: a long one in windows of so many
    characters, a short, empty or null one as it is with both null."""
    windows = documents.withColumn("__w", F.when(F.length(text) > size, char_windows(F.col(text), size, overlap)).otherwise(F.array(text)))
    each = windows.select("*", F.posexplode("__w").alias("__at", "page_content"))
    many = F.size("__w") > 1
    return each.select(*[c for c in documents.columns if c != text], "page_content", F.when(many, F.col("__at")).alias("chunk_index"), F.when(many, F.size("__w")).alias("chunk_total"))


def ruling_parts(rulings: DataFrame, key: str, text: str, whole_words: int = RULING_WORDS, overlap: int = RULING_OVERLAP) -> DataFrame:
    """rulings with sub_index, chunk_total, word_count, chunk_id: whole if short, else in word windows."""
    parts = rulings.select("*", F.posexplode(word_windows(F.col(text), whole_words, overlap)).alias("sub_index", "page_content"))
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    words = F.size(F.split("page_content", " "))
    chunk = F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("sub_index").cast("string"), "page_content"), 256), 1, 16)
    return parts.select("*", total.alias("chunk_total"), words.alias("word_count"), chunk.alias("chunk_id")).drop(text)


def sections(text: Column, heads: dict[str, str]) -> list[Column]:
    """A column for each named head: the text from its pattern to the next head or the end, or null."""
    later = "|".join(heads.values())
    return [F.trim(extract(text, rf"(?Us)(?:{head})\s*[:：]?\s*(.*?)(?={later}|$)")).alias(name) for name, head in heads.items()]


def of_version(chunks: DataFrame, mode: str = "all") -> DataFrame:
    """Chunks to index: all of them, the latest version of each article, the original ones, or the amended ones."""
    amended = F.col("chunk_type") == "amended_article"
    return {"all": lambda: chunks, "latest": lambda: latest_versions(chunks), "original": lambda: chunks.filter(~amended), "amended": lambda: chunks.filter(amended)}[mode]()
