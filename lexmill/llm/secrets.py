"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: pattern has the groups head and value; values of fewer characters are dropped."""

    name: str
    pattern: str
    least: int
    base: bool = True


#: Base kinds in the order in which spans with one start are listed (fixed values), then what the method adds.
ASSIGN = Kind("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6)
ACCESS = Kind("access", r"()(AKIA[A-Z0-9]+)", 20)
HEX = Kind("hex", r"()((?<![0-9a-f])[0-9a-f]{24,})", 24)
TOKEN = Kind("token", r"()((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,})", 20, base=False)
KINDS = (ASSIGN, ACCESS, HEX, TOKEN)

#: Marks put around matches; in the text they are first replaced by another character that no pattern has.
_OPEN, _VALUE, _CLOSE, _SPARE = "\u0001", "\u0002", "\u0003", "\u0004"
_NO_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,hash:string,varied:boolean>>"
_NO_RUNS = "array<struct<at:int,parts:array<string>>>"
#: Matches of a text that are placed in one run.
_RUN = 256
#: Widely copied hashes that are broadcast at most; more are joined under one of _SALTS salts.
BROADCAST_HASHES, _SALTS = 1_000_000, 16


def _parts(text: Column, kind: Kind) -> Column:
    """The text cut before each match of the kind, with marks before and after its value; without a match one part."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _VALUE + _CLOSE, _SPARE * 3), kind.pattern, f"{_OPEN}$1{_VALUE}$2{_CLOSE}")
    return F.when(text.rlike(kind.pattern), F.split(marked, _OPEN)).otherwise(F.array(F.lit("")))


def _spans(parts: Column, rank: int, kind: Kind) -> Column:
    """The kind's matches of _parts as structs; positions count code points, the end is exclusive.

    Matches are placed in runs of _RUN, so that the work is nearly in proportion to them.
    """

    def run(done: Column, own: Column) -> Column:
        moved = F.aggregate(own, F.lit(0), lambda n, part: n + F.length(part) - 2)
        return F.struct((done["at"] + moved).alias("at"), F.concat(done["runs"], F.array(F.struct(done["at"].alias("at"), own.alias("parts")))).alias("runs"))

    def step(done: Column, part: Column) -> Column:
        head = F.length(F.substring_index(part, _VALUE, 1))
        value = F.substring_index(F.substring_index(part, _CLOSE, 1), _VALUE, -1)
        size = F.length(value)
        span = F.struct(
            done["at"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            (done["at"] + head + size).alias("end"),
            F.sha2(value.cast("binary"), 256).alias("hash"),
            (value.rlike("[0-9]") & value.rlike("[A-Za-z]")).alias("varied"),
        )
        return F.struct(
            (done["at"] + F.length(part) - 2).alias("at"),
            F.when(size >= kind.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    none = F.array().cast(_NO_SPANS)
    cut = F.transform(F.sequence(F.lit(2), F.size(parts), F.lit(_RUN)), lambda i: F.slice(parts, i, F.lit(_RUN)))
    start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(_NO_RUNS).alias("runs"))
    runs = F.aggregate(cut, start, run, lambda x: x["runs"])
    found = F.flatten(F.transform(runs, lambda r: F.aggregate(r["parts"], F.struct(r["at"].alias("at"), none.alias("spans")), step, lambda x: x["spans"])))
    return F.when(F.size(parts) > 1, found).otherwise(none)


def find_candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, owner, repository, text_id, base, added) of each row: the arrays of base spans and of further tokens.

    A further token is a long run of letters, digits and +/_=- with both a letter and a digit, apart from base spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(
        F.col("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        F.xxhash64(text).alias("text_id"),
        *[_parts(text, kind).alias(kind.name) for kind in KINDS],
    )
    rows = cut.select(
        "doc_id",
        "owner",
        "repository",
        "text_id",
        F.concat(*[_spans(F.col(kind.name), i, kind) for i, kind in enumerate(KINDS) if kind.base]).alias("base"),
        _spans(F.col(TOKEN.name), KINDS.index(TOKEN), TOKEN).alias("tokens"),
    )
    apart = F.filter("tokens", lambda t: t["varied"] & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("doc_id", "owner", "repository", "text_id", F.array_sort("base").alias("base"), apart.alias("added"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories): in how many distinct owners and repositories each candidate's hash is found.

    A null owner or repository counts as one of its own. A text that several repositories hold counts for the smallest
    of them alone, so that exact copies of one file are one find. Every count is reduced before it is shuffled.
    """
    each = candidates.select("owner", "repository", "text_id", F.explode(F.concat(F.col("base"), F.col("added"))["hash"]).alias("hash"))
    owners = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    texts = each.groupBy("hash", "text_id").agg(F.min("repository").alias("repository"))
    repositories = texts.groupBy("hash", "repository").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(repositories, "hash")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """(doc_id, base, added, live, widespread) of each row of docs, the spans as arrays of structs without the secrets.

    base holds all spans of the base kinds. A candidate is a widely copied example if more than max_owners distinct
    owners or more than max_repositories distinct repositories hold its hash, equal texts counting once; one that is
    not, and has both letters and digits, looks live. added holds the further tokens that look live; live and
    widespread count the candidates of either verdict. Null and empty texts have no spans; repeated rows have equal
    results; a null owner is an owner; an empty table gives an empty result; other columns of docs are not read.
    """
    rows = staged(find_candidates(docs, owner, repository), "secret-candidates")
    many = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    widely = staged(ownership(rows).filter(many).select("hash"), "widely-copied").withColumn("wide", F.lit(True))
    some = rows.filter("size(base) + size(added) > 0").select("doc_id", "text_id", F.explode(F.concat("base", "added")).alias("span")).withColumn("hash", F.col("span.hash"))
    if widely.count() <= BROADCAST_HASHES:
        judged = some.join(F.broadcast(widely), "hash", "left")
    else:  # a hash that very many rows hold meets its verdict in several tasks
        salted = widely.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        judged = some.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_id"), F.lit(_SALTS))).join(salted, ["hash", "salt"], "left")
    wide = F.coalesce("wide", F.lit(False))
    live = F.col("span.varied") & ~wide
    tally = judged.groupBy("doc_id", "text_id").agg(
        F.collect_set(F.when(live & (F.col("span.kind") == TOKEN.name), F.col("span"))).alias("added"),
        F.count_distinct(F.when(live, F.struct("span.start", "span.rank"))).alias("live"),
        F.count_distinct(F.when(wide, F.struct("span.start", "span.rank"))).alias("widespread"),
    )
    tally = tally.select(F.col("doc_id").alias("id"), F.col("text_id").alias("of"), "added", "live", "widespread")
    whole = rows.drop("added").join(tally, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_id") == F.col("of")), "left")
    none = F.array().cast(_NO_SPANS)
    return whole.select("doc_id", "base", F.coalesce("added", none).alias("added"), *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("live", "widespread")])


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_widespread) of each row."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: Kind) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    return scanned.select(
        "doc_id",
        *[counted(kind) for kind in KINDS if kind.base],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.col("live").alias("n_live"),
        F.col("widespread").alias("n_widespread"),
    )


def oracle_sql(max_owners: int = 2, max_repositories: int = 8) -> str:
    """The SQL that gives digest(scan(documents)) in DuckDB, with patterns of its own.

    It lists all matches of a kind and finds each one's place by the lengths of what regexp_split_to_array leaves
    between them.
    """
    words, marks = "(?i:password|passwd|secret|token|api_?key)", "[\"'']?"
    kinds = [
        ("assign", f"{words}{marks} *[:=] *{marks}[A-Za-z0-9+/_.=-]+", f"^{words}{marks} *[:=] *{marks}", 6),
        ("access", "AKIA[A-Z0-9]+", "", 20),
        ("hex", "[0-9a-f]+", "", 24),
        ("token", "[A-Za-z0-9+/_=-]+", "", 20),
    ]
    each = " UNION ALL ".join(
        f"SELECT doc_id, source, {rank} AS rank, '{name}' AS kind, {least} AS least, '{head}' AS head, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS apart FROM texts"
        for rank, (name, pattern, head, least) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{name}') AS n_{name}" for name, *_ in kinds[:3])
    return f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
matched AS (SELECT * FROM ({each}) WHERE len(found) > 0),
listed AS (SELECT doc_id, source, rank, kind, least, head, generate_subscripts(found, 1) AS pos, unnest(found) AS whole, unnest(apart[1:len(found)]) AS gap FROM matched),
placed AS (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, rank ORDER BY pos) AS stop,
    CASE WHEN head = '' THEN whole ELSE regexp_replace(whole, head, '') END AS value FROM listed),
spans AS (
  SELECT doc_id, source, rank, kind, CAST(stop - length(whole) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, sha256(value) AS hash,
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS varied FROM placed WHERE length(value) >= least),
candidates AS (
  SELECT * FROM spans s WHERE kind <> 'token' OR (varied AND NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = s.doc_id AND b.kind <> 'token' AND b.start < s.stop AND s.start < b.stop))),
owned AS (SELECT hash, count(DISTINCT coalesce(c.source, chr(0))) AS owners, count(DISTINCT text) AS repositories FROM candidates c JOIN texts USING (doc_id) GROUP BY hash),
judged AS (SELECT c.*, owners > {max_owners} OR repositories > {max_repositories} AS wide, c.kind || ':' || start || ':' || stop AS span FROM candidates c JOIN owned USING (hash)),
found AS (
  SELECT doc_id, {counts},
    coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'token'), '') AS base,
    coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'token' OR (varied AND NOT wide)), '') AS spans,
    count(*) FILTER (WHERE varied AND NOT wide) AS n_live, count(*) FILTER (WHERE wide) AS n_widespread
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_widespread, 0) AS n_widespread
FROM documents LEFT JOIN found USING (doc_id)
"""
