"""Vector code compression: integer parts of vectors as codebook indexes, fitted by Lloyd rounds over active entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, made, staged

#: Scale of the integers, how many parts a vector has, entries of a codebook and rounds of fitting.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers beyond this size in either direction raise an error: squared distances must be exact in 64 bits.
LARGEST = 1 << 26
#: Distances that a task holds at once.
_HELD = 1 << 22
#: Most rows of label sums that are broadcast; beyond, both sides are shuffled by label and a salt.
BROADCAST_LABELS, _SALTS = 50_000, 32


def _finite(vector: str) -> str:
    """SQL: the vector is there and all of its components are finite."""
    return f"{vector} IS NOT NULL AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of x to those of entries, exact: in doubles where they hold every sum."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if most >= LARGEST or 4 * most * most * max(1, x.shape[1]) >= 1 << 62:
        raise ValueError(f"components of {most} are too large for exact distances")
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64
    x, e = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)


def assign_active(x: np.ndarray, code: np.ndarray, error: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of x, its squared distance, and how many distances were taken.

    code and error are those by the codebook before, moved the indexes of the entries that differ since. A row whose
    entry stayed has its distance already and no entry that stayed can be nearer: it is compared with the moved ones
    alone. The other rows see all entries. Of equal distances the lower index counts.
    """
    code, error, taken = code.copy(), error.copy(), 0
    anew = np.isin(code, moved) | (code < 0)
    step, everything, moved = max(1, _HELD // len(entries)), np.arange(len(entries)), np.sort(moved)
    for rows, among, whole in ((np.flatnonzero(anew), everything, True), (np.flatnonzero(~anew), moved, False)):
        for at in range(0, len(rows) if len(among) else 0, step):
            part = rows[at : at + step]
            found = distances(x[part], entries[among])
            best = found.argmin(axis=1)
            far, index = found[np.arange(len(part)), best], among[best]
            better = whole | (far < error[part]) | ((far == error[part]) & (index < code[part]))
            code[part[better]], error[part[better]] = index[better], far[better]
            taken += found.size
    return code, error, taken


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _assigner(codebooks: np.ndarray, moved: list[np.ndarray], names: list[str], dim: int):
    """Rows with codes and errors by these codebooks (part, entry, position)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, parts = _matrix(batch.column("ints"), dim, np.int64), len(codebooks)
            codes, errors = _matrix(batch.column("codes"), parts, np.int64), _matrix(batch.column("errors"), parts, np.int64)
            width = dim // parts
            for p in range(parts):
                codes[:, p], errors[:, p], _ = assign_active(x[:, p * width : (p + 1) * width], codes[:, p], errors[:, p], codebooks[p], moved[p])
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts)
            new = {"codes": pa.ListArray.from_arrays(at, pa.array(codes.astype(np.int32).ravel())), "errors": pa.ListArray.from_arrays(at, pa.array(errors.ravel()))}
            yield pa.RecordBatch.from_arrays([new[name] if name in new else batch.column(name) for name in names], names=names)

    return assign


def _summer(parts: int, entries: int, dim: int):
    """For each part and entry that a task's rows are assigned to: how many, and their sum by position."""
    width = dim // parts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _matrix(batch.column("ints"), dim, np.int64), _matrix(batch.column("codes"), parts, np.int64)
            for p in range(parts):
                at = codes[:, p] + p * entries
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                total[own] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                n += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(n)
        if len(used):
            columns = [pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(n[used]), *(pa.array(total[used, i]) for i in range(width))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return add


def _updated(rows: DataFrame, codebooks: np.ndarray, dim: int) -> np.ndarray:
    """The codebooks with each used entry at the floor of its parts' mean; a row an entry reaches the driver."""
    parts, entries, width = codebooks.shape
    names = [f"s{i}" for i in range(width)]
    sums = rows.select("ints", "codes").mapInArrow(_summer(parts, entries, dim), "part int, entry int, n long" + "".join(f", {s} long" for s in names))
    new = codebooks.copy()
    for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():
        new[row.part, row.entry] = [row[s] // row.n for s in names]
    return new


def _with_group_sums(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over equal by, nulls together; a by that very many rows share is spread over tasks."""
    sums = staged(rows.groupBy(by).agg(F.sum(value).alias(name)), "label-sums").select(F.col(by).alias("__by"), name)
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), rows[by].eqNullSafe(sums["__by"])).drop("__by")
    salted = sums.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    from_rows = rows.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "errors"), F.lit(_SALTS)).cast("int"))
    return from_rows.join(salted, from_rows[by].eqNullSafe(salted["__by"]) & (F.col("__salt") == F.col("__to"))).drop("__by", "__to", "__salt")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, errors) of every vector that is compressed, and the codebooks (part, entry, position).

    Each component x counts as floor(1024 x); a vector is cut into so many equal consecutive parts, and a part's code
    is the nearest entry of its position's codebook by squared Euclidean distance, the lower index of equal ones.
    Codebooks start as the parts of the vectors of the smallest vec_ids (nulls last; vectors of one vec_id by their
    components) and are fitted in so many rounds; then all parts are assigned once more. Between rounds a part whose
    entry stayed is compared with the moved entries alone.

    Vectors that are null or hold null or non-finite components are left out, whatever their label; repeated rows stay
    rows; the label may be null; other columns are not read. All vectors must have the length of the first one, a
    multiple of parts: those of another length are left out too. A component of 65,536 or more raises an error, as
    distances must be exact in 64 bits. An empty table gives no rows and empty codebooks.
    Codebooks (parts x entries rows at most) are all that the driver holds.
    """
    spark = vectors.sparkSession
    whole = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(_finite("v"))
    ints = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    least = whole.select("vec_id", ints.alias("ints")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    dim = len(least[0].ints) if least else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components have no {parts} equal parts")
    if least and any(len(r.ints) != dim for r in least):
        least = whole.filter(F.size("v") == dim).select("vec_id", ints.alias("ints")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r.ints for r in least], np.int64).reshape(len(least), parts, dim // parts)
    codebooks = np.ascontiguousarray(start.transpose(1, 0, 2))
    none = F.array_repeat(F.lit(-1), parts)
    rows = whole.filter(F.size("v") == dim).select("vec_id", "label", ints.alias("ints"), none.alias("codes"), F.array_repeat(F.lit(-1).cast("long"), parts).alias("errors"))
    if not least:
        return rows.drop("ints"), codebooks
    moved = [np.arange(len(least))] * parts
    rows = staged(rows, "integer-vectors")
    last = made()[-1:]
    for step in range(rounds + 1):
        before = made()
        rows = staged(rows.mapInArrow(_assigner(codebooks, moved, rows.columns, dim), rows.schema), "assigned-vectors")
        discard(spark, last)
        last = [path for path in made() if path not in before]
        if step < rounds:
            new = _updated(rows, codebooks, dim)
            moved = [np.flatnonzero((new[p] != codebooks[p]).any(axis=1)) for p in range(parts)]
            codebooks = new
    return rows.drop("ints"), codebooks


def codebook_text(codebooks: np.ndarray) -> str:
    """All integers by part, entry and position, comma-joined."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def digest(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of compressed vectors."""
    hexes = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b)
    flat = rows.select("vec_id", "label", "errors", hexes.alias("code"), error.alias("error"))
    checked = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    return _with_group_sums(flat, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(checked).alias("codebooks_sha256"))


def decode(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, vector) with each part as its entry says, in the units of the input."""
    parts, _, width = codebooks.shape

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _matrix(batch.column("codes"), parts, np.int64)
            values = np.concatenate([codebooks[p][codes[:, p]] for p in range(parts)], axis=1) / SCALE
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts * width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(at, pa.array(values.ravel()))], names=["vec_id", "vector"])

    return rows.select("vec_id", "codes").mapInArrow(look_up, "vec_id long, vector array<double>")


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The SQL of digest(*compress(embeddings)): complete rescans in every round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, part, min(d) AS d, arg_min(entry, d * {entries} + entry) AS entry FROM (
    SELECT p.r, p.part, b.entry, list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.c) + list_dot_product(b.c, b.c) AS d
    FROM p JOIN b{k} b USING (part)) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY i) AS c FROM (
      SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM (
        SELECT p.part, entry, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM a{k} JOIN p USING (r, part)) GROUP BY ALL)
    GROUP BY ALL) m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(part)),
b0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries}),{','.join(steps)},
book AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS h
  FROM (SELECT part, entry, generate_subscripts(c, 1) AS i, unnest(c) AS v FROM b{rounds})),
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), book
"""
