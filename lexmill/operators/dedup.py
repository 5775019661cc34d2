"""Which of several rows stays: first, last, first that is not null, one for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(frame: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the order given; null keys are equal.

    With names alone the least struct is aggregated, so tasks keep one row a key before anything is shuffled; an order
    that is no name needs a sorted window.
    """
    if all(isinstance(x, str) for x in [*keys, *order]) and not any(t.startswith(("map", "variant")) for _, t in frame.dtypes):
        rest = [c for c in frame.columns if c not in keys]
        # nulls sort first in structs as in windows
        best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
        return frame.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in frame.columns]) if rest else frame.distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def last_wins(frame: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: partial aggregates, no sort."""
    fields = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("x")).select(key, "x.*")


def by_keys_keep_null(frame: DataFrame, keys: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The first row of each key within a group; rows whose keys are all null all stay."""
    known = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    return first_wins(frame.filter(known), [*within, *keys], list(order)).unionByName(frame.filter(~known))


def first_non_null(frame: DataFrame, group: str, columns: Sequence[str], order: str) -> DataFrame:
    """For each group the first value of each column, in the order given, that is not null."""
    return frame.groupBy(group).agg(*[F.expr(f"min_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns])


def pinned_first(frame: DataFrame, pins: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """pins with pinned = 1, then the rows of frame that pins do not have, with pinned = 0."""
    rest = frame.join(pins.select(*keys), list(keys), "left_anti").withColumn("pinned", F.lit(0))
    return pins.withColumn("pinned", F.lit(1)).unionByName(rest).orderBy(F.desc("pinned"), F.desc(score), *keys)
