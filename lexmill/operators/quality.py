"""A report on the quality of an extracted corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT, LONG = 20, 10_000


def article_report(articles: DataFrame) -> DataFrame:
    """For each law: articles, empty, short and long ones, repeated numbers, least, mean and greatest length."""
    size = F.length(F.coalesce("text", F.lit("")))
    repeated = articles.groupBy("law_id", "article_number").count().groupBy("law_id").agg(F.sum(F.when((F.col("count") > 1) & F.col("article_number").isNotNull(), 1).otherwise(0)).alias("repeated_numbers"))
    report = articles.groupBy("law_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(size == 0).alias("empty"),
        F.count_if((size > 0) & (size < SHORT)).alias("short"),
        F.count_if(size > LONG).alias("long"),
        F.min(size).alias("least"),
        F.round(F.avg(size), 4).alias("mean"),
        F.max(size).alias("greatest"),
    )
    return report.join(repeated, "law_id")


def numbering_gaps(frame: DataFrame, group: str, number: str) -> DataFrame:
    """(group, missing): the whole numbers between a group's least and greatest that it lacks."""
    spans = frame.groupBy(group).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    wanted = spans.select(group, F.explode(F.sequence("low", "high")).alias("missing"))
    return wanted.join(frame.select(group, F.col(number).alias("missing")), [group, "missing"], "left_anti")


def dangling(references: DataFrame, articles: DataFrame) -> DataFrame:
    """References to articles that the law does not have."""
    known = articles.select("law_id", F.col("article_number").alias("to_article")).distinct()
    return references.join(known, ["law_id", "to_article"], "left_anti")


def score(report: DataFrame) -> DataFrame:
    """report (issues, warnings, coverage, terms, refs, topics, rules) with score: 100, less 10 for each issue and 2 for
    each warning, 5 more for a coverage from 85 to 100, 2 more for each list that is not empty, from 0 to 100."""
    extra = F.when(F.col("coverage").between(85, 100), 5).otherwise(0)
    for name in ("terms", "refs", "topics", "rules"):
        extra = extra + F.when(F.col(name) > 0, 2).otherwise(0)
    return report.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - 10 * F.col("issues") - 2 * F.col("warnings") + extra)))
