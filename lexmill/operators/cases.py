"""Case files: entities extracted from documents, merged, judged in stages by a pluggable language model."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lexmill.functions.articles import normalize_article
from lexmill.functions.coerce import law_code, salvage_json
from lexmill.functions.vocabulary import ENTITY_KEYS

from .dedup import by_keys_keep_null, first_non_null

AGENTS = ["data_ingestion", "procedural_auditor", "legal_researcher", "evidence_analyst", "confession_validity", "witness_credibility", "prosecution_analyst", "defense_analyst", "sentencing", "judge"]
META_FIELDS = ["case_number", "court", "court_level", "jurisdiction", "prosecutor_name", "referral_order_text", "filing_date", "referral_date"]


# What a stage's output never changes in a case, entities that are lists, what a prosecution answer is known by.
CASE_FIELDS = ["case_id", "case_number", "court", "court_level", "jurisdiction", "filing_date", "referral_date", "prosecutor_name", "referral_order_text", "current_agent", "last_updated", "extraction_notes", "source_documents"]
PROSECUTION_FIELDS = ["prosecution_narrative", "prosecution_arguments"]


class LanguageModel(Protocol):
    """Answers a prompt; made once in each task."""

    def answer(self, prompt: str) -> str: ...


class OfflineModel:
    """Answers by rules, without a network: an empty JSON object unless a rule's key is in the prompt."""

    def __init__(self, rules: Mapping[str, str] | None = None):
        self.rules = dict(rules or {})

    def answer(self, prompt: str) -> str:
        return next((v for k, v in self.rules.items() if k in prompt), "{}")


def ask(prompts: DataFrame, model: LanguageModel, retries: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts with answer and error; empty answers and failures are asked again after pauses that double.

    Errors that say payment is due are not asked again.
    """
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in prompts.dtypes), "answer string, error string"])

    def one(prompt: str) -> tuple[str | None, str | None]:
        error = "no answer"
        for attempt in range(retries):
            try:
                if answer := model.answer(prompt):
                    return answer, None
            except Exception as e:
                error = str(e)[:200]
                if "402" in error:
                    break
            sleep(pause * 2**attempt)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = rows["prompt"].map(one)
            yield rows.assign(answer=found.str[0], error=found.str[1])

    return prompts.mapInPandas(run, kinds)


def entities(answers: DataFrame, kind: str, schema: str, order: str = "doc_id") -> DataFrame:
    """Rows of one kind of entity from answers (case_id, doc_id, answer): distinct by ENTITY_KEYS within a case.

    An answer may be the list itself, an object with the list under the kind's name, or a list of such objects; rows
    without a source document take the answer's. Answers that are no JSON give no rows.
    """
    json = salvage_json(F.col("answer"))
    under = F.get_json_object(json, f"$.{kind}")
    wrapped = F.get_json_object(json, f"$[0].{kind}")
    items = F.from_json(F.coalesce(under, wrapped, F.when(json.startswith("["), json)), f"array<struct<{schema}, source_document_id string>>")
    rows = answers.select("case_id", order, F.posexplode(items).alias("pos", "e")).filter("e IS NOT NULL").select("case_id", order, "pos", "e.*")
    rows = rows.withColumn("source_document_id", F.coalesce(F.nullif("source_document_id", F.lit("")), order))
    if kind == "charges":
        rows = rows.withColumn("law_code", law_code(F.col("law_code"))).withColumn("article_number", normalize_article(F.col("article_number"), schema_form=True))
    return by_keys_keep_null(rows, ENTITY_KEYS[kind], [order, "pos"], within=["case_id"]).drop("pos", order)


def case_meta(answers: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row a case: of each field the first value, by document, that is not null."""
    json = salvage_json(F.col("answer"))
    fields = [F.nullif(F.get_json_object(json, f"$.case_meta.{f}"), F.lit("")).alias(f) for f in META_FIELDS]
    return first_non_null(answers.select("case_id", order, *fields), "case_id", META_FIELDS, order)


def entity_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(case_id, entity, n)."""
    out = None
    for name, frame in tables.items():
        one = frame.groupBy("case_id").agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def void_sources(issues: DataFrame) -> DataFrame:
    """(case_id, source_document_id): the documents that a nullity touches, each once."""
    touched = issues.filter("nullity_type IS NOT NULL AND nullity_type <> '' AND source_document_id IS NOT NULL")
    return touched.select("case_id", "source_document_id").distinct()


def flag_invalidated(frame: DataFrame, void: DataFrame) -> DataFrame:
    """frame with invalidated: whether its source document is void; without one it is not."""
    marked = void.withColumn("__void", F.lit(True))
    return frame.join(marked, ["case_id", "source_document_id"], "left").withColumn("invalidated", F.coalesce("__void", F.lit(False))).drop("__void")


def confession_issues(issues: DataFrame) -> DataFrame:
    """Issues of a kind that names interrogation, and those whose text names a confession if they touch a document."""
    kind, text = F.coalesce("procedure_type", F.lit("")), F.coalesce("issue_description", F.lit(""))
    return issues.filter((F.col("nullity_type").isNotNull() & kind.contains("استجواب")) | text.contains("اعتراف"))


def route_cases(audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases that go to the judge at once, cases that go on) by pipeline_fatality."""
    fatal = F.coalesce(F.lower("pipeline_fatality") == "fatal", F.lit(False))
    return audits.filter(fatal), audits.filter(~fatal)


def missing_agents(done: DataFrame, required: Sequence[str] = tuple(AGENTS[:-1])) -> DataFrame:
    """(case_id, missing): required agents that did not finish, of completed_agents."""
    return done.select("case_id", F.array_except(F.array(*map(F.lit, required)), F.coalesce("completed_agents", F.array().cast("array<string>"))).alias("missing"))


def verdicts(answers: DataFrame) -> DataFrame:
    """(case_id, verdict, confidence_score, reasoning, status) from the judge's answers.

    reasoning joins the reasons for each charge by blank lines; an answer that is no object has status "unparsed".
    """
    json = salvage_json(F.col("answer"))
    rulings = F.from_json(F.get_json_object(json, "$.per_charge_rulings"), "array<struct<reasoning string>>")
    return answers.select(
        "case_id",
        F.get_json_object(json, "$.verdict").alias("verdict"),
        F.get_json_object(json, "$.confidence_score").try_cast("double").alias("confidence_score"),
        F.array_join(F.transform(rulings, lambda r: r["reasoning"]), "\n\n").alias("reasoning"),
        F.when(json.startswith("{"), "ok").otherwise("unparsed").alias("status"),
    )


def defence_arguments(formal: Column, substantive: Column) -> Column:
    """Both kinds of defence as one array of structs (kind, text)."""
    shape = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    return F.concat(F.transform(formal, shape("formal")), F.transform(substantive, shape("substantive")))


def run_stages(cases: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str | None = None) -> DataFrame:
    """(case_id, agent, status): every stage's own result on the cases; stages see the cases alone, not each other.

    A stage that cannot be planned gives each case a row with the error's first 200 characters, and the others run on.
    With a folder, each stage's result is written below it first, so one that fails while it runs is state likewise.
    """
    out = None
    for name, stage in stages:
        try:
            one = stage(cases).select("case_id", F.lit(name).alias("agent"), F.lit("done").alias("status"))
            if folder is not None:
                path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
                one.write.parquet(path)
                one = cases.sparkSession.read.schema(one.schema).parquet(path)
        except Exception as e:
            one = cases.select("case_id", F.lit(name).alias("agent"), F.lit(str(e)[:200]).alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def stage_output(frame: DataFrame, case_id: str = "case_id") -> DataFrame:
    """A stage's columns but for those of the case itself, which no stage may change; its id stays as the key."""
    return frame.select(case_id, *[c for c in frame.columns if c not in CASE_FIELDS and c != case_id])


def null_to_blank(value: Column, kind) -> Column:
    """The value with every null text in it as a blank one and every null array as an empty one, at any depth."""
    if isinstance(kind, StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.transform(value, lambda x: null_to_blank(x, kind.elementType)), F.array().cast(kind))
    if isinstance(kind, StructType):
        return F.struct(*[null_to_blank(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
    return value


def without_nulls(frame: DataFrame) -> DataFrame:
    """frame with null_to_blank of every column."""
    return frame.select(*[null_to_blank(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in frame.schema.fields])


def stage_input(cases: DataFrame, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], skip_invalidated: bool = True) -> DataFrame:
    """(case_id, context): what a stage's prompt shows of each case, a JSON object of arrays.

    tables names frames (case_id, ...) and the fields to show of each, sorted; null fields are left out, rows of void
    sources too; a case without rows of a table has an empty array.
    """
    out = cases.select("case_id").distinct()
    for name, (frame, fields) in tables.items():
        rows = frame.filter(~F.coalesce("invalidated", F.lit(False))) if skip_invalidated and "invalidated" in frame.columns else frame
        listed = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(listed, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out.select("case_id", F.to_json(F.struct(*tables)).alias("context"))


def extraction_error(answer: Column, lists: Sequence[str] = tuple(ENTITY_KEYS)) -> Column:
    """Why an extracted answer is rejected, or null: it must be an object, its lists arrays, its case_meta an object."""
    json = F.try_parse_json(salvage_json(answer))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(json, path, "variant"))
    is_object, absent = lambda k: k.startswith("OBJECT"), lambda k: k.isNull() | k.isin("VOID", "NULL")
    error = F.when(F.coalesce(~is_object(F.schema_of_variant(json)), F.lit(True)), "not an object")
    for name in lists:
        error = error.when(~absent(kind(f"$.{name}")) & ~kind(f"$.{name}").startswith("ARRAY"), f"{name} is not a list")
    return error.when(~absent(kind("$.case_meta")) & ~is_object(kind("$.case_meta")), "case_meta is not an object")


def prosecution_answer(answer: Column) -> Column:
    """The answer as a JSON object: an array of the one object that has its fields gives that object, another array is
    its arguments, anything else an empty object."""
    json = salvage_json(answer)
    variant = F.try_parse_json(json)
    items = F.try_variant_get(variant, "$", "array<variant>")
    one = F.to_json(F.get(items, F.lit(0)))
    known = F.lit(False)
    for name in PROSECUTION_FIELDS:
        known = known | F.get_json_object(one, f"$.{name}").isNotNull()
    bare = F.concat(F.lit('{"prosecution_narrative":{},"prosecution_arguments":'), F.to_json(variant), F.lit("}"))
    return F.when(json.startswith("{"), F.to_json(variant)).when((F.size(items) == 1) & F.coalesce(known, F.lit(False)), one).when(items.isNotNull(), bare).otherwise("{}")


def defence_summary(documents: DataFrame) -> DataFrame:
    """(case_id, has_alibi, arguments): whether any defence document of a case has an alibi, and all their arguments in
    order of document."""
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("arguments", F.array().cast("array<string>")).alias("arguments"))))
    each = documents.groupBy("case_id").agg(F.bool_or(F.coalesce(F.col("has_alibi"), F.lit(False))).alias("has_alibi"), ordered.alias("x"))
    return each.select("case_id", "has_alibi", F.flatten(F.transform("x", lambda d: d["arguments"])).alias("arguments"))


def sanitised(messages: Sequence[Mapping[str, object]]) -> list[dict[str, str]]:
    """Messages with a known role and text that is not blank; other roles count as the user's."""
    texts = [(str(m.get("role") or "user"), str(m.get("content") or "").strip()) for m in messages]
    return [{"role": role if role in ("system", "user", "assistant") else "user", "content": text} for role, text in texts if text]


def transformed_queries(answers: DataFrame) -> DataFrame:
    """answers (query_id, question, answer) with article_query and principle_query; the question where the model gave none."""
    json = salvage_json(F.col("answer"))
    asked = [F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, f"$.{n}")), F.lit("")) for n in names], F.col("question")).alias(names[0]) for names in (("article_query", "articles"), ("principle_query", "principles"))]
    return answers.select("query_id", "question", *asked)


def evidence_scores(answers: DataFrame) -> DataFrame:
    """(case_id, evidence_id, strength, admissibility) from the analyst's answers, an array for each incident flattened."""
    json = salvage_json(F.col("answer"))
    items = "array<struct<evidence_id string, strength string, admissibility string>>"
    nested = F.from_json(F.get_json_object(json, "$.incidents"), f"array<struct<evidences {items}>>")
    flat = F.coalesce(F.flatten(F.transform(nested, lambda i: i["evidences"])), F.from_json(F.get_json_object(json, "$.evidences"), items))
    return answers.select("case_id", F.explode(flat).alias("e")).select("case_id", "e.*")
