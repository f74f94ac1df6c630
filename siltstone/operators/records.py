"""Canonical records: conversion, normalization, validation, messages and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FINAL, THINKING, canonical, let, strip

#: Splits, required fields of each record family, and the prompt texts of the evaluation contract.
SPLITS = ("dev", "test", "train")
REQUIRED = {
    "mcq": ("id", "source", "question", "options", "answer", "split"),
    "sft": ("id", "source", "question", "reasoning", "response", "messages", "split"),
    "rl": ("id", "source", "prompt", "ground_truth_answer", "split"),
}
DIRECT_INSTRUCTION = """You are answering a medical multiple-choice question.
Select the single best option.
Return only one line in this exact format:
Answer: <OPTION_LETTER>"""
COT_INSTRUCTION = """You are solving a medical multiple-choice question.
Analyze the case step by step and select the single best option.
Use exactly this response structure:

## Thinking
Your step-by-step reasoning.

## Final Response
Answer: <OPTION_LETTER>"""

_OPTIONS = "array<struct<key:string,value:string>>"
_MESSAGES = "array<struct<role:string,content:string>>"


def optional(text: Column) -> Column:
    """Stripped text; null stays null."""
    return F.when(text.isNotNull(), canonical(text))


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or an empty text (a null for other types) where the record family's field is missing."""
    if name in df.columns:
        return F.col(name)
    return F.lit("") if kind == "string" else F.lit(None).cast(kind)


def meta(df: DataFrame) -> Column:
    """Provenance as JSON text: an empty object for null, objects as they are, anything else under ``raw_meta``."""
    if "meta" not in df.columns:
        return F.lit("{}")
    c, kind = F.col("meta"), df.schema["meta"].dataType
    if isinstance(kind, T.StructType | T.MapType):
        return F.coalesce(F.to_json(c), F.lit("{}"))
    if isinstance(kind, T.StringType):
        is_object = F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull()
        return F.when(c.isNull(), F.lit("{}")).when(is_object, c).otherwise(F.to_json(F.struct(c.alias("raw_meta"))))
    return F.when(c.isNull(), F.lit("{}")).otherwise(F.to_json(F.struct(c.alias("raw_meta"))))


def option_value(options: Column, key: Column) -> Column:
    return F.try_element_at(F.transform(F.filter(options, lambda o: o["key"] == key), lambda o: o["value"]), F.lit(1))


def normalize_options(options: Column) -> Column:
    """Keys stripped and upper-cased, blank ones dropped, values stripped; of equal keys the last value stays at the first place."""
    clean = F.filter(F.transform(F.coalesce(options, F.array().cast(_OPTIONS)), lambda o: F.struct(F.upper(canonical(o["key"])).alias("key"), canonical(o["value"]).alias("value"))), lambda o: o["key"] != "")

    def collapse(c: Column) -> Column:
        keys = F.array_distinct(F.transform(c, lambda o: o["key"]))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(c, lambda o: o["key"] == k), -1)["value"].alias("value")))

    return let(clean, collapse)


def options_from_map(options: Column) -> Column:
    return F.transform(F.map_entries(options), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].cast("string").alias("value")))


def options_from_lists(labels: Column, texts: Column) -> Column:
    """Labels and texts of equal number; an error otherwise."""
    pairs = F.transform(F.arrays_zip(labels.alias("a"), texts.alias("b")), lambda p: F.struct(p["a"].cast("string").alias("key"), p["b"].cast("string").alias("value")))
    return F.when(F.size(labels) == F.size(texts), pairs).otherwise(F.raise_error(F.lit("labels and texts differ in number")).cast(_OPTIONS))


def options_from_items(items: Column, key: str = "key", value: str = "value") -> Column:
    """Items with a key and a value; incomplete ones are skipped."""
    return F.transform(F.filter(items, lambda o: o[key].isNotNull() & o[value].isNotNull()), lambda o: F.struct(o[key].cast("string").alias("key"), o[value].cast("string").alias("value")))


def build_messages(question: Column, reasoning: Column, response: Column) -> Column:
    answer = F.concat(F.lit(f"{THINKING}\n"), reasoning, F.lit(f"\n\n{FINAL}\n"), response)
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def normalize_messages(messages: Column) -> Column:
    return F.transform(F.coalesce(messages, F.array().cast(_MESSAGES)), lambda m: F.struct(canonical(m["role"]).alias("role"), canonical(m["content"]).alias("content")))


def normalize_mcq(df: DataFrame) -> DataFrame:
    options = normalize_options(column(df, "options", _OPTIONS))
    answer = F.upper(canonical(column(df, "answer")))
    given = optional(column(df, "answer_text", "string") if "answer_text" in df.columns else F.lit(None).cast("string"))
    explanation = optional(F.col("explanation")) if "explanation" in df.columns else F.lit(None).cast("string")
    base = df.select(canonical(column(df, "id")).alias("id"), canonical(column(df, "source")).alias("source"), canonical(column(df, "question")).alias("question"), options.alias("options"), answer.alias("answer"), F.lower(canonical(column(df, "split"))).alias("split"), given.alias("answer_text"), explanation.alias("explanation"), meta(df).alias("meta"))
    found = option_value(F.col("options"), F.col("answer"))
    return base.withColumn("answer_text", F.when(F.coalesce(F.col("answer_text"), F.lit("")) == "", F.coalesce(found, F.col("answer_text"))).otherwise(F.col("answer_text")))


def normalize_sft(df: DataFrame) -> DataFrame:
    base = df.select(*(canonical(column(df, c)).alias(c) for c in ("id", "source", "question", "reasoning", "response")), normalize_messages(column(df, "messages", _MESSAGES)).alias("messages"), F.lower(canonical(column(df, "split"))).alias("split"), meta(df).alias("meta"))
    full = (F.col("question") != "") & (F.col("reasoning") != "") & (F.col("response") != "")
    return base.withColumn("messages", F.when((F.size("messages") == 0) & full, build_messages(F.col("question"), F.col("reasoning"), F.col("response"))).otherwise(F.col("messages")))


def normalize_rl(df: DataFrame) -> DataFrame:
    return df.select(*(canonical(column(df, c)).alias(c) for c in ("id", "source", "prompt", "ground_truth_answer")), F.lower(canonical(column(df, "split"))).alias("split"), meta(df).alias("meta"))


def _blank(c: Column) -> Column:
    return canonical(c) == ""


# The wording of the messages below is what callers compare.


def _common_errors(df: DataFrame, family: str, prompt: str) -> list[Column]:
    missing = sorted(f for f in REQUIRED[family] if f not in df.columns)
    errors = [F.lit(f"missing required fields: {', '.join(missing)}")] if missing else []
    errors += [F.when(_blank(column(df, c)), F.lit(f"{c} must be a non-empty string")) for c in ("id", "source", prompt)]
    errors.append(F.when(~F.lower(canonical(column(df, "split"))).isin(*SPLITS), F.lit(f"split must be one of {list(SPLITS)}")))
    if "meta" in df.columns and dict(df.dtypes)["meta"] == "string":
        errors.append(F.when(F.col("meta").isNotNull() & ~F.trim("meta").startswith("{"), F.lit("meta must be an object when provided")))
    return errors


def _all(df: DataFrame, errors: list[Column], more: Column | None = None) -> DataFrame:
    found = F.filter(F.array(*errors), lambda e: e.isNotNull())
    return df.withColumn("errors", F.concat(found, more) if more is not None else found)


def validate_mcq(df: DataFrame) -> DataFrame:
    """``errors``: every violation, in a fixed order."""
    options = normalize_options(column(df, "options", _OPTIONS))
    answer = F.upper(canonical(column(df, "answer")))
    keys = F.transform(options, lambda o: o["key"])
    empty = F.transform(F.filter(options, lambda o: o["value"] == ""), lambda o: o["key"])
    errors = _common_errors(df, "mcq", "question") + [
        F.when(F.size(options) < 2, F.lit("options must contain at least two choices")),
        F.when(F.size(empty) > 0, F.concat(F.lit("option values must be non-empty: "), F.array_join(empty, ", "))),
        F.when(answer == "", F.lit("answer must be a non-empty option key")).when((F.size(options) > 0) & ~F.array_contains(keys, answer), F.concat(F.lit("answer '"), answer, F.lit("' is not in options: "), F.array_join(F.sort_array(keys), ", "))),
    ]
    return _all(df, errors)


def validate_sft(df: DataFrame) -> DataFrame:
    messages = F.coalesce(column(df, "messages", _MESSAGES), F.array().cast(_MESSAGES))
    enough = F.size(messages) >= 2
    roles = F.transform(messages, lambda m: m["role"])
    both = F.coalesce(F.array_contains(roles, "user"), F.lit(False)) & F.coalesce(F.array_contains(roles, "assistant"), F.lit(False))
    errors = _common_errors(df, "sft", "question") + [
        F.when(_blank(column(df, "reasoning")), F.lit("reasoning must be a non-empty string")),
        F.when(_blank(column(df, "response")), F.lit("response must be a non-empty string")),
        F.when(~enough, F.lit("messages must contain at least user and assistant messages")).when(~both, F.lit("messages must contain user and assistant roles")),
    ]
    empty = F.filter(F.transform(messages, lambda m, i: F.when(F.coalesce(strip(m["content"]), F.lit("None")) == "", F.concat(F.lit("messages["), i.cast("string"), F.lit("] must contain non-empty content")))), lambda e: e.isNotNull())
    return _all(df, errors, F.when(enough, empty).otherwise(F.array().cast("array<string>")))


def validate_rl(df: DataFrame) -> DataFrame:
    return _all(df, _common_errors(df, "rl", "prompt") + [F.when(_blank(column(df, "ground_truth_answer")), F.lit("ground_truth_answer must be a non-empty string"))])


def strict(validated: DataFrame, family: str) -> DataFrame:
    """Valid rows; the first invalid one raises with its id and all its errors when it is read."""
    said = F.concat(F.lit(f"invalid {family} sample "), F.coalesce(F.nullif(F.col("id"), F.lit("")), F.lit("<unknown>")), F.lit(": "), F.array_join("errors", "; "))
    return validated.filter(F.when(F.size("errors") > 0, F.raise_error(said).cast("boolean")).otherwise(True)).drop("errors")


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid ones with their errors."""
    return validated.filter(F.size("errors") == 0).drop("errors"), validated.filter(F.size("errors") > 0)


def positional_id(prefix: str, row_index: Column) -> Column:
    """Prefix and the 1-based row number with six digits."""
    return F.format_string(f"{prefix}_%06d", row_index)


def provenance(row_index: Column, **source: str | None) -> Column:
    return F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in source.items()), row_index.alias("row_index")))


def from_sft_source(df: DataFrame, *, prefix: str, source: str, row_index: str = "row_index", **where: str | None) -> DataFrame:
    """Rows of Question, Complex_CoT, Response as canonical records."""
    i = F.col(row_index)
    return strict(validate_sft(normalize_sft(df.select(positional_id(prefix, i).alias("id"), F.lit(source).alias("source"), F.col("Question").alias("question"), F.col("Complex_CoT").alias("reasoning"), F.col("Response").alias("response"), F.lit("train").alias("split"), provenance(i, **where).alias("meta")))), "SFT")


def from_rl_source(df: DataFrame, *, prefix: str, source: str, row_index: str = "row_index", **where: str | None) -> DataFrame:
    i = F.col(row_index)
    return strict(validate_rl(normalize_rl(df.select(positional_id(prefix, i).alias("id"), F.lit(source).alias("source"), F.col("Open-ended Verifiable Question").alias("prompt"), F.col("Ground-True Answer").alias("ground_truth_answer"), F.lit("train").alias("split"), provenance(i, **where).alias("meta")))), "RL")


def _given_id(df: DataFrame, prefix: str, i: Column) -> Column:
    return F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), positional_id(prefix, i)) if "id" in df.columns else positional_id(prefix, i)


def from_indexed_answers(df: DataFrame, *, prefix: str, source: str, split: str = "test", row_index: str = "row_index", **where: str | None) -> DataFrame:
    """Rows of id, question, options (array of key and value), answer_idx, answer."""
    i = F.col(row_index)
    return strict(validate_mcq(normalize_mcq(df.select(_given_id(df, prefix, i).alias("id"), F.lit(source).alias("source"), "question", "options", F.col("answer_idx").alias("answer"), F.col("answer").alias("answer_text"), F.lit(split).alias("split"), provenance(i, **where).alias("meta")))), "MCQ")


def from_lettered_columns(df: DataFrame, *, prefix: str, source: str, split: str = "dev", row_index: str = "row_index", **where: str | None) -> DataFrame:
    """Rows of opa to opd and cop (0 to 3); another cop raises."""
    i = F.col(row_index)
    options = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for k, c in zip("ABCD", ("opa", "opb", "opc", "opd"))))
    wrong = F.raise_error(F.concat(F.lit("row "), i.cast("string"), F.lit(" has invalid cop="), F.coalesce(F.col("cop").cast("string"), F.lit("null")))).cast("string")
    answer = F.when(F.coalesce(F.col("cop").between(0, 3), F.lit(False)), F.try_element_at(F.array(*map(F.lit, "ABCD")), F.col("cop").cast("int") + 1)).otherwise(wrong)
    explanation = F.col("exp").alias("explanation") if "exp" in df.columns else F.lit(None).cast("string").alias("explanation")
    return strict(validate_mcq(normalize_mcq(df.select(_given_id(df, prefix, i).alias("id"), F.lit(source).alias("source"), "question", options.alias("options"), answer.alias("answer"), explanation, F.lit(split).alias("split"), provenance(i, **where).alias("meta")))), "MCQ")


def from_abstracts(df: DataFrame, *, source: str, split: str = "test", row_index: str = "row_index", **where: str | None) -> DataFrame:
    """Rows of pubid, question, contexts (array), final_decision (yes, no, maybe), long_answer; ``question_only`` stays in meta."""
    i = F.col(row_index)
    letters = F.create_map(*[F.lit(v) for p in (("yes", "A"), ("no", "B"), ("maybe", "C")) for v in p])
    decision = F.lower(canonical(F.coalesce(F.col("final_decision"), F.lit(""))))
    answer = F.coalesce(F.try_element_at(letters, decision), F.raise_error(F.concat(F.lit("row "), i.cast("string"), F.lit(" has invalid final_decision="), decision)).cast("string"))
    options = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("A", "yes"), ("B", "no"), ("C", "maybe"))))
    question = F.concat(F.lit("Abstract context:\n"), F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), "\n"), F.lit("\n\nQuestion:\n"), F.coalesce("question", F.lit("")))
    about = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in where.items()), i.alias("row_index"), F.col("pubid"), F.col("question").alias("question_only")))
    return strict(validate_mcq(normalize_mcq(df.select(F.concat(F.lit(f"{source}_"), F.coalesce(F.col("pubid").cast("string"), i.cast("string"))).alias("id"), F.lit(source).alias("source"), question.alias("question"), options.alias("options"), answer.alias("answer"), F.col("long_answer").alias("explanation"), F.lit(split).alias("split"), about.alias("meta")))), "MCQ")


def prompt_completion(df: DataFrame) -> DataFrame:
    """``problem`` (null if none), prompt and completion of one-turn conversations."""
    m = F.col("messages")
    user, answer = F.try_element_at(m, F.lit(1)), F.try_element_at(m, F.lit(2))
    text = F.coalesce(answer["content"], F.lit(""))
    problem = (
        F.when(F.coalesce(F.size(m), F.lit(0)) != 2, "not one user and one assistant message")
        .when(~((user["role"] == "user") & (answer["role"] == "assistant")), "roles are not user, assistant")
        .when(~(F.contains(text, F.lit(THINKING)) & F.contains(text, F.lit(FINAL))), "the answer lacks its headings")
    )
    made = df.select("id", "source", problem.alias("problem"), F.array(F.struct(F.lit("user").alias("role"), F.coalesce(user["content"], F.lit("")).alias("content"))).alias("prompt"), F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content"))).alias("completion"))
    return made


def strict_prompt_completion(df: DataFrame) -> DataFrame:
    made = prompt_completion(df)
    said = F.concat(F.col("id").cast("string"), F.lit(": "), F.col("problem"))
    return made.filter(F.when(F.col("problem").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop("problem")


def format_options(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["value"])), "\n")


def render_prompt(question: Column, options: Column, protocol: str) -> Column:
    """The user turn of an evaluation prompt; options stay in their order."""
    if protocol not in ("direct", "cot"):
        raise ValueError(f"unknown protocol {protocol!r}")
    instruction = DIRECT_INSTRUCTION if protocol == "direct" else COT_INSTRUCTION
    return F.concat(F.lit(f"{instruction}\n\nQuestion:\n"), question, F.lit("\n\nOptions:\n"), format_options(options))


def render_chat(messages: Column, generation_prompt: bool = False) -> Column:
    """Turns between start and end marks. A renderer for another template is a Column of the caller's."""
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(turns, F.lit("<|im_start|>assistant\n")) if generation_prompt else turns
