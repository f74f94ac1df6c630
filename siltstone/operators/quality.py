"""Quality report of record sets: validity, repeated prompts, a frozen sample, length profiles of every field."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from . import curation as C
from . import records as R
from .evaluation import length_summary

LONG = 4096
ERRORS = 20
SAMPLE = 100
#: For each family of records: its check, the field of its prompt, and the fields whose lengths are profiled.
FAMILIES = {
    "sft": (R.validate_sft, "question", ("question", "reasoning", "response")),
    "rl": (R.validate_rl, "prompt", ("prompt", "ground_truth_answer")),
    "mcq": (R.validate_mcq, "question", ("question",)),
}


def schema_summary(checked: DataFrame) -> dict[str, Any]:
    """Rows by validity, and the first errors by id."""
    counts = checked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("bad")).first()
    firsts = checked.filter(F.size("errors") > 0).orderBy("id").limit(ERRORS).select("id", "errors").collect()
    return {"rows": counts["rows"], "valid_rows": counts["rows"] - counts["bad"], "invalid_rows": counts["bad"], "first_errors": [{"id": r["id"], "errors": list(r["errors"])} for r in firsts]}


def length_profiles(df: DataFrame, texts: Mapping[str, Column]) -> dict[str, Any]:
    """Characters and tokens of several texts of each row, in one pass and one ranking."""
    cells = [F.struct(F.lit(f"{name}/{kind}").alias("measure"), v.cast("long").alias("v")) for name, text in texts.items() for kind, v in (("characters", F.length(text)), ("tokens", token_count(text)))]
    each = df.select(F.inline(F.array(*cells)))
    over = each.groupBy("measure").agg(F.count_if(F.col("v") > LONG).alias("over"))
    found = {r["measure"]: r.asDict() for r in length_summary(each, "v", ["measure"]).join(over, "measure").collect()}  # two rows for each text
    none = dict.fromkeys(("min", "mean", "p50", "p95", "p99", "max", "over"), 0)
    profile = lambda m: {k: v for k, v in found.get(m, none).items() if k not in ("measure", "over")}
    return {name: {"characters": profile(f"{name}/characters"), "tokens": profile(f"{name}/tokens"), f"over_{LONG}_tokens": found.get(f"{name}/tokens", none)["over"]} for name in texts}


def describe(df: DataFrame, family: str, seed: int = 42) -> dict[str, Any]:
    """One record set's report. The sample is by a seeded hash of the id, so that it can be compared later."""
    check, prompt, fields = FAMILIES[family]
    texts = {f: F.coalesce(F.col(f), F.lit("")) for f in fields}
    if family == "sft":
        texts["chat_template"] = R.render_chat(F.col("messages"))
    sampled = df.select("id").withColumn("all_", F.lit(0))
    ids = [r["id"] for r in C.sample(sampled, by="all_", n=SAMPLE, seed=seed).orderBy("rank").collect()]
    return {
        "schema": schema_summary(check(df)), "duplicate_normalized_prompts": C.duplicate_count(df, prompt).first()["duplicates"], "sampled_ids": ids, "lengths": length_profiles(df, texts),
    }


def report(datasets: Mapping[str, tuple[DataFrame, str]], seed: int = 42) -> dict[str, Any]:
    """The report of named record sets (rows, family) with their totals: training sets are those that aren't multiple choice."""
    parts = {name: describe(df, family, seed) for name, (df, family) in datasets.items()}
    repeated = lambda training: sum(p["duplicate_normalized_prompts"] for n, p in parts.items() if (datasets[n][1] != "mcq") == training)
    return {
        "schema_version": 1,
        "summary": {
            "total_rows": sum(p["schema"]["rows"] for p in parts.values()), "schema_invalid_rows": sum(p["schema"]["invalid_rows"] for p in parts.values()),
            "training_duplicate_normalized_prompts": repeated(True), "official_evaluation_duplicate_normalized_prompts": repeated(False), "sampled_rows": sum(len(p["sampled_ids"]) for p in parts.values()),
        },
        "datasets": parts,
    }
