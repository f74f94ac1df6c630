"""Prediction metrics, length profiles and paired comparison of two runs."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import difference_quantiles, holm, mcnemar_exact, rank_percentiles, wilson
from ..functions.text import common_prefix
from .ordering import within

GROUP = ["dataset", "protocol"]
REPEATED = 0.20


def beside(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Columns of two summaries of the same groups in one row."""
    if by:
        return df.join(other, by)
    one = F.lit(0).alias("__one")  # one row each side
    return df.select("*", one).join(other.select("*", one), "__one").drop("__one")


def length_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, mean (2 places, ties to even), p50, p95, p99, max; zeros for no rows."""
    by = by or []
    aggs = [F.coalesce(F.min(value), F.lit(0)).cast("long").alias("min"), F.coalesce(F.bround(F.avg(value), 2), F.lit(0.0)).alias("mean"), F.coalesce(F.max(value), F.lit(0)).cast("long").alias("max")]
    base = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    ranks = rank_percentiles(df, value, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, by)
    return beside(base, ranks, by).select(*by, "min", "mean", *(F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in ("p50", "p95", "p99")), "max")


def prediction_summary(p: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """One row a group. Rows that were not parsed stay in the denominator of the accuracy."""
    n = F.count(F.lit(1))
    rate = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))) / n
    base = p.groupBy(*by).agg(
        n.alias("rows"), F.count_if("correct").alias("correct"), rate("correct").alias("accuracy"), F.count_if("parse_success").alias("parsed_rows"), rate("parse_success").alias("parse_success"), rate("ambiguous").alias("ambiguous_parse_rate"),
        F.coalesce(F.try_divide(F.count_if("correct"), F.count_if("parse_success")), F.lit(0.0)).alias("accuracy_on_parsed"), rate("format_valid").alias("format_compliance"), rate("hit_max_new_tokens").alias("hit_max_new_tokens_rate"),
        F.avg("completion_tokens").alias("completion_mean"), F.max("completion_tokens").cast("double").alias("completion_max"), F.avg("prompt_tokens").alias("prompt_mean"), F.max("prompt_tokens").cast("double").alias("prompt_max"),
        F.avg("repetition_4gram_ratio").alias("repetition_mean"), (F.count_if(F.col("repetition_4gram_ratio") > REPEATED) / n).alias("abnormal_repetition_rate"),
        F.sum("estimated_sample_seconds").alias("estimated_generation_seconds"),
    )
    base = base.withColumn("estimated_examples_per_second", F.when(F.col("estimated_generation_seconds") > 0, F.col("rows") / F.col("estimated_generation_seconds")))
    low, high = wilson(F.col("correct"), F.col("rows"))
    base = base.withColumn("wilson_low", low).withColumn("wilson_high", high)
    cells = [F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("v")) for v in ("completion_tokens", "prompt_tokens", "repetition_4gram_ratio")]
    ranks = rank_percentiles(p.select(*by, F.inline(F.array(*cells))), "v", {"p50": 0.5, "p95": 0.95}, [*by, "measure"], half_even=True)
    wanted = (("completion_p50", "completion_tokens", "p50"), ("completion_p95", "completion_tokens", "p95"), ("prompt_p95", "prompt_tokens", "p95"), ("repetition_p95", "repetition_4gram_ratio", "p95"))
    wide = ranks.groupBy(*by).agg(*(F.max(F.when(F.col("measure") == m, F.col(q))).alias(name) for name, m, q in wanted))
    base = base.join(wide, by)
    return base.join(macro_f1(p, by), by)


def required_summary(p: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """``prediction_summary`` of predictions that there must be; none raise."""
    if not p.limit(1).count():
        raise ValueError("there are no predictions")
    return prediction_summary(p, by)


def input_lengths(df: DataFrame, value: str, limit: int, by: list[str]) -> DataFrame:
    """Rows, least, mean and most tokens of each group, and how many are over ``limit``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(value).alias("min"), F.bround(F.avg(value), 2).alias("mean"), F.max(value).alias("max"), F.count_if(F.col(value) > limit).alias("overlong"))


def assert_input_lengths(lengths: DataFrame) -> list[dict]:
    """The rows of ``input_lengths``; any that are too long raise."""
    rows = [r.asDict() for r in lengths.collect()]  # a row for each group
    if wrong := [r for r in rows if r["overlong"]]:
        raise ValueError(f"inputs over the limit: {wrong}")
    return rows


def training_steps(rows: int, batch: int, epochs: float = 1.0) -> int:
    """Optimizer steps: batches of an epoch, the last one short, times the epochs."""
    return math.ceil(math.ceil(rows / batch) * epochs)


def token_boundaries(df: DataFrame, prompt_ids: str, full_ids: str, max_length: int) -> DataFrame:
    """One row on where supervision begins: the tokens after the common beginning of a prompt's ids and its conversation's ids."""
    shared = common_prefix(F.col(prompt_ids), F.col(full_ids))
    each = df.select(F.size(full_ids).cast("long").alias("v"), shared.alias("shared"), F.size(prompt_ids).alias("p")).withColumn("s", F.col("v") - F.col("shared"))
    base = each.agg(
        F.count(F.lit(1)).alias("rows"), F.min("v").alias("min_input_tokens"), F.round(F.avg("v"), 2).alias("mean_input_tokens"), F.max("v").alias("max_input_tokens"), F.min("s").alias("min_supervised_tokens"), F.round(F.avg("s"), 2).alias("mean_supervised_tokens"), F.max("s").alias("max_supervised_tokens"),
        F.count_if(F.col("v") > max_length).alias("truncated_rows"), F.count_if(F.col("s") <= 0).alias("empty_completion_rows"), F.count_if(F.col("shared") != F.col("p")).alias("prefix_mismatch_rows"),
    )
    return beside(base, rank_percentiles(each, "v", {"p95_input_tokens": 0.95}, half_even=True), [])


def boundary_previews(df: DataFrame, prompt_ids: str, full_ids: str, n: int = 100, tokens: int = 96, order: str = "id") -> DataFrame:
    """The first ``n`` rows with the first tokens that are supervised."""
    shared = common_prefix(F.col(prompt_ids), F.col(full_ids))
    first = df.orderBy(order).limit(n)
    return first.select("id", F.size(full_ids).alias("input_tokens"), shared.alias("prompt_tokens"), (F.size(full_ids) - shared).alias("supervised_tokens"), F.slice(F.col(full_ids), (shared + 1).cast("int"), F.lit(tokens)).alias("supervised_preview"))


def assert_boundaries(summary: DataFrame) -> dict:
    """The row of ``token_boundaries``; anything truncated, empty or without its prompt as a prefix raises."""
    row = summary.first().asDict()
    if wrong := {k: row[k] for k in ("truncated_rows", "empty_completion_rows", "prefix_mismatch_rows") if row[k]}:
        raise ValueError(f"token boundaries are wrong: {wrong}")
    return row


def macro_f1(p: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Unweighted mean of F1 over all labels that are gold or predicted."""
    gold, said = F.col("gold_answer"), F.nullif(F.col("parsed_answer"), F.lit(""))
    cells = p.groupBy(*by, gold.alias("g"), said.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.array_distinct(F.filter(F.array("g", "s"), lambda x: x.isNotNull()))
    each = cells.select(*by, "g", "s", "n", F.explode(labels).alias("label"))
    is_g, is_s = F.col("g") == F.col("label"), F.coalesce(F.col("s") == F.col("label"), F.lit(False))
    counted = each.groupBy(*by, "label").agg(F.sum(F.when(is_g & is_s, F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("any"))
    return counted.groupBy(*by).agg(F.avg(2 * F.col("tp") / (F.col("any") + F.col("tp"))).alias("macro_f1"))


def confusion(p: DataFrame, by: list[str] = GROUP) -> DataFrame:
    cell = F.concat(F.coalesce("gold_answer", F.lit("None")), F.lit("->"), F.coalesce(F.nullif(F.col("parsed_answer"), F.lit("")), F.lit("UNPARSED")))
    return p.groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def parse_methods(p: DataFrame, by: list[str] = GROUP) -> DataFrame:
    return p.groupBy(*by, F.coalesce("parse_method", F.lit("None")).alias("parse_method")).agg(F.count(F.lit(1)).alias("n"))


def subgroup_accuracy(p: DataFrame, field: str, by: list[str] = GROUP) -> DataFrame:
    """Rows and accuracy by one field; nulls and blanks are left out."""
    return p.filter(F.trim(F.coalesce(F.col(field).cast("string"), F.lit(""))) != "").groupBy(*by, F.col(field).cast("string").alias("subgroup")).agg(F.count(F.lit(1)).alias("rows"), (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"))


def aligned(base: DataFrame, candidate: DataFrame, by: list[str] = GROUP, order: str | None = None) -> DataFrame:
    """Pairs of equal ids; ids (and, given ``order``, their places in their group) that differ raise when the pairs are read."""
    keys = [*by, "id"]

    def pick(df: DataFrame, name: str) -> DataFrame:
        if order is None:
            return df.select(*keys, F.col("correct").cast("int").alias(name), F.lit(0).alias(f"{name}_at"))
        return within(df.select(*keys, F.col(order).alias("order"), F.col("correct").cast("int").alias(name)), by, ["order", "id"], into=f"{name}_at").drop("order")

    joined = pick(base, "b").join(pick(candidate, "c"), keys, "full_outer")
    wrong = F.col("b").isNull() | F.col("c").isNull() | (F.col("b_at") != F.col("c_at"))
    return joined.filter(F.when(wrong, F.raise_error(F.concat(F.lit("ids differ: "), F.col("id").cast("string"))).cast("boolean")).otherwise(True)).select(*keys, "b", "c")


def paired_outcomes(base: DataFrame, candidate: DataFrame, by: list[str] = GROUP, order: str | None = None) -> DataFrame:
    b, c = F.col("b") == 1, F.col("c") == 1
    return aligned(base, candidate, by, order).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg("b").alias("baseline_accuracy"), F.avg("c").alias("candidate_accuracy"), F.avg(F.col("c") - F.col("b")).alias("accuracy_delta"), F.count_if(b & c).alias("both_correct"), F.count_if(b & ~c).alias("baseline_only_correct"), F.count_if(~b & c).alias("candidate_only_correct"), F.count_if(~b & ~c).alias("both_wrong"))


def bootstrap_interval(outcomes: DataFrame, by: list[str] = GROUP, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean paired difference. A group's four outcome counts are all that a resample needs."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        up, down, n = int(row["candidate_only_correct"]), int(row["baseline_only_correct"]), int(row["rows"])
        rng = np.random.default_rng(seed)
        counts = rng.multinomial(n, [up / n, down / n, 1 - (up + down) / n], size=resamples)
        low, high = np.quantile((counts[:, 0] - counts[:, 1]) / n, [0.025, 0.975])
        return pd.DataFrame([[*(row[c] for c in by), float(low), float(high)]], columns=[*by, "delta_low", "delta_high"])

    kinds = dict(outcomes.dtypes)
    return outcomes.groupBy(*by).applyInPandas(draw, ", ".join([f"{c} {kinds[c]}" for c in by] + ["delta_low double", "delta_high double"]))


def exact_interval(outcomes: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """95 % interval of the mean paired difference in resamples of a group, without drawing any: quantiles of its exact distribution.

    What ``bootstrap_interval`` approaches with more and more resamples, apart from its interpolation between values. The same on every run.
    """

    @F.pandas_udf("array<double>")
    def bounds(n: pd.Series, up: pd.Series, down: pd.Series) -> pd.Series:
        return pd.Series([[q / int(k) for q in difference_quantiles(int(k), int(u), int(d))] for k, u, d in zip(n, up, down)])

    found = outcomes.select(*by, bounds("rows", "candidate_only_correct", "baseline_only_correct").alias("b"))
    return found.select(*by, F.get("b", F.lit(0)).alias("delta_low"), F.get("b", F.lit(1)).alias("delta_high"))


def compare(base: DataFrame, candidate: DataFrame, by: list[str] = GROUP, order: str | None = None, contracts: tuple[str, str] | None = None, *, draws: int | None = None) -> DataFrame:
    """Paired outcomes with exact McNemar p, its Holm adjustment over the groups, and the resampling interval of the difference: exact, or
    from ``draws`` resamples. Runs with other groups or contracts raise."""
    if contracts and contracts[0] != contracts[1]:
        raise ValueError("the runs have different evaluation contracts")
    same_groups(base, candidate, by)
    outcomes = paired_outcomes(base, candidate, by, order).withColumn("mcnemar_exact_p", mcnemar_exact(F.col("baseline_only_correct"), F.col("candidate_only_correct")))
    named = outcomes.withColumn("group", F.concat_ws("_", *by))
    interval = bootstrap_interval(outcomes, by, draws) if draws else exact_interval(outcomes, by)
    return holm(named, "mcnemar_exact_p", "group", "mcnemar_holm_p").join(interval, by)


def same_groups(base: DataFrame, candidate: DataFrame, by: list[str] = GROUP) -> None:
    """Raise unless both runs have the same groups."""
    left = {tuple(r) for r in base.select(*by).distinct().collect()}
    if left != {tuple(r) for r in candidate.select(*by).distinct().collect()}:
        raise ValueError("the runs have different groups")


def select(values: Iterable[str], known: tuple[str, ...]) -> tuple[str, ...]:
    """Names of comma- or space-separated selectors in the known order; "all" stands alone; unknown ones raise."""
    wanted = [p.lower() for v in values for p in v.replace(",", " ").split()]
    if not wanted or "all" in wanted:
        if len(wanted) > 1:
            raise ValueError("all excludes other names")
        return known
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown names {unknown}")
    return tuple(k for k in known if k in wanted)
