"""Markdown reports from small collected summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, order: str | None = None) -> str:
    """A summary table as Markdown; numbers as they are, nulls as a dash."""
    rows = (df.orderBy(order) if order else df).collect()
    cell = lambda v: "–" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.6g}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(cell(v) for v in r)} |" for r in rows]) + "\n"


def contamination(funnel: DataFrame, summaries: dict[str, DataFrame], thresholds: dict[str, float]) -> str:
    parts = ["# Contamination audit\n", "Thresholds: " + ", ".join(f"{k} {v:g}" for k, v in thresholds.items()) + "\n", "## Rows by stage\n", table(funnel)]
    for name, s in summaries.items():
        parts += [f"## {name}\n", table(s)]
    return "\n".join(parts)


def quality(lengths: DataFrame, schema: DataFrame) -> str:
    return "\n".join(["# Data quality\n", "## Lengths\n", table(lengths), "## Schema\n", table(schema)])


def quality_markdown(report: dict) -> str:
    """A quality report (``operators.quality``) as Markdown."""
    totals = "\n".join(f"- {k.replace('_', ' ')}: {v:,}" for k, v in report["summary"].items())
    head = "| set | rows | invalid | repeated prompts | field | p95 tokens | max tokens |\n|" + " --- |" * 7
    rows = [f"| {name} | {p['schema']['rows']:,} | {p['schema']['invalid_rows']:,} | {p['duplicate_normalized_prompts']:,} | {field} | {x['tokens']['p95']:,} | {x['tokens']['max']:,} |" for name, p in report["datasets"].items() for field, x in p["lengths"].items()]
    return "\n".join(["# Data quality\n", totals, "", head, *rows]) + "\n"
