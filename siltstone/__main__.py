"""Command line: ``python -m siltstone <command>``; each prints one JSON document."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as E
from .operators import manifests as M
from .plans import curation, evaluation_run, prepare
from .sources import config, runtime


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name, help=said)
        for option, more in options:
            c.add_argument(option, **more)

    table = {"required": True, "help": "a Parquet table"}
    command("inventory", "files of a folder with their hashes", ("root", {}))
    command("snapshot", "what a run would run on", ("root", {}))
    command("prepare", "curate two pools against evaluation sets", ("--sft", table), ("--rl", table), ("--evaluation", {"required": True, "action": "append", "metavar": "NAME=TABLE"}), ("--out", {"required": True}), ("--review", {"type": float, "default": 0.82}), ("--exclude", {"type": float, "default": 0.93}), ("--dev-ratio", {"type": float, "default": 0.02}), ("--seed", {"type": int, "default": 42}), ("--no-quality", {"action": "store_true"}))
    command("check", "gates of what prepare wrote", ("root", {}))
    command("steps", "training steps", ("rows", {"type": int}), ("batch", {"type": int}), ("--epochs", {"type": float, "default": 1.0}))
    command("evaluate", "summary of predictions", ("--predictions", table))
    command("dry-run", "what an evaluation would run on", ("config", {"help": "settings in YAML"}), ("root", {"help": "the folder that prepare wrote"}), ("--profile", {"default": "full"}), ("--datasets", {"nargs": "+", "default": ["all"]}), ("--protocols", {"nargs": "+", "default": ["all"]}), ("--max-samples", {"type": int}))
    command("compare", "paired comparison of two runs", ("--baseline", table), ("--candidate", table))
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> object:
    read = spark.read.parquet
    if a.command == "inventory":
        files = M.inventory(spark, a.root)
        return {"files": files.count(), "bytes": files.agg(F.sum("bytes")).first()[0], "sha256": M.tree_fingerprint(files)}
    if a.command == "snapshot":
        return runtime.snapshot(spark, a.root)
    if a.command == "prepare":
        evaluation = {name: read(path) for name, _, path in (e.partition("=") for e in a.evaluation)}
        return prepare.prepare(spark, read(a.sft), read(a.rl), evaluation, a.out, curation.Thresholds(a.review, a.exclude, a.dev_ratio, a.seed), quality=not a.no_quality)
    if a.command == "check":
        return prepare.check(spark, a.root)
    if a.command == "steps":
        return {"steps": E.training_steps(a.rows, a.batch, a.epochs)}
    if a.command == "dry-run":
        settings = config.load(a.config, a.profile)
        return evaluation_run.dry_run(spark, settings, a.root, E.select(a.datasets, tuple(settings.datasets)), E.select(a.protocols, tuple(settings.protocols)), max_samples=a.max_samples)
    summary = evaluation_run.metrics(read(a.predictions)) if a.command == "evaluate" else E.compare(read(a.baseline), read(a.candidate))
    return [r.asDict() for r in summary.collect()]  # a row for each dataset and protocol


def main(words: list[str] | None = None) -> None:
    a = parser().parse_args(words)
    print(json.dumps(run(SparkSession.builder.appName("siltstone").getOrCreate(), a), ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
