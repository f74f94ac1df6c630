"""A resumable evaluation run over shards. Predictions come from a function of DataFrames; generation itself is not part of this."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.text import token_count
from ..operators import evaluation as E
from ..operators import manifests as M
from ..operators import records as R
from ..operators.curation import duplicate_ids, shard
from ..sources import config
from ..sources.tables import materialise
from . import prepare as prepare_plan


def prepare(records: DataFrame, order: str = "row_index", *, shard_size: int = 64, max_samples: int | None = None) -> DataFrame:
    """Records in order, the first ``max_samples`` of them, with their shard. Repeated ids and an empty set raise."""
    rows = records.orderBy(order).limit(max_samples) if max_samples else records
    if repeated := duplicate_ids(rows, "id").limit(5).collect():
        raise ValueError(f"repeated ids {[r['id'] for r in repeated]}")
    out = shard(rows, order, shard_size)
    if not out.limit(1).count():
        raise ValueError("no records")
    return out


COMMITS = "_commits"  # below the table of predictions, where readers of it don't look
SHARDS_PER_COMMIT = 1_000
_MARK = "shard long, rows long, ids_sha256 string, evaluation_contract_sha256 string"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table under ``path``; None if there are no files of one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where) or not any(f.getPath().getName()[0] not in "._" for f in system.listStatus(where)):
        return None
    return spark.read.parquet(path)


def done_shards(spark: SparkSession, path: str) -> DataFrame | None:
    """Predictions that are already under ``path``, of unfinished shards too; None if there are none."""
    return _read(spark, path)


def _digests(rows: DataFrame) -> DataFrame:
    """shard, rows, ids_sha256: of the sorted ids of each shard, repeated ones too."""
    ids = F.sort_array(F.collect_list(F.col("id").cast("string")))  # a shard's size is bounded
    return rows.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.to_json(ids), 256).alias("ids_sha256"))


def _raise_if(found: DataFrame, said: str) -> None:
    if wrong := [r["shard"] for r in found.select("shard").distinct().orderBy("shard").limit(5).collect()]:
        raise ValueError(f"{said}: shards {wrong}")


def state(spark: SparkSession, records: DataFrame, path: str, contract: str) -> DataFrame:
    """shard, rows, ids_sha256, complete, marked of each shard of the records, after everything under ``path`` has been checked.

    Predictions or marks of another contract, predictions of ids that their shard doesn't have, marks of other shards or ids, and a
    marked shard that isn't whole raise; nothing is written. A shard is complete if it has each of its ids once; one that isn't and has
    no mark was cut off.
    """
    wanted = _digests(records)
    old, marks = _read(spark, path), _read(spark, f"{path.rstrip('/')}/{COMMITS}")
    marks = (spark.createDataFrame([], _MARK) if marks is None else marks).distinct()
    if old is None:
        old = records.limit(0).select("id", "shard", F.lit(contract).alias("evaluation_contract_sha256"))
    other = ~F.col("evaluation_contract_sha256").eqNullSafe(F.lit(contract))
    _raise_if(old.filter(other).select("shard").union(marks.filter(other).select("shard")), "predictions of another contract are there")
    _raise_if(old.select(F.col("id").cast("string").alias("id"), "shard").join(records.select(F.col("id").cast("string").alias("id"), "shard"), ["id", "shard"], "left_anti"), "predictions of other ids are there")
    _raise_if(marks.join(wanted, ["shard", "rows", "ids_sha256"], "left_anti"), "marks of other shards are there")
    found = wanted.join(_digests(old).withColumn("complete", F.lit(True)), ["shard", "rows", "ids_sha256"], "left").join(marks.select("shard", F.lit(True).alias("marked")), "shard", "left").na.fill(False)
    found = materialise(found, "shards")
    _raise_if(found.filter("marked AND NOT complete"), "marked shards that aren't whole are there")
    return found


def _mark(shards: DataFrame, path: str, contract: str) -> None:
    shards.select("shard", "rows", "ids_sha256", F.lit(contract).alias("evaluation_contract_sha256")).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{COMMITS}")


def run(
    spark: SparkSession, records: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, contract: str, order: str = "row_index", *, shards_per_commit: int = SHARDS_PER_COMMIT,
) -> DataFrame:
    """Predictions of all records, in a table partitioned by shard; a run that was cut off goes on where it stopped.

    What is there is checked before anything is written (see ``state``). Complete shards are kept, and get their mark if they lack it.
    The others are predicted, ``shards_per_commit`` in one job: each job stages its rows and replaces the whole partitions of its shards,
    so rows of a cut-off attempt go; then it is checked that each shard has each of its ids once, and the shards are marked with their
    ids' digest. A run with nothing to do writes nothing.
    """
    found = state(spark, records, path, contract)
    if found.filter("complete AND NOT marked").limit(1).count():
        _mark(found.filter("complete AND NOT marked"), path, contract)
    todo = [r["shard"] for r in found.filter("NOT complete").select("shard").orderBy("shard").collect()]  # a number for each shard
    for a in range(0, max(1, len(todo)), shards_per_commit):
        some = todo[a : a + shards_per_commit]
        chosen = F.col("shard").between(some[0], some[-1]) if some else F.lit(False)
        now = materialise(found.filter("NOT complete").filter(chosen).select("shard", "rows", "ids_sha256"), "todo")
        made = predict(records.join(F.broadcast(now.select("shard")), "shard", "left_semi")).withColumn("evaluation_contract_sha256", F.lit(contract))
        if some:
            made.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
            written = _digests(spark.read.parquet(path).filter(chosen))
            _raise_if(now.join(written, ["shard", "rows", "ids_sha256"], "left_anti"), "predictions missing or repeated")
            _mark(now, path, contract)
    return merge(spark.read.parquet(path), records, order)


def merge(predictions: DataFrame, records: DataFrame, order: str = "row_index") -> DataFrame:
    """Predictions with their record's place; a missing or repeated one raises when it is read."""
    keys = records.select("id", F.col(order).alias("__at"))
    joined = keys.join(predictions, "id", "left").withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("id")))
    wrong = F.col("evaluation_contract_sha256").isNull() | (F.col("__n") > 1)
    said = F.concat(F.lit("prediction missing or repeated: "), F.col("id").cast("string"))
    return joined.filter(F.when(wrong, F.raise_error(said).cast("boolean")).otherwise(True)).drop("__n").withColumnRenamed("__at", order)


def metrics(predictions: DataFrame) -> DataFrame:
    return E.required_summary(predictions)


#: The options of the parser's self-check; text, protocol and answer of each case.
SELF_CHECK_OPTIONS = {"A": "alpha", "B": "beta", "C": "maybe", "D": "delta"}
SELF_CHECK = (
    ("Answer: B", "direct", "B"),
    ("b", "direct", "B"),
    ("\\boxed{C}", "direct", "C"),
    ("beta", "direct", "B"),
    ("## Thinking\nA is wrong.\n## Final Response\nAnswer: B", "cot", "B"),
    ("## Thinking\nReason.\n## Final Response\nFinal Answer is D", "cot", "D"),
)


def parser_self_check(spark: SparkSession) -> dict[str, Any]:
    """The answer parser on made-up outputs; another answer than the expected one raises."""
    options = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in SELF_CHECK_OPTIONS.items()))
    cases = spark.createDataFrame(list(SELF_CHECK), "text string, protocol string, expected string")
    parsed = cases.withColumn("answer", answers.parse(F.col("text"), options, F.col("protocol"))["parsed_answer"])
    if wrong := [r.asDict() for r in parsed.filter(~F.col("answer").eqNullSafe(F.col("expected"))).collect()]:
        raise ValueError(f"the parser fails on {wrong}")
    return {"cases": len(SELF_CHECK), "failures": 0, "status": "ok"}


def dry_run(
    spark: SparkSession, settings: config.Evaluation, root: str, datasets: tuple[str, ...], protocols: tuple[str, ...], *, max_samples: int | None = None, tokens: Callable[[Column], Column] = token_count, parser_version: str = "1", prompt_version: str = "1",
) -> dict[str, Any]:
    """What an evaluation would run on, without a model: verified data, lengths of all prompts, the parser's self-check and the contract.

    Every prompt is rendered as the chat that a model would get and measured by ``tokens``; one over the settings' ``max_input_length``
    raises, as does whatever ``prepare.load_verified`` finds wrong with the data.
    """
    limit = settings.max_samples(max_samples)
    keys = {name: settings.datasets[name].manifest_key for name in datasets}
    loaded, report = prepare_plan.load_verified(spark, root, settings.expected_aggregate_sha256, list(keys.values()), prepare_plan.SCHEMAS["mcq"][0], max_samples=limit, manifest=settings.manifest_file)
    inputs = None
    for name, key in keys.items():
        for protocol in protocols:
            turn = F.array(F.struct(F.lit("user").alias("role"), R.render_prompt(F.col("question"), F.col("options"), protocol).alias("content")))
            each = loaded[key].select(F.lit(f"{name}/{protocol}").alias("input"), tokens(R.render_chat(turn, generation_prompt=True)).alias("v"))
            inputs = each if inputs is None else inputs.unionByName(each)
    lengths = {r.pop("input"): r for r in E.assert_input_lengths(E.input_lengths(inputs, "v", settings.inference.max_input_length, ["input"]))}
    parameters = {
        "base_model": settings.model.name_or_path, "base_revision": settings.model.revision, "selected_datasets": list(datasets), "selected_protocols": list(protocols), "max_samples_per_dataset": limit,
        "inference": asdict(settings.inference), "protocols": {p: asdict(settings.protocols[p]) for p in protocols}, "prompt": M.prompt_contract(prompt_version), "parser_version": parser_version,
    }
    return {
        "status": "ok", "profile": settings.profile, "selected_datasets": list(datasets), "selected_protocols": list(protocols), "max_samples_per_dataset": limit, "total_predictions": sum(r["rows"] for r in lengths.values()), "data": report,
        "input_token_audit": lengths, "parser_self_check": parser_self_check(spark), "evaluation_contract": M.contract(parameters, report["datasets"]),
    }
