"""Prepare a corpus: curate two pools against the evaluation sets and write every file, manifest and report under one root."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import manifests as M
from ..operators import quality as Q
from ..operators import records as R
from ..operators import reports
from ..sources.registry import Source
from ..sources.tables import get_text, put_text, write_jsonl
from .curation import Thresholds, curate

MANIFEST = "manifests/manifest.json"
EXCLUDED = "manifests/excluded_ids.jsonl"
CANDIDATES = "reports/contamination_candidates.jsonl"
CONTAMINATION = "reports/contamination_report"
QUALITY = "reports/data_quality_report"


def prepare(spark: SparkSession, sft: DataFrame, rl: DataFrame, evaluation: Mapping[str, DataFrame], root: str, t: Thresholds = Thresholds(), *, sources: Mapping[str, Source] | None = None, quality: bool = True) -> dict[str, Any]:
    """The manifest, after writing all of it.

    ``sft``, ``rl`` and ``evaluation`` hold normalized records; a record that is invalid raises before anything is written. Files are
    folders of JSON lines that Spark writes; reports and manifests are single files on the same file system. Evaluation sets stay
    whole. A record of a repeated id is written once. ``sources``: for each file's name before its split, where its rows come from.
    """
    for family, df in (("sft", sft), ("rl", rl), *(("mcq", df) for df in evaluation.values())):
        R.strict(Q.FAMILIES[family][0](df), family).write.format("noop").mode("overwrite").save()
    protected = None
    for name, df in evaluation.items():
        asked = F.get_json_object("meta", "$.question_only") if "meta" in df.columns else F.lit(None).cast("string")
        rows = A.records(df.withColumn("text", F.coalesce(asked, F.col("question"))), "id", "text", F.lit(name))
        protected = rows if protected is None else protected.unionByName(rows)
    pools = [A.records(df, "id", text, "source") for df, text in ((sft, "question"), (rl, "prompt"))]
    c = curate(*pools, protected, t)
    outputs: dict[str, tuple[DataFrame, str, list[str]]] = {}
    for name, df, placed, audits in (("sft", sft, c.first, ["first_vs_protected"]), ("rl", rl, c.second, ["second_vs_first", "second_vs_protected"])):
        kept = df.drop("split").dropDuplicates(["id"]).join(placed.select("id", "split"), "id").select(*df.columns)
        for part in ("train", "dev"):
            outputs[f"{name}_{part}"] = kept.filter(F.col("split") == part), name, audits
    outputs |= {name: (df, "mcq", []) for name, df in evaluation.items()}
    origin = {n: [s.describe()] for n, s in (sources or {}).items()}
    files = {}
    for name, (df, family, audits) in outputs.items():
        write_jsonl(df, f"{root}/processed/{name}.jsonl")
        files[name] = M.table_manifest(spark, f"{root}/processed/{name}.jsonl", family, origin.get(name.rpartition("_")[0], origin.get(name, [])), audits, f"processed/{name}.jsonl")
    candidates = write_jsonl(c.candidates(), f"{root}/{CANDIDATES}")
    write_jsonl(c.ledger(), f"{root}/{EXCLUDED}")
    funnel = c.funnel()
    counted = c.summaries
    summaries = {name: spark.createDataFrame([Row(**row)]) for name, row in counted.items()}
    stages = {r["stage"]: r["rows"] for r in funnel.collect()}
    now = datetime.now(UTC).isoformat()
    contamination = {
        "schema_version": 1, "generated_at": now, "config": {"review": t.review, "exclude": t.exclude, "dev_ratio": t.dev_ratio, "seed": t.seed}, "candidate_file": CANDIDATES, "candidate_rows": candidates, "rows": stages,
        "audits": [{"name": n, "unresolved_review_count": s["review"]} | s for n, s in counted.items()],
    }
    put_text(spark, f"{root}/{CONTAMINATION}.json", _json(contamination))
    put_text(spark, f"{root}/{CONTAMINATION}.md", reports.contamination(funnel, summaries, {"review": t.review, "exclude": t.exclude}))
    if quality:
        schema = {name: df.schema for name, (df, _, _) in outputs.items()}
        found = Q.report({n: (spark.read.schema(schema[n]).json(f"{root}/processed/{n}.jsonl"), family) for n, (_, family, _) in outputs.items()}, t.seed) | {"generated_at": now}
        put_text(spark, f"{root}/{QUALITY}.json", _json(found))
        put_text(spark, f"{root}/{QUALITY}.md", reports.quality_markdown(found))
    manifest = {
        "schema_version": 1, "created_at": now, "seed": t.seed, "source_revisions": {n: s.revision for n, s in (sources or {}).items()},
        "datasets": {name: {"rows_before": stages[f"{pool}_raw"], "rows_after": stages[f"{pool}_clean"], "splits": {p: files[f"{name}_{p}"]["rows"] for p in ("train", "dev")}} for name, pool in (("sft", "first"), ("rl", "second"))}
        | {"evaluation": {"splits": {n: files[n]["rows"] for n in evaluation}}},
        "files": files, "aggregate_sha256": M.aggregate(files), "excluded_ids_file": EXCLUDED, "contamination_report": f"{CONTAMINATION}.json", "data_quality_report": f"{QUALITY}.json" if quality else None,
    }
    put_text(spark, f"{root}/{MANIFEST}", _json(manifest))
    return manifest


def _json(content: Mapping[str, Any]) -> str:
    return json.dumps(content, ensure_ascii=False, indent=2) + "\n"


def load_verified(spark: SparkSession, root: str, expected: str, names: list[str], schema, *, max_samples: int | None = None, order: str = "id", manifest: str = MANIFEST) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Evaluation sets that are what their manifest says, and the report of what was checked.

    Raises on another aggregate hash, a file that the manifest lacks or has elsewhere, another file hash or row count, a record
    that isn't canonical, an empty set and repeated ids. The first ``max_samples`` rows by ``order`` are taken; None: all.
    """
    stated = json.loads(get_text(spark, f"{root}/{manifest}"))
    if stated["aggregate_sha256"] != expected or M.aggregate(stated["files"]) != expected:
        raise ValueError(f"aggregate sha256 {stated['aggregate_sha256']} is not {expected}")
    loaded, checked = {}, {}
    for name in names:
        if name not in stated["files"]:
            raise ValueError(f"the manifest has no {name}")
        found = _same_file(spark, root, name, stated["files"][name])
        rows = R.normalize_mcq(spark.read.schema(schema).json(f"{root}/{found['path']}"))
        rows = R.strict(R.validate_mcq(rows), "mcq")
        rows = rows.orderBy(order).limit(max_samples) if max_samples is not None else rows
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.struct(order, "id")).alias("a"), F.max(F.struct(order, "id")).alias("z")).first()
        if not facts["n"]:
            raise ValueError(f"{name} has no records")
        if facts["n"] != facts["ids"]:
            raise ValueError(f"{name} has repeated ids")
        loaded[name] = rows
        checked[name] = {"path": f"{root}/{found['path']}", "file_sha256": found["sha256"], "full_rows": found["rows"], "selected_rows": facts["n"], "first_id": facts["a"]["id"], "last_id": facts["z"]["id"]}
    return loaded, {"manifest_path": f"{root}/{manifest}", "aggregate_sha256": expected, "max_samples_per_dataset": max_samples, "datasets": checked}


def _same_file(spark: SparkSession, root: str, name: str, stated: Mapping[str, Any]) -> dict[str, Any]:
    made = M.table_manifest(spark, f"{root}/{stated['path']}", stated["schema"], [], [], stated["path"])
    for what in ("sha256", "rows"):
        if made[what] != stated[what]:
            raise ValueError(f"{name}: {what} {made[what]} is not that of the manifest, {stated[what]}")
    return made


#: For each family: the columns of its written records, and what makes them canonical.
SCHEMAS = {
    "sft": ("id string, source string, question string, reasoning string, response string, messages array<struct<role:string,content:string>>, split string, meta string", R.normalize_sft),
    "rl": ("id string, source string, prompt string, ground_truth_answer string, split string, meta string", R.normalize_rl),
    "mcq": ("id string, source string, question string, options array<struct<key:string,value:string>>, answer string, split string, answer_text string, explanation string, meta string", R.normalize_mcq),
}


def round_trips(spark: SparkSession, root: str, stated: Mapping[str, Any]) -> dict[str, int]:
    """Records of each file, each of which its family's normalization leaves as it is; a training conversation also has one user and one
    assistant turn with both headings. Others raise with their ids. Only ids and 64-bit hashes of records are shuffled."""
    rows = {}
    for name, f in stated["files"].items():
        schema, normalize = SCHEMAS[f["schema"]]
        written = spark.read.schema(schema).json(f"{root}/{f['path']}")
        hashed = lambda df: df.select("id", F.xxhash64(*written.columns).alias("h"))  # noqa: B023, E731
        changed = hashed(written).exceptAll(hashed(normalize(written))).select("id")
        if f["schema"] == "sft":
            changed = changed.unionByName(R.prompt_completion(written).filter("problem is not null").select("id"))
        if ids := [r["id"] for r in changed.limit(5).collect()]:
            raise ValueError(f"{name}: records that aren't canonical: {ids}")
        rows[name] = f["rows"]
    return rows


def check(spark: SparkSession, root: str, manifest: str = MANIFEST) -> dict[str, Any]:
    """Raise unless every file is that of the manifest, every record is canonical, none is invalid, no training prompt repeated and no
    review open."""
    stated = json.loads(get_text(spark, f"{root}/{manifest}"))
    rows = {name: _same_file(spark, root, name, f)["rows"] for name, f in stated["files"].items()}
    totals = json.loads(get_text(spark, f"{root}/{stated['data_quality_report']}"))["summary"]
    audits = json.loads(get_text(spark, f"{root}/{stated['contamination_report']}"))["audits"]
    gates = {"schema_invalid_rows": totals["schema_invalid_rows"], "training_duplicate_normalized_prompts": totals["training_duplicate_normalized_prompts"], "unresolved_contamination_candidates": sum(a["unresolved_review_count"] for a in audits)}
    if failed := {k: v for k, v in gates.items() if v}:
        raise ValueError(f"gates that fail: {failed}")
    round_trips(spark, root, stated)
    return {"aggregate_sha256": stated["aggregate_sha256"], "checked_files": rows, "status": "ok"} | gates
