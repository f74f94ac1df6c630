"""Fingerprints, manifests and contracts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .records import COT_INSTRUCTION, DIRECT_INSTRUCTION

def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def aggregate(files: Mapping[str, Mapping[str, Any]]) -> str:
    """``aggregate_fingerprint`` of the file manifests of one manifest."""
    lines = [f"{name}\0{files[name]['sha256']}\0{files[name]['rows']}\n" for name in sorted(files)]
    return hashlib.sha256("".join(lines).encode()).hexdigest()


def aggregate_fingerprint(files: DataFrame, name: str = "name", sha: str = "sha256", rows: str = "rows") -> DataFrame:
    """sha256 over the files' names, hashes and row counts, sorted by name. A table of files is small."""
    line = F.concat(F.col(name), F.lit("\x00"), F.col(sha), F.lit("\x00"), F.col(rows).cast("string"), F.lit("\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), line.alias("l")))), lambda x: x["l"])
    return files.agg(F.sha2(F.array_join(ordered, ""), 256).alias("fingerprint"))


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-free digest: sums and exclusive or of 64-bit row hashes. Nothing is collected or sorted."""
    h = F.xxhash64(*(columns or df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum"))


WHOLE = 1 << 30  # bytes of a file that are one value; a longer one is read piece by piece
_BOM = b"\xef\xbb\xbf"


def inventory(spark: SparkSession, root: str, *, whole: int = WHOLE) -> DataFrame:
    """path (relative), bytes, sha256 of each file under a folder, in the order of path components.

    Executors hash the files; a file of more than ``whole`` bytes, which no value could hold, streams through one task (see ``_streamed``).
    Empty files have no row, as Spark doesn't list them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "")
    hashed = files.filter(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if large := [r["path"] for r in files.filter(F.col("length") > whole).select("path").collect()]:  # names only
        hashed = hashed.unionByName(_streamed(spark, large))
    return hashed.select(relative.alias("path"), "bytes", "sha256").orderBy(F.split("path", "/"))


def _streamed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes, sha256 of files of any size, each read by one task in the order of its bytes and never held as a whole.

    The reader of text lines gives a file's bytes between line feeds as they are, on every file system that Spark reads; a session of
    its own keeps files from being split. What the reader leaves out (the last line feed, a byte order mark at the start) follows from the file's size.
    """
    side, unsplit = spark.newSession(), str(1 << 61)
    side.conf.set("spark.sql.files.maxPartitionBytes", unsplit)
    side.conf.set("spark.sql.files.openCostInBytes", unsplit)
    lines = side.read.option("lineSep", "\n").text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))

    def digest(batches):
        seen: dict[str, list] = {}  # of each file of the task: its size, what was read, and the hash without and with a mark
        for batch in batches:
            for path, size, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0)):
                line = value.as_py()
                if path not in seen:
                    seen[path] = [size, len(line), hashlib.sha256(line), hashlib.sha256(_BOM + line)]
                    continue
                own = seen[path]
                own[1] += 1 + len(line)
                for h in own[2:]:
                    h.update(b"\n")
                    h.update(line)
        for path, (size, read, plain, marked) in seen.items():
            found = marked if size - read >= len(_BOM) else plain
            found.update(b"\n" * (size - read - len(_BOM) * (found is marked)))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([found.hexdigest()])], names=["path", "bytes", "sha256"])

    made = materialise(lines.mapInArrow(digest, "path string, bytes long, sha256 string"), "hashes")
    return spark.read.schema(made.schema).parquet(*made.inputFiles())


def tree_fingerprint(files: DataFrame) -> str:
    """sha256 over relative path, size and hash of each file of an inventory, in the order of path components; no time is in it.

    Spark sorts the files; the driver takes one part of them at a time.
    """
    digest = hashlib.sha256()
    for r in files.orderBy(F.split("path", "/")).toLocalIterator():
        digest.update(f"{r['path']}\0{r['bytes']}\0{r['sha256']}\n".encode())
    return digest.hexdigest()


def file_manifest(path: str | Path, rows: int, schema: str, sources: list[Mapping[str, Any]], exclusions: list[str]) -> dict[str, Any]:
    path = Path(path)
    return {"path": str(path), "rows": rows, "bytes": path.stat().st_size, "sha256": file_sha256(path), "schema": schema, "sources": list(sources), "exclusions": list(exclusions)}


def verify_manifest(manifest: Mapping[str, Any], rows: int) -> None:
    """Raise unless the file's hash and the row count are those of its manifest."""
    if not Path(manifest["path"]).is_file():
        raise FileNotFoundError(manifest["path"])
    if file_sha256(manifest["path"]) != manifest["sha256"]:
        raise ValueError(f"{manifest['path']}: sha256 differs from the manifest")
    if rows != manifest["rows"]:
        raise ValueError(f"{manifest['path']}: {rows} rows, the manifest has {manifest['rows']}")


def table_manifest(spark: SparkSession, path: str, schema: str, sources: list[Mapping[str, Any]], exclusions: list[str], relative: str) -> dict[str, Any]:
    """Manifest of a folder of JSON lines: rows, bytes and one fingerprint of all its part files, hashed where they are read."""
    files = inventory(spark, path).filter(F.element_at(F.split("path", "/"), -1).startswith("part-"))
    return {"path": relative, "rows": spark.read.text(path).count(), "bytes": files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], "sha256": tree_fingerprint(files), "schema": schema, "sources": list(sources), "exclusions": list(exclusions)}


#: Suffixes of the files that make up an adapter.
ADAPTER_SUFFIXES = (".json", ".safetensors", ".model")


def adapter_sha256(folder: str | Path) -> str:
    """One hash of an adapter's settings and weights: each file's relative path and its hash, in the order of the paths."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file() and p.suffix in ADAPTER_SUFFIXES)
    if not files:
        raise FileNotFoundError(f"{folder} has neither settings nor weights")
    digest = hashlib.sha256()
    for p in files:
        digest.update(p.relative_to(folder).as_posix().encode() + file_sha256(p).encode())
    return digest.hexdigest()


def prompt_contract(version: str) -> dict[str, str]:
    """The prompt texts and their version, as they go into a contract."""
    return {"version": version, "direct_instruction": DIRECT_INSTRUCTION, "cot_instruction": COT_INSTRUCTION}


def json_sha256(value: Any) -> str:
    """sha256 of the sorted JSON of a value."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


#: What a fair comparison has to fix.
FAIRNESS = (
    "base_model", "base_revision", "tokenizer_revision", "dtype", "attn_implementation", "selected_datasets", "selected_protocols", "max_samples_per_dataset", "max_input_length", "shard_size", "seed", "protocols", "prompt", "parser_version",
)


def fair_contract(parameters: Mapping[str, Any], datasets: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """A ``contract`` that has every field of ``FAIRNESS``; missing ones raise."""
    if missing := [f for f in FAIRNESS if f not in parameters]:
        raise ValueError(f"the contract lacks {missing}")
    return contract(parameters, datasets)


def contract(parameters: Mapping[str, Any], datasets: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """What must be equal for two runs to be comparable, with the sha256 of its sorted JSON; machine paths stay out."""
    body = dict(parameters) | {"datasets": {k: {f: v for f, v in d.items() if f != "path"} for k, d in datasets.items()}}
    return body | {"evaluation_contract_sha256": json_sha256(body)}


#: Names of files that hold metrics.
METRIC_FILES = ("metrics.json", "train_results.json", "eval_results.json", "all_results.json")


def metric_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """path and content of the metric files under a folder that are JSON objects; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select("path", F.col("content").cast("string").alias("payload")).filter(F.element_at(F.split("path", "/"), -1).isin(*METRIC_FILES))
    return named.filter(F.trim("payload").startswith("{") & F.try_parse_json("payload").isNotNull())


def latest_checkpoint(names: list[str], prefix: str = "checkpoint-") -> str | None:
    """The name with the largest number after the prefix."""
    numbered = [(int(n.removeprefix(prefix)), n) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]
    return max(numbered)[1] if numbered else None
