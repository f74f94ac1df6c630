"""Settings, resumable runs, reports and metric files."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import manifests as M
from siltstone.operators import reports
from siltstone.plans import evaluation_run as run
from siltstone.sources import config

GOOD = f"""
schema_version: 1
experiment_name: demo
model: {{name_or_path: m, revision: {"a" * 40}}}
data: {{manifest_file: m.json, expected_aggregate_sha256: {"b" * 64}, datasets: {{one: {{manifest_key: k, path: p}}}}}}
inference: {{max_input_length: 10}}
protocols: {{direct: {{max_new_tokens: 1, batch_size: 1}}, cot: {{max_new_tokens: 2, batch_size: 1}}}}
profiles: {{smoke: {{max_samples_per_dataset: 12}}, full: {{}}}}
runtime: {{output_root: out}}
"""


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(GOOD)
    assert config.load(path, "smoke").max_samples() == 12 and config.load(path).max_samples(3) == 3 and config.load(path).max_samples() is None
    for bad, said in ((GOOD.replace("output_root: out", "output_root: out, other: 1"), "runtime"), (GOOD.replace("a" * 40, "abc"), "revision"), (GOOD.replace("max_input_length: 10", "shard_size: 0"), "inference")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=said):
            config.load(path)


def test_run_resumes(spark, tmp_path):
    records = run.prepare(spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("row_index")), shard_size=4)
    path, asked = str(tmp_path / "p"), []

    def predict(df):
        asked.append(sorted(r["id"] for r in df.select("id").collect()))
        return df.select("id", "shard", (F.col("row_index") % 2 == 0).alias("correct"))

    predict(records).filter("shard = 1").withColumn("evaluation_contract_sha256", F.lit("c")).write.partitionBy("shard").parquet(path)
    out = run.run(spark, records, predict, path, "c")
    assert out.count() == 10 and asked[-1] == ["0", "1", "2", "3", "8", "9"]
    assert run.run(spark, records, predict, path, "c").count() == 10 and asked[-1] == []
    with pytest.raises(ValueError, match="contract"):
        run.run(spark, records, predict, path, "other")
    with pytest.raises(ValueError, match="repeated"):
        run.prepare(spark.createDataFrame([("a", 1), ("a", 2)], "id string, row_index long"))


@pytest.fixture
def cut_off(spark, tmp_path):
    """Records in shards of four, a path, and how to write predictions there."""
    records = run.prepare(spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("row_index")), shard_size=4)
    path, asked = str(tmp_path / "p"), []

    def predict(df):
        asked.append(sorted(r["id"] for r in df.select("id").collect()))
        return df.select("id", "shard", (F.col("row_index") % 2 == 0).alias("correct"))

    def leave(ids, contract="c", shard=None):
        rows = records.filter(F.col("id").isin(ids)).select("id", "shard" if shard is None else F.lit(shard).cast("long").alias("shard"), F.lit(False).alias("correct"), F.lit(contract).alias("evaluation_contract_sha256"))
        rows.write.mode("append").partitionBy("shard").parquet(path)

    return records, path, asked, predict, leave


def stored(spark, path):
    return sorted((r["id"], r["correct"]) for r in spark.read.parquet(path).collect())


def files(path):
    return sorted((str(p), p.stat().st_mtime_ns) for p in path.rglob("*") if p.is_file())


def test_partial_shards_are_replaced(spark, tmp_path, cut_off):
    records, path, asked, predict, leave = cut_off
    leave(["4", "5", "6"])  # three of four
    leave(["0", "1", "2", "3"])  # whole, not marked
    leave(["8", "8", "9"])
    leave(["8"])  # more rows than ids
    out = run.run(spark, records, predict, path, "c")
    assert asked[-1] == ["4", "5", "6", "7", "8", "9"]
    whole = [(str(k), k % 2 == 0 and k > 3) for k in range(10)]  # of the kept shard what was there
    assert sorted((r["id"], r["correct"]) for r in out.collect()) == stored(spark, path) == whole
    before = files(tmp_path)
    for _ in range(2):
        assert run.run(spark, records, predict, path, "c").count() == 10 and asked[-1] == []
    assert [f for f in files(tmp_path) if "/p/" in f[0]] == [f for f in before if "/p/" in f[0]]


def test_what_is_there_is_checked_before_anything_is_written(spark, tmp_path, cut_off):
    records, path, asked, predict, leave = cut_off
    leave(["4", "5"], contract="old")  # stale
    before = files(tmp_path)
    with pytest.raises(ValueError, match="another contract.*1"):
        run.run(spark, records, predict, path, "c")
    assert files(tmp_path) == before and not asked
    extra = str(tmp_path / "extra")
    records.filter("id = '3'").select("id", F.lit(7).cast("long").alias("shard"), F.lit(True).alias("correct"), F.lit("c").alias("evaluation_contract_sha256")).write.partitionBy("shard").parquet(extra)
    before = files(tmp_path)
    with pytest.raises(ValueError, match="other ids.*7"):
        run.run(spark, records, predict, extra, "c")
    assert files(tmp_path) == before and not asked


def test_marked_shards_must_stay_as_they_were(spark, tmp_path, cut_off):
    records, path, asked, predict, leave = cut_off
    run.run(spark, records, predict, path, "c")
    leave(["4"])  # a repeated row in a marked shard
    with pytest.raises(ValueError, match="aren't whole.*1"):
        run.run(spark, records, predict, path, "c")
    fewer = run.prepare(records.filter("row_index < 9").drop("shard"), shard_size=4)
    with pytest.raises(ValueError, match="other ids"):
        run.run(spark, fewer, predict, path, "c")


def test_a_failed_job_keeps_what_was_marked(spark, cut_off):
    records, path, asked, predict, leave = cut_off

    def fails(df):
        made = predict(df)
        return made.withColumn("correct", F.when(F.col("shard") == 1, F.raise_error(F.lit("out of memory")).cast("boolean")).otherwise(F.col("correct")))

    with pytest.raises(Exception, match="out of memory"):
        run.run(spark, records, fails, path, "c", shards_per_commit=1)
    assert [len(x) for x in asked] == [4, 4]
    assert run.run(spark, records, predict, path, "c", shards_per_commit=1).count() == 10
    assert asked[2:] == [["4", "5", "6", "7"], ["8", "9"]]
    with pytest.raises(ValueError, match="missing or repeated"):
        run.run(spark, records, lambda df: predict(df).filter("id <> '2'"), path + "2", "c")


def test_reports_and_metric_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1000, 0.5), ("b", None, None)], "stage string, rows long, share double")
    text = reports.contamination(df, {"one": df}, {"review": 0.82})
    assert "| a | 1,000 | 0.5 |" in text and "| b | – | – |" in text
    (tmp_path / "metrics.json").write_text('{"x": 1}')
    (tmp_path / "eval_results.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    assert [r["payload"] for r in M.metric_snapshots(spark, str(tmp_path)).collect()] == ['{"x": 1}']
    assert M.latest_checkpoint(["checkpoint-9", "checkpoint-10", "x", "checkpoint-a"]) == "checkpoint-10" and M.latest_checkpoint([]) is None


def test_files_that_stream_have_the_hash_of_the_whole(spark, tmp_path):
    import hashlib
    import os
    import random

    rng = random.Random(4)
    contents = {
        "a.bin": rng.randbytes(300_000), "b/crlf.txt": b"one\r\ntwo\r\n\r\n", "b/mark.txt": b"\xef\xbb\xbfmark\n", "b/mark2": b"\xef\xbb\xbfno end", "c": b"\n\n\n", "d": b"no line feed", "e": b"\n", "f": b"x\n\xef\xbb\xbf\n", "b.txt": b"\xff\xfe\n\x00",
    }
    for name, content in contents.items():
        os.makedirs((tmp_path / "t" / name).parent, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(content)
    expected = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for whole in (0, 100, M.WHOLE):
        found = M.inventory(spark, f"file://{tmp_path}/t", whole=whole)
        rows = [(r["path"], (r["bytes"], r["sha256"])) for r in found.collect()]
        assert dict(rows) == expected and [n for n, _ in rows] == sorted(expected, key=lambda n: n.split("/"))
    lines = "".join(f"{n}\0{expected[n][0]}\0{expected[n][1]}\n" for n in sorted(expected, key=lambda n: n.split("/")))
    assert M.tree_fingerprint(found) == hashlib.sha256(lines.encode()).hexdigest()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
