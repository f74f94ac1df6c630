"""Preparing a corpus on disk, its gates, verified loading, and the reports."""

import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import curation as C
from siltstone.operators import evaluation as E
from siltstone.operators import manifests as M
from siltstone.operators import quality as Q
from siltstone.operators import records as R
from siltstone.plans import prepare as P
from siltstone.sources import registry, tables


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def corpus(spark):
    mcq = [(f"m{i}", "exam", f"{words(500 + i, 14)}?", [("A", "yes"), ("B", "no")], "A", "test", "{}") for i in range(6)]
    evaluation = R.normalize_mcq(spark.createDataFrame(mcq, "id string, source string, question string, options array<struct<key:string,value:string>>, answer string, split string, meta string"))
    sft = [(f"s{i:03}", "src", words(i, 14), "because", "so", "train") for i in range(40)] + [("s900", "src", words(3, 14).upper(), "again", "so", "train"), ("s901", "src", mcq[2][2], "leak", "so", "train"), ("s000", "src", words(0, 14), "because", "so", "train")]
    rl = [(f"r{i:03}", "src", words(100 + i, 14), "yes", "train") for i in range(30)] + [("r900", "src", words(7, 14), "yes", "train"), ("r901", "src", mcq[4][2] + "!", "yes", "train")]
    made = R.normalize_sft(spark.createDataFrame(sft, "id string, source string, question string, reasoning string, response string, split string").withColumn("messages", F.lit(None).cast("array<struct<role:string,content:string>>")))
    return made, R.normalize_rl(spark.createDataFrame(rl, "id string, source string, prompt string, ground_truth_answer string, split string")), {"exam": evaluation}


def test_prepare_writes_everything_and_its_gates_hold(spark, tmp_path):
    sft, rl, evaluation = corpus(spark)
    root = f"file://{tmp_path}/out"
    manifest = P.prepare(spark, sft, rl, evaluation, root, sources={"sft": registry.SOURCES["huatuo_sft_en"]})
    rows = {n: f["rows"] for n, f in manifest["files"].items()}
    assert rows == {"sft_train": 39, "sft_dev": 1, "rl_train": 29, "rl_dev": 1, "exam": 6}
    assert manifest["files"]["sft_train"]["sources"][0]["revision"] == registry.SOURCES["huatuo_sft_en"].revision
    ids = {r["id"] for n in ("sft_train", "sft_dev") for r in spark.read.json(f"{root}/processed/{n}.jsonl").collect()}
    assert ids == {f"s{i:03}" for i in range(40)}
    lost = {(r["id"], r["decision"]) for r in spark.read.json(f"{root}/{P.EXCLUDED}").collect()}
    assert lost == {("s900", "exclude_duplicate_normalized_prompt"), ("s000", "exclude_duplicate_normalized_prompt"), ("s901", "exclude_exact"), ("r900", "exclude_exact"), ("r901", "exclude_exact")}
    report = json.loads(tables.get_text(spark, f"{root}/{P.QUALITY}.json"))
    assert report["summary"]["total_rows"] == 76 and report["summary"]["schema_invalid_rows"] == 0 and len(report["datasets"]["exam"]["sampled_ids"]) == 6
    assert report["datasets"]["sft_train"]["lengths"]["question"]["tokens"] == {"min": 14, "mean": 14.0, "p50": 14, "p95": 14, "p99": 14, "max": 14}
    contamination = json.loads(tables.get_text(spark, f"{root}/{P.CONTAMINATION}.json"))
    assert contamination["rows"] == {"first_raw": 43, "first_dedup": 41, "first_clean": 40, "second_raw": 32, "second_dedup": 32, "second_without_first": 31, "second_clean": 30}
    assert "# Contamination audit" in tables.get_text(spark, f"{root}/{P.CONTAMINATION}.md") and "| exam | 6 |" in tables.get_text(spark, f"{root}/{P.QUALITY}.md")
    assert P.check(spark, root)["status"] == "ok"
    loaded, said = P.load_verified(spark, root, manifest["aggregate_sha256"], ["exam"], evaluation["exam"].schema, max_samples=4)
    assert loaded["exam"].count() == said["datasets"]["exam"]["selected_rows"] == 4 and said["datasets"]["exam"]["full_rows"] == 6 and said["datasets"]["exam"]["first_id"] == "m0"
    for more in ({"expected": "0" * 64}, {"names": ["other"]}):
        with pytest.raises(ValueError):
            P.load_verified(spark, root, **({"expected": manifest["aggregate_sha256"], "names": ["exam"], "schema": evaluation["exam"].schema} | more))
    part = next((tmp_path / "out" / "processed" / "exam.jsonl").glob("part-*"))
    part.write_text(part.read_text().replace("yes", "YES", 1))
    for crc in part.parent.glob(".part-*"):
        crc.unlink()
    with pytest.raises(ValueError, match="sha256"):
        P.load_verified(spark, root, manifest["aggregate_sha256"], ["exam"], evaluation["exam"].schema)
    with pytest.raises(ValueError, match="exam"):
        P.check(spark, root)


def test_written_records_are_canonical_and_an_evaluation_can_start(spark, tmp_path):
    from siltstone.plans import evaluation_run
    from siltstone.sources import config

    sft, rl, evaluation = corpus(spark)
    root = f"file://{tmp_path}/out"
    manifest = P.prepare(spark, sft, rl, evaluation, root, quality=False)
    assert P.round_trips(spark, root, manifest) == {n: f["rows"] for n, f in manifest["files"].items()}
    settings = f"""
schema_version: 1
experiment_name: demo
model: {{name_or_path: m, revision: {"a" * 40}}}
data: {{manifest_file: {P.MANIFEST}, expected_aggregate_sha256: {manifest["aggregate_sha256"]}, datasets: {{exam_set: {{manifest_key: exam, path: processed/exam.jsonl}}}}}}
inference: {{max_input_length: 400}}
protocols: {{direct: {{max_new_tokens: 1, batch_size: 1}}, cot: {{max_new_tokens: 2, batch_size: 1}}}}
profiles: {{full: {{}}, smoke: {{max_samples_per_dataset: 4}}}}
runtime: {{output_root: out}}
"""
    (tmp_path / "c.yaml").write_text(settings)
    said = evaluation_run.dry_run(spark, config.load(tmp_path / "c.yaml", "smoke"), root, ("exam_set",), ("direct", "cot"))
    assert said["total_predictions"] == 8 and said["parser_self_check"]["failures"] == 0 and said["input_token_audit"]["exam_set/direct"]["rows"] == 4
    assert said["input_token_audit"]["exam_set/direct"]["max"] < said["input_token_audit"]["exam_set/cot"]["max"]
    again = evaluation_run.dry_run(spark, config.load(tmp_path / "c.yaml", "smoke"), root, ("exam_set",), ("direct", "cot"))
    assert again["evaluation_contract"] == said["evaluation_contract"] and len(said["evaluation_contract"]["evaluation_contract_sha256"]) == 64
    (tmp_path / "c.yaml").write_text(settings.replace("400", "10"))
    with pytest.raises(ValueError, match="over the limit"):
        evaluation_run.dry_run(spark, config.load(tmp_path / "c.yaml"), root, ("exam_set",), ("direct",))
    part = next((tmp_path / "out" / "processed" / "rl_dev.jsonl").glob("part-*"))
    part.write_text(part.read_text().replace('"yes"', '" yes "', 1))
    for crc in part.parent.glob(".part-*"):
        crc.unlink()
    with pytest.raises(ValueError, match="rl_dev.*aren't canonical"):
        P.round_trips(spark, root, manifest)


def test_full_width_answers(spark):
    from siltstone.functions import answers

    options = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "Ｂeta 2"), ("B", "caf\u00e9"), ("C", "gamma"))))
    cases = [("ｙｅｓ", "A", "pubmed_semantic"), ("BETA  ２.", "A", "exact_option_text"), ("cafe\u0301", "B", "exact_option_text"), ("## Final Response ｇamma", "C", "exact_option_text"), ("beta 3", None, None), (None, None, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    got = [tuple(r["r"])[:2] for r in df.select(answers.parse(F.col("t"), options, F.lit("direct")).alias("r")).collect()]
    assert got == [(a, m) for _, a, m in cases]
    plain = df.select(answers.parse(F.col("t"), options, F.lit("direct"), compatibility=False)["parsed_answer"].alias("a"))
    assert {r["a"] for r in plain.collect()} == {None} and "ArrowEvalPython" not in plain._jdf.queryExecution().toString()


def test_converters_quarantine_and_provenance(spark):
    """Records from raw columns: what is in them, and what is set aside with its errors."""
    raw = spark.createDataFrame([(1, "Why?", "because", "so"), (2, "What?", "as", "it is")], "row_index long, Question string, Complex_CoT string, Response string")
    made = R.from_sft_source(raw, prefix="sft", source="src", dataset="d", revision=None).orderBy("id").collect()
    assert [r["id"] for r in made] == ["sft_000001", "sft_000002"] and made[0]["messages"][0]["content"] == "Why?" and json.loads(made[0]["meta"]) == {"dataset": "d", "row_index": 1}
    rl = spark.createDataFrame([(7, "Q", "A")], ["row_index", "Open-ended Verifiable Question", "Ground-True Answer"])
    assert tuple(R.from_rl_source(rl, prefix="rl", source="src").select("id", "prompt", "ground_truth_answer", "split").first()) == ("rl_000007", "Q", "A", "train")
    given = spark.createDataFrame([(1, None, "Q", [("A", "x"), ("B", "y")], "B", None), (2, "own", "Q", [("A", "x"), ("B", "y")], "A", "x")], "row_index long, id string, question string, options array<struct<key:string,value:string>>, answer_idx string, answer string")
    assert [(r["id"], r["answer"], r["answer_text"]) for r in R.from_indexed_answers(given, prefix="m", source="s").orderBy("answer").collect()] == [("own", "A", "x"), ("m_000001", "B", "y")]
    checked = R.validate_rl(R.normalize_rl(spark.createDataFrame([("1", "s", "p", "g", "train"), ("2", "s", " ", "g", "train")], "id string, source string, prompt string, ground_truth_answer string, split string")))
    kept, aside = R.quarantine(checked)
    assert [r["id"] for r in kept.collect()] == ["1"] and [(r["id"], r["errors"]) for r in aside.collect()] == [("2", ["prompt must be a non-empty string"])]
    assert "errors" not in kept.columns
    optional = spark.createDataFrame([(" x ",), (None,), ("",)], "t string").select(R.optional(F.col("t")).alias("t"))
    assert [r["t"] for r in optional.collect()] == ["x", None, ""]


def test_means_tie_to_even(spark):
    values = spark.createDataFrame([("a", 0), ("a", 1), ("a", 0), ("a", 0), ("a", 0), ("a", 0), ("a", 0), ("a", 0), ("b", 3), ("b", 0), ("b", 0), ("b", 0), ("b", 0), ("b", 0), ("b", 0), ("b", 0)], "g string, v long")
    assert {r["g"]: r["mean"] for r in E.length_summary(values, "v", ["g"]).collect()} == {"a": 0.12, "b": 0.38}  # 0.125 and 0.375


def test_invalid_records_stop_before_anything_is_written(spark, tmp_path):
    sft, rl, evaluation = corpus(spark)
    bad = rl.withColumn("prompt", F.when(F.col("id") == "r003", "").otherwise(F.col("prompt")))
    with pytest.raises(Exception, match="prompt"):
        P.prepare(spark, sft, bad, evaluation, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_quality_report_counts_what_is_wrong(spark):
    _, rl, _ = corpus(spark)
    bad = rl.withColumn("ground_truth_answer", F.when(F.col("id") < "r025", "").otherwise(F.lit("x"))).unionByName(rl.filter("id = 'r001'"))
    found = Q.report({"rl_train": (bad, "rl")})
    schema = found["datasets"]["rl_train"]["schema"]
    assert (schema["rows"], schema["invalid_rows"], len(schema["first_errors"])) == (33, 25, 20) and schema["first_errors"][0]["id"] == "r000"
    assert found["summary"]["training_duplicate_normalized_prompts"] == 1 and found["summary"]["official_evaluation_duplicate_normalized_prompts"] == 0
    assert Q.report({"rl_train": (rl.limit(0), "rl")})["datasets"]["rl_train"]["lengths"]["prompt"]["tokens"]["max"] == 0


def test_sources_are_pinned(spark, tmp_path):
    with pytest.raises(ValueError, match="commit"):
        registry.Source("a", "x/y", "main", None, "train")
    source = registry.Source("a", "x/y", "a" * 40, None, "train")
    spark.range(5).withColumnRenamed("id", "row_index").write.parquet(source.path(f"file://{tmp_path}"))
    assert registry.load(spark, source, f"file://{tmp_path}").count() == 5 and [r[0] for r in registry.load(spark, source, f"file://{tmp_path}", 2).orderBy("row_index").collect()] == [0, 1]


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A B"), (3, None), (4, None), (5, "z")], "id long, text string")
    assert sorted(tuple(r) for r in C.retained(df).collect()) == [(1, "a b"), (3, None), (5, "z")]
    assert sorted((r["id"], r["reference_id"]) for r in C.lineage(df, "x").collect()) == [(1, 1), (2, 1), (4, 3)]
    assert C.duplicate_count(df).first()[0] == 3 and C.retained(df.limit(0)).count() == 0


def test_split_boundary_is_found_by_prefixes(spark):
    df = spark.range(3000)
    a = {r["id"] for r in C.split(df, ratio=0.1, most=5).filter("split = 'dev'").collect()}
    b = {r["id"] for r in C.split(df, ratio=0.1).filter("split = 'dev'").collect()}
    assert len(a) == 300 and a == b


def test_shards_of_groups(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", None, "b") for i in range(10)], "g string, i int")
    rows = C.shard(df, "i", 4, ["g"]).collect()
    assert all(r["shard"] == r["i"] // 4 for r in rows) and len(rows) == 30
    assert all(r["shard"] == r["i"] // 4 for r in C.shard(df.filter("g = 'a'"), "i", 4).collect())


def test_lines_are_numbered_over_parts_of_a_file(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text("".join(f'{{"n": {i}}}\n' + "\n" * (i % 3) for i in range(3000)))
    (tmp_path / "b.jsonl").write_text('{"n": 0}\n')
    schema = T.StructType([T.StructField("n", T.LongType())])
    places, at = {}, 0
    for i in range(3000):
        places[i], at = at + 1, at + 1 + i % 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = tables.read_jsonl(spark, f"file://{tmp_path}", schema).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["n"]: r["line"] for r in rows if r["path"].endswith("a.jsonl")} == places and len(rows) == 3001
    with pytest.raises(ValueError, match="3 are needed"):
        tables.head(spark, f"file://{tmp_path}/b.jsonl", schema, 3)
    assert tables.read_lenient(spark, f"file://{tmp_path}/b.jsonl", schema).count() == 1


def test_mcnemar_columns_are_the_scalar_test(spark):
    from siltstone.functions import statistics as S

    pairs = [(0, 0), (3, 17), (17, 3), (5, 5), (1, 0), (400, 460), (30_000, 31_000)]
    rows = spark.createDataFrame(pairs, "b long, c long").select("b", "c", S.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    assert all(abs(r["p"] - S.mcnemar(r["b"], r["c"])) < 1e-7 for r in rows)


def test_mcnemar_of_any_size(spark):
    from siltstone.functions import statistics as S

    rng = random.Random(7)
    exact = lambda b, c: min(1.0, float(Fraction(2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)), 2 ** (b + c)))) if b + c else 1.0
    pairs = [(b, c) for b in range(22) for c in range(22)] + [(rng.randint(0, 600), rng.randint(0, 600)) for _ in range(60)] + [(4900, 5100), (4700, 5300), (0, 900), (1, 2000)]
    rows = spark.createDataFrame(pairs, "b long, c long").select("b", "c", S.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        assert math.isclose(r["p"], exact(r["b"], r["c"]), rel_tol=1e-11), r
    big = spark.createDataFrame([(500_000_000, 500_000_000), (499_980_000, 500_020_000), (400_000_000, 600_000_000)], "b long, c long").select(S.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    normal = math.erfc((40_000 - 1) / math.sqrt(2e9))  # with the continuity correction
    assert big[0]["p"] == 1.0 and math.isclose(big[1]["p"], normal, rel_tol=1e-6) and big[2]["p"] == 0.0


def test_difference_quantiles_are_those_of_the_whole_distribution(spark):
    from siltstone.functions import statistics as S

    for n, up, down in ((1, 1, 0), (1, 0, 0), (10, 3, 2), (5, 5, 0), (50, 10, 10), (333, 100, 60), (2500, 20, 3), (40, 0, 0), (7, 0, 7)):
        chance, draw = np.array([1.0]), np.array([down / n, 1 - (up + down) / n, up / n])
        for _ in range(n):
            chance = np.convolve(chance, draw)
        upto = np.cumsum(chance)
        assert S.difference_quantiles(n, up, down) == [int(np.searchsorted(upto, p - 1e-12)) - n for p in (0.025, 0.975)]
    low, high = S.difference_quantiles(10**9, 300_000_000, 299_990_000)
    assert abs(low - (10_000 - 1.959964 * math.sqrt(6e8))) < 30 and abs(high - (10_000 + 1.959964 * math.sqrt(6e8))) < 30
    outcomes = spark.createDataFrame([("a", 333, 100, 60), ("b", 50, 0, 0)], "g string, rows long, candidate_only_correct long, baseline_only_correct long")
    found = {r["g"]: (r["delta_low"], r["delta_high"]) for r in E.exact_interval(outcomes, ["g"]).collect()}
    assert found == {"a": (16 / 333, 64 / 333), "b": (0.0, 0.0)}
    drawn = {r["g"]: (r["delta_low"], r["delta_high"]) for r in E.bootstrap_interval(outcomes, ["g"]).collect()}
    assert all(abs(drawn["a"][k] - v / 333) < 1.001 / 333 for k, v in enumerate((16, 64)))


def test_ranks_of_groups_that_no_task_holds(spark):
    from siltstone.functions import statistics as S

    rng = random.Random(1)
    rows = [(g, rng.choice([rng.random() * 1e9, rng.random() * 1e-9, float(rng.randint(0, 5)), None])) for g in ("a", "b", None) for _ in range(700)] + [("one", 4.0), ("none", None)]
    df, points = spark.createDataFrame(rows, "g string, v double"), {"least": 0.0, "p50": 0.5, "p95": 0.95, "most": 1.0}
    for by in (["g"], []):
        for half_even in (False, True):
            whole = sorted(map(str, S.rank_percentiles(df, "v", points, by, half_even=half_even).collect()))
            assert whole == sorted(map(str, S.rank_percentiles(df, "v", points, by, half_even=half_even, together=60).collect()))
    a = sorted(((v is not None, v) for g, v in rows if g == "a"), key=lambda x: (x[0], x[1] or 0))
    got = next(r for r in S.rank_percentiles(df, "v", points, ["g"], together=60).collect() if r["g"] == "a")
    assert got["p95"] == a[math.ceil(699 * 0.95)][1]


def test_places_of_aligned_rows(spark):
    schema = "dataset string, protocol string, id string, at long, correct boolean"
    base = spark.createDataFrame([("d", "p", str(k), k, True) for k in range(6)] + [("e", "p", "0", 3, True)], schema)
    moved = base.withColumn("at", F.when(F.col("id") == "2", 9).otherwise(F.col("at")))
    assert E.aligned(base, base.withColumn("at", F.col("at") * 7), order="at").count() == 7
    with pytest.raises(Exception, match="ids differ"):
        E.aligned(base, moved, order="at").collect()
    with pytest.raises(ValueError, match="different groups"):
        E.compare(base, base.filter("dataset = 'd'"))


def test_few_files_are_dealt_out(spark, tmp_path):
    where = f"{tmp_path}/a b%20c"
    spark.range(400).coalesce(1).write.parquet(where)
    one = spark.read.parquet(where)
    many = tables.dealt(one)
    sizes = [r["n"] for r in many.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 400
    assert tables.dealt(one, most_bytes=1) is one
    spark.range(400).repartition(9).write.parquet(f"{tmp_path}/nine")
    nine = spark.read.parquet(f"{tmp_path}/nine")
    assert tables.dealt(nine) is nine and tables.dealt(spark.range(3)).count() == 3


def test_rows_are_counted_by_the_write(spark, tmp_path):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("counting"))
    df = spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") % 3)
    spark.sparkContext.setJobGroup("counting", "")
    try:
        assert tables.write_jsonl(df, f"{tmp_path}/j") == 1000 and jobs() == 1
        out, seen = tables.counted(df, "c", odd=F.count_if("x = 1"), most=F.max("id"))
        assert seen == {"rows": 1000, "odd": 333, "most": 999} and jobs() == 2
        assert tables.write_jsonl(df.filter("id < 0"), f"{tmp_path}/none") == 0
        assert tables.write_jsonl(spark.createDataFrame([], "a int"), f"{tmp_path}/empty") == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 1000


def test_retained_rows(spark):
    schema = "id long, text string, key string, order long, kept string"
    rows = [(3, "One two", "a", 1, "x"), (2, "one TWO!", "b", 2, "x"), (5, "other", "c", 0, "x"), (5, "other", "c", 0, "x"), (7, "single", "d", 0, "x"), (None, "none", "e", 0, "x"), (None, None, "f", 0, "x"), (9, "", "g", 0, "x"), (8, "?", "h", 0, "x")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in C.retained(df).select("key").collect())
    got = ["e" if k == "f" else k for (k,) in got]  # rows of the same text and id
    assert got == ["b", "c", "d", "e", "h"] and C.retained(df).columns == df.columns  # a null text is the word None
    assert sorted(r["key"].replace("f", "e") for r in C.retained(df, order_col="order").collect()) == ["a", "c", "d", "e", "h"]
    assert C.retained(df.limit(0)).count() == 0


def test_bootstrap_interval_holds_the_difference(spark):
    o = spark.createDataFrame([("d", "p", 1000, 300, 200), ("e", "p", 10, 0, 0)], "dataset string, protocol string, rows long, candidate_only_correct long, baseline_only_correct long")
    got = {r["dataset"]: (r["delta_low"], r["delta_high"]) for r in E.bootstrap_interval(o).collect()}
    deviation = ((0.5 - 0.1**2) / 1000) ** 0.5
    assert abs(got["d"][0] - (0.1 - 1.96 * deviation)) < 0.005 and abs(got["d"][1] - (0.1 + 1.96 * deviation)) < 0.005 and got["e"] == (0.0, 0.0)


def test_token_boundaries(spark):
    df = spark.createDataFrame([("a", [1, 2], [1, 2, 3]), ("b", [1, 9], [1, 2, 3]), ("c", [1], [1]), ("d", [1], [1] * 9)], "id string, p array<int>, f array<int>")
    row = E.token_boundaries(df, "p", "f", 8).first()
    assert (row["rows"], row["truncated_rows"], row["empty_completion_rows"], row["prefix_mismatch_rows"], row["min_supervised_tokens"], row["max_supervised_tokens"]) == (4, 1, 1, 1, 0, 8)
    with pytest.raises(ValueError, match="truncated_rows"):
        E.assert_boundaries(E.token_boundaries(df, "p", "f", 8))
    assert E.assert_boundaries(E.token_boundaries(df.filter("id = 'a'"), "p", "f", 8))["rows"] == 1
    assert [(r["id"], r["supervised_preview"]) for r in E.boundary_previews(df, "p", "f", 2).collect()] == [("a", [3]), ("b", [2, 3])]


def test_adapters_prompts_and_contracts(tmp_path):
    with pytest.raises(FileNotFoundError):
        M.adapter_sha256(tmp_path)
    (tmp_path / "sub").mkdir()
    (tmp_path / "adapter_config.json").write_text("{}")
    (tmp_path / "sub" / "w.safetensors").write_bytes(b"w")
    first = M.adapter_sha256(tmp_path)
    (tmp_path / "notes.txt").write_text("x")
    assert first == M.adapter_sha256(tmp_path)
    (tmp_path / "sub" / "w.safetensors").write_bytes(b"v")
    assert first != M.adapter_sha256(tmp_path)
    assert M.json_sha256(M.prompt_contract("1")) != M.json_sha256(M.prompt_contract("2"))
    with pytest.raises(ValueError, match="dtype"):
        M.fair_contract({f: 1 for f in M.FAIRNESS if f != "dtype"}, {})
    assert len(M.fair_contract(dict.fromkeys(M.FAIRNESS, 1), {"d": {"rows": 1}})["evaluation_contract_sha256"]) == 64


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)


def test_provenance_is_always_an_object(spark):
    df = spark.createDataFrame([(None,), ('{"a": 1}',), ("plain",), ("[1]",)], "meta string")
    assert [r[0] for r in df.select(R.meta(df)).collect()] == ["{}", '{"a": 1}', '{"raw_meta":"plain"}', '{"raw_meta":"[1]"}']
    nested = spark.sql("SELECT named_struct('a', 1) AS meta")
    assert nested.select(R.meta(nested)).first()[0] == '{"a":1}' and R.meta(spark.range(1)) is not None


def test_gates_of_evaluations(spark):
    with pytest.raises(ValueError, match="no predictions"):
        E.required_summary(spark.createDataFrame([], "dataset string, protocol string"))
    lengths = spark.createDataFrame([("a", 3), ("a", 9), ("b", 2)], "g string, v int")
    assert {r["g"]: r["overlong"] for r in E.assert_input_lengths(E.input_lengths(lengths, "v", 9, ["g"]))} == {"a": 0, "b": 0}
    with pytest.raises(ValueError, match="over the limit"):
        E.assert_input_lengths(E.input_lengths(lengths, "v", 8, ["g"]))
    assert (E.training_steps(33, 16), E.training_steps(32, 16, 1.5), E.training_steps(19_147, 16)) == (3, 3, 1197)


def test_runtime(spark, tmp_path):
    from siltstone.sources import runtime

    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert runtime.root_of(tmp_path / "a" / "b") == tmp_path
    taken = runtime.snapshot(spark, tmp_path)
    assert taken["git"] == {"commit": None, "dirty": None} and taken["spark"] == spark.version
    with pytest.raises(ValueError, match="repository"):
        runtime.require(taken)
    with pytest.raises(ValueError, match="disk"):
        runtime.require(taken, clean_git=False, free_disk_gb=1e9)
    assert runtime.valid_run_id(runtime.run_id("base")).startswith("base-")
    for bad in ("", "../x", "a/b", "a..b"):
        with pytest.raises(ValueError):
            runtime.valid_run_id(bad)


def test_command_line(spark, tmp_path, capsys):
    from siltstone import __main__ as cli

    (tmp_path / "f").write_text("x")
    cli.main(["inventory", str(tmp_path)])
    assert json.loads(capsys.readouterr().out)["files"] == 1
    cli.main(["steps", "33", "16"])
    assert json.loads(capsys.readouterr().out) == {"steps": 3}
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
