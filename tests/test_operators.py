"""The reference system's own test cases and what they leave out."""

import json
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from siltstone.functions import answers
from siltstone.functions import statistics as S
from siltstone.functions import text as T
from siltstone.operators import audit as A
from siltstone.operators import curation as C
from siltstone.operators import evaluation as E
from siltstone.operators import manifests as M
from siltstone.operators import records as R
from siltstone.sources import tables

RECORD = "id string, source string, text string"
OPTIONS = "array<struct<key:string,value:string>>"


def audit_rows(spark, queries, references, **more):
    q = spark.createDataFrame([(f"q{i}", "q", t) for i, t in enumerate(queries)], RECORD)
    r = spark.createDataFrame([(f"r{i}", "r", t) for i, t in enumerate(references)], RECORD)
    return A.promote(A.audit(q, r, **more)).orderBy("query_id").collect()


def test_variants_are_equal(spark):
    a, b = "What is the first-line therapy for acute bacterial meningitis in adults?", "WHAT is the first line therapy for acute bacterial meningitis in adults"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.normalize(F.col("a")).alias("a"), T.normalize(F.col("b")).alias("b")).select(F.col("a") == F.col("b"), T.shares_span(F.col("a"), F.col("b"), 32), T.jaccard(T.char_ngrams(F.col("a")), T.char_ngrams(F.col("b")))).first()
    assert tuple(row) == (True, True, 1.0)


def test_audit_decisions(spark):
    assert audit_rows(spark, ["What is the treatment for bacterial meningitis?"], ["What is the treatment for bacterial meningitis?"])[0]["decision"] == "exclude_exact"
    clean = audit_rows(spark, ["Which drug reverses atropine toxicity?"], ["How is an open tibial fracture managed?"], review=0.95, exclude=0.99)
    assert clean[0]["decision"] == "clean"
    close = audit_rows(spark, ["What is the earliest manifestation of Cushing syndrome?"], ["Which is the earliest manifestation of Cushing syndrome?"], review=0.50, exclude=0.99)
    assert close[0]["decision"] == "exclude_fuzzy_conservative"


def test_audit_empty_sides_and_blocks(spark):
    empty = spark.createDataFrame([], RECORD)
    some = spark.createDataFrame([("a", "s", "text of a query")], RECORD)
    assert A.audit(empty, some).count() == 0
    assert A.audit(some, empty).first()["decision"] == "clean"
    refs = spark.createDataFrame([(f"r{i}", "r", f"alpha beta gamma number {i}") for i in range(9)], RECORD)
    q = spark.createDataFrame([("q", "q", "alpha beta gamma number 7")], RECORD)
    one, many = (A.neighbours(q, refs, block=b).first()["candidates"] for b in (100, 2))
    assert one[0]["reference_id"] == many[0]["reference_id"] == "r7" and [round(c["cosine"], 9) for c in one] == [round(c["cosine"], 9) for c in many]


def test_compatibility_forms_are_equal(spark):
    plain = "caf\u00e9 of\u00fcr fine first-line therapy of acute bacterial meningitis in adults and in small children"
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in plain)
    forms = [plain, wide, unicodedata.normalize("NFD", plain), plain.replace("fi", "\ufb01")]
    r = spark.createDataFrame([("r", "r", plain)], RECORD)
    q = spark.createDataFrame([(f"q{i}", "q", t) for i, t in enumerate(forms)] + [("n", "q", None)], RECORD)
    assert sorted(x["query_id"] for x in A.exact_matches(q, r).collect()) == sorted(x["query_id"] for x in A.spans_everywhere(q, r).collect()) == ["q0", "q1", "q2", "q3"]
    near = audit_rows(spark, [t + " today" for t in forms], [plain])
    assert [(round(x["tfidf_cosine"], 9), x["decision"]) for x in near] == [(round(near[0]["tfidf_cosine"], 9), near[0]["decision"])] * 4 and near[0]["decision"] != "clean"
    assert [x["id"] for x in C.retained(q).orderBy("id").collect()] == ["n", "q0"] and C.duplicate_count(q).first()[0] == 3


def test_spans_everywhere_finds_unaligned_spans(spark):
    shared = "".join(chr(97 + (i * i + 3 * i) % 26) for i in range(64))
    q = spark.createDataFrame([("a", "s", "x" * 17 + shared + "tail"), ("b", "s", "x" * 17 + shared[:63] + "0")], RECORD)
    r = spark.createDataFrame([("p", "s", "zz" + shared + "qq")], RECORD)
    assert [tuple(x) for x in A.spans_everywhere(q, r).collect()] == [("a", "p")]


def test_dedup_keeps_first_with_lineage(spark):
    df = spark.createDataFrame([(1, "What is first-line therapy?"), (2, "WHAT is first line therapy!"), (3, "different")], "id long, text string")
    assert [r["id"] for r in C.retained(df).orderBy("id").collect()] == [1, 3]
    assert [tuple(r) for r in C.lineage(df, "a").collect()] == [("a", 2, "exclude_duplicate_normalized_prompt", 1)]


def test_split(spark):
    df = spark.range(10).withColumnRenamed("id", "id")
    a = {r["id"] for r in C.split(df, ratio=0.2).filter("split = 'dev'").collect()}
    b = {r["id"] for r in C.split(df.repartition(5), ratio=0.2).filter("split = 'dev'").collect()}
    assert len(a) == 2 and a == b
    assert C.split(df, ratio=0.0).filter("split = 'dev'").count() == 0
    with pytest.raises(ValueError):
        C.split(df, ratio=1.0)


def test_length_summary_and_percentiles(spark):
    row = E.length_summary(spark.range(1, 101).withColumnRenamed("id", "v"), "v").first()
    assert row.asDict() == {"min": 1, "mean": 50.5, "p50": 51, "p95": 96, "p99": 100, "max": 100}
    assert E.length_summary(spark.range(0).withColumnRenamed("id", "v"), "v").first()["p95"] == 0
    assert S.rank_percentiles(spark.range(1, 101).withColumnRenamed("id", "v"), "v", {"p": 0.5}, half_even=True).first()["p"] == 51
    assert S.rank_percentiles(spark.range(1, 7).withColumnRenamed("id", "v"), "v", {"p": 0.5}, half_even=True).first()["p"] == 3


def test_sft_messages(spark):
    row = R.normalize_sft(spark.createDataFrame([("1", "s", " q ", "r", "a", "TRAIN")], "id string, source string, question string, reasoning string, response string, split string")).first()
    assert row["messages"][0]["content"] == "q" and row["messages"][1]["content"] == "## Thinking\nr\n\n## Final Response\na" and row["split"] == "train"


def test_validation_messages(spark):
    mcq = spark.createDataFrame([("1", "s", "q", [("A", "x"), ("B", "y")], "C", "test")], f"id string, source string, question string, options {OPTIONS}, answer string, split string")
    assert R.validate_mcq(mcq).first()["errors"] == ["answer 'C' is not in options: A, B"]
    rl = spark.createDataFrame([("1", "s", "p", "", "train")], "id string, source string, prompt string, ground_truth_answer string, split string")
    assert R.validate_rl(rl).first()["errors"] == ["ground_truth_answer must be a non-empty string"]
    with pytest.raises(Exception, match="invalid RL sample 1"):
        R.strict(R.validate_rl(rl), "RL").collect()


def test_option_shapes_and_colliding_keys(spark):
    df = spark.createDataFrame([({"A": "x", "B": "y"}, ["A", "B"], ["x", "y"], [("A", "x"), ("B", "y"), ("C", None)])], "m map<string,string>, l array<string>, t array<string>, i array<struct<key:string,value:string>>")
    row = df.select(R.options_from_map(F.col("m")).alias("m"), R.options_from_lists(F.col("l"), F.col("t")).alias("l"), R.options_from_items(F.col("i")).alias("i")).first()
    assert row["m"] == row["l"] == row["i"]
    twice = spark.createDataFrame([([("a", "1"), ("B", "x"), (" A", "2"), (" ", "z")],)], f"o {OPTIONS}").select(R.normalize_options(F.col("o")).alias("o")).first()["o"]
    assert [tuple(o) for o in twice] == [("A", "2"), ("B", "x")]


def test_converters(spark):
    letters = spark.createDataFrame([(1, "", "q", "a", "b", "c", "d", 2)], "row_index long, id string, question string, opa string, opb string, opc string, opd string, cop int")
    row = R.from_lettered_columns(letters, prefix="p", source="s").first()
    assert (row["id"], row["answer"], row["answer_text"]) == ("p_000001", "C", "c")
    with pytest.raises(Exception, match="invalid cop=7"):
        R.from_lettered_columns(letters.withColumn("cop", F.lit(7)), prefix="p", source="s").collect()
    abstract = spark.createDataFrame([(1, 5, "q?", ["c1", "c2"], "Maybe", "why")], "row_index long, pubid long, question string, contexts array<string>, final_decision string, long_answer string")
    row = R.from_abstracts(abstract, source="pub").first()
    assert row["id"] == "pub_5" and row["answer"] == "C" and row["question"].startswith("Abstract context:\nc1\nc2\n\nQuestion:\nq?")


@pytest.mark.parametrize(
    ("text", "protocol", "options", "expected"),
    [
        ("## Thinking\nA is tempting\n## Final Response\nAnswer: B", "cot", "ABCD", ("B", "final_answer_marker", True)),
        (r"\boxed{C}", "direct", "ABCD", ("C", "boxed_letter", True)),
        ("(d)", "direct", "ABCD", ("D", "single_letter", True)),
        ("Answer: **B**", "direct", "ABCD", ("B", "final_answer_marker", True)),
        ("heparin", "direct", "ABCD", ("B", "exact_option_text", True)),
        ("A may work, while B may also work.", "cot", "ABCD", (None, None, False)),
        ("no", "direct", "words", ("B", "pubmed_semantic", True)),
    ],
)
def test_parse_answers(spark, text, protocol, options, expected):
    values = {"ABCD": ["aspirin", "heparin", "warfarin", "none"], "words": ["yes", "no", "maybe"]}[options]
    df = spark.createDataFrame([(text, list(zip("ABCD", values)))], f"t string, o {OPTIONS}")
    row = df.select(answers.parse(F.col("t"), F.col("o"), F.lit(protocol)).alias("r")).first()["r"]
    assert (row["parsed_answer"], row["parse_method"], row["parse_success"]) == expected


PREDICTION = "dataset string, protocol string, id string, gold_answer string, parsed_answer string, parse_method string, correct boolean, parse_success boolean, ambiguous boolean, format_valid boolean, hit_max_new_tokens boolean, completion_tokens int, prompt_tokens int, repetition_4gram_ratio double, estimated_sample_seconds double"


def test_prediction_summary(spark):
    rows = [("d", "p", "1", "A", "A", "m", True, True, False, True, False, 5, 7, 0.0, 1.0), ("d", "p", "2", "B", None, None, False, False, False, False, True, 9, 8, 0.5, 1.0)]
    s = E.prediction_summary(spark.createDataFrame(rows, PREDICTION)).first()
    assert (s["accuracy"], s["parse_success"], s["accuracy_on_parsed"], s["hit_max_new_tokens_rate"]) == (0.5, 0.5, 1.0, 0.5)
    assert 0 <= s["wilson_low"] <= 0.5 <= s["wilson_high"] <= 1 and s["macro_f1"] == 0.5


def test_paired_comparison(spark):
    schema = "dataset string, protocol string, id string, correct boolean"
    base = spark.createDataFrame([("d", "p", str(i), i < 2) for i in range(4)], schema)
    cand = spark.createDataFrame([("d", "p", str(i), i % 2 == 0) for i in range(4)], schema)
    row = E.compare(base, cand).first()
    assert [row[c] for c in ("both_correct", "baseline_only_correct", "candidate_only_correct", "both_wrong", "accuracy_delta", "mcnemar_holm_p")] == [1, 1, 1, 1, 0.0, 1.0]
    with pytest.raises(ValueError):
        E.compare(base, cand, contracts=("a", "b"))
    with pytest.raises(Exception, match="ids differ"):
        E.aligned(base, cand.filter("id <> '3'")).collect()


def test_mcnemar_and_holm(spark):
    assert S.mcnemar(0, 0) == 1.0
    n, k = 20, 3
    assert math.isclose(S.mcnemar(k, n - k), 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel_tol=1e-9)
    rows = {r["g"]: r["p_holm"] for r in S.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "g string, p double"), "p", "g").collect()}
    assert {k: round(v, 9) for k, v in rows.items()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": "é", "n": null}\n')
    from pyspark.sql import types as Ty

    schema = Ty.StructType([Ty.StructField("id", Ty.StringType()), Ty.StructField("n", Ty.LongType())])
    rows = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema).orderBy("line").collect()
    assert [(r["line"], r["id"], r["n"]) for r in rows] == [(1, "1", 2), (3, "é", None)]
    with pytest.raises(Exception, match="not a JSON object"):
        tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, blanks="error").collect()
    assert tables.write_jsonl(spark.createDataFrame([("é", None)], "id string, n long"), str(tmp_path / "out")) == 1
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"id":"é","n":null}'


def test_fingerprints(spark, tmp_path):
    (tmp_path / "t" / "nested").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_text("alpha")
    (tmp_path / "t" / "nested" / "b.txt").write_text("beta")
    files = M.inventory(spark, str(tmp_path / "t"))
    first = M.tree_fingerprint(files)
    assert files.count() == 2 and files.agg(F.sum("bytes")).first()[0] == 9 and first == M.tree_fingerprint(M.inventory(spark, str(tmp_path / "t")))
    (tmp_path / "t" / "a.txt").write_text("other")
    assert first != M.tree_fingerprint(M.inventory(spark, str(tmp_path / "t")))
    manifest = M.file_manifest(tmp_path / "t" / "a.txt", 1, "text", [], [])
    M.verify_manifest(manifest, 1)
    with pytest.raises(ValueError):
        M.verify_manifest(manifest, 2)
    assert M.contract({"seed": 1}, {"d": {"rows": 2, "path": "/x"}}) == M.contract({"seed": 1}, {"d": {"rows": 2, "path": "/y"}})
    json.dumps(manifest)


def test_small_text_functions(spark):
    row = spark.createDataFrame([([1, 2, 3], [1, 2, 4], [5, 9, 2, 0, 0], "ab")], "a array<int>, b array<int>, c array<int>, t string").select(T.common_prefix(F.col("a"), F.col("b")), T.trim_ids(F.col("c"), 9, 0), T.trim_ids(F.col("c"), 7, 0), T.repetition_ratio(F.lit("a b c d " * 4)), T.repetition_ratio(F.lit("a b c")), T.canonical(F.lit(None)), T.char_ngrams(F.col("t"))).first()
    assert row[0] == 2 and row[1] == [5, 9] and row[2] == [5, 9, 2] and row[3] == 1 - 4 / 13 and row[4] == 0.0 and row[5] == "None" and row[6] == ["ab"]


def test_selectors():
    known = ("medqa", "medmcqa", "pubmedqa")
    assert E.select(["pubmedqa", "medqa"], known) == ("medqa", "pubmedqa") and E.select(["medqa,medmcqa"], known) == ("medqa", "medmcqa") and E.select(["all"], known) == known
    for bad in (["all", "medqa"], ["other"]):
        with pytest.raises(ValueError):
            E.select(bad, known)


def test_curation_counts_add_up(spark):
    from siltstone.plans import curation

    body = "a long shared passage about the very same subject matter that goes on for more than sixty four characters "
    first = spark.createDataFrame([("1", "f", body + "one"), ("2", "f", "unrelated words entirely"), ("3", "f", "Unrelated, words entirely!")], RECORD)
    second = spark.createDataFrame([("4", "s", "unrelated words entirely"), ("5", "s", "nothing like the others at all")], RECORD)
    protected = spark.createDataFrame([("p", "b", body + "two"), ("q", "b", "some other protected question")], RECORD)
    made = curation.curate(first, second, protected)
    counts = {r["stage"]: r["rows"] for r in made.funnel().collect()}
    assert counts == {"first_raw": 3, "first_dedup": 2, "first_clean": 1, "second_raw": 2, "second_dedup": 2, "second_without_first": 1, "second_clean": 1}
    assert {(r["id"], r["decision"]) for r in made.ledger().collect()} == {("3", "exclude_duplicate_normalized_prompt"), ("1", "exclude_common_64"), ("4", "exclude_exact")}


def test_stream(spark, tmp_path):
    from siltstone.streaming import incremental

    rows = spark.createDataFrame([("1", "s", "Same text."), ("2", "s", "same TEXT"), ("3", "s", "other")], RECORD).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    protected = spark.createDataFrame([("p", "b", "same text")], RECORD)
    stream = incremental.deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    incremental.audited(stream, protected, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["decision"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["clean", "exclude_exact"]


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4


def audit_brute(queries, references, k=3):
    """Plain dictionaries and sets: (query, reference, exact, span, cosine, jaccard) of the candidates in their order."""
    import collections
    import math
    import re
    import unicodedata

    norm = lambda t: re.sub(r"[\W_]", "", unicodedata.normalize("NFKC", t).lower())
    grams = lambda t: collections.Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))
    qs, rs = [norm(t) for t in queries], [norm(t) for t in references]
    tf = [grams(t) for t in rs]
    df, total = collections.Counter(g for c in tf for g in c), collections.Counter()
    for c in tf:
        total.update(c)
    kept = sorted((g for g in df if df[g] >= (1 if len(rs) < 20 else 2)), key=lambda g: (-total[g], g))[:200_000]
    idf = {g: math.log((1 + len(rs)) / (1 + df[g])) + 1 for g in kept}

    def unit(c):
        w = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / size for g, x in w.items()}

    parts = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t} - {""}
    vectors, out = [unit(c) for c in tf], []
    for i, q in enumerate(qs):
        u = unit(grams(q))
        cos = [round(sum(x * v.get(g, 0) for g, x in u.items()), 12) for v in vectors]
        exact = [j for j, r in enumerate(rs) if r == q]
        near = [j for j in sorted(range(len(rs)), key=lambda j: (-cos[j], j))[:k] if cos[j] > 0 and j not in exact]
        for j in [*exact, *near]:
            a, b = parts(q, 5), parts(rs[j], 5)
            out.append((f"q{i}", f"r{j}", j in exact, len(q) >= 64 and len(rs[j]) >= 64 and bool(parts(q, 64) & parts(rs[j], 64)), round(1.0 if j in exact else min(1.0, cos[j]), 9), round(len(a & b) / len(a | b), 9) if a | b else 0.0))
    return out


def test_audit_is_that_of_plain_sets(spark):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lam", "ño", "te", "ko", "ri") for b in ("na", "ß", "zu", "pe")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    references = [text(rng.randint(1, 40)) for _ in range(9)] + ["", "ab", "same text", "Same, text!"]
    queries = [text(rng.randint(1, 60)) for _ in range(20)] + [references[3].upper(), references[0] + text(5), "x" + text(4) + references[1], "", "ab", "ａｂ", "zzz qqq", "same text"]
    q = spark.createDataFrame([(f"q{i}", "s", t) for i, t in enumerate(queries)], "id string, source string, text string")
    for refs in (references[:9], references, references * 2):
        r = spark.createDataFrame([(f"r{i}", "s", t) for i, t in enumerate(refs)], "id string, source string, text string")
        expected = audit_brute(queries, refs)
        for more in ({}, {"block": 4}, {"block": 3, "per_pass": 7}):
            rows = A.neighbours(q, r, **more).select("id", "candidates").collect()
            got = [(x["id"], c["reference_id"], c["exact_match"], c["common_64_chars"], round(c["cosine"], 9), round(c["jaccard"], 9)) for x in rows for c in x["candidates"]]
            assert sorted(got) == sorted(expected)
            if not more:
                assert [g for g in got if g[0] == "q20"] == [e for e in expected if e[0] == "q20"]


def test_best_candidate_is_by_cosine_among_those_not_clean(spark):
    c = lambda span, cosine: (f"r{cosine}", False, span, cosine, 0.1)
    shape = "id string, source string, text string, candidates array<struct<reference_id:string,exact_match:boolean,common_64_chars:boolean,cosine:double,jaccard:double>>"
    found = spark.createDataFrame([("a", "s", "t", [c(True, 0.5), c(False, 0.9), c(False, 0.95)]), ("b", "s", "t", [c(False, 0.7), c(True, 0.6)]), ("c", "s", "t", [c(False, 0.3), c(False, 0.3)]), ("d", "s", "t", [])], shape)
    got = {r["query_id"]: (r["decision"], r["tfidf_cosine"]) for r in A.best(found).collect()}
    assert got == {"a": ("review", 0.95), "b": ("exclude_common_64", 0.6), "c": ("clean", 0.3), "d": ("clean", None)}


def test_running_sums_over_ranges(spark):
    from siltstone.operators.ordering import running

    rows = [(i * 7 % 50, i % 5, f"x{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, part int, before_ string")
    got = running(df, ["k"], F.col("part"), rows_per_range=9).orderBy("k").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["part"]
    assert len(got) == 50 and running(df.limit(0), ["k"]).count() == 0 and sorted(r["n"] for r in running(df, ["k"], into="n", rows_per_range=4).collect()) == list(range(50))


def test_decisions_that_do_not_add_up_raise(spark):
    bad = spark.createDataFrame([("unknown", 0.1)], "decision string, tfidf_cosine double")
    with pytest.raises(Exception, match="add up"):
        A.summary(bad).collect()


def test_blocks_of_references_are_made_once_for_many_queries(monkeypatch):
    """A block was made anew for each 256 queries as soon as there were more than four. The nearest are those of all cosines."""
    import types

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 6, 4)) for _ in range(60)]
    texts = lambda n: ["".join(rng.choice(words, rng.integers(0, 30))) for _ in range(n)]
    refs, queries = texts(100), texts(600)
    refs[90], refs[91], queries[5], queries[6] = refs[3], refs[4] + "zz", refs[3], "q" * 9
    learned = sorted({t[i : i + k] for t in refs for k in A.GRAMS for i in range(len(t) - k + 1)})
    idf = 1 + rng.random(len(learned))
    sent = types.SimpleNamespace(value=(A._hashes(learned), idf, [str(i) for i in range(100)], refs))
    made = []

    class Block(A._Block):
        def __init__(self, *given):
            made.append(1)
            super().__init__(*given)

    monkeypatch.setattr(A, "_Block", Block)
    arrow = pa.list_(pa.struct([("reference_id", pa.string()), ("exact_match", pa.bool_()), ("common_64_chars", pa.bool_()), ("cosine", pa.float64()), ("jaccard", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(queries)] * 4 + [pa.array([[]] * 600, arrow)], names=["id", "source", "text", "norm", "candidates"])
    (out,) = A._scorer(sent, 3, 10, arrow)([batch])
    assert len(made) == 10

    place = {g: i for i, g in enumerate(learned)}

    def unit(t):
        v = np.zeros(len(learned))
        for k in A.GRAMS:
            for i in range(len(t) - k + 1):
                if t[i : i + k] in place:
                    v[place[t[i : i + k]]] += 1
        v[v > 0] = (1 + np.log(v[v > 0])) * idf[v > 0]
        return v / (np.linalg.norm(v) or 1)

    cosines = np.round(np.array([unit(q) for q in queries]) @ np.array([unit(r) for r in refs]).T, 12)
    five = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t} - {""}
    for q, row, found in zip(queries, cosines, out.column(4).to_pylist()):
        same = [r for r in range(100) if refs[r] == q]
        near = [r for r in sorted(range(100), key=lambda r: (-row[r], r))[:3] if row[r] > 0 and refs[r] != q]
        assert [c["reference_id"] for c in found] == [str(r) for r in (same + near)[: max(3, len(same))]]
        for c in found:
            r = refs[int(c["reference_id"])]
            assert abs(c["cosine"] - (1 if r == q else row[int(c["reference_id"])])) < 1e-11
            assert c["common_64_chars"] == any(q[i : i + 64] in r for i in range(len(q) - 63))
            assert c["jaccard"] == (len(five(q) & five(r)) / len(five(q) | five(r)) if q or r else 0)


def test_texts_that_are_their_own_compatibility_form_stay_in_the_jvm(spark):
    """Every text that wasn't all ASCII went to Python."""
    stable = [chr(c) for c in (*range(0x80), *range(0xC0, 0x100))]
    assert all(unicodedata.normalize("NFKC", b + c) == b + c for c in stable for b in stable)
    texts = ["\u00e9t\u00e9", "\u00dfa", "e\u0301", "\u2122", "\ufb01x", "\u1100\u1161", "\u304b\u3099", "\u00bd"]
    sent = F.col("t").rlike(T.UNSTABLE[0]) | F.col("t").rlike(T.UNSTABLE[1])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t"), compatibility=True).alias("n"), sent.alias("sent")).collect()
    assert [r["sent"] for r in rows] == [False, False] + [True] * 6
    assert [r["n"] for r in rows] == [unicodedata.normalize("NFKC", t).lower().replace("\u2044", "") for t in texts]


def test_texts_of_latin_letters_are_normalized_where_they_are_compared(spark):
    """The tasks that compare texts got each of them normalized by a pattern in the JVM as well."""
    stable = "".join(chr(c) for c in (*range(0x80), *range(0xC0, 0x100)))
    texts = [stable, stable[::-1], "", " .", None, "\u00dfA\u00d7", "\u2122x", "e\u0301 \ufb01", "\u0130I", "\u00aa\u00b5", "a\u0660"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t"), compatibility=True).alias("n"), T.unsettled(F.col("t")).alias("u")).collect()
    assert [r["u"] is None for r in rows] == [True] * 6 + [False] * 5
    assert [T.plain(r["t"]) if r["u"] is None else r["u"] for r in rows] == [r["n"] for r in rows]


def test_character_ngrams_are_counted_as_they_are_listed(spark):
    """The list was made to be counted, one array a text and one string a character."""
    texts = ["", "a", "abcde", "abcdef", "aaaaaaaa", "abcabcabcabc", "\U0001f600\u4e2d" * 7, "\U0010ffff" * 6 + "abc\u0000abc", None]
    row = lambda n: spark.createDataFrame([(t,) for t in texts], "t string").select(T.ngram_count(F.col("t"), n).alias("a"), F.size(T.char_ngrams(F.coalesce("t", F.lit("")), n)).alias("b")).collect()
    for n in (1, 5, 8):
        assert all(r["a"] == r["b"] for r in row(n))


def test_postings_are_added_up_some_at_a_time(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(0, 60)))
    refs, queries = [text() for _ in range(80)], ["", *(text() for _ in range(9)), ""]
    learned = sorted({t[i : i + k] for t in refs for k in A.GRAMS for i in range(len(t) - k + 1)})
    grams = A._Grams(A._hashes(learned), np.ones(len(learned)))
    block, vectors = A._Block([A._codes(t) for t in refs], grams), A._Vectors([A._codes(t) for t in queries], grams)
    full = lambda v, n: np.array([np.bincount(v.of(i)[0], v.of(i)[1], len(learned)) for i in range(n)])
    expected, sizes, bincount = full(vectors, len(queries)) @ full(block.vectors, len(refs)).T, [], np.bincount
    monkeypatch.setattr(A.np, "bincount", lambda x, *a: (sizes.append(len(x)), bincount(x, *a))[1])
    for most in (1, 100, 1 << 16):
        monkeypatch.setattr(A, "PRODUCTS", most)
        sizes.clear()
        assert np.abs(block.screened(len(queries), *vectors.some(0, len(queries))) - expected).max() < 1e-5
        assert (len(sizes) == 1) == (most == 1 << 16), (most, len(sizes))
