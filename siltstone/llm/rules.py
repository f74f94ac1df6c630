"""Quality rules as a ledger of failure bits and measurements. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .native import GAP, let, lines, total, trimmed, words

#: Rules in the order of their bits: name, and when a document fails, from the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("upper_case", "2 * n_upper > word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: the bits of which any rejects a document.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["exclamations"],
    "v2": (1 << len(RULES)) - 1,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_upper")


def _repeats(w: Column) -> Column:
    """How many words are in windows of three that the text has twice or more.

    Windows become 64-bit hashes; sorted with their places, equal ones are neighbours. Linear but for the sort.
    """
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def places(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return total(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long")))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(ordered, places), covered))

    return let(hashes, count)


def measure(text: Column) -> Column:
    """All measurements of a text as one struct."""

    def without(t: Column, chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")

    def of(t: Column) -> Column:
        full = F.filter(lines(t), lambda s: F.length(trimmed(s)) > 0)
        per_line = let(full, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        per_word = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeats(w).alias("repeats")))
        return let(per_line, lambda a: let(per_word, lambda b: F.struct(
            b["n"].alias("n_words"), b["chars"].alias("word_chars"), without(t, "#*$%&|<>").alias("n_symbols"), a["n"].alias("n_lines"), a["dup"].alias("n_dup_lines"),
            b["repeats"].alias("n_repeat_words"), without(t, "!").alias("n_exclamations"), without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        )))

    return let(F.coalesce(text, F.lit("")), of)


def ledger(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents (columns in ``keep``, default all) with the measurements and ``rule_bits``: bit k is set if rule k fails.

    Every rule is evaluated once, in one projection without a shuffle; policies and ablations read the ledger only. Null and
    empty texts have no words, so they fail ``few_words``. Columns of the ledger's names, if the input has any, are replaced.
    Repeated rows all stay; a very long text is one row of its words' hashes; an empty table gives an empty ledger. A caller that applies
    several policies writes the ledger once and reads it for each.
    """
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in (*MEASURES, "rule_bits")]
    (all_,) = common.fresh(docs, "measures")
    measured = docs.select(*columns, measure(F.col(text_col)).alias(all_)).select(*columns, *(F.col(all_)[m].alias(m) for m in MEASURES))
    bits = sum((F.when(F.expr(fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, fails) in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.withColumn("rule_bits", bits)


def apply_policy(entries: DataFrame, policy: str = "v1", into: str = "kept") -> DataFrame:
    """``into``: whether a document fails none of the policy's rules."""
    return entries.withColumn(into, F.col("rule_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(entries: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that the policy rejects, and that it would keep without the rule.

    One aggregation over the bits for all of them; the rows come from unpivoting its single row.
    """
    names = policies or list(POLICIES)
    bits, one = F.col("rule_bits"), F.lit(1).cast("long")
    sums = [F.bit_or("rule_bits").alias("any_bits"), F.count(F.lit(1)).alias("n")]
    for p in names:
        sums.append(F.count_if(bits.bitwiseAND(F.lit(POLICIES[p])) != 0).alias(f"rejected_{p}"))
    for k, (rule, _) in enumerate(RULES):
        sums.append(F.sum(F.shiftright(bits, k).bitwiseAND(one)).alias(f"failed_{rule}"))
        for p in names:
            sums.append(F.count_if(bits.bitwiseAND(F.lit(POLICIES[p])) == F.lit(1 << k)).alias(f"only_{p}_{rule}"))
    row = entries.agg(*sums)
    cells = [F.struct(F.lit(p).alias("policy"), F.lit(rule).alias("rule"), F.lit(bool(POLICIES[p] >> k & 1)).alias("in_policy"), F.coalesce(F.col(f"failed_{rule}"), F.lit(0)).alias("n_failed"), F.col(f"rejected_{p}").alias("n_rejected"), F.col(f"only_{p}_{rule}").alias("n_only")) for p in names for k, (rule, _) in enumerate(RULES)]
    return row.select(F.inline(F.array(*cells)))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document; the verdict is policy v1."""
    entries = ledger(common.documents(spark, sf_dir), keep=["doc_id"])
    return apply_policy(entries, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("rule_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "rule_bits")


def _sql() -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
    FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & {BASE}) <> 0 AS base_failed, (rule_bits & {POLICIES["v1"]}) = 0 AS kept, rule_bits FROM b
"""


SQL = _sql()
