"""Every query by name, over the driver's tables, with its SQL where SQL can express it.

Roles: ``documents`` is the training pool (even doc_ids the first pool, odd ones the second), ``benchmark`` the protected set,
``conversations`` chat records; predictions are made from ``labels`` and ``documents`` by plain rules, with two runs that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as T
from ..functions.statistics import holm, mcnemar_exact, wilson
from ..operators import audit as A
from ..operators import curation as C
from ..operators import evaluation as E
from ..operators import manifests as M
from ..operators import records as R
from ..sources.tables import dealt, first_n, scan
from . import audit_sql, curation

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_N = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_TEXT = _N.format("text")
_STRIP = r"regexp_replace({}, '^[\x1c-\x1f\s\x0b\x{{85}}\x{{a0}}]+|[\x1c-\x1f\s\x0b\x{{85}}\x{{a0}}]+$', '', 'g')"
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+|[\\p{L}\\p{N}_]')"
_RANK = "list_sort(list({0}))[CAST(ceil((count(*) - 1) * {1}::DOUBLE) AS INT) + 1]"
_HALF = "list_sort(list({0}))[CAST(round_even((count(*) - 1) * {1}::DOUBLE, 0) AS INT) + 1]"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def docs(spark, d, *columns):
    df = scan(spark, d, "documents", list(columns) or None)
    return dealt(df) if "text" in df.columns else df


def pool(spark, d, part: int | None = None) -> DataFrame:
    df = docs(spark, d, "doc_id", "text", "source")
    return df.select(F.col("doc_id").alias("id"), "source", "text") if part is None else df.filter(F.pmod("doc_id", F.lit(2)) == part).select(F.col("doc_id").alias("id"), "source", "text")


def protected(spark, d) -> DataFrame:
    return A.records(scan(spark, d, "benchmark", ["item_id", "text"]), "item_id", "text", F.lit("benchmark"))


def audit_pool(spark, d) -> DataFrame:
    return A.records(docs(spark, d, "doc_id", "text", "source"), "doc_id", "text", "source")


def chats(spark, d) -> DataFrame:
    """id, source, question (first user turn), response (last assistant turn), messages in turn order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = scan(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    users, says = F.filter("t", lambda x: x["role"] == "user"), F.filter("t", lambda x: x["role"] == "assistant")
    return grouped.select(F.col("conv_id").cast("string").alias("id"), F.lit("conversations").alias("source"), F.try_element_at(users, F.lit(1))["text"].alias("question"), F.try_element_at(says, F.lit(-1))["text"].alias("response"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


_CHATS = """chats AS (SELECT CAST(conv_id AS VARCHAR) AS id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS response,
  list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"""


def predictions(spark, d, run: int = 0) -> DataFrame:
    """Predictions for labelled documents; run 1 has another length rule."""
    joined = scan(spark, d, "labels").join(docs(spark, d, "doc_id", "lang", "source", "n_chars"), "doc_id")
    n = F.col("n_chars")
    parsed = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n > (300 if run else 500), "A").otherwise("B")
    p = joined.select(F.col("doc_id").alias("id"), F.col("lang").alias("dataset"), F.lit("direct").alias("protocol"), "source", F.when(F.col("quality") == 1, "A").otherwise("B").alias("gold_answer"), parsed.alias("parsed_answer"), "n_chars")
    return p.select("*", F.coalesce(F.col("gold_answer") == F.col("parsed_answer"), F.lit(False)).alias("correct"), F.col("parsed_answer").isNotNull().alias("parse_success"), (n % 11 == 0).alias("ambiguous"), (n % 5 != 0).alias("format_valid"), (n > 4000).alias("hit_max_new_tokens"), (n % 1000).alias("completion_tokens"), (n % 300).alias("prompt_tokens"), ((n % 100) / 200.0).alias("repetition_4gram_ratio"), (n / 1000.0).alias("estimated_sample_seconds"), F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 2 == 0, "final_answer_marker").otherwise("single_letter").alias("parse_method"))


def _p(run: int = 0) -> str:
    return f"""p{run} AS (SELECT *, coalesce(gold_answer = parsed_answer, false) AS correct, parsed_answer IS NOT NULL AS parse_success FROM (
  SELECT doc_id AS id, lang AS dataset, 'direct' AS protocol, source, n_chars, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS gold_answer,
  CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars > {300 if run else 500} THEN 'A' ELSE 'B' END AS parsed_answer,
  n_chars % 11 = 0 AS ambiguous, n_chars % 5 <> 0 AS format_valid, n_chars > 4000 AS hit_max, n_chars % 1000 AS completion_tokens, n_chars % 300 AS prompt_tokens,
  (n_chars % 100)::DOUBLE / 200 AS repetition, n_chars::DOUBLE / 1000 AS seconds,
  CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 2 = 0 THEN 'final_answer_marker' ELSE 'single_letter' END AS parse_method
  FROM labels JOIN documents USING (doc_id)))"""


# ---- scans and projections


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "lang", "source", "n_chars")


@query("first_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return first_n(docs(spark, d, "doc_id", "text"), "doc_id", 100)


@query("canonical_text", f"SELECT doc_id, coalesce({_STRIP.format('text')}, 'None') AS text FROM documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.canonical(F.col("text")).alias("text"))


@query("positional_ids", "SELECT 'doc_' || lpad(CAST(doc_id + 1 AS VARCHAR), CAST(greatest(6, length(CAST(doc_id + 1 AS VARCHAR))) AS INTEGER), '0') AS id, source FROM documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "source").select(R.positional_id("doc", F.col("doc_id") + 1).alias("id"), "source")


@query("sft_messages", "SELECT doc_id, lang AS question, '## Thinking' || chr(10) || source || chr(10) || chr(10) || '## Final Response' || chr(10) || text AS answer FROM documents")
def _(spark, d):
    made = docs(spark, d, "doc_id", "lang", "source", "text").select("doc_id", R.build_messages(F.col("lang"), F.col("source"), F.col("text")).alias("m"))
    return made.select("doc_id", F.get("m", F.lit(0))["content"].alias("question"), F.get("m", F.lit(1))["content"].alias("answer"))


def rl(spark, d):
    given = docs(spark, d, "doc_id", "source", "text", "lang").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("prompt"), F.col("lang").alias("ground_truth_answer"), F.upper(F.lit(" train ")).alias("split"))
    return R.normalize_rl(given)


@query("rl_records", f"SELECT CAST(doc_id AS VARCHAR) AS id, source, {_STRIP.format('text')} AS prompt, lang AS ground_truth_answer, 'train' AS split, '{{}}' AS meta FROM documents")
def _(spark, d):
    return rl(spark, d)


@query("validate_records", f"""SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(list_filter([
  CASE WHEN n_chars % 13 = 0 THEN 'source must be a non-empty string' END, CASE WHEN {_STRIP.format("text")} = '' THEN 'prompt must be a non-empty string' END,
  CASE WHEN n_chars % 17 = 0 THEN 'split must be one of [''dev'', ''test'', ''train'']' END, CASE WHEN n_chars % 19 = 0 THEN 'ground_truth_answer must be a non-empty string' END], lambda e: e IS NOT NULL), '; ') AS errors FROM documents""")
def _(spark, d):
    n = F.col("n_chars")
    given = docs(spark, d).select(F.col("doc_id").alias("id"), F.when(n % 13 == 0, " ").otherwise(F.col("source")).alias("source"), F.col("text").alias("prompt"), F.when(n % 19 == 0, "").otherwise(F.col("lang")).alias("ground_truth_answer"), F.when(n % 17 == 0, "other").otherwise(F.lit("Train")).alias("split"))
    return R.validate_rl(given).select(F.col("id").cast("string").alias("id"), F.array_join("errors", "; ").alias("errors"))


@query("validate_conversations", f"""WITH {_CHATS} SELECT id, array_to_string(list_filter([
  CASE WHEN question IS NOT NULL AND {_STRIP.format("question")} = '' THEN 'question must be a non-empty string' END, CASE WHEN response IS NOT NULL AND {_STRIP.format("response")} = '' THEN 'response must be a non-empty string' END,
  CASE WHEN len(messages) < 2 THEN 'messages must contain at least user and assistant messages' WHEN question IS NULL OR response IS NULL THEN 'messages must contain user and assistant roles' END], lambda e: e IS NOT NULL), '; ') AS errors FROM chats""")
def _(spark, d):
    given = chats(spark, d).withColumn("reasoning", F.lit("r")).withColumn("split", F.lit("train"))
    return R.validate_sft(given).select("id", F.array_join("errors", "; ").alias("errors"))


@query("prompt_completion", f"""WITH {_CHATS} SELECT id, CASE WHEN len(messages) <> 2 THEN 'not one user and one assistant message' WHEN NOT (messages[1].role = 'user' AND messages[2].role = 'assistant') THEN 'roles are not user, assistant'
  WHEN NOT (contains(messages[2].content, '## Thinking') AND contains(messages[2].content, '## Final Response')) THEN 'the answer lacks its headings' END AS problem, coalesce(messages[1].content, '') AS prompt, coalesce(messages[2].content, '') AS completion FROM chats""")
def _(spark, d):
    made = R.prompt_completion(chats(spark, d))
    return made.select("id", "problem", F.get("prompt", F.lit(0))["content"].alias("prompt"), F.get("completion", F.lit(0))["content"].alias("completion"))


_LETTERS = (("A", "yes"), ("B", "no"), ("C", "maybe"), ("D", "unknown"))


def options():
    return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in _LETTERS))


@query("render_prompt", "SELECT item_id, sha256('" + R.COT_INSTRUCTION + "' || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || 'C. maybe' || chr(10) || 'D. unknown') AS prompt_sha256 FROM benchmark")
def _(spark, d):
    return scan(spark, d, "benchmark").select("item_id", F.sha2(R.render_prompt(F.col("text"), options(), "cot"), 256).alias("prompt_sha256"))


@query("chat_render", f"WITH {_CHATS} SELECT id, sha256(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')) AS chat_sha256 FROM chats")
def _(spark, d):
    return chats(spark, d).select("id", F.sha2(R.render_chat(F.col("messages")), 256).alias("chat_sha256"))


# ---- text functions


@query("normalize_text", f"SELECT doc_id, {_TEXT} AS normalized FROM documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query("char_ngrams", f"""SELECT doc_id, CAST(CASE WHEN length(n) >= 5 THEN len(list_distinct(list_transform(range(1, length(n) - 3), lambda i: n[i:i + 4]))) WHEN n = '' THEN 0 ELSE 1 END AS INT) AS grams FROM (SELECT doc_id, {_TEXT} AS n FROM documents)""")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.ngram_count(T.normalize(F.col("text"))).alias("grams"))


@query("jaccard_pairs", f"""WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(n) - 3), lambda i: n[i:i + 4])) AS g FROM (SELECT item_id, {_TEXT} AS n FROM benchmark))
SELECT a.item_id, b.item_id AS other_id, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS jaccard FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def _(spark, d):
    g = scan(spark, d, "benchmark").select("item_id", T.char_ngrams(T.normalize(F.col("text"))).alias("g"))
    other = g.select(F.col("item_id").alias("other_id"), F.col("g").alias("h"))
    return g.join(other, F.col("other_id") == F.col("item_id") + 1).select("item_id", "other_id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


_SPANS = f"""w AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(n) - 62), lambda i: n[i:i + 63])) AS w FROM (SELECT doc_id AS id, {_TEXT} AS n FROM documents) WHERE length(n) >= 64),
r AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(n) - 62), lambda i: n[i:i + 63])) AS w FROM (SELECT item_id AS id, {_TEXT} AS n FROM benchmark) WHERE length(n) >= 64)"""


@query("common_span_64", f"WITH {_SPANS} SELECT DISTINCT CAST(w.id AS VARCHAR) AS query_id, CAST(r.id AS VARCHAR) AS reference_id FROM w JOIN r USING (w)")
def _(spark, d):
    return A.spans_everywhere(audit_pool(spark, d), protected(spark, d))


@query("excerpts", r"SELECT doc_id, left(trim(regexp_replace(text, '[\x1c-\x1f\s\x0b\x{85}\x{a0}]+', ' ', 'g')), 300) AS excerpt FROM documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


_COMPLETION = """CASE doc_id % 8 WHEN 0 THEN '## Thinking' || chr(10) || text || chr(10) || '## Final Response' || chr(10) || 'Answer: B' WHEN 1 THEN '\\boxed{C}' WHEN 2 THEN '(d)' WHEN 3 THEN text || ' Answer: **B**' WHEN 4 THEN 'No.' WHEN 5 THEN ' unknown ' WHEN 6 THEN text ELSE 'Answer: A. Final answer is C' END"""
_SECTIONS = f"""s AS (SELECT doc_id, {_STRIP.format("c")} AS raw FROM (SELECT doc_id, {_COMPLETION} AS c FROM documents)),
f AS (SELECT doc_id, raw, string_split(raw, '## Final Response')[-1] AS section FROM s)"""


def completion():
    t, nl = F.col("text"), F.lit("\n")
    k = F.col("doc_id") % 8
    return F.when(k == 0, F.concat(F.lit("## Thinking"), nl, t, nl, F.lit("## Final Response"), nl, F.lit("Answer: B"))).when(k == 1, r"\boxed{C}").when(k == 2, "(d)").when(k == 3, F.concat(t, F.lit(" Answer: **B**"))).when(k == 4, "No.").when(k == 5, " unknown ").when(k == 6, t).otherwise("Answer: A. Final answer is C")


@query("final_section", f"WITH {_SECTIONS} SELECT doc_id, sha256(section) AS section_sha256, raw LIKE '%## Thinking%## Final Response%' AS in_order FROM f")
def _(spark, d):
    raw = T.strip(completion())
    return docs(spark, d, "doc_id", "text").select("doc_id", F.sha2(T.final_section(raw), 256).alias("section_sha256"), T.headings_in_order(raw).alias("in_order"))


@query("format_valid", f"WITH {_SECTIONS} SELECT doc_id, raw LIKE '%## Thinking%## Final Response%' AS valid, CASE WHEN contains(raw, '## Final Response') THEN trim(section, ' ' || chr(10)) ELSE '' END AS response FROM f")
def _(spark, d):
    raw = T.strip(completion())
    return docs(spark, d, "doc_id", "text").select("doc_id", T.format_valid(raw).alias("valid"), T.final_response(raw).alias("response"))


@query("parse_answers", rf"""WITH {_SECTIONS},
m AS (SELECT doc_id, raw, section, raw LIKE '%## Thinking%## Final Response%' AS in_order,
  list_filter(list_transform(regexp_extract_all(regexp_replace(section, '[*_`]', '', 'g'), '(?i)(?:final\s+answer|answer)\s*(?:is\s*)?[:=\-]?\s*[\(\[]?([A-Za-z])[\)\]]?(?:\s|$|[.,;])', 1), lambda a: upper(a)), lambda a: a IN ('A', 'B', 'C', 'D')) AS marked,
  list_filter(list_transform(regexp_extract_all(section, '\\boxed\s*\{{\s*([A-Za-z])\s*\}}', 1), lambda a: upper(a)), lambda a: a IN ('A', 'B', 'C', 'D')) AS boxed,
  upper(regexp_extract(regexp_replace(section, '[*_`]', '', 'g'), '^\s*[\(\[]?([A-Za-z])[\)\].]?\s*$', 1)) AS lone,
  trim(regexp_replace(lower(section), '\s+', ' ', 'g'), ' :.-*`' || chr(9) || chr(10) || chr(13)) AS short FROM f),
k AS (SELECT *, CASE WHEN len(marked) > 0 THEN 'final_answer_marker' WHEN len(boxed) > 0 THEN 'boxed_letter' WHEN lone IN ('A', 'B', 'C', 'D') THEN 'single_letter' WHEN short IN ('yes', 'no', 'maybe') THEN 'pubmed_semantic' WHEN short = 'unknown' THEN 'exact_option_text' END AS parse_method FROM m)
SELECT doc_id, CASE parse_method WHEN 'final_answer_marker' THEN marked[-1] WHEN 'boxed_letter' THEN boxed[-1] WHEN 'single_letter' THEN lone WHEN 'pubmed_semantic' THEN CASE short WHEN 'yes' THEN 'A' WHEN 'no' THEN 'B' ELSE 'C' END WHEN 'exact_option_text' THEN 'D' END AS parsed_answer,
  parse_method, parse_method IS NOT NULL AS parse_success, CASE parse_method WHEN 'final_answer_marker' THEN len(list_distinct(marked)) > 1 WHEN 'boxed_letter' THEN len(list_distinct(boxed)) > 1 ELSE false END AS ambiguous,
  parse_method IS NOT NULL AND in_order AS format_valid FROM k""")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", answers.parse(completion(), options(), F.lit("cot")).alias("r")).select("doc_id", "r.*")


@query("repetition_ratio", f"""SELECT doc_id, round(CASE WHEN len(t) < 8 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(list_transform(range(1, len(t) - 2), lambda i: t[i:i + 3])))::DOUBLE / (len(t) - 3) END, 6) AS ratio FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)""")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.round(T.repetition_ratio(F.col("text")), 6).alias("ratio"))


@query("common_prefix", f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), p AS (SELECT a.doc_id, a.t AS x, b.t AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CAST(coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])) - 1, least(len(x), len(y))) AS BIGINT) AS n FROM p""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("x"))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return t.join(other, "doc_id").select("doc_id", T.common_prefix(F.col("x"), F.col("y")).alias("n"))


@query("text_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("token_lengths", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


# ---- contamination audit


@query("exact_contamination", f"SELECT CAST(doc_id AS VARCHAR) AS query_id, CAST(item_id AS VARCHAR) AS reference_id FROM (SELECT doc_id, {_TEXT} AS n FROM documents) JOIN (SELECT item_id, {_TEXT} AS n FROM benchmark) USING (n)")
def _(spark, d):
    return A.exact_matches(audit_pool(spark, d), protected(spark, d))


_VOCAB = f"""n AS (SELECT item_id, {_TEXT} AS n FROM benchmark),
g AS (SELECT item_id, gram, count(*) AS tf FROM (SELECT item_id, unnest(list_concat(list_transform(range(1, greatest(1, length(n) - 1)), lambda i: n[i:i + 2]), list_transform(range(1, greatest(1, length(n) - 2)), lambda i: n[i:i + 3]), list_transform(range(1, greatest(1, length(n) - 3)), lambda i: n[i:i + 4]))) AS gram FROM n) GROUP BY ALL),
v AS (SELECT gram, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM n)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY gram HAVING count(*) >= CASE WHEN (SELECT count(*) FROM n) < 20 THEN 1 ELSE 2 END ORDER BY sum(tf) DESC, gram LIMIT 200000)"""


@query("tfidf_vocab", f"WITH {_VOCAB} SELECT gram, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM v")
def _(spark, d):
    return A.vocabulary(protected(spark, d)).select("gram", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_topk", f"""WITH {_VOCAB},
rw AS (SELECT item_id, gram, (1 + ln(tf)) * idf AS w FROM g JOIN v USING (gram)), rn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM rw GROUP BY item_id),
q AS (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(list_transform(range(1, greatest(1, length(n) - 1)), lambda i: n[i:i + 2]), list_transform(range(1, greatest(1, length(n) - 2)), lambda i: n[i:i + 3]), list_transform(range(1, greatest(1, length(n) - 3)), lambda i: n[i:i + 4]))) AS gram FROM (SELECT doc_id, {_TEXT} AS n FROM documents)) SEMI JOIN v USING (gram) GROUP BY ALL),
qw AS (SELECT doc_id, gram, (1 + ln(tf)) * idf AS w FROM q JOIN v USING (gram)), qn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY doc_id),
s AS (SELECT doc_id, item_id, sum(qw.w * rw.w) AS dot FROM qw JOIN rw USING (gram) GROUP BY doc_id, item_id),
c AS (SELECT doc_id, dot / (qn.norm * rn.norm) AS cosine FROM s JOIN qn USING (doc_id) JOIN rn USING (item_id))
SELECT CAST(doc_id AS VARCHAR) AS query_id, CAST(rank AS BIGINT) AS rank, round(cosine, 6) AS cosine FROM (SELECT doc_id, cosine, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC) AS rank FROM c) WHERE rank <= 3""")
def _(spark, d):
    found = A.neighbours(audit_pool(spark, d), protected(spark, d)).select(F.col("id").alias("query_id"), F.posexplode("candidates").alias("at", "c"))
    return found.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.round(F.col("c")["cosine"], 6).alias("cosine"))


@query("contamination_decisions", """SELECT doc_id, CASE WHEN n_chars % 97 = 0 THEN 'exclude_exact' WHEN n_chars % 89 = 0 THEN 'exclude_common_64' WHEN (n_chars % 100)::DOUBLE / 100 >= 0.93::DOUBLE AND (n_chars % 90)::DOUBLE / 90 >= 0.5::DOUBLE THEN 'exclude_fuzzy_high'
  WHEN (n_chars % 100)::DOUBLE / 100 >= 0.82::DOUBLE OR (n_chars % 90)::DOUBLE / 90 >= 0.6::DOUBLE THEN 'review' ELSE 'clean' END AS decision FROM documents""")
def _(spark, d):
    n = F.col("n_chars")
    return docs(spark, d, "doc_id", "n_chars").select("doc_id", A.decide(n % 97 == 0, n % 89 == 0, (n % 100) / F.lit(100.0), (n % 90) / F.lit(90.0)).alias("decision"))


_AUDIT = f"""q AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, source FROM documents), r AS (SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark), {audit_sql.audit("a", "q", "r")}"""
_CASCADE = audit_sql.cascade()


@query("contamination_audit", rf"""WITH {_AUDIT} SELECT a.*, source AS query_source, left(trim(regexp_replace(text, '[\x1c-\x1f\s\x0b\x{{85}}\x{{a0}}]+', ' ', 'g')), 300) AS query_excerpt FROM a JOIN q ON q.id = a.query_id""")
def _(spark, d):
    return A.audit(audit_pool(spark, d), protected(spark, d))


@query("contamination_promoted", f"WITH {_AUDIT} SELECT query_id, reference_id, {audit_sql.promoted()} AS decision FROM a")
def _(spark, d):
    return A.promote(A.audit(audit_pool(spark, d), protected(spark, d))).select("query_id", "reference_id", "decision")


@query("contamination_summary", f"""WITH {_AUDIT}, p AS (SELECT tfidf_cosine, {audit_sql.promoted()} AS decision FROM a)
SELECT CAST(count(*) AS BIGINT) AS query_count, {", ".join(f"CAST(count(*) FILTER (decision = '{d}') AS BIGINT) AS {d}" for d in A.DECISIONS)}, coalesce(max(tfidf_cosine), 0.0::DOUBLE) AS maximum_tfidf_cosine FROM p""")
def _(spark, d):
    return A.summary(A.promote(A.audit(audit_pool(spark, d), protected(spark, d))))


# ---- deduplication, exclusion, splits

_FIRST = f"k AS (SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY {_TEXT} ORDER BY doc_id) AS kept FROM documents)"


@query("dedup_retained", f"WITH {_FIRST} SELECT doc_id AS id, source FROM k WHERE doc_id = kept")
def _(spark, d):
    return C.retained(pool(spark, d)).select("id", "source")


@query("dedup_excluded", f"WITH {_FIRST} SELECT 'documents' AS audit, doc_id AS id, 'exclude_duplicate_normalized_prompt' AS decision, kept AS reference_id FROM k WHERE doc_id <> kept")
def _(spark, d):
    return C.lineage(pool(spark, d), "documents")


@query("duplicate_count", f"SELECT CAST(count(*) - count(DISTINCT {_TEXT}) AS BIGINT) AS duplicates FROM documents")
def _(spark, d):
    return C.duplicate_count(pool(spark, d))


@query("duplicate_ids", "SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def _(spark, d):
    return C.duplicate_ids(scan(spark, d, "conversations", ["conv_id"]), "conv_id")


@query("clean_pool", f"WITH {_SPANS} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT w.id FROM w JOIN r USING (w))")
def _(spark, d):
    hits = A.span_hits(audit_pool(spark, d), protected(spark, d)).select(F.col("query_id").cast("long").alias("id"))
    return C.without(docs(spark, d, "doc_id").select(F.col("doc_id").alias("id")), hits)


@query("protected_union", "SELECT CAST(item_id AS VARCHAR) AS id, 'benchmark' AS source, text FROM benchmark UNION ALL SELECT CAST(conv_id AS VARCHAR), 'conversations', text FROM conversations WHERE role = 'user'")
def _(spark, d):
    return protected(spark, d).unionByName(A.records(scan(spark, d, "conversations").filter("role = 'user'"), "conv_id", "text", F.lit("conversations")))


def curated(spark, d) -> curation.Curated:
    text_ids = lambda df: df.withColumn("id", F.format_string("%012d", "id"))
    return curation.curate(text_ids(pool(spark, d, 0)), text_ids(pool(spark, d, 1)), protected(spark, d))


@query("exclusion_cascade", f"WITH {_CASCADE} SELECT stage, CAST(rows AS BIGINT) AS rows FROM stages")
def _(spark, d):
    return curated(spark, d).funnel()


@query("exclusion_ledger", f"WITH {_CASCADE} SELECT * FROM gone UNION ALL SELECT audit, query_id, decision, reference_id FROM hits WHERE decision LIKE 'exclude%'")
def _(spark, d):
    return curated(spark, d).ledger().select("audit", "id", "decision", "reference_id")


@query("audit_candidates", f"WITH {_CASCADE} SELECT * FROM hits")
def _(spark, d):
    return curated(spark, d).candidates().select("audit", "query_id", "reference_id", "tfidf_cosine", "char_5gram_jaccard", "decision")


@query("row_funnel", f"""WITH d AS (SELECT min(doc_id) AS id FROM documents GROUP BY {_TEXT}), e AS (SELECT doc_id AS id FROM documents WHERE {_TEXT} IN (SELECT {_TEXT} FROM benchmark)), {_SPANS}, x AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM e))
SELECT 'raw' AS stage, count(*) AS rows FROM documents UNION ALL SELECT 'dedup', count(*) FROM d UNION ALL SELECT 'without_exact', count(*) FROM x UNION ALL SELECT 'clean', count(*) FROM x WHERE id NOT IN (SELECT w.id FROM w JOIN r USING (w))""")
def _(spark, d):
    stages = curation.quick(pool(spark, d).withColumn("id", F.format_string("%012d", "id")), protected(spark, d))
    return curation.Curated({}, None, stages, None, None).funnel()


@query("train_dev_split", """SELECT doc_id AS id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.02::DOUBLE, 0)) THEN 'dev' ELSE 'train' END AS split FROM documents""")
def _(spark, d):
    return C.split(pool(spark, d), ratio=0.02).select("id", "split")


@query("inspection_sample", "SELECT lang, doc_id, CAST(rank AS INT) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents) WHERE rank <= 100")
def _(spark, d):
    return C.sample(docs(spark, d, "doc_id", "lang"), by="lang", id_col="doc_id").select("lang", "doc_id", "rank")


@query("shard_assignment", "SELECT lang, doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 64 AS BIGINT) AS shard FROM documents")
def _(spark, d):
    return C.shard(docs(spark, d, "doc_id", "lang"), "doc_id", by=["lang"])


# ---- length and schema profiles

_LENGTHS = f"CAST(min(v) AS BIGINT) AS min, round_even(avg(v), 2) AS mean, CAST({_RANK.format('v', 0.5)} AS BIGINT) AS p50, CAST({_RANK.format('v', 0.95)} AS BIGINT) AS p95, CAST({_RANK.format('v', 0.99)} AS BIGINT) AS p99, CAST(max(v) AS BIGINT) AS max"


@query("length_summary", f"SELECT lang, {_LENGTHS} FROM (SELECT lang, length(text) AS v FROM documents) GROUP BY lang")
def _(spark, d):
    return E.length_summary(docs(spark, d, "lang", "text").select("lang", F.length("text").alias("v")), "v", ["lang"])


@query("field_lengths", f"SELECT measure, {_LENGTHS}, CAST(count(*) FILTER (measure = 'tokens' AND v > 4096) AS BIGINT) AS over_4096 FROM (SELECT 'characters' AS measure, length(text) AS v FROM documents UNION ALL SELECT 'tokens', len({_TOKENS}) FROM documents) GROUP BY measure")
def _(spark, d):
    pairs = F.array(F.struct(F.lit("characters").alias("measure"), F.length("text").cast("long").alias("v")), F.struct(F.lit("tokens").alias("measure"), T.token_count(F.col("text")).alias("v")))
    each = docs(spark, d, "text").select(F.inline(pairs))
    over = each.groupBy("measure").agg(F.count_if((F.col("measure") == "tokens") & (F.col("v") > 4096)).alias("over_4096"))
    return E.length_summary(each, "v", ["measure"]).join(over, "measure")


_INVALID = "n_chars % 13 = 0 OR n_chars % 17 = 0"


@query("schema_summary", f"SELECT lang, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (NOT ({_INVALID})) AS BIGINT) AS valid_rows, CAST(count(*) FILTER ({_INVALID}) AS BIGINT) AS invalid_rows, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) FILTER ({_INVALID})[1:20], ',') AS first_errors FROM documents GROUP BY lang")
def _(spark, d):
    n = F.col("n_chars")
    given = docs(spark, d).select(F.col("doc_id").alias("id"), "lang", F.when(n % 13 == 0, "").otherwise(F.col("source")).alias("source"), F.concat(F.lit("p"), "text").alias("prompt"), F.lit("a").alias("ground_truth_answer"), F.when(n % 17 == 0, "x").otherwise(F.lit("train")).alias("split"))
    checked = R.validate_rl(given).select("id", "lang", (F.size("errors") > 0).alias("bad"))
    firsts = checked.filter("bad").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("id"))).filter("r <= 20").groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("first_errors"))
    counts = checked.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("bad")).alias("valid_rows"), F.count_if("bad").alias("invalid_rows"))
    return counts.join(firsts, "lang", "left")


@query("quality_report", f"SELECT coalesce(lang, 'total') AS dataset, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT lang || ':' || {_TEXT}) AS BIGINT) AS duplicates, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY ROLLUP (lang)")
def _(spark, d):
    keyed = docs(spark, d, "lang", "text").groupBy("lang", F.sha2(T.normalize(F.col("text")), 256).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"), F.max(F.length("text")).alias("m"))
    return keyed.rollup("lang").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("c").alias("characters"), F.max("m").cast("long").alias("longest")).withColumn("dataset", F.coalesce("lang", F.lit("total"))).drop("lang")


@query("token_audit", f"""WITH {_CHATS}, l AS (SELECT len(regexp_extract_all(lower(question), '[a-z0-9]+|[\\p{{L}}\\p{{N}}_]')) AS p, len(regexp_extract_all(lower(response), '[a-z0-9]+|[\\p{{L}}\\p{{N}}_]')) AS s FROM chats WHERE question IS NOT NULL AND response IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(min(p + s) AS BIGINT) AS min_input_tokens, round(avg(p + s), 2) AS mean_input_tokens, CAST({_HALF.format('p + s', 0.95)} AS BIGINT) AS p95_input_tokens, CAST(max(p + s) AS BIGINT) AS max_input_tokens, CAST(min(s) AS BIGINT) AS min_supervised_tokens, round(avg(s), 2) AS mean_supervised_tokens, CAST(max(s) AS BIGINT) AS max_supervised_tokens,
  CAST(count(*) FILTER (p + s > 1536) AS BIGINT) AS truncated_rows, CAST(count(*) FILTER (s <= 0) AS BIGINT) AS empty_completion_rows FROM l""")
def _(spark, d):
    from ..functions.statistics import rank_percentiles

    t = chats(spark, d).filter("question IS NOT NULL AND response IS NOT NULL").select(T.token_count(F.col("question")).alias("p"), T.token_count(F.col("response")).alias("s")).withColumn("v", F.col("p") + F.col("s"))
    base = t.agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("min_input_tokens"), F.round(F.avg("v"), 2).alias("mean_input_tokens"), F.max("v").alias("max_input_tokens"), F.min("s").alias("min_supervised_tokens"), F.round(F.avg("s"), 2).alias("mean_supervised_tokens"), F.max("s").alias("max_supervised_tokens"), F.count_if(F.col("v") > 1536).alias("truncated_rows"), F.count_if(F.col("s") <= 0).alias("empty_completion_rows"))
    return E.beside(base, rank_percentiles(t, "v", {"p95_input_tokens": 0.95}, half_even=True), [])


_BOUNDARY = "SELECT regexp_extract_all(lower(question), '[a-z0-9]+|[\\p{L}\\p{N}_]') AS p, regexp_extract_all(lower(question || right(response, 2000)), '[a-z0-9]+|[\\p{L}\\p{N}_]') AS f FROM chats WHERE question IS NOT NULL AND response IS NOT NULL"


@query("token_boundaries", f"""WITH {_CHATS}, t AS ({_BOUNDARY}), l AS (SELECT len(p) AS p, len(f) AS v, coalesce(list_min(list_filter(range(1, least(len(p), len(f)) + 1), lambda i: p[i] <> f[i])) - 1, least(len(p), len(f))) AS c FROM t)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(min(v) AS BIGINT) AS min_input_tokens, round_even(avg(v), 2) AS mean_input_tokens, CAST({_HALF.format('v', 0.95)} AS BIGINT) AS p95_input_tokens, CAST(max(v) AS BIGINT) AS max_input_tokens, CAST(min(v - c) AS BIGINT) AS min_supervised_tokens,
  round(avg(v - c), 2) AS mean_supervised_tokens, CAST(max(v - c) AS BIGINT) AS max_supervised_tokens, CAST(count(*) FILTER (v > 1536) AS BIGINT) AS truncated_rows, CAST(count(*) FILTER (v - c <= 0) AS BIGINT) AS empty_completion_rows, CAST(count(*) FILTER (c <> p) AS BIGINT) AS prefix_mismatch_rows FROM l""")
def _(spark, d):
    both = chats(spark, d).filter("question IS NOT NULL AND response IS NOT NULL")
    ids = both.select(T.tokens(F.col("question")).alias("p"), T.tokens(F.concat("question", F.right("response", F.lit(2000)))).alias("f"))
    return E.token_boundaries(ids, "p", "f", 1536)


@query("generation_diagnostics", f"""WITH {_SECTIONS}, r AS (SELECT raw LIKE '%## Thinking%## Final Response%' AS ok, contains(raw, '## Final Response') AND trim(section, ' ' || chr(10)) <> '' AS full_, length(raw) > 4000 AS hit, {_TOKENS.replace("text", "raw")} AS t FROM f),
n AS (SELECT ok, full_, hit, CASE WHEN len(t) < 8 THEN false ELSE 1 - len(list_distinct(list_transform(range(1, len(t) - 2), lambda i: t[i:i + 3])))::DOUBLE / (len(t) - 3) > 0.2::DOUBLE END AS again FROM r)
SELECT CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (again)::DOUBLE / count(*) AS abnormal_repetition_rate, count(*) FILTER (ok)::DOUBLE / count(*) AS format_compliance, count(*) FILTER (full_)::DOUBLE / count(*) AS nonempty_final_response, count(*) FILTER (hit)::DOUBLE / count(*) AS max_token_hit_rate FROM n""")
def _(spark, d):
    raw = T.strip(completion())
    r = docs(spark, d, "doc_id", "text").select(T.format_valid(raw).alias("ok"), (T.final_response(raw) != "").alias("full"), (F.length(raw) > 4000).alias("hit"), (T.repetition_ratio(raw) > E.REPEATED).alias("again"))
    share = lambda c, name: F.coalesce(F.try_divide(F.count_if(c), F.count(F.lit(1))), F.lit(0.0)).alias(name)
    return r.agg(F.count(F.lit(1)).alias("rows"), share("ok", "format_compliance"), share("full", "nonempty_final_response"), share("again", "abnormal_repetition_rate"), share("hit", "max_token_hit_rate"))


@query("input_length_audit", f"SELECT lang, CAST(count(*) AS BIGINT) AS rows, CAST(min(v) AS BIGINT) AS min, round_even(avg(v), 2) AS mean, CAST(max(v) AS BIGINT) AS max, CAST(count(*) FILTER (v > 2048) AS BIGINT) AS overlong FROM (SELECT lang, len({_TOKENS}) AS v FROM documents) GROUP BY lang")
def _(spark, d):
    v = docs(spark, d, "lang", "text").select("lang", T.token_count(F.col("text")).alias("v"))
    return E.input_lengths(v, "v", 2048, ["lang"])


# ---- predictions and comparison


@query("prediction_summary", f"""WITH {_p()}, l AS (SELECT dataset, label, count(*) FILTER (gold_answer = label AND parsed_answer = label) AS tp, count(*) AS anyc FROM (SELECT *, unnest(list_distinct(list_filter([gold_answer, parsed_answer], lambda x: x IS NOT NULL))) AS label FROM p0) GROUP BY ALL),
f AS (SELECT dataset, avg(2 * tp::DOUBLE / (anyc + tp)) AS macro_f1 FROM l GROUP BY dataset)
SELECT dataset, protocol, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (correct) AS BIGINT) AS correct, round(avg(correct::INT), 6) AS accuracy, CAST(count(*) FILTER (parse_success) AS BIGINT) AS parsed_rows, round(avg(ambiguous::INT), 6) AS ambiguous_parse_rate,
  round(coalesce(count(*) FILTER (correct)::DOUBLE / nullif(count(*) FILTER (parse_success), 0), 0), 6) AS accuracy_on_parsed, round(avg(format_valid::INT), 6) AS format_compliance, round(avg(hit_max::INT), 6) AS hit_max_new_tokens_rate,
  {_HALF.format('completion_tokens::DOUBLE', 0.5)} AS completion_p50, {_HALF.format('completion_tokens::DOUBLE', 0.95)} AS completion_p95, {_HALF.format('prompt_tokens::DOUBLE', 0.95)} AS prompt_p95, round({_HALF.format('repetition', 0.95)}, 6) AS repetition_p95,
  round(avg((repetition > 0.2::DOUBLE)::INT), 6) AS abnormal_repetition_rate, round(count(*) / sum(seconds), 6) AS estimated_examples_per_second, round(any_value(macro_f1), 6) AS macro_f1 FROM p0 JOIN f USING (dataset) GROUP BY dataset, protocol""")
def _(spark, d):
    s = E.prediction_summary(predictions(spark, d))
    rounded = ("accuracy", "ambiguous_parse_rate", "accuracy_on_parsed", "format_compliance", "hit_max_new_tokens_rate", "repetition_p95", "abnormal_repetition_rate", "estimated_examples_per_second", "macro_f1")
    return s.select("dataset", "protocol", "rows", "correct", "parsed_rows", "completion_p50", "completion_p95", "prompt_p95", *(F.round(c, 6).alias(c) for c in rounded))


@query("macro_f1", f"""WITH {_p()}, l AS (SELECT dataset, label, count(*) FILTER (gold_answer = label AND parsed_answer = label) AS tp, count(*) AS anyc FROM (SELECT *, unnest(list_distinct(list_filter([gold_answer, parsed_answer], lambda x: x IS NOT NULL))) AS label FROM p0) GROUP BY ALL)
SELECT dataset, round(avg(2 * tp::DOUBLE / (anyc + tp)), 6) AS macro_f1 FROM l GROUP BY dataset""")
def _(spark, d):
    return E.macro_f1(predictions(spark, d), ["dataset"]).select("dataset", F.round("macro_f1", 6).alias("macro_f1"))


@query("confusion_matrix", f"WITH {_p()} SELECT dataset, gold_answer || '->' || coalesce(parsed_answer, 'UNPARSED') AS cell, CAST(count(*) AS BIGINT) AS n FROM p0 GROUP BY ALL")
def _(spark, d):
    return E.confusion(predictions(spark, d), ["dataset"])


@query("parse_methods", f"WITH {_p()} SELECT dataset, coalesce(parse_method, 'None') AS parse_method, CAST(count(*) AS BIGINT) AS n FROM p0 GROUP BY ALL")
def _(spark, d):
    return E.parse_methods(predictions(spark, d), ["dataset"])


@query("subgroup_accuracy", f"WITH {_p()} SELECT dataset, source AS subgroup, CAST(count(*) AS BIGINT) AS rows, round(avg(correct::INT), 6) AS accuracy FROM p0 WHERE trim(coalesce(source, '')) <> '' GROUP BY dataset, source")
def _(spark, d):
    return E.subgroup_accuracy(predictions(spark, d), "source", ["dataset"]).withColumn("accuracy", F.round("accuracy", 6))


_Z = 1.959963984540054


@query("wilson_interval", f"""WITH {_p()}, s AS (SELECT dataset, count(*)::DOUBLE AS n, avg(correct::INT) AS p FROM p0 GROUP BY dataset), m AS (SELECT *, 1 + {_Z * _Z}::DOUBLE / n AS d, p + {_Z * _Z}::DOUBLE / (2 * n) AS c, {_Z}::DOUBLE * sqrt(p * (1 - p) / n + {_Z * _Z}::DOUBLE / (4 * n * n)) AS h FROM s)
SELECT dataset, round(greatest(0.0::DOUBLE, (c - h) / d), 6) AS low, round(least(1.0::DOUBLE, (c + h) / d), 6) AS high FROM m""")
def _(spark, d):
    s = predictions(spark, d).groupBy("dataset").agg(F.count_if("correct").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return s.select("dataset", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_PAIRED = f"""{_p(0)}, {_p(1)}, o AS (SELECT a.dataset, a.protocol, CAST(count(*) AS BIGINT) AS rows, avg(a.correct::INT) AS b, avg(c.correct::INT) AS c, CAST(count(*) FILTER (a.correct AND c.correct) AS BIGINT) AS both_correct, CAST(count(*) FILTER (a.correct AND NOT c.correct) AS BIGINT) AS baseline_only_correct,
  CAST(count(*) FILTER (NOT a.correct AND c.correct) AS BIGINT) AS candidate_only_correct, CAST(count(*) FILTER (NOT a.correct AND NOT c.correct) AS BIGINT) AS both_wrong FROM p0 a JOIN p1 c USING (id) GROUP BY ALL)"""
_MCNEMAR = """m AS (SELECT dataset, baseline_only_correct + candidate_only_correct AS n, CASE WHEN baseline_only_correct + candidate_only_correct = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(baseline_only_correct, candidate_only_correct) + 1), lambda k:
  exp(lgamma(baseline_only_correct + candidate_only_correct + 1) - lgamma(k + 1) - lgamma(baseline_only_correct + candidate_only_correct - k + 1) - (baseline_only_correct + candidate_only_correct) * ln(2.0::DOUBLE))))) END AS p FROM o)"""


@query("paired_outcomes", f"WITH {_PAIRED} SELECT dataset, protocol, rows, round(b, 6) AS baseline_accuracy, round(c, 6) AS candidate_accuracy, round(c - b, 6) AS accuracy_delta, both_correct, baseline_only_correct, candidate_only_correct, both_wrong FROM o")
def _(spark, d):
    o = E.paired_outcomes(predictions(spark, d), predictions(spark, d, 1))
    return o.select(*(F.round(c, 6).alias(c) if c.endswith(("accuracy", "delta")) else c for c in o.columns))


def tested(spark, d):
    o = E.paired_outcomes(predictions(spark, d), predictions(spark, d, 1))
    return o.select("dataset", mcnemar_exact(F.col("baseline_only_correct"), F.col("candidate_only_correct")).alias("p"))


@query("mcnemar_exact", f"WITH {_PAIRED}, {_MCNEMAR} SELECT dataset, round(p, 6) AS p FROM m")
def _(spark, d):
    return tested(spark, d).select("dataset", F.round("p", 6).alias("p"))


@query("holm_correction", f"WITH {_PAIRED}, {_MCNEMAR}, h AS (SELECT dataset, p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, dataset) + 1) * p) AS a FROM m) SELECT dataset, round(max(a) OVER (ORDER BY p, dataset ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h")
def _(spark, d):
    return holm(tested(spark, d), "p", "dataset").select("dataset", F.round("p_holm", 6).alias("p_holm"))


_LOG = "CASE WHEN {1} > 0 THEN {0} * ln({1}::DOUBLE / rows) WHEN {0} = 0 THEN 0 ELSE -1e300 END"
_INTERVAL = f"""draws AS (SELECT *, u - v AS difference, exp(lgamma(rows + 1) - lgamma(u + 1) - lgamma(v + 1) - lgamma(rows - u - v + 1) + {_LOG.format("u", "candidate_only_correct")} + {_LOG.format("v", "baseline_only_correct")}
  + {_LOG.format("(rows - u - v)", "(rows - candidate_only_correct - baseline_only_correct)")}) AS chance
  FROM (SELECT *, unnest(range(0, rows - u + 1)) AS v FROM (SELECT *, unnest(range(0, rows + 1)) AS u FROM o))),
upto AS (SELECT dataset, protocol, rows, difference, sum(sum(chance)) OVER (PARTITION BY dataset, protocol ORDER BY difference) AS cumulative FROM draws GROUP BY dataset, protocol, rows, difference),
i AS (SELECT dataset, protocol, min(difference) FILTER (cumulative >= 0.025 - 1e-9)::DOUBLE / rows AS delta_low, min(difference) FILTER (cumulative >= 0.975 - 1e-9)::DOUBLE / rows AS delta_high FROM upto GROUP BY dataset, protocol, rows)"""


@query("bootstrap_delta", f"WITH {_PAIRED}, {_INTERVAL} SELECT * FROM i")
def _(spark, d):
    return E.exact_interval(E.paired_outcomes(predictions(spark, d), predictions(spark, d, 1)))


@query("compare_runs", f"""WITH {_PAIRED}, {_MCNEMAR}, {_INTERVAL}, h AS (SELECT dataset, p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, dataset) + 1) * p) AS a FROM m)
SELECT dataset, protocol, rows, round(b, 6) AS baseline_accuracy, round(c, 6) AS candidate_accuracy, round(c - b, 6) AS accuracy_delta, both_correct, baseline_only_correct, candidate_only_correct, both_wrong, round(p, 6) AS mcnemar_exact_p, dataset || '_' || protocol AS "group",
  round(max(a) OVER (ORDER BY p, dataset ROWS UNBOUNDED PRECEDING), 6) AS mcnemar_holm_p, delta_low, delta_high FROM o JOIN h USING (dataset) JOIN i USING (dataset, protocol)""")
def _(spark, d):
    o = E.compare(predictions(spark, d), predictions(spark, d, 1))
    return o.select(*(F.round(c, 6).alias(c) if c.endswith(("accuracy", "accuracy_delta", "_p")) else c for c in o.columns))


# ---- fingerprints


@query("aggregate_fingerprint", "SELECT sha256(string_agg(lang || chr(0) || sha || chr(0) || CAST(n AS VARCHAR) || chr(10), '' ORDER BY lang)) AS fingerprint FROM (SELECT lang, count(*) AS n, sha256(CAST(sum(doc_id) AS VARCHAR)) AS sha FROM documents GROUP BY lang)")
def _(spark, d):
    files = docs(spark, d, "doc_id", "lang").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.sum("doc_id").cast("string"), 256).alias("sha256"))
    return M.aggregate_fingerprint(files)
