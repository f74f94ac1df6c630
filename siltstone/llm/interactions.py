"""Audit of how filters interact: what each filter removes, in every order of all of them.

Min-plus removal ranks. A mask matrix has 0 where a text fails a filter and infinity elsewhere; a position matrix, the inverse of
each order's permutation, has the step at which a filter stands. Their min-plus product is the step at which each order removes each
text. Texts with the same failures share a row of the mask matrix, so their counts are its weights: they are scattered over order and
step by the removal step, and where a text fails a filter that stands later it is redundant there.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
MIN_WORDS = 200
NEVER = 1 << 20  # the step of what no filter removes
_STEP = 1 << 20  # bytes of a text that are split at a time
_CAPITALS = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#$%&*|"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: bytes, n_chars: int) -> int:
    """Failures of the filters that look at one text, as bits: A too few words, B few distinct ones, C capitals, D symbols."""
    n, seen, at = 0, set(), 0
    while at < len(text):  # a long text is split in steps: the words in memory are those of a step and the distinct ones
        end = _SPACE.search(text, at + _STEP) if len(text) - at > _STEP else None
        stop = end.start() if end else len(text)
        words = text[at:stop].split()
        n += len(words)
        seen.update(words)
        at = stop + 1
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text.translate(None, _SYMBOLS)) < len(text)
    return (n < MIN_WORDS) | (100 * len(seen) < 50 * n) << 1 | (100 * capitals > 3 * n_chars) << 2 | symbols << 3


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (bits of A to D) and key (128 bits of the text's hash) of each document, in one pass over the texts."""

    def measure(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            chars, raw = pc.utf8_length(texts).to_pylist(), texts.cast(pa.binary())
            masks, keys = [], []
            for n, text in zip(chars, raw):
                text = text.as_py()
                masks.append(text_failures(text, n))
                keys.append(xxhash.xxh3_128_digest(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "part", "mask", "key"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(measure, "doc_id long, part string, mask int, key binary")


def profiles(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """part, mask (bits of A to E), n, good, toxic: documents of each part and each set of failures.

    E: the text is that of a smaller id. The first id of each text is joined back by text and id, so a text of many copies is no hot key;
    the texts themselves aren't shuffled.
    """
    each = common.materialise(failures(docs, **columns), "failures")
    first = each.groupBy("key").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("toxic"))
    marked = given.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = each.join(first, ["key", "doc_id"], "left").join(marked, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    return joined.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def positions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of ``n`` filters (a row each) and, for each filter (row) and order (column), the step from 1 at which it stands."""
    orders = np.array(list(itertools.permutations(range(n))), np.int64)
    return orders, (np.argsort(orders, axis=1) + 1).T


def min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The product of two matrices with minimum for sum and sum for product."""
    return (left[:, :, None] + right[None, :, :]).min(axis=1)


def interactions(masks: np.ndarray, weights: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """Of sets of failures (bits) with three weights each (documents, good and toxic ones): arrays by order and step."""
    n = len(filters)
    orders, at = positions(n)
    fails = (masks[:, None] >> np.arange(n)) & 1
    step = np.minimum(min_plus(np.where(fails, 0, NEVER), at), n + 1)  # n + 1: kept
    lost = np.zeros((len(orders), n + 2, 3), np.int64)
    np.add.at(lost, (np.arange(len(orders))[None, :], step), weights[:, None, :])
    removed = lost[:, 1 : n + 1]
    late = step[:, :, None] < np.take_along_axis(at.T, orders, 1)[None]  # removed before the filter at each step
    redundant = np.einsum("mos,mos,m->os", late, fails[:, orders], weights[:, 0])
    alone = np.zeros(n, np.int64)
    np.add.at(alone, np.argmax(fails, axis=1), np.where(fails.sum(axis=1) == 1, weights[:, 0], 0))
    each = np.zeros(n, np.int64)
    np.add.at(each, orders, removed[:, :, 0])
    return {
        "filter_order": np.array(["".join(filters[k] for k in o) for o in orders]), "kept": weights[:, 0].sum() - np.cumsum(removed[:, :, 0], axis=1), "removed": removed[:, :, 0], "redundant": redundant,
        "unique_fails": alone[orders], "good_lost": removed[:, :, 1], "toxic_lost": removed[:, :, 2], "shapley": each[orders],
    }


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step's filter does there.

    A null or empty text has no words: it fails A and, with another such text of a smaller id, E. A null part is the empty string. A null
    id is no smaller id and never fails E, nor has it labels; rows of the same id and text are equal in this (none is smaller). An id with
    several labels counts as good or toxic if one says so. A very long text is measured in steps. An empty table gives no rows; an empty
    table of labels zeros. Extra columns are not read.
    """

    def count(table: pa.Table) -> pa.Table:
        masks = table["mask"].to_numpy().astype(np.int64)
        found = interactions(masks, np.stack([table[c].to_numpy().astype(np.int64) for c in ("n", "good", "toxic")], axis=1))
        orders, steps = found["removed"].shape
        columns = [pa.array([table["part"][0].as_py()] * (orders * steps)), pa.array(np.repeat(found.pop("filter_order"), steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), orders))]
        return pa.Table.from_arrays([*columns, *(pa.array(v.reshape(-1).astype(np.int64)) for v in found.values())], names=["part", "filter_order", "step", *found])

    return profiles(docs, labels, **columns).groupBy("part").applyInArrow(count, _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the five filters over every document of the table."""
    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH given AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, doc_id > min(doc_id) OVER (PARTITION BY text) AS copy FROM given
), failed AS (
  SELECT doc_id, part, list_filter([
    CASE WHEN len(words) < 200 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN copy THEN 'E' END], lambda f: f IS NOT NULL) AS fails FROM split
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), profile AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), run AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, fails,
    coalesce(list_min(list_transform(fails, lambda f: instr(filter_order, f))), 6) AS removal
  FROM profile, orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step, any_value(filter) AS filter, sum(CASE WHEN removal > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN removal = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(fails, filter) AND removal < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = [filter] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN removal = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN removal = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM run GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
