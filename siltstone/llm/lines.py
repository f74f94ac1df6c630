"""Line deduplication by the spread of a line over distinct sites. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .native import let, lines, trimmed, words

MIN_SITES = 10
MIN_WORDS = 3
BAND = 0.3  # sketches within this share of the threshold are counted exactly
LG_K = 12
BROADCAST_LINES = 100_000  # boilerplate lines are broadcast up to so many
NEAR_LINES = 5  # near copies of a copied text lack one of at least so many lines: a line similarity of 0.8
SALTS = 32  # parts of a hot text or set of lines, where copied texts are too many to broadcast
HOT = 1000  # beyond it, those with over a HOT-th of all rows (so under HOT of them) are


def _hash(line: Column) -> Column:
    return F.xxhash64(trimmed(line))


def _hashes(text: Column, min_words: int) -> Column:
    """Hashes of the distinct lines of a text that have words enough."""
    return F.array_distinct(F.transform(F.filter(lines(text), lambda s: F.size(words(s)) >= min_words), _hash))


def _site(site_col: str) -> Column:
    return F.coalesce(F.col(site_col).cast("string"), F.lit("\x00"))


def _set_key(hashes: Column) -> Column:
    """One number for a set of line hashes, whatever their order; xor with a line's ``_own`` takes that line out."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(_own(x)))


def _own(line: Column) -> Column:
    return F.xxhash64(line)


def copied(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Texts that are copies as a whole: hashes (text_key) of those on ``min_sites`` distinct sites, and keys (set_key) of their lines.

    The keys are those of all lines of such a text, and of all but one where it has ``NEAR_LINES`` or more; texts of fewer lines give
    none. Counts are taken map side first, so a text in a third of all rows costs a row for each task and site. Few copied texts
    are broadcast, and only their rows are hashed; beyond that one row of keys for each distinct text goes to the shuffle.
    """
    whole = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text_key"), _site(site_col).alias("site"), F.col(text_col).alias("text"))
    texts = whole.groupBy("text_key").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites).select("text_key")
    texts = common.materialise(texts, "copied")

    def variants(hashes: Column) -> Column:
        keys = let(_set_key(hashes), lambda k: F.concat(F.array(k), F.transform(hashes, lambda x: k.bitwiseXOR(_own(x)))))
        return F.when(F.size(hashes) >= NEAR_LINES, keys)

    keys = let(_hashes(F.col("text"), min_words), variants).alias("keys")
    if _few(texts):
        sets = whole.join(F.broadcast(texts), "text_key", "left_semi").select(keys)
    else:
        sets = whole.select("text_key", keys).dropDuplicates(["text_key"]).join(texts, "text_key", "left_semi")
    return texts, common.materialise(sets.select(F.explode("keys").alias("set_key")).distinct(), "copied_lines")


def _few(keys: DataFrame) -> bool:
    return keys.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES


def _flagged(rows: DataFrame, column: str, keys: DataFrame, flag: str, salt: Column) -> DataFrame:
    """``rows`` with ``flag``: whether the only column of ``keys`` has the value of ``column``. A hot value is dealt over ``SALTS`` tasks."""
    known = keys.toDF("known").withColumn(flag, F.lit(True))
    if _few(keys):
        found = rows.join(F.broadcast(known), F.col(column) == F.col("known"), "left")
    else:
        salted = known.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.join(salted, (F.col(column) == F.col("known")) & (F.pmod(salt, F.lit(SALTS)) == F.col("dealt")), "left").drop("dealt")
    return found.drop("known").withColumn(flag, F.coalesce(flag, F.lit(False)))


def spread(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, band: float = BAND) -> DataFrame:
    """Lines (64-bit hash of the trimmed line) on at least ``min_sites`` distinct sites, with the number of documents that have them.

    HyperLogLog sketches of the sites of each line merge by aggregation, map side first, so a line in a third of all documents
    costs one sketch for each task. A sketch clearly above or below the threshold decides; lines within ``band`` of it are counted
    exactly from their distinct (line, site) pairs. A null site is a site of its own.
    """
    each = docs.select(_site(site_col).alias("site"), F.explode(_hashes(F.col(text_col), min_words)).alias("line"))
    sketched = each.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count(F.lit(1)).alias("n"))
    guess = sketched.select("line", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = common.materialise(guess.filter(F.col("sites") >= min_sites * (1 - band)), "lines")
    near = likely.filter(F.col("sites") <= min_sites * (1 + band)).select("line")
    exact = each.distinct().join(near, "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("exact"))
    joined = likely.join(exact, "line", "left")
    return joined.filter(F.coalesce("exact", "sites") >= min_sites).select("line", "n")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, band: float = BAND, least_left: float = 0.0, copies_only: bool = False, counts: bool = False) -> DataFrame:
    """Documents without their cross-site lines; other columns stay as they are.

    A line goes if its trimmed text has ``min_words`` words and is on ``min_sites`` sites. ``least_left`` is off by default; a
    caller that deduplicates documents next can set it, and a text that would keep less than this share of its characters then stays
    whole for that step; with ``copies_only`` only if it is a copy, which means that its whole text is on ``min_sites`` sites, or that
    its cross-site lines are those of such a text, of whose ``NEAR_LINES`` lines or more one may lack. Null texts stay null, empty ones empty; blank lines stay. Null ids are keyed by their text; rows of equal
    id share their boilerplate lines, which changes nothing as a line is boilerplate for all documents. Repeated rows and lines all
    count and all stay or go alike. A very long text is one row of its lines' hashes. An empty table gives an empty one. Columns of any
    other name stay as they are.
    """
    boiler = common.materialise(spread(docs, text_col=text_col, site_col=site_col, min_sites=min_sites, min_words=min_words, band=band), "boilerplate")
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    doc, text_key, dropped, rest, spared = common.fresh(docs, "doc", "text_key", "dropped", "rest", "spared")
    keys = {doc: key, text_key: F.xxhash64(text_col)} if copies_only else {doc: key}
    each = docs.select(*(c.alias(name) for name, c in keys.items()), F.explode(_hashes(F.col(text_col), min_words)).alias("line"))
    found = boiler.count()
    if found <= BROADCAST_LINES:
        hits = each.join(F.broadcast(boiler.select("line")), "line")
    else:
        most = boiler.agg(F.sum("n")).first()[0] / HOT
        hot, others = boiler.filter(F.col("n") > most).select("line"), boiler.filter(F.col("n") <= most).select("line")
        hits = each.join(F.broadcast(hot), "line").unionByName(each.join(others, "line"))
    gone = hits.groupBy(*keys).agg(F.collect_set("line").alias(dropped))
    if copies_only:
        texts, sets = copied(docs, text_col=text_col, site_col=site_col, min_sites=min_sites, min_words=min_words)
        looked = gone.withColumn("set_key", _set_key(F.col(dropped)))
        looked = _flagged(looked, text_key, texts, "same", F.xxhash64(doc))
        looked = _flagged(looked, "set_key", sets, "near", F.xxhash64(doc))
        gone = looked.select(*keys, dropped, (F.col("same") | F.col("near")).alias(spared))
    joined = docs.withColumns(keys).join(gone, [*keys], "left")
    text = F.col(text_col)

    def cut(parts: Column) -> Column:
        kept = F.filter(parts, lambda s: ~(F.array_contains(dropped, _hash(s)) & (F.size(words(s)) >= min_words)))
        if not least_left:
            return kept
        sizes = lambda x: F.length(F.translate(F.array_join(x, ""), " \t\r", ""))
        cuts = lambda k: sizes(k) >= least_left * sizes(parts)
        return let(kept, lambda k: F.when(cuts(k) | ~F.col(spared) if copies_only else cuts(k), k).otherwise(parts))

    lean = joined.withColumn(rest, F.when(F.col(dropped).isNotNull(), let(lines(text), cut)))
    columns = [F.when(F.col(rest).isNotNull(), F.array_join(rest, "\n")).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines(text))).cast("long")
        columns += [n.alias("n_lines"), F.when(F.col(rest).isNotNull(), n - F.size(rest)).otherwise(F.lit(0)).cast("long").alias("n_removed")]
    return lean.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document with the digest of what is left of it."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "source")
    return dedup(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, chr(1)) AS site FROM documents),
l AS (SELECT r, site, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT r, site, string_split(text, chr(10)) AS s FROM d WHERE text IS NOT NULL)),
t AS (SELECT r, site, i, line, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} AS long_enough FROM l),
b AS (SELECT bare FROM t WHERE long_enough GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT t.*, long_enough AND b.bare IS NOT NULL AS gone FROM t LEFT JOIN b ON t.bare = b.bare),
g AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS rest FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN k > 0 THEN coalesce(rest, '') ELSE coalesce(text, '') END) AS text_sha256
FROM d LEFT JOIN g USING (r)
"""
