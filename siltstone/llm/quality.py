"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN_ROWS = 20_000  # labelled rows that the document classifier is fitted on
THRESHOLD = 0.5
BROADCAST_SITES = 50_000  # a table of sites is broadcast up to so many rows, shuffled beyond

#: Classes of bytes whose shares describe a text.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" ", b"\n", b".", b",", b"!", b"?", b"|", b"%", b"$", b"*", b"&", b"#", b"<>{}[]()", b"=+-_/\\~^@", b"'\":;`", b"\t\r")
N_FEATURES = len(_CLASSES) + 7


def features(text: str | None) -> np.ndarray:
    """Bounded measures of a text: bias, shares of byte classes for each word, length, word length, and what repeats."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    x = np.zeros(N_FEATURES)
    x[0] = 1.0
    if not n:
        x[1] = 1.0
        return x
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    x[2] = math.log1p(n) / 10
    x[3] = min(1.0, sum(map(len, words)) / n / 20)
    x[4] = 1 - len(set(lines)) / len(lines)
    x[5] = 1 - len(set(words)) / n
    x[6] = sum(w[-1:] in b"!%$*&#|" for w in words) / n
    for k, chars in enumerate(_CLASSES):
        x[7 + k] = math.sqrt(min(4.0, counts[np.frombuffer(chars, np.uint8)].sum() / n)) / 2
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(y)) ** 0.5)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = np.abs(step).max()
        w += step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """Weights of the document classifier, from at most ``max_rows`` labelled rows chosen by a hash of their id.

    Only the sample's features come to the driver. Without labelled rows, or with labels of one kind only, the weights are those
    of a fixed prior: every text counts as good.
    """
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    sample = given.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def extract(batches):
        for batch in batches:
            c = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            xs = [features(t).astype(np.float32).tobytes() for t in c["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([c["id"], c["y"], pa.array(xs, pa.binary())], names=["id", "y", "x"])

    found = rows.mapInArrow(extract, "id long, y int, x binary").orderBy("id", "x").limit(max_rows).collect()
    y = np.array([r["y"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return np.concatenate([[4.0], np.zeros(N_FEATURES - 1)])
    return logistic(np.stack([np.frombuffer(r["x"], np.float32).astype(float) for r in found]), y)


def evidence(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", into: str = "p_doc", keep: list[str] | None = None) -> DataFrame:
    """``into``: the document classifier's probability. Columns in ``keep`` (default all) stay; no shuffle."""
    columns = [c for c in (keep if keep is not None else docs.columns) if c != into]
    given = docs.select(*columns, *([] if text_col in columns else [text_col]))
    schema = docs.select(*columns).withColumn(into, F.lit(0.5)).schema

    def apply(batches):
        for batch in batches:
            at = {f.name: k for k, f in enumerate(batch.schema)}
            p = [1 / (1 + math.exp(-max(-35.0, min(35.0, float(features(t) @ weights))))) for t in batch.column(at[text_col]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in columns), pa.array(p, pa.float64())], names=[*columns, into])

    return given.mapInArrow(apply, schema)


def site_posteriors(p: DataFrame, *, p_col: str = "p_doc", host_col: str = "host", path_col: str = "path") -> tuple[DataFrame, float]:
    """Posterior mean quality of each (host, path), and the global mean; also the sums and prior strengths that the means come from.

    One grouped aggregation gives each path's count and sum of evidence. A host's mean shrinks to the global mean, and a path's
    mean to its host's, each with the prior strength that empirical Bayes finds by moments (between-site against within-site
    variance): sparse sites stay at the prior, large ones follow their documents.
    """
    paths = common.materialise(p.groupBy(host_col, path_col).agg(F.count(F.lit(1)).alias("n"), F.sum(p_col).alias("s"), F.sum(F.col(p_col) * F.col(p_col)).alias("q")), "paths")
    hosts = common.materialise(paths.groupBy(host_col).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq")), "hosts")
    total = hosts.agg(F.sum("hn"), F.sum("hs"), F.sum("hq"), F.count(F.lit(1)), F.sum(F.col("hn") * F.col("hn")), F.sum(F.col("hs") * F.col("hs") / F.col("hn"))).first()
    if not total[0]:
        return paths.select(host_col, path_col, F.lit(0.5).alias("host_mean"), F.lit(0.5).alias("path_mean"), "n", "s", F.col("n").alias("hn"), F.col("s").alias("hs"), F.lit(1.0).alias("host_k"), F.lit(1.0).alias("path_k")), 0.5
    mean = total[1] / total[0]
    host_k = _strength(total[0], total[3], total[4], total[5] - total[1] ** 2 / total[0], total[2] - total[5])
    inner = paths.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.col("n")), F.sum(F.col("s") * F.col("s") / F.col("n"))).first()
    path_k = _strength(total[0], inner[0] - total[3] + 1, inner[1], inner[2] - total[5], total[2] - inner[2])
    shrunk = hosts.select(host_col, "hn", "hs", ((F.col("hs") + host_k * mean) / (F.col("hn") + host_k)).alias("host_mean"))
    same = [F.col(f"a.{host_col}").eqNullSafe(F.col(f"b.{host_col}"))]
    out = paths.alias("a").join(shrunk.alias("b"), same).select(F.col(f"a.{host_col}").alias(host_col), path_col, "host_mean", ((F.col("s") + path_k * F.col("host_mean")) / (F.col("n") + path_k)).alias("path_mean"), "n", "s", "hn", "hs", F.lit(float(host_k)).alias("host_k"), F.lit(float(path_k)).alias("path_k"))
    return out, mean


def _strength(n: float, groups: float, squares: float, between: float, within: float) -> float:
    """Prior strength, in documents: the within variance over the between variance of an unbalanced one-way layout."""
    if groups < 2 or n <= groups:
        return 1e6
    w = max(1e-9, within / (n - groups))
    b = (between - (groups - 1) * w) / max(1e-9, n - squares / n)
    return float(min(1e6, max(1.0, w / b))) if b > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Documents (columns in ``keep``, default all) with p_doc, host_mean, path_mean, quality_score and quality_keep.

    The score adds the evidence of the document to its site's posterior: logit(p_doc) + logit(path_mean) - logit(global mean). The
    posterior is that of the site's other documents: a document's own evidence is taken out of its host's and its path's sums, so on a
    site of its own it meets the global mean. Null hosts and paths are sites of their own; null and empty texts are classified by their lack of words, a very long
    one by all of its words as one row. Repeated rows all stay, each the others' evidence. An empty table gives no rows; without labels everything is kept. Columns of the five names, if there are, are replaced.
    """
    own = ("p_doc", "host_mean", "path_mean", "quality_score", "quality_keep")
    weights = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    scored = common.materialise(evidence(docs, weights, text_col=text_col, keep=list(dict.fromkeys([*columns, host_col, path_col]))), "evidence")
    sites, mean = site_posteriors(scored, host_col=host_col, path_col=path_col)
    host, path, *sums = common.fresh(scored, "site_host", "site_path", "n", "s", "hn", "hs", "host_k", "path_k")
    sites = common.materialise(sites.drop("host_mean", "path_mean"), "sites").toDF(host, path, *sums)
    n, s, hn, hs, host_k, path_k = (F.col(c) for c in sums)
    others = (hs - F.col("p_doc") + host_k * mean) / (hn - 1 + host_k)
    joined = scored.join(common.checked(sites, BROADCAST_SITES), F.col(host_col).eqNullSafe(F.col(host)) & F.col(path_col).eqNullSafe(F.col(path)), "left")
    joined = joined.withColumn("host_mean", others).withColumn("path_mean", (s - F.col("p_doc") + path_k * F.col("host_mean")) / (n - 1 + path_k))
    logit = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), c))
    z = logit(inside(F.col("p_doc"))) + logit(inside(F.col("path_mean"))) - math.log(max(1e-9, mean) / max(1e-9, 1 - mean))
    score = 1 / (1 + F.exp(-z))
    return joined.select(*columns, "p_doc", "host_mean", "path_mean", score.alias("quality_score"), (score >= threshold).alias("quality_keep"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document, its source as the host and its language as the path."""
    docs = common.documents(spark, sf_dir)
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
