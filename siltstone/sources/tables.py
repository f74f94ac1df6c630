"""Tables, JSON lines and reports: reading and writing."""

from __future__ import annotations

import itertools
import json
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_counter = itertools.count()


def scan(spark: SparkSession, root: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table under a versioned root; only ``columns`` are read."""
    df = spark.read.parquet(f"{root}/{table}.parquet")
    return df.select(*columns) if columns else df


def dealt(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """A small input of fewer files than the session has cores, dealt out to all of them: a file may be one row group, and what is done
    to its texts would be one task. Larger inputs, and those of more files, stay as they are read."""
    files, cores = df._jdf.inputFiles(), df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:  # names of more files than that don't leave the JVM
        return df
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    return df.repartition(cores) if sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) <= most_bytes else df


def first_n(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows in the order of a row number or key; all for None."""
    return df if n is None else df.orderBy(order).limit(n)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, blanks: str = "skip") -> DataFrame:
    """JSON objects, one a line, with ``path`` and ``line`` (from 1) of each.

    Lines are numbered where they are read, from the counts of the parts of a file before. A line that is no object of the schema raises with its place when it is read. ``blanks``: "skip" or "error".
    """
    given = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = given.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each part of a file that a task reads
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("above"))
    lines = given.join(F.broadcast(offsets), ["path", "block"]).withColumn("line", F.col("at") - F.col("first") + F.col("above") + 1)
    blank = F.trim("value") == ""
    if blanks == "skip":
        lines = lines.filter(~blank)
    bad = F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object")))
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    wrong = blank | F.col("row").isNull() | F.col("row")["_bad"].isNotNull() | ~F.trim("value").startswith("{")
    rows = lines.withColumn("row", parsed)
    checked = rows.select("path", "line", F.when(wrong, bad).alias("_check"), *(F.col("row")[f.name].alias(f.name) for f in schema.fields))
    return checked.filter(F.col("_check").isNull()).drop("_check")


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by Spark's own reader: blank lines are skipped, and a bad line raises as the reader says it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def head(spark: SparkSession, path: str, schema: T.StructType, n: int) -> DataFrame:
    """The first ``n`` objects of a file of JSON lines; fewer raise."""
    rows = read_jsonl(spark, path, schema).orderBy("line").limit(n)
    if (have := rows.count()) < n:
        raise ValueError(f"{path}: {have} rows, {n} are needed")
    return rows


def write_jsonl(df: DataFrame, path: str) -> int:
    """Rows as JSON lines, nulls and non-ASCII characters kept; the committer shows all or nothing. Gives the number of rows, from the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["rows"]


def write_report(path: str | Path, content: dict | str) -> None:
    """A JSON or text file, replaced as a whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(path.name + ".tmp")
    text = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2) + "\n"
    temporary.write_text(text, encoding="utf-8")
    os.replace(temporary, path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark knows, replaced as a whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, temporary = hadoop(path), hadoop(f"{path}.{uuid.uuid4().hex}.tmp")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(temporary, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    system.delete(target, False)
    if not system.rename(temporary, target):
        raise OSError(f"{path} can't be replaced")


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local session takes a temporary folder and keeps it in that setting; on a cluster this raises,
    since other machines would not see what one of them writes.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/siltstone-{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{next(_counter)}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that the cluster shares and read back: cuts lineage, survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and ``rows`` and other aggregates of what was written, which the write itself gives: nothing is read again.

    They are observed at the plan's root, in the tasks that write: each part counts once, whichever attempt of its task succeeds.
    """
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())), name)
    return out, seen.get


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name a column name that ``df`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def checked(small: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table as the side of a join: broadcast up to ``most`` rows, else left to a shuffle."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small
