"""Streams that stop and start again against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import curation as C
from siltstone.streaming import incremental

SCHEMA = "id long, source string, text string"


def batch(first, n, texts, seed):
    rng = random.Random(seed)
    return [(first + k, f"s{k % 3}", rng.choice(texts)) for k in range(n)]


@pytest.mark.parametrize("files_at_a_time", [1, 10])
def test_a_restarted_stream_gives_the_rows_of_the_batch(spark, tmp_path, files_at_a_time):
    texts = [f"Text number {k}" for k in range(25)] + ["TEXT number 3!", "text, Number 4", "", "?", None, "none"]
    parts = [batch(0, 40, texts, 1), batch(40, 40, texts, 2), batch(80, 30, texts + ["new one"], 3)]
    parts[1] += parts[1][-1:]  # a repeated row
    where, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_a_time).parquet(where)
        incremental.curated(stream, out, check).awaitTermination(180)

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(where)
        if k != 1:  # the second part meets the third in one run
            go()
    go()  # nothing new
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    read = lambda what, *columns: sorted(map(tuple, spark.read.parquet(f"{out}/{what}").select(*columns).collect()), key=str)
    assert read("retained", "id", "source", "text") == sorted(map(tuple, C.retained(whole).collect()), key=str)
    assert read("lineage", "audit", "id", "decision", "reference_id") == sorted(map(tuple, C.lineage(whole, "stream").select("audit", "id", "decision", "reference_id").collect()), key=str)


def test_traced_rows_of_odd_ids(spark, tmp_path):
    rows = [(None, "s", "A"), (5, "s", "a."), (4, "s", "b"), (4, "s", "b")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.traced(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("traced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("traced").select("id", "text", "reference_id").collect()), key=str)
    assert got == sorted([(None, "A", None), (5, None, None), (4, "b", None), (4, None, 4)], key=str)
    assert spark.table("traced").filter(F.col("text").isNotNull()).count() == 2
