"""Incremental curation of a stream. An extension: batch semantics are those of the operators.

A stream of (id, source, text, ts) is deduplicated by normalized text, within a watermark or against all that has come before; each
micro-batch is audited against a protected set that doesn't change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import normalize
from ..operators import audit as A


def deduplicated(stream: DataFrame, *, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each normalized text within the watermark; state older than the watermark is dropped."""
    keyed = stream.withColumn("text_key", F.sha2(normalize(F.col("text"), compatibility=True), 256))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["text_key"]).drop("text_key")


def traced(stream: DataFrame, *, id_col: str = "id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Each row with ``reference_id``: null for the first of its normalized text, the first one's id for all that come later.

    The state is the first id of each text and survives restarts with the checkpoint; it is never dropped, so a copy is known however
    late it comes. Rows of one micro-batch go by ``order_col`` (default: the id) and then the id, null ids first; across micro-batches
    the earlier one is first. So a stream in that order gives what ``curation.retained`` and ``curation.lineage`` give. Null texts are the word None.
    Repeated rows after the first refer to it. Of later rows only the id is kept, other columns are null.
    """
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in stream.schema.fields), T.StructField("reference_id", stream.schema[id_col].dataType)])
    state = T.StructType([T.StructField("first", stream.schema[id_col].dataType)])
    keyed = stream.withColumn("__key", F.sha2(normalize(F.col(text_col), compatibility=True), 256))
    order = list(dict.fromkeys([order_col or id_col, id_col]))

    def place(key: tuple, parts: Iterator[pd.DataFrame], known: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable", na_position="first").drop(columns="__key")
        later = rows
        if not known.exists:
            first, later = rows.iloc[:1].copy(), rows.iloc[1:]
            value = first[id_col].iloc[0]
            known.update((None if pd.isna(value) else value.item() if hasattr(value, "item") else value,))
            first["reference_id"] = None
            yield first
        if len(later):
            out = pd.DataFrame({c: later[c] if c == id_col else None for c in rows.columns}, index=later.index)
            out["reference_id"] = known.get[0]
            yield out

    return keyed.groupBy("__key").applyInPandasWithState(place, schema, state, "append", GroupStateTimeout.NoTimeout)


def curated(stream: DataFrame, output: str, checkpoint: str, *, audit: str = "stream", id_col: str = "id", **more) -> StreamingQuery:
    """Write the first row of each text under ``output``/retained and the others' lineage under ``output``/lineage, a folder for each
    micro-batch; a repeated one replaces its own. A query that starts again from its checkpoint goes on."""
    placed = traced(stream.withColumn("__later", F.lit(False)), id_col=id_col, **more)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            first = F.col("__later").isNotNull()  # later rows keep the id alone
            batch.filter(first).drop("__later", "reference_id").write.mode("overwrite").parquet(f"{output}/retained/batch={batch_id}")
            gone = batch.filter(~first).select(F.lit(audit).alias("audit"), F.col(id_col).alias("id"), F.lit("exclude_duplicate_normalized_prompt").alias("decision"), "reference_id")
            gone.write.mode("overwrite").parquet(f"{output}/lineage/batch={batch_id}")
        finally:
            batch.unpersist()

    return placed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited(stream: DataFrame, protected: DataFrame, output: str, checkpoint: str, **more) -> StreamingQuery:
    """Write each micro-batch's audit rows under ``output``/batch=<id>; a repeated batch replaces its own folder."""

    def step(batch: DataFrame, batch_id: int) -> None:
        A.promote(A.audit(batch.select("id", "source", "text"), protected, **more)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
