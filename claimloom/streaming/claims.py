"""A stream of claims against the facts there are: the comparator as a stream-static join, an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.compare import compare


def judge(claims: DataFrame, facts: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("execution_id",)) -> StreamingQuery:
    """Write each micro-batch of claims with its labels. A batch that runs again overwrites its own files."""

    def batch(df: DataFrame, n: int) -> None:
        compare(df, facts, keys).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
