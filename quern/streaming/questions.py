"""An extension: a stream of questions against a fixed index, answered batch by batch.

Answering is stateless, so no watermark is needed; each micro-batch is written once by its batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes ``answer(batch)`` to a folder per batch, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recent_questions(history: DataFrame, n: int = 40) -> DataFrame:
    """The n questions asked last, each once. history: question, asked_at."""
    return history.groupBy("question").agg(F.max("asked_at").alias("asked_at")).orderBy(F.desc("asked_at"), "question").limit(n)
