"""Mastery and counters over a stream of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import play
from ..sources.keyed import KeyedStore

KEYS = ["profile", "qid"]


def store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    """The state of a stream of answers: one summary per question of each profile."""
    return KeyedStore(spark, path, KEYS, buckets)


def keep(events: DataFrame, state: KeyedStore, checkpoint: str) -> None:
    """Reads all that is there: answers (profile, qid, point, ts, seq) are merged into the state, micro-batch by micro-batch in the order of their arrival.

    A batch's answers are summarised first, in any number of tasks, so a question costs one row however often it was answered; only the buckets of the batch's questions are
    read and written. With a column `removed` rows of true take their profile out, with all that was answered before; answers of the same batch come after them.
    A batch that runs again after a failure changes nothing, as its number is published with its rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            answers = batch
            if "removed" in batch.columns:
                if not batch.where("removed").isEmpty():
                    state.remove(batch.where("removed").select("profile"), ["profile"], f"{number} removed")
                answers = batch.where("removed is null or not removed")
            answers = answers.select(*KEYS, "point", F.col("ts").cast("timestamp").alias("ts"), "seq").where("qid is not null")
            state.merge(play.folded(play.summarised(answers)), "s", play.merged_summaries, f"{number} answers")
            state.compact()
        finally:
            batch.unpersist()

    events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def progress(state: KeyedStore) -> DataFrame | None:
    """Every question's state."""
    rows = state.read()
    return None if rows is None else play.states(rows)


def counters(answers: DataFrame, by: str) -> DataFrame:
    """Running answers and right answers per profile and difficulty or category; rows without one don't count."""
    rows = answers.where(F.col(by).isNotNull() & (F.col(by) != ""))
    if by == "difficulty":
        rows = rows.where(F.col(by).isin("easy", "medium", "hard"))
    return rows.groupBy("profile", by).agg(F.count("*").alias("total"), F.sum("point").alias("correct"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Reads all that is there and appends every micro-batch's rows with its number, so the last row of a key is its state."""

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
