"""Documents as they arrive: each id once, a status for each, and batch counts kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

SCHEMA = "file_id long, batch_id long, uploaded_at timestamp, text string"


def arriving(spark: SparkSession, folder: str, schema: str = SCHEMA, files_at_once: int = 1) -> DataFrame:
    """Parquet files of a folder in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def once(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """An id that is on its way or came within ``lateness`` is not taken again."""
    return stream.withWatermark("uploaded_at", lateness).dropDuplicatesWithinWatermark(["file_id"])


def judged(stream: DataFrame) -> DataFrame:
    """Adds status; a text that can't be used is FAILED and stops no other."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return stream.withColumn("status", F.when(text == "", "FAILED").when(~text.rlike("[0-9]"), "NEED_SUPPLEMENT").when(F.length(text) < 40, "NEED_REVIEW").otherwise("NORMAL"))


def batch_counts(judged_rows: DataFrame) -> DataFrame:
    """Counts by batch and status; for update or complete mode."""
    return judged_rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), *[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in ("NORMAL", "NEED_REVIEW", "NEED_SUPPLEMENT", "FAILED")])


def start(stream: DataFrame, out: str, checkpoint: str):
    """Append judged rows to a table; the checkpoint lets a restarted query go on where it stopped."""
    return judged(once(stream)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A file in one of these states isn't taken again; one that failed, or needs review or more papers, can be.
FINAL = ("NORMAL", "CONFIRMED")
CHANGES = "file_id long, batch_id long, attempt int, before string, status string, error string, at timestamp"


def attempts(stream: DataFrame, status: Column, error: Column) -> DataFrame:
    """Rows (file_id, batch_id, uploaded_at, ...) -> one change of state (``CHANGES``) for each attempt that is taken.

    ``status`` and ``error`` say how an attempt ends; null is a failure of its own, with its message, and no other
    file's. A file's state is kept: after a final one further attempts are passed over, else they are counted. Of
    attempts that come at once the earlier upload goes first. Works on a table as on a stream.
    """
    failed = F.coalesce(status, F.lit("FAILED"))
    message = F.when(failed == "FAILED", F.coalesce(error, F.lit("AI 처리 중 오류가 발생했습니다.")))
    rows = stream.select("file_id", "batch_id", F.col("uploaded_at").alias("at"), failed.alias("status"), message.alias("error")).filter("file_id is not null")

    def take(attempt: int, last: str | None, rows: pd.DataFrame) -> tuple[int, str | None, list[tuple]]:
        out = []
        for r in rows.sort_values(["at", "status"], na_position="first").itertuples(index=False):
            if last in FINAL:
                break
            attempt += 1
            out.append((r.file_id, r.batch_id, attempt, last, r.status, r.error, r.at))
            last = r.status
        return attempt, last, out

    names = [f.name for f in StructType.fromDDL(CHANGES)]
    if not stream.isStreaming:
        order = Window.partitionBy("file_id").orderBy("at", "status")
        ended = F.coalesce(F.max(F.col("status").isin(*FINAL)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        out = rows.withColumns({"attempt": F.row_number().over(order), "before": F.lag("status").over(order), "_ended": ended})
        return out.filter("not _ended").select(*names)

    def with_state(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, last = state.get if state.exists else (0, None)
        attempt, last, out = take(attempt, last, pd.concat(list(parts)))
        state.update((attempt, last))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("file_id").applyInPandasWithState(with_state, CHANGES, "attempt int, last string", "append", GroupStateTimeout.NoTimeout)


def rolled_up(changes: DataFrame) -> DataFrame:
    """(batch_id, files, processing, and a count for each end state) from changes: each file counts once, in its last state."""
    states = ("NORMAL", "NEED_REVIEW", "NEED_SUPPLEMENT", "FAILED")
    of = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0) - F.when(F.col("before") == s, 1).otherwise(0)).alias(s.lower())
    return changes.groupBy("batch_id").agg(F.sum(F.when(F.col("before").isNull(), 1).otherwise(0)).alias("files"), *[of(s) for s in states])


def keep_counts(changes: DataFrame, folder: str, checkpoint: str):
    """Write the batches' counts as they change (update mode): each micro-batch is a folder of its own, written over if it runs again."""

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/version={number:09d}")

    return rolled_up(changes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def counts_now(spark: SparkSession, folder: str) -> DataFrame:
    """The last counts of every batch."""
    rows = spark.read.parquet(f"{folder}/version=*")
    others = [c for c in rows.columns if c not in ("batch_id", "version")]
    return rows.groupBy("batch_id").agg(F.max_by(F.struct(*others), "version").alias("x")).select("batch_id", "x.*")
