"""Sessions of speech and other events; the same expression serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verseframe.functions import fixed as K, text as T


def utterances(events: DataFrame, key: str, at: str, text: str, gap_seconds: float = K.SILENCE_SECONDS, watermark: str | None = None) -> DataFrame:
    """key, start_at, n_events, utterance of every session of events without a silence longer than the gap.

    Words come in order of time; `substantial` tells whether the session counts as speech. On a stream name a
    watermark; sessions are then emitted when it has passed them. Rows with a null key or time are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("timestamp").alias("_at"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if watermark:
        rows = rows.withWatermark("_at", watermark)
    session = F.session_window("_at", f"{int(gap_seconds * 1000)} milliseconds")
    per = rows.groupBy(key, session.alias("_s")).agg(F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_list(F.struct("_at", "_text"))).alias("_w"))
    said = F.trim(F.array_join(F.transform("_w", lambda x: x["_text"]), " "))
    return per.select(key, F.col("_s.start").alias("start_at"), "n_events", said.alias("utterance")).withColumn("substantial", T.is_substantial("utterance"))


def recent_memory(turns: DataFrame, key: str, order: str, text: str, last: int = 5) -> DataFrame:
    """turns with memory: the last entries up to and with the current one, one per line."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(last - 1), 0)
    return turns.withColumn("memory", F.array_join(F.collect_list(text).over(w), "\n"))


def merged_inputs(voice: DataFrame, keyboard: DataFrame, at: str | None = None) -> DataFrame:
    """Both inputs with source and priority: voice 0 before keyboard 1. at: a time column; `polled` then sorts the inputs
    in the order in which they are taken: by second, within one by priority, then by time."""
    both = voice.withColumns({"source": F.lit("voice"), "priority": F.lit(0)}).unionByName(keyboard.withColumns({"source": F.lit("keyboard"), "priority": F.lit(1)}), allowMissingColumns=True)
    return both if at is None else both.withColumn("polled", F.struct(F.date_trunc("second", F.col(at)).alias("second"), "priority", F.col(at).alias("at")))


def progress_rate(done: str, started: str, now: str, total: str):
    """(rate, eta_seconds) columns: items a second, and seconds left, infinite at rate 0."""
    seconds = (F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1e6
    rate = F.coalesce(F.try_divide(F.col(done).cast("double"), seconds), F.lit(0.0))
    return rate.alias("rate"), F.when(rate > 0, (F.col(total) - F.col(done)) / rate).otherwise(F.lit(float("inf"))).alias("eta_seconds")
