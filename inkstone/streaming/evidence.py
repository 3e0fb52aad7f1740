"""Evidence scoring of documents as they arrive, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators import evidence as E


def score_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, lexicon: E.Lexicon, rules: E.Rules, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> StreamingQuery:
    """Scores the Parquet files that appear in ``folder`` into ``out``; each document is scored by itself, so the
    stream keeps no state. Runs until what is there is done."""
    docs = spark.readStream.schema(schema).parquet(folder)
    writer = E.scores(docs, lexicon, rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) in tumbling windows of event time; later events than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")
