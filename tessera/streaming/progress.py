"""Progress of running jobs: the state of each job from a stream of events, and event frames.

The state is kept by (event time, event id), so late or repeated events don't turn it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import STREAM_TOKEN
from tessera.session import own_folder, path_exists

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def current_state(events: DataFrame) -> DataFrame:
    """(user_id, event_type, ts, events): the last event of each user and how many there were."""
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")
    return events.groupBy("user_id").agg(last, F.max("ts").alias("ts"), F.count("*").alias("events"))


def stream_state(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """The same state by Structured Streaming over the files at ``path``: a stateful aggregation by user, whose changed rows each
    micro-batch appends to a table; the last row of each user is the state when the source is used up."""
    at = f"{own_folder(spark)}/progress-{uuid.uuid4().hex}"
    # as a pattern, the path may be a file or a folder of files
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    state = source.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("events"))

    def append(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{at}/state/batch={epoch}")

    changes = state.writeStream.outputMode("update").foreachBatch(append)
    changes.option("checkpointLocation", f"{at}/_offsets").trigger(availableNow=True).start().awaitTermination()
    types = state.withColumn("epoch", F.lit(0)).schema
    rows = spark.read.schema(types).option("recursiveFileLookup", "true").parquet(at + "/state") if path_exists(spark, at + "/state") else spark.createDataFrame([], types)
    now = rows.groupBy("user_id").agg(F.max_by(F.struct("last", "events"), "epoch").alias("now"))
    return now.select("user_id", "now.last.event_type", "now.last.ts", "now.events")


def answer_events(answers: DataFrame) -> DataFrame:
    """(answer_id, seq, event, data) of answers (answer_id, text, citations array of strings, score, verdict): a token event
    for each word with its blanks, then the citations, the grounding and the end."""
    token = F.transform(F.regexp_extract_all("text", F.lit(STREAM_TOKEN), 0), lambda t: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(t.alias("text"))).alias("data")))
    citation = F.transform("citations", lambda c: F.struct(F.lit("citation").alias("event"), F.to_json(F.struct(c.alias("span"))).alias("data")))
    end = F.array(
        F.struct(F.lit("grounding").alias("event"), F.to_json(F.struct("score", "verdict")).alias("data")),
        F.struct(F.lit("done").alias("event"), F.to_json(F.struct(F.size("citations").alias("total_citations"))).alias("data")),
    )
    rows = answers.select("answer_id", F.posexplode(F.concat(token, citation, end)))
    return rows.select("answer_id", F.col("pos").cast("long").alias("seq"), "col.event", "col.data")


def parse_frames(frames: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data) of raw event frames (stream_id, raw), which blank lines part."""
    rows = frames.select("stream_id", F.posexplode(F.filter(F.split("raw", "\r?\n\r?\n"), lambda x: F.trim(x) != "")))
    return rows.select("stream_id", F.col("pos").cast("long").alias("seq"), F.regexp_extract("col", r"(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract("col", r"(?m)^data: ?(.*)$", 1).alias("data"))
